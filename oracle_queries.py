"""Independent SQL for the registered queries, over the same tables.

Written in the literal form wherever the library uses a closed one: loads batch
by batch with NOT EXISTS, end dates by correlated minimum, point-in-time by
cross join and correlated maximum, chunking by recursion.
"""

from __future__ import annotations

from annalake.functions.markup import MARKUP_RULES

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
MOMENT = "TIMESTAMP '2024-01-15 12:00:00'"


def sha(expression: str) -> str:
    return f"upper(sha256({expression}))"


def text(expression: str) -> str:
    return f"coalesce(CAST({expression} AS VARCHAR), '')"


# Column lists and types of the company tables and views.
PAYLOAD_TYPES = {
    "name": "VARCHAR", "subscription": "VARCHAR", "org_type": "BIGINT", "uid": "VARCHAR",
    "description": "VARCHAR", "street": "VARCHAR", "citycode": "VARCHAR", "city": "VARCHAR",
    "province": "VARCHAR", "state": "VARCHAR", "country": "BIGINT", "website": "VARCHAR",
    "email": "VARCHAR", "phone": "VARCHAR", "mobile": "VARCHAR", "mobile2": "VARCHAR",
    "fax": "VARCHAR", "bic": "VARCHAR", "iban": "VARCHAR", "credit_rating": "VARCHAR",
    "commission_fee": "VARCHAR", "employeecount": "DOUBLE", "date_created": "TIMESTAMP",
    "date_updated": "TIMESTAMP",
}
GIVEN = ("name", "subscription", "country", "credit_rating", "employeecount", "date_created", "date_updated")


def payload(prefix: str = "", columns=tuple(PAYLOAD_TYPES)) -> str:
    shown = []
    for column in columns:
        if column == "employeecount":
            shown.append(f"CAST({prefix}employeecount AS DOUBLE) AS employeecount")
        elif column in GIVEN:
            shown.append(f"{prefix}{column} AS {column}")
        else:
            shown.append(f"CAST(NULL AS {PAYLOAD_TYPES[column]}) AS {column}")
    return ", ".join(shown)


COMPANY = f"""
summary AS (
  SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total,
         first(o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS priority,
         first(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS status
  FROM orders GROUP BY o_custkey),
feed AS (
  SELECT c_custkey AS object_id, 'CLIENT' AS role_code, 'wp_company_client' AS source_table, c_name AS name,
         nullif(CAST(c_nationkey AS BIGINT), 0) AS country,
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS credit_rating,
         CAST(NULL AS DECIMAL(38,18)) AS employeecount, c_mktsegment AS subscription,
         first_order AS date_created, CAST(NULL AS TIMESTAMP) AS date_updated,
         CASE WHEN status = 'F' THEN last_order END AS exempt, 'crm' AS source, '2024-01-05 06:00:00' AS loaded, 1 AS batch
  FROM customer LEFT JOIN summary ON c_custkey = o_custkey
  UNION ALL
  SELECT c_custkey, 'CONTRACTOR', 'wp_company_contractor', c_name, nullif(CAST(c_nationkey AS BIGINT), 0),
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, 'n/a', 1
  FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL
  SELECT s_suppkey, 'SUPPLIER', 'wp_company_supplier', s_name, nullif(CAST(s_nationkey AS BIGINT), 0),
         CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,18)),
         NULL, NULL, NULL, NULL, NULL, NULL, 1
  FROM supplier
  UNION ALL
  SELECT c_custkey, 'CLIENT', 'wp_company_client', c_name,
         nullif(CAST(CASE WHEN status = 'P' THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS BIGINT), 0),
         CASE WHEN status = 'O' THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) ELSE total END, NULL,
         CASE WHEN status = 'O' THEN c_mktsegment ELSE priority END, first_order, last_order,
         CASE WHEN status = 'F' THEN last_order END, 'crm', '2024-03-01 06:30:00', 2
  FROM customer JOIN summary ON c_custkey = o_custkey),
stg AS (
  SELECT {sha(f"{text('object_id')} || '^^' || source_table")} AS hk_company,
         {sha(text('country'))} AS hk_country,
         {sha('role_code')} AS hk_role,
         {sha(f"{text('object_id')} || '^^' || source_table || '^^' || role_code")} AS hk_link_company_role,
         {sha(f"{text('object_id')} || '^^' || source_table || '^^' || {text('country')}")} AS hk_link_company_country,
         {sha(f"{text('name')} || {text('country')} || {text('credit_rating')} || {text('employeecount')} || {text('subscription')}")} AS hd_company,
         feed.*, coalesce(source, 'portal') AS dss_record_source,
         coalesce(TRY_CAST(loaded AS TIMESTAMP), {NOW}) AS dss_load_date
  FROM feed),
hub_c1 AS (SELECT DISTINCT hk_company, object_id, source_table, dss_load_date, dss_record_source FROM stg WHERE batch = 1),
hub_c AS (
  SELECT * FROM hub_c1 UNION ALL
  SELECT DISTINCT hk_company, object_id, source_table, dss_load_date, dss_record_source FROM stg s
  WHERE batch = 2 AND NOT EXISTS (SELECT 1 FROM hub_c1 h WHERE h.hk_company = s.hk_company)),
sat_c1 AS (SELECT * FROM stg WHERE batch = 1),
sat_c2 AS (
  SELECT * FROM sat_c1 UNION ALL
  SELECT * FROM stg s WHERE batch = 2
   AND NOT EXISTS (SELECT 1 FROM sat_c1 e WHERE e.hk_company = s.hk_company AND e.hd_company = s.hd_company)),
sat_c3 AS (
  SELECT s.*, (SELECT min(t.dss_load_date) FROM sat_c2 t
               WHERE t.hk_company = s.hk_company AND t.dss_load_date > s.dss_load_date) AS dss_end_date
  FROM sat_c2 s),
sat_c AS (SELECT *, CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_current FROM sat_c3),
link_r1 AS (SELECT DISTINCT hk_link_company_role, hk_company, hk_role, role_code, dss_load_date, dss_record_source FROM stg WHERE batch = 1),
link_r AS (
  SELECT * FROM link_r1 UNION ALL
  SELECT DISTINCT hk_link_company_role, hk_company, hk_role, role_code, dss_load_date, dss_record_source FROM stg s
  WHERE batch = 2 AND NOT EXISTS (SELECT 1 FROM link_r1 l WHERE l.hk_link_company_role = s.hk_link_company_role)),
link_n1 AS (
  SELECT DISTINCT hk_link_company_country, hk_company, hk_country, dss_load_date, dss_record_source
  FROM stg WHERE batch = 1 AND country IS NOT NULL),
link_n AS (
  SELECT * FROM link_n1 UNION ALL
  SELECT DISTINCT hk_link_company_country, hk_company, hk_country, dss_load_date, dss_record_source FROM stg s
  WHERE batch = 2 AND country IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM link_n1 l WHERE l.hk_link_company_country = s.hk_link_company_country)),
eff_1 AS (
  SELECT DISTINCT hk_link_company_country, hk_company, hk_country, dss_load_date AS dss_start_date, dss_record_source
  FROM stg WHERE batch = 1),
eff_2 AS (
  SELECT * FROM eff_1 UNION ALL
  SELECT DISTINCT hk_link_company_country, hk_company, hk_country, dss_load_date, dss_record_source FROM stg s
  WHERE batch = 2 AND NOT EXISTS (SELECT 1 FROM eff_1 e WHERE e.hk_link_company_country = s.hk_link_company_country)),
eff_n AS (
  SELECT e.*, (SELECT min(t.dss_start_date) FROM eff_2 t
               WHERE t.hk_company = e.hk_company AND t.dss_start_date > e.dss_start_date) AS dss_end_date
  FROM eff_2 e),
stg_n AS (
  SELECT {sha(text('n_nationkey'))} AS hk_country, {sha('n_name')} AS hd_country,
         CAST(n_nationkey AS BIGINT) AS object_id, n_name AS name, 'portal' AS dss_record_source, {NOW} AS dss_load_date
  FROM nation),
hub_n AS (SELECT hk_country, object_id, dss_load_date, dss_record_source FROM stg_n),
sat_n AS (
  SELECT hk_country, hd_country, dss_load_date, dss_record_source, name, 'Y' AS dss_is_current,
         CAST(NULL AS TIMESTAMP) AS dss_end_date
  FROM stg_n)
"""

def loads_in_turn(name: str, source: str, batches: list[str], key: str, value: str) -> str:
    """A table after each batch in turn: rows whose value isn't at the key's newest load date."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT * FROM {source} WHERE batch = {batches[0]})"]
    for i, batch in enumerate(batches[1:], 1):
        steps.append(f"""{name}_{i} AS MATERIALIZED (SELECT * FROM {name}_{i - 1} UNION ALL SELECT * FROM {source} s WHERE batch = {batch}
  AND NOT EXISTS (SELECT 1 FROM {name}_{i - 1} e WHERE e.{key} = s.{key} AND e.{value} = s.{value}
    AND e.dss_load_date = (SELECT max(n.dss_load_date) FROM {name}_{i - 1} n WHERE n.{key} = s.{key})))""")
    return ",\n".join([*steps, f"{name} AS (SELECT * FROM {name}_{len(batches) - 1})"])


def daily_loads() -> str:
    """The days of the events and a few more, one batch each."""
    return loads_in_turn("versions", "feed", [f"DATE '2024-01-01' + {i}" for i in range(35)], "hk_user", "hd_user")


EVENTS = f"""
feed AS MATERIALIZED (
  SELECT {sha(text('user_id'))} AS hk_user, {sha('event_type')} AS hk_type, CAST(user_id AS VARCHAR) AS user_code,
         {sha("CAST(user_id AS VARCHAR) || '^^' || event_type")} AS hk_link_user_type, {sha('event_type')} AS hd_user,
         event_type, value, ts AS dss_load_date, 'events' AS dss_record_source,
         CAST(ts AS DATE) AS batch
  FROM events),
{daily_loads()},
closed AS (
  SELECT v.*, (SELECT min(t.dss_load_date) FROM versions t
               WHERE t.hk_user = v.hk_user AND t.dss_load_date > v.dss_load_date) AS dss_end_date
  FROM versions v),
user_hub AS (
  SELECT DISTINCT hk_user, user_code, dss_load_date, dss_record_source FROM feed f
  WHERE batch = (SELECT min(batch) FROM feed g WHERE g.hk_user = f.hk_user)),
order_versions AS (
  SELECT {sha(text('o_custkey'))} AS hk_user, o_orderkey AS order_key, o_orderstatus AS state, o_orderdate AS dss_load_date
  FROM orders)
"""

CLOSED_COLUMNS = """hk_user, hd_user, dss_load_date, dss_record_source, event_type, CAST(value AS DOUBLE) AS value,
  CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_current, dss_end_date"""
OPEN_COLUMNS = """hk_user, hd_user, dss_load_date, dss_record_source, event_type, CAST(value AS DOUBLE) AS value,
  'Y' AS dss_is_current, CAST(NULL AS TIMESTAMP) AS dss_end_date"""

LATE = """
late_rows AS (SELECT *, batch BETWEEN DATE '2024-01-16' AND DATE '2024-01-20' AS late FROM feed),
late_state AS (
  SELECT hk_user, event_type, value, dss_load_date, late,
         CASE WHEN late THEN (SELECT min(t.dss_load_date) FROM late_rows t
                              WHERE t.hk_user = r.hk_user AND t.dss_load_date > r.dss_load_date)
              ELSE (SELECT min(t.dss_load_date) FROM late_rows t
                    WHERE NOT t.late AND t.hk_user = r.hk_user AND t.dss_load_date > r.dss_load_date) END AS end1,
         (SELECT min(t.dss_load_date) FROM late_rows t
          WHERE t.hk_user = r.hk_user AND t.dss_load_date > r.dss_load_date) AS next1
  FROM late_rows r),
late_final AS (
  SELECT hk_user, event_type, CAST(value AS DOUBLE) AS value, dss_load_date, next1,
         coalesce(end1, next1) AS dss_end_date
  FROM late_state)
"""

WS = r"[\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LINE = r"[^\n\r\x{2028}\x{2029}]"


def length16(expression: str) -> str:
    """UTF-16 code units: characters beyond the basic plane count twice."""
    return f"(length({expression}) + length(regexp_replace({expression}, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')))"


def trim16(expression: str) -> str:
    return f"regexp_replace(regexp_replace({expression}, '^{WS}+', ''), '{WS}+$', '')"


CHUNKS = f"""
paragraphs AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, par FROM (
    SELECT doc_id, unnest(parts) AS par, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, string_split_regex(text, '\\n+') AS parts FROM documents))),
packing AS (
  SELECT doc_id, pos, par AS cur, CAST(NULL AS VARCHAR) AS done FROM paragraphs WHERE pos = 1
  UNION ALL
  SELECT p.doc_id, p.pos,
    CASE WHEN k.cur <> '' AND {length16('k.cur')} + {length16('p.par')} > 500
         THEN array_to_string(list_slice(string_split_regex(k.cur, '{WS}+'), -10, -1), ' ') || chr(10) || chr(10) || p.par
         WHEN k.cur <> '' THEN k.cur || chr(10) || chr(10) || p.par
         ELSE p.par END,
    CASE WHEN k.cur <> '' AND {length16('k.cur')} + {length16('p.par')} > 500 THEN {trim16('k.cur')} END
  FROM packing k JOIN paragraphs p ON p.doc_id = k.doc_id AND p.pos = k.pos + 1),
chunked AS (
  SELECT doc_id, pos, done AS content FROM packing WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, pos + 1, {trim16('cur')} FROM packing
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1),
chunk_rows AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, content
  FROM chunked WHERE content <> '')
"""
CHUNKS = CHUNKS.replace("paragraphs AS (", "paragraphs AS MATERIALIZED (", 1)

HEADER = f"#{{1,6}}{WS}+{LINE}+"
START = r"(?:^|[\n\r\x{2028}\x{2029}])"


def titles(expression: str) -> str:
    """Header titles in a text, as a list."""
    found = f"regexp_extract_all({expression}, '{START}({HEADER})', 1)"
    return f"list_transform({found}, lambda h: regexp_replace(h, '^#+{WS}+', ''))"


SIMILAR = """
means AS (
  SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos),
queries AS (SELECT label AS query_id, list(x ORDER BY pos) AS q FROM means GROUP BY label),
scored AS (
  SELECT query_id, vec_id, round(raw, 9) AS s, raw
  FROM (SELECT query_id, vec_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS raw FROM queries CROSS JOIN embeddings))
"""


def ranked(k: int, threshold: float | None) -> str:
    bound = "" if threshold is None else f"WHERE raw >= {threshold}"
    return f"""SELECT query_id, vec_id, round(s, 6) AS similarity,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank
      FROM scored {bound} QUALIFY rank <= {k}"""


EDGES = """
edges AS (
  SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)
"""

HUB_COLUMNS = "hk_company, object_id, source_table, dss_load_date, dss_record_source"
SAT_COLUMNS = f"""hk_company, hd_company, dss_load_date, dss_record_source, {payload()}, dss_is_current, dss_end_date"""


def company_view(columns, tail: str = "") -> str:
    return f"""WITH {COMPANY}
SELECT h.hk_company, h.object_id, {payload('s.', columns)}, h.dss_load_date AS hub_load_date
FROM hub_c h LEFT JOIN sat_c s ON h.hk_company = s.hk_company AND s.dss_is_current = 'Y'
WHERE h.object_id > 0 {tail}"""


TOP3 = ("name", "org_type", "description", "city", "country", "website", "email", "employeecount", "date_created")
TOP5 = ("name", "org_type", "city", "country", "email", "phone", "website", "employeecount", "date_created")
TOP10 = (
    "name", "subscription", "org_type", "uid", "description", "street", "city", "country", "website",
    "email", "phone", "credit_rating", "employeecount", "date_created",
)

COUNTRY_VIEW = f"""WITH {COMPANY}
SELECT h.hk_country, h.object_id, s.name, h.dss_load_date AS hub_load_date
FROM hub_n h LEFT JOIN sat_n s ON h.hk_country = s.hk_country AND s.dss_is_current = 'Y'
WHERE h.object_id > 0"""


def two_batches(compare: str) -> str:
    against = "sat_c1" if compare == "any" else "newest"
    return f"""WITH {COMPANY},
newest AS (SELECT * FROM sat_c1 QUALIFY row_number() OVER (PARTITION BY hk_company ORDER BY dss_load_date DESC, hd_company DESC) = 1),
merged AS (SELECT * FROM sat_c1 UNION ALL SELECT * FROM stg s WHERE batch = 2
  AND NOT EXISTS (SELECT 1 FROM {against} e WHERE e.hk_company = s.hk_company AND e.hd_company = s.hd_company))
SELECT hk_company, hd_company, dss_load_date, dss_record_source, name, subscription, credit_rating, country,
  'Y' AS dss_is_current, CAST(NULL AS TIMESTAMP) AS dss_end_date FROM merged"""


def checks_sql() -> str:
    """The declared suite, one SELECT per check."""
    def null(model: str, table: str, *columns: str) -> list[tuple]:
        return [(model, c, "not_null", f"SELECT 1 FROM {table} WHERE {c} IS NULL") for c in columns]

    def uniq(model: str, table: str, column: str) -> tuple:
        return (model, column, "unique", f"SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1")

    def rel(model: str, table: str, column: str, parent: str) -> tuple:
        return (model, column, "relationships",
                f"SELECT 1 FROM {table} c WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{column} = c.{column})")

    rows = [
        *null("stg_company", "stg", "hk_company", "hd_company", "object_id", "source_table", "role_code"),
        ("stg_company", "role_code", "accepted_values",
         "SELECT role_code FROM stg WHERE role_code NOT IN ('CLIENT', 'CONTRACTOR', 'SUPPLIER') GROUP BY role_code"),
        *null("stg_country", "stg_n", "hk_country", "object_id"),
        *null("hub_company", "hub_c", "hk_company", "object_id", "source_table", "dss_load_date", "dss_record_source"),
        uniq("hub_company", "hub_c", "hk_company"),
        *null("hub_country", "hub_n", "hk_country", "object_id"),
        uniq("hub_country", "hub_n", "hk_country"),
        *null("sat_company", "sat_c", "hk_company", "hd_company"),
        rel("sat_company", "sat_c", "hk_company", "hub_c"),
        *null("sat_country", "sat_n", "hk_country"),
        rel("sat_country", "sat_n", "hk_country", "hub_n"),
        *null("sat_company_client_ext", "ext_c", "hk_company"),
        rel("sat_company_client_ext", "ext_c", "hk_company", "hub_c"),
        *null("link_company_role", "link_r", "hk_link_company_role", "hk_company", "hk_role", "role_code"),
        uniq("link_company_role", "link_r", "hk_link_company_role"),
        rel("link_company_role", "link_r", "hk_company", "hub_c"),
        *null("link_company_country", "link_n", "hk_link_company_country", "hk_company", "hk_country"),
        uniq("link_company_country", "link_n", "hk_link_company_country"),
        rel("link_company_country", "link_n", "hk_company", "hub_c"),
        rel("link_company_country", "link_n", "hk_country", "hub_n"),
        *null("v_company_top5", "company_v", "object_id", "name", "hk_company"),
        uniq("v_company_top5", "company_v", "object_id"),
        uniq("v_company_top5", "company_v", "hk_company"),
        *null("v_top10_customers", "company_v", "hk_company", "object_id", "name", "date_created"),
        uniq("v_top10_customers", "company_v", "hk_company"),
        *null("v_countries", "country_v", "object_id", "name", "hk_country"),
        uniq("v_countries", "country_v", "object_id"),
        uniq("v_countries", "country_v", "hk_country"),
        *null("v_company_current", "company_v", "name", "state"),
        *null("v_company_extended", "extended_v", "hk_company", "company_id", "company_name"),
        uniq("v_company_extended", "extended_v", "hk_company"),
        uniq("v_company_extended", "extended_v", "company_id"),
        *null("ref_role", "roles", "role_code"),
        uniq("ref_role", "roles", "role_code"),
        *null("ext_company_client", "(SELECT object_id FROM feed WHERE role_code = 'CLIENT')", "object_id"),
        *null("ext_project", "(SELECT o_orderkey AS object_id FROM orders)", "object_id"),
    ]
    parts = [
        f"SELECT '{m}' AS model, '{c}' AS column_name, '{t}' AS test, (SELECT count(*) FROM ({q})) AS failures" for m, c, t, q in rows
    ]
    return f"""WITH {COMPANY}, {EXT},
roles(role_code) AS (VALUES ('CLIENT'), ('CONTRACTOR'), ('SUPPLIER')),
extended_v AS (SELECT h.hk_company, h.object_id AS company_id, s.name AS company_name FROM hub_c h
  LEFT JOIN sat_c s ON h.hk_company = s.hk_company AND s.dss_is_current = 'Y' LEFT JOIN link_n l ON l.hk_company = h.hk_company
  LEFT JOIN sat_n n ON n.hk_country = l.hk_country AND n.dss_is_current = 'Y' WHERE h.object_id > 0),
company_v AS (SELECT h.hk_company, h.object_id, s.name, CAST(NULL AS VARCHAR) AS state, s.date_created FROM hub_c h
  LEFT JOIN sat_c s ON h.hk_company = s.hk_company AND s.dss_is_current = 'Y' WHERE h.object_id > 0),
country_v AS (SELECT h.hk_country, h.object_id, s.name FROM hub_n h LEFT JOIN sat_n s USING (hk_country) WHERE h.object_id > 0)
""" + "\nUNION ALL ".join(parts)


EXT_HASH = sha("strftime(exempt, '%Y-%m-%d %H:%M:%S.%f')")
EXT = f"""
ext_rows AS (
  SELECT hk_company, {EXT_HASH} AS hd_company_client_ext, dss_load_date, dss_record_source, exempt, batch
  FROM stg WHERE role_code = 'CLIENT' AND exempt IS NOT NULL),
ext_c AS (
  SELECT * FROM ext_rows WHERE batch = 1 UNION ALL
  SELECT * FROM ext_rows r WHERE batch = 2 AND NOT EXISTS (
    SELECT 1 FROM ext_rows e WHERE e.batch = 1 AND e.hk_company = r.hk_company
     AND e.hd_company_client_ext = r.hd_company_client_ext))
"""

PROJECT_TEXTS = [
    "o_orderpriority", "o_orderstatus", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "''",
    "CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS VARCHAR)",
    *["''"] * 8, "CAST(o_custkey AS VARCHAR)", "''", "''",
]
PROJECT = f"""
stg_p AS (
  SELECT {sha('CAST(o_orderkey AS VARCHAR)')} AS hk_project, {sha(" || '^^' || ".join(PROJECT_TEXTS))} AS hd_project,
         o_orderkey AS object_id, o_orderpriority AS name, o_orderstatus AS state, o_orderdate AS "begin",
         CAST(NULL AS VARCHAR) AS location, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
         CAST(NULL AS DOUBLE) AS commission, CAST(NULL AS TIMESTAMP) AS "end", CAST(NULL AS VARCHAR) AS work_begin,
         CAST(NULL AS VARCHAR) AS author_email, CAST(NULL AS VARCHAR) AS description,
         CAST(NULL AS VARCHAR) AS price_units_value, CAST(NULL AS VARCHAR) AS commission_units_value,
         CAST(NULL AS VARCHAR) AS details, o_custkey AS client, CAST(NULL AS BIGINT) AS contractor,
         CAST(NULL AS VARCHAR) AS member, 'ext_project' AS dss_record_source, o_orderdate AS dss_load_date
  FROM orders)
"""


def pit_naive(hub: str, sat: str, spine: str, name: str) -> str:
    """Cross join of keys and days with a correlated lookup."""
    return f"""SELECT hk AS {{hk}}, CAST(snapshot_date AS VARCHAR) AS snapshot_date, hk AS {name}_hk, found AS {name}_load_date,
  {NOW} AS dss_load_date, 'PIT_GENERATION' AS dss_record_source
FROM (SELECT h.hk, d.snapshot_date, (SELECT max(s.dss_load_date) FROM {sat} s
        WHERE s.{{hk}} = h.hk AND CAST(s.dss_load_date AS DATE) <= d.snapshot_date) AS found
      FROM (SELECT DISTINCT {{hk}} AS hk FROM {hub}) h CROSS JOIN ({spine}) d)
WHERE found IS NOT NULL"""


PIT_USER = pit_naive("user_hub", "versions", "SELECT DISTINCT CAST(dss_load_date AS DATE) AS snapshot_date FROM versions", "sat_user").format(hk="hk_user")

WEEKS = f"""
weeks AS MATERIALIZED (SELECT * REPLACE (CAST(date_trunc('week', dss_load_date) AS DATE) AS batch) FROM feed),
{loads_in_turn("changes", "weeks", [f"DATE '2024-01-01' + {7 * i}" for i in range(6)], "hk_user", "hk_link_user_type")}
"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    # staging
    sql["stage_company"] = f"""WITH {COMPANY}
SELECT hk_company, hk_country, hk_role, hk_link_company_role, hk_link_company_country, hd_company, object_id, source_table,
  role_code, {payload()}, exempt AS freistellungsbescheinigung, batch, dss_record_source, dss_load_date,
  CAST(NULL AS VARCHAR) AS dss_run_id FROM stg"""
    sql["stage_country"] = f"""WITH {COMPANY} SELECT hk_country, hd_country, object_id, name, dss_record_source, dss_load_date,
  CAST(NULL AS VARCHAR) AS dss_run_id FROM stg_n"""
    sql["stage_project"] = f"WITH {PROJECT} SELECT *, CAST(NULL AS VARCHAR) AS dss_run_id FROM stg_p"
    sql["hash_key_md5"] = f"""SELECT c_custkey, upper(md5(c_custkey || '||' || c_mktsegment)) AS hk_md5,
  {sha("c_custkey || '||' || c_mktsegment")} AS hk_sha, {sha(text('c_nationkey'))} AS hk_country,
  {sha("c_custkey || '^^' || c_nationkey")} AS hk_link FROM customer"""
    wide = "unhex(regexp_replace(hex(c_custkey || '^^' || c_name), '(..)', '\\100', 'g'))"
    sql["hash_key_utf16"] = f"SELECT c_custkey, {sha(wide)} AS hk_company FROM customer"
    diff = ["o_orderstatus", "CAST(o_totalprice AS VARCHAR)",
            "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderpriority"]
    sql["hash_diff_nosep"] = f"""SELECT o_orderkey, {sha(' || '.join(diff))} AS hd_plain,
  {sha(" || '^^' || ".join(diff))} AS hd_separated FROM orders"""
    sql["union_feeds"] = f"""WITH {COMPANY} SELECT object_id, role_code, source_table, name, country, credit_rating, subscription,
  CAST(employeecount AS VARCHAR) AS employeecount FROM feed WHERE role_code <> 'CLIENT'"""
    sql["derived_columns"] = """SELECT c_custkey, 'crm' AS record_source, lower(substring(c_mktsegment, 1, 3)) AS segment_code
FROM customer"""
    sql["seed_reference"] = "SELECT CAST(r_regionkey AS VARCHAR) AS region_code, r_name AS region_name FROM region"
    sql["load_metadata"] = f"""WITH {COMPANY} SELECT object_id, role_code, dss_load_date, dss_record_source FROM stg WHERE batch = 1"""
    # hubs, links, satellites
    sql["hub_company"] = f"WITH {COMPANY} SELECT {HUB_COLUMNS} FROM hub_c"
    sql["hub_country"] = f"WITH {COMPANY} SELECT * FROM hub_n"
    sql["hub_project"] = f"WITH {PROJECT} SELECT DISTINCT hk_project, object_id, dss_load_date, dss_record_source FROM stg_p"
    sql["hub_incremental"] = f"""SELECT DISTINCT {sha(text('o_custkey'))} AS hk_user, CAST(o_custkey AS VARCHAR) AS user_code,
  o_orderdate AS dss_load_date, 'orders' AS dss_record_source
FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)"""
    sql["link_incremental"] = f"""SELECT DISTINCT {sha("o_custkey || '^^' || o_orderpriority")} AS hk_link_user_priority,
  {sha(text('o_custkey'))} AS hk_user, {sha('o_orderpriority')} AS hk_priority, o_orderpriority AS priority_code,
  o_orderdate AS dss_load_date, 'orders' AS dss_record_source
FROM orders o WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM orders e
  WHERE e.o_orderdate < TIMESTAMP '1998-01-01' AND e.o_custkey = o.o_custkey AND e.o_orderpriority = o.o_orderpriority)"""
    sql["link_company_role"] = f"WITH {COMPANY} SELECT * FROM link_r"
    sql["link_company_country"] = f"WITH {COMPANY} SELECT * FROM link_n"
    sql["sat_company"] = f"WITH {COMPANY} SELECT {SAT_COLUMNS} FROM sat_c"
    sql["sat_country"] = f"WITH {COMPANY} SELECT * FROM sat_n"
    sql["sat_project"] = f"""WITH {PROJECT} SELECT * EXCLUDE (object_id), 'Y' AS dss_is_current,
  CAST(NULL AS TIMESTAMP) AS dss_end_date FROM stg_p"""
    sql["sat_subset"] = f"""WITH {COMPANY}, {EXT},
ended AS (SELECT e.*, (SELECT min(t.dss_load_date) FROM ext_c t WHERE t.hk_company = e.hk_company
  AND t.dss_load_date > e.dss_load_date) AS dss_end_date FROM ext_c e)
SELECT hk_company, hd_company_client_ext, dss_load_date, dss_record_source, exempt AS freistellungsbescheinigung,
  CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_current, dss_end_date FROM ended"""
    sql["sat_two_batch"] = two_batches("any")
    sql["sat_two_batch_latest"] = two_batches("latest")
    sql["sat_replay_any"] = f"""WITH {EVENTS} SELECT {OPEN_COLUMNS} FROM feed f
WHERE batch = (SELECT min(batch) FROM feed g WHERE g.hk_user = f.hk_user AND g.hd_user = f.hd_user)"""
    sql["sat_replay_latest"] = f"WITH {EVENTS} SELECT {OPEN_COLUMNS} FROM versions"
    sql["sat_reload"] = f"""WITH {EVENTS} SELECT hk_user, lower(sha256(CAST(order_key AS VARCHAR))) AS hd_user, dss_load_date,
  'orders' AS dss_record_source, order_key, state, 'Y' AS dss_is_current FROM order_versions"""
    sql["hub_replay"] = f"WITH {EVENTS} SELECT * FROM user_hub"
    sql["link_replay"] = f"""WITH {EVENTS} SELECT DISTINCT hk_link_user_type, hk_user, hk_type, dss_load_date, dss_record_source
FROM feed f WHERE batch = (SELECT min(batch) FROM feed g WHERE g.hk_link_user_type = f.hk_link_user_type)"""
    product = f"""{sha('CAST(p_partkey AS VARCHAR)')} AS hk_product"""
    diff = "p_name || p_type || CAST(p_size AS VARCHAR) || CAST(p_retailprice AS VARCHAR)"
    loaded = f"{NOW} AS dss_load_date, 'portal' AS dss_record_source"
    sql["hub_product"] = f"SELECT {product}, p_partkey AS object_id, {loaded} FROM part"
    sql["sat_product"] = f"""SELECT {product}, {sha(diff)} AS hd_product, {loaded}, p_name AS name, p_type AS kind, p_size AS size,
  p_retailprice AS price, 'Y' AS dss_is_current, CAST(NULL AS TIMESTAMP) AS dss_end_date FROM part"""
    sql["link_product_brand"] = f"""SELECT DISTINCT {sha("p_partkey || '^^' || p_brand")} AS hk_link_product_brand, {product},
  {sha('p_brand')} AS hk_brand, {loaded} FROM part"""
    # history
    sql["sat_closed"] = f"WITH {EVENTS} SELECT {CLOSED_COLUMNS} FROM closed"
    sql["sat_closed_ties"] = f"""WITH {EVENTS},
ended AS (SELECT v.*, (SELECT min(t.dss_load_date) FROM order_versions t
  WHERE t.hk_user = v.hk_user AND t.dss_load_date > v.dss_load_date) AS dss_end_date FROM order_versions v)
SELECT *, CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_current FROM ended"""
    sql["sat_closed_strict"] = f"""WITH {EVENTS}, {LATE} SELECT hk_user, event_type, value, dss_load_date,
  CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_current, dss_end_date FROM late_final"""
    sql["interval_overlaps"] = f"""WITH {EVENTS}, {LATE} SELECT hk_user, event_type, value, dss_load_date,
  CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_current, dss_end_date, next1 AS next_load_date
FROM late_final WHERE next1 IS NOT NULL AND (dss_end_date IS NULL OR dss_end_date > next1)"""
    sql["eff_sat_company_country"] = f"""WITH {COMPANY} SELECT hk_link_company_country, hk_company, hk_country, dss_record_source,
  dss_start_date, CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_active, dss_end_date FROM eff_n"""
    sql["eff_sat_two_batch"] = f"""WITH {COMPANY} SELECT hk_link_company_country, hk_company, hk_country, dss_record_source,
  dss_start_date, 'Y' AS dss_is_active, CAST(NULL AS TIMESTAMP) AS dss_end_date FROM eff_2"""
    sql["eff_sat_driving_start"] = f"""WITH {COMPANY},
first AS (SELECT * FROM stg WHERE batch = 1),
merged AS (SELECT * FROM first UNION ALL SELECT * FROM stg s WHERE NOT EXISTS (SELECT 1 FROM first f
  WHERE f.hk_company = s.hk_company AND f.dss_load_date = s.dss_load_date))
SELECT hk_link_company_country, hk_company, hk_country, dss_record_source, dss_load_date AS dss_start_date,
  'Y' AS dss_is_active, CAST(NULL AS TIMESTAMP) AS dss_end_date FROM merged"""
    relation = "hk_link_user_type, hk_user, hk_type, dss_record_source, dss_load_date AS dss_start_date"
    flag = "CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_active, dss_end_date"
    sql["eff_sat_replay"] = f"""WITH {EVENTS} SELECT {relation}, 'Y' AS dss_is_active, CAST(NULL AS TIMESTAMP) AS dss_end_date
FROM versions"""
    sql["eff_closed"] = f"WITH {EVENTS} SELECT {relation}, {flag} FROM closed"
    sql["relationship_as_of"] = f"""WITH {EVENTS} SELECT {relation}, {flag} FROM closed
WHERE dss_load_date <= {MOMENT} AND (dss_end_date > {MOMENT} OR dss_end_date IS NULL)"""
    sql["ghost_hub"] = f"""WITH {COMPANY} SELECT {HUB_COLUMNS} FROM hub_c
UNION ALL SELECT repeat('0', 64), -1, 'GHOST_UNKNOWN', TIMESTAMP '1900-01-01', 'SYSTEM'
UNION ALL SELECT repeat('F', 64), -2, 'GHOST_ERROR', TIMESTAMP '1900-01-01', 'SYSTEM'"""
    sql["ghost_sat"] = f"""WITH {COMPANY} SELECT * FROM sat_n
UNION ALL SELECT repeat('0', 64), repeat('0', 64), TIMESTAMP '1900-01-01', 'SYSTEM', 'Unknown', 'Y', NULL
UNION ALL SELECT repeat('F', 64), repeat('F', 64), TIMESTAMP '1900-01-01', 'SYSTEM', 'Error', 'Y', NULL"""
    sql["resolve_key"] = f"""SELECT c_custkey AS object_id, CASE WHEN c_nationkey = 0 THEN repeat('0', 64)
  WHEN c_nationkey <= 20 THEN {sha(text('c_nationkey'))} ELSE repeat('F', 64) END AS hk_country FROM customer"""
    sql["sat_current"] = f"WITH {EVENTS} SELECT {CLOSED_COLUMNS} FROM closed WHERE dss_end_date IS NULL"
    sql["sat_history"] = f"WITH {EVENTS} SELECT {CLOSED_COLUMNS} FROM closed WHERE user_code = '8' ORDER BY dss_load_date DESC"
    sql["sat_as_of"] = f"""WITH {EVENTS} SELECT {CLOSED_COLUMNS} FROM closed
WHERE dss_load_date <= {MOMENT} AND (dss_end_date > {MOMENT} OR dss_end_date IS NULL)"""
    sql["evolve_satellite"] = f"""WITH {EVENTS} SELECT hk_user, {sha("event_type || '^^' || CAST(value AS VARCHAR)")} AS hd_user,
  dss_load_date, event_type, CAST(value AS DOUBLE) AS value,
  CASE WHEN dss_end_date IS NULL THEN 'Y' ELSE 'N' END AS dss_is_current, dss_end_date, CAST(NULL AS VARCHAR) AS region
FROM closed"""
    # business vault
    sql["snapshot_spine"] = f"""WITH {EVENTS} SELECT CAST(CAST(dss_load_date AS DATE) AS VARCHAR) AS snapshot_date FROM order_versions
UNION SELECT CAST(CAST(dss_load_date AS DATE) AS VARCHAR) FROM versions"""
    sql["pit_user"] = f"WITH {EVENTS} {PIT_USER}"
    sql["pit_company"] = f"WITH {COMPANY} " + pit_naive(
        "hub_c", "sat_c", "SELECT DISTINCT CAST(dss_load_date AS DATE) AS snapshot_date FROM sat_c", "sat_company"
    ).format(hk="hk_company")
    sql["pit_weekly"] = f"WITH {EVENTS} " + pit_naive(
        "user_hub", "versions", "SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS snapshot_date FROM events", "sat_user"
    ).format(hk="hk_user")
    sql["pit_multi"] = f"""WITH {EVENTS},
months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date FROM orders),
keys AS (SELECT DISTINCT hk_user FROM feed),
found AS (SELECT k.hk_user, m.snapshot_date,
  (SELECT max(s.dss_load_date) FROM versions s WHERE s.hk_user = k.hk_user AND CAST(s.dss_load_date AS DATE) <= m.snapshot_date) AS a,
  (SELECT max(s.dss_load_date) FROM order_versions s WHERE s.hk_user = k.hk_user AND CAST(s.dss_load_date AS DATE) <= m.snapshot_date) AS b
  FROM keys k CROSS JOIN months m)
SELECT hk_user, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CASE WHEN a IS NOT NULL THEN hk_user END AS sat_user_hk,
  a AS sat_user_ldts, CASE WHEN b IS NOT NULL THEN hk_user END AS sat_order_hk, b AS sat_order_ldts
FROM found WHERE a IS NOT NULL OR b IS NOT NULL"""
    sql["pit_lookup"] = f"""WITH {EVENTS}, pit AS ({PIT_USER})
SELECT p.hk_user, v.dss_load_date, p.snapshot_date, v.event_type, CAST(v.value AS DOUBLE) AS value
FROM pit p JOIN versions v ON v.hk_user = p.hk_user AND v.dss_load_date = p.sat_user_load_date
WHERE p.snapshot_date = '2024-01-15'"""
    sql["bridge_company"] = f"""WITH {COMPANY} SELECT h.hk_company, n.hk_country, r.hk_role, n.hk_link_company_country,
  r.hk_link_company_role, h.dss_load_date, h.dss_record_source
FROM hub_c h JOIN link_n n ON n.hk_company = h.hk_company JOIN link_r r ON r.hk_company = h.hk_company"""
    # marts
    sql["mart_company_current"] = company_view(("name", "state", "org_type", "description"))
    sql["mart_company_flat"] = f"""WITH {COMPANY} SELECT hk_company, {payload()}, hd_company, dss_load_date, dss_record_source,
  dss_is_current FROM sat_c WHERE dss_is_current = 'Y'"""
    sql["mart_countries"] = COUNTRY_VIEW
    sql["mart_country_names"] = COUNTRY_VIEW
    sql["mart_country_view"] = COUNTRY_VIEW
    by_date = "ORDER BY s.date_created ASC NULLS LAST, h.hk_company LIMIT"
    sql["mart_company_top3"] = company_view(TOP3)
    sql["mart_company_top3_described"] = company_view(TOP3, f"{by_date} 3")
    sql["mart_company_top5"] = company_view(TOP5)
    sql["mart_company_top5_described"] = company_view(TOP5, "ORDER BY h.object_id, h.hk_company LIMIT 5")
    sql["mart_top10_customers"] = company_view(TOP10)
    sql["mart_top10_customers_described"] = company_view(TOP10, f"{by_date} 10")
    shown = payload("s.").replace("AS name", "AS company_name").replace("AS uid", "AS company_uid")
    shown = shown.replace("AS description", "AS company_description").replace("AS country", "AS country_code")
    sql["mart_company_extended"] = f"""WITH {COMPANY}
SELECT h.hk_company, h.object_id AS company_id, {shown}, n.name AS country_name, h.dss_load_date AS hub_load_date,
  greatest(coalesce(s.dss_load_date, h.dss_load_date), coalesce(n.dss_load_date, h.dss_load_date)) AS last_updated
FROM hub_c h LEFT JOIN sat_c s ON h.hk_company = s.hk_company AND s.dss_is_current = 'Y'
LEFT JOIN link_n l ON l.hk_company = h.hk_company
LEFT JOIN sat_n n ON n.hk_country = l.hk_country AND n.dss_is_current = 'Y'
WHERE h.object_id > 0"""
    nothing = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in
                        ("street", "zip_code", "city", "email", "phone", "mobile", "website", "iban", "bic"))
    sql["mart_company_full"] = f"""WITH {COMPANY},
roles(role_code, role_name) AS (VALUES ('CLIENT', 'Client'), ('CONTRACTOR', 'Contractor'), ('SUPPLIER', 'Supplier'))
SELECT h.hk_company, h.object_id, h.source_table, s.name AS company_name, {nothing}, s.country AS country_id,
  n.name AS country_name, s.credit_rating, lr.role_code, r.role_name, s.dss_load_date AS last_updated,
  s.dss_record_source AS source_system
FROM hub_c h JOIN sat_c s ON h.hk_company = s.hk_company AND s.dss_is_current = 'Y'
LEFT JOIN link_r lr ON lr.hk_company = h.hk_company LEFT JOIN roles r ON r.role_code = lr.role_code
LEFT JOIN link_n l ON l.hk_company = h.hk_company
LEFT JOIN sat_n n ON n.hk_country = l.hk_country AND n.dss_is_current = 'Y'
WHERE h.object_id > 0"""
    sql["mart_star_aliases"] = f"""WITH {COMPANY}
SELECT h.hk_company, h.object_id, s.name, s.subscription, s.credit_rating, n.name AS country_name, h.dss_load_date AS hub_load_date
FROM hub_c h LEFT JOIN sat_c s ON h.hk_company = s.hk_company AND s.dss_is_current = 'Y'
LEFT JOIN link_n l ON l.hk_company = h.hk_company
LEFT JOIN sat_n n ON n.hk_country = l.hk_country AND n.dss_is_current = 'Y' WHERE h.object_id > 0"""
    sql["companies_in_country"] = f"""WITH {COMPANY} SELECT s.name, n.name AS country FROM sat_c s
JOIN link_n l ON l.hk_company = s.hk_company JOIN sat_n n ON n.hk_country = l.hk_country
WHERE s.dss_is_current = 'Y' AND n.name = 'NATION_7'"""
    # reports and checks
    sql["client_count"] = f"WITH {COMPANY} SELECT count(*) AS n FROM link_r WHERE role_code = 'CLIENT'"
    sql["count_by_role"] = f"WITH {COMPANY} SELECT role_code, count(*) AS n FROM link_r GROUP BY role_code"
    sql["count_by_country"] = f"WITH {COMPANY} SELECT hk_country, count(*) AS n FROM link_n GROUP BY hk_country"
    pairs = [("hub_company", "stg", "hub_c"), ("hub_country", "stg_n", "hub_n"),
             ("sat_company", "stg", "sat_c"), ("link_company_country", "stg", "link_n")]
    counted = " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, (SELECT count(*) FROM {s}) AS source_rows, (SELECT count(*) FROM {t}) AS vault_rows" for layer, s, t in pairs
    )
    sql["reconciliation"] = f"WITH {COMPANY} SELECT *, vault_rows - source_rows AS difference FROM ({counted})"
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
    sql["table_stats"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in names)
    sql["duplicate_keys"] = f"WITH {COMPANY} SELECT hk_company, count(*) AS n_records FROM sat_c GROUP BY hk_company HAVING count(*) > 1"
    sql["first_and_last_load"] = f"""WITH {EVENTS} SELECT hk_user, min(dss_load_date) AS first_load, max(dss_load_date) AS last_load
FROM order_versions GROUP BY hk_user"""
    sql["check_not_null"] = f"WITH {COMPANY} SELECT hk_company, object_id, role_code, batch FROM stg WHERE country IS NULL"
    sql["check_unique"] = f"WITH {COMPANY} SELECT object_id, count(*) AS n_records FROM hub_c GROUP BY object_id HAVING count(*) > 1"
    sql["check_accepted"] = """SELECT event_type, count(*) AS n_records FROM events WHERE event_type NOT IN ('click', 'view')
GROUP BY event_type"""
    sql["check_relationships"] = f"""WITH {COMPANY} SELECT hk_company, hk_country, dss_start_date FROM eff_n e
WHERE NOT EXISTS (SELECT 1 FROM hub_n h WHERE h.hk_country = e.hk_country)"""
    sql["check_suite"] = checks_sql()
    sql["orphans"] = f"""WITH {EVENTS} SELECT * FROM order_versions o
WHERE NOT EXISTS (SELECT 1 FROM user_hub h WHERE h.hk_user = o.hk_user)"""
    # document index
    sql["chunks"] = f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunk_rows"
    sql["chunk_metadata"] = f"""WITH RECURSIVE {CHUNKS},
placed AS (SELECT c.doc_id, c.chunk_index, c.content, left(d.text, CAST(greatest(strpos(d.text, c.content) - 1, 0) AS BIGINT)) AS ahead
  FROM chunk_rows c JOIN documents d ON d.doc_id = c.doc_id)
SELECT doc_id, chunk_index, array_to_string({titles('content')}, chr(10)) AS headers, list_last({titles('ahead')}) AS section
FROM placed"""
    markdown = "html"
    for pattern, replacement in MARKUP_RULES:
        markdown = f"regexp_replace({markdown}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    sql["page_chunk_metadata"] = f"""WITH RECURSIVE documents AS MATERIALIZED (SELECT page_id AS doc_id, {markdown} AS text FROM pages), {CHUNKS},
placed AS (SELECT c.doc_id, c.chunk_index, c.content, left(d.text, CAST(greatest(strpos(d.text, c.content) - 1, 0) AS BIGINT)) AS ahead
  FROM chunk_rows c JOIN documents d ON d.doc_id = c.doc_id)
SELECT doc_id AS page_id, chunk_index, array_to_string({titles('content')}, chr(10)) AS headers, list_last({titles('ahead')}) AS section
FROM placed""".replace(r"string_split_regex(text, '\n+')", r"string_split_regex(text, '\n\n+')")
    old = """old AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'Draft.' || chr(10) || d.text ELSE d.text END AS text
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id WHERE d.lang <> 'de')"""
    sql["reindex_plan"] = f"""WITH {old} SELECT d.doc_id, md5(d.text) AS content_hash,
  CASE WHEN o.doc_id IS NULL THEN 'new' WHEN md5(o.text) = md5(d.text) THEN 'unchanged' ELSE 'changed' END AS action
FROM documents d LEFT JOIN old o ON o.doc_id = d.doc_id"""
    sql["incremental_reindex"] = f"""WITH RECURSIVE {CHUNKS} SELECT c.doc_id, c.chunk_index, c.content,
  CASE WHEN c.chunk_index = 0 THEN md5(d.text) END AS content_hash FROM chunk_rows c JOIN documents d ON d.doc_id = c.doc_id"""
    sql["chunk_stats"] = f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(*) AS chunks FROM chunk_rows GROUP BY doc_id"
    sql["index_stats"] = f"""WITH RECURSIVE {CHUNKS}, per_doc AS (SELECT doc_id, count(*) AS n FROM chunk_rows GROUP BY doc_id)
SELECT count(*) AS documents_count, CAST(sum(n) AS BIGINT) AS chunks_count, round(avg(n), 6) AS avg_chunks_per_doc FROM per_doc"""
    sql["duplicate_content"] = """SELECT md5(text) AS content_hash, count(*) AS n_copies, min(doc_id) AS first_id
FROM documents GROUP BY md5(text) HAVING count(*) > 1"""
    sql["cosine_to_label"] = f"""WITH {SIMILAR} SELECT vec_id, label, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 6)
  AS similarity FROM embeddings JOIN queries ON query_id = label"""
    sql["similar_topk"] = f"WITH {SIMILAR} {ranked(5, None)}"
    sql["similar_threshold"] = f"WITH {SIMILAR} {ranked(20, 0.3)}"
    sql["context"] = f"""WITH {SIMILAR}, hits AS ({ranked(5, 0.3)})
SELECT query_id, string_agg('### From doc_' || vec_id || '.md (' || lang || ') [' || CAST(round(similarity * 100) AS INTEGER)
  || '% relevant]' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hits JOIN documents ON doc_id = vec_id GROUP BY query_id"""
    # logs and lineage
    sql["upsert"] = """WITH halves AS (
  SELECT user_id, first(event_type ORDER BY ts DESC) AS state, min(ts) FILTER (ts < TIMESTAMP '2024-01-16') AS early,
    max(ts) AS updated_at, max(ts) AS newest FROM events GROUP BY user_id)
SELECT user_id, state, coalesce(early, newest) AS created_at, updated_at FROM halves"""
    message = "conv_id, turn, role, text"
    for name, order, n in (("recent_messages", "turn DESC", 3), ("session_messages", "turn", None)):
        sql[name] = f"""SELECT {message}, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS INTEGER) AS position
FROM conversations""" + (f" QUALIFY position <= {n}" if n else "")
    sql["latest_status"] = """WITH last AS (
  SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS status FROM events
  WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT coalesce(c_custkey, user_id) AS model_key,
  CASE status WHEN 'purchase' THEN 'deployed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state
FROM customer FULL JOIN last ON c_custkey = user_id"""
    for name, near, far, seeds in (
        ("reachable_down", "src", "dst", "SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'"),
        ("reachable_up", "dst", "src", "SELECT 'region:' || r_regionkey FROM region WHERE r_name = 'ASIA'"),
    ):
        sql[name] = f"""WITH RECURSIVE {EDGES},
walk(node, distance) AS (SELECT *, 0 FROM ({seeds})
  UNION SELECT {far}, distance + 1 FROM walk JOIN edges ON {near} = node)
SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY node HAVING min(distance) > 0"""
    sql["neighbours"] = f"WITH {EDGES} SELECT DISTINCT src AS node FROM edges WHERE dst = 'nation:7'"
    # loads kept on storage
    sql["batches_satellite"] = f"""WITH {EVENTS}, {WEEKS},
first AS (SELECT * FROM weeks w WHERE batch = (SELECT min(batch) FROM weeks x WHERE x.hk_user = w.hk_user AND x.hd_user = w.hd_user)),
ended AS (SELECT f.*, (SELECT min(t.dss_load_date) FROM first t WHERE t.hk_user = f.hk_user
  AND t.dss_load_date > f.dss_load_date) AS dss_end_date FROM first f)
SELECT {CLOSED_COLUMNS} FROM ended"""
    sql["batches_eff_satellite"] = f"""WITH {EVENTS}, {WEEKS},
ended AS (SELECT f.*, (SELECT min(t.dss_load_date) FROM changes t WHERE t.hk_user = f.hk_user
  AND t.dss_load_date > f.dss_load_date) AS dss_end_date FROM changes f)
SELECT {relation}, {flag} FROM ended"""
    sql["batches_compacted"] = sql["batches_satellite"]
    sql["stream_satellite"] = sql["batches_satellite"]
    sql["stream_state_satellite"] = sql["batches_satellite"]
    sql["pit_refreshed"] = sql["pit_user"]
    sql["reindex_stored"] = sql["incremental_reindex"]
    for name in ("mart_company_current", "mart_company_extended", "mart_company_full"):
        sql[f"{name}_stored"] = sql[name]
    return sql
