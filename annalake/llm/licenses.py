"""Licence scan: base phrases, and an exact containment join of blocks with templates.

A block is a window of consecutive words, across line breaks, as long as the
template and ``SLACK`` words more. It meets a template at the threshold t when it
has at least ceil(t x template) of the template's distinct words, and all that tell
it from a template that could pass for it, so wrapped notices meet and words
scattered over a text don't. Texts that have too few of
them anywhere are left out first (length filter). Words are ordered by how many
of the texts left have them, rare ones first; a window that meets a template has
a word of the template's prefix in this order (prefix filter), so only windows
around those words are looked at, and what has enough words around one is
counted exactly.

DataFrame functions only. Defined results: a NULL text counts as empty, has no
word, no label and score 0. Rows that repeat are scanned alike and come back as
often as they came; rows that share an id but not the text are kept apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import scratch, stored

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mpl", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
)
#: Share of a template's words that a block must have, in hundredths.
THRESHOLD = 90
#: Words that a block may have beyond the template's.
SLACK = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters of words before A-Z are lower-cased; a negated class is many times slower.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _lower(text: Column) -> Column:
    """A-Z in lower case. What else changes stays outside ASCII: the two
    characters whose lower case is not are put out of the way."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), _GAP), "")


def needed(size: int, threshold: int) -> int:
    return math.ceil(size * threshold / 100)


def template_words(text: str) -> list[str]:
    lower = text.translate(str.maketrans(_UPPER, _LOWER))
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)))


def required_words(token_sets: Sequence[Sequence[str]], overlaps: Sequence[int]) -> list[list[str]]:
    """For each template the words that tell it from those that have enough of its
    words to pass for it."""
    found = []
    for number, (tokens, overlap) in enumerate(zip(token_sets, overlaps, strict=True)):
        alike = [set(tokens) - set(other) for k, other in enumerate(token_sets) if k != number and len(set(tokens) & set(other)) >= overlap]
        found.append(sorted(set().union(*alike)))
    return found


def _places(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """For each phrase the words it starts at. Words are listed only where one occurs."""
    lower, found = _lower(text), F.lit(False)
    for phrase, _ in phrases:
        near = F.lit(True)
        for word in sorted(phrase.split(), key=len, reverse=True):
            near = near & F.contains(lower, F.lit(word))
        found = found | (near & text.rlike(f"(?i){_GAP.join(map(re.escape, phrase.split()))}"))

    def places(listed: Column, phrase: str) -> Column:
        parts = phrase.split()
        last_start = F.size(listed) - len(parts)

        def stands(i: Column) -> Column:
            same = F.lit(True)
            for k, word in enumerate(parts):
                same = same & (F.get(listed, i + k) == word)
            return same

        return F.when(last_start >= 0, F.filter(F.sequence(F.lit(0), last_start), stands)).otherwise(F.array().cast("array<int>"))

    # An array of one list binds it to a variable, so it is split once for all places.
    nothing = F.transform(F.array(*[F.lit(0)] * len(phrases)), lambda _: F.array().cast("array<int>"))
    listed = F.array(_words(text))
    by_phrase = F.when(found, F.get(F.transform(listed, lambda w: F.array(*[places(w, phrase) for phrase, _ in phrases])), F.lit(0))).otherwise(nothing)
    return by_phrase


def _listed(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _candidates(rows: DataFrame, token_sets: Sequence[Sequence[str]], overlaps: Sequence[int]) -> DataFrame:
    """Texts that have enough words of some template anywhere: all their words."""
    known = _listed(sorted(set().union(*token_sets)))

    def enough(one: Column) -> Column:
        met = F.lit(False)
        for tokens, overlap in zip(token_sets, overlaps, strict=True):
            met = met | (F.size(F.array_intersect(one["_own"], _listed(tokens))) >= overlap)
        return (F.size(one["_own"]) >= min(overlaps)) & met

    # An array of one list binds it to a variable, so it is split once for all templates.
    listed = F.transform(F.array(_words(F.col("_text"))), lambda w: F.struct(w.alias("_words"), F.array_intersect(known, w).alias("_own")))
    return rows.select("_id", "_text_hash", F.inline(F.filter(listed, enough)))


def containment_join(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _text_hash, label, template, containment: every template that a
    text meets, with the greatest containment of its blocks."""
    rows = _plain(docs, id_col, text_col)
    token_sets = [template_words(text) for _, text in templates]
    overlaps = [needed(len(t), threshold) for t in token_sets]
    found = stored(_candidates(rows, token_sets, overlaps), f"{scratch(docs.sparkSession)}/candidates")
    counted = found.select(F.explode("_own").alias("word")).groupBy("word").count().collect()  # one row a word of the vocabulary
    frequency = {r["word"]: r["count"] for r in counted}

    probes = []
    needs = required_words(token_sets, overlaps)
    for number, ((label, text), tokens, overlap, must) in enumerate(zip(templates, token_sets, overlaps, needs, strict=True)):
        ordered = sorted(tokens, key=lambda w: (frequency.get(w, 0), w))
        width = len(_WORDS.findall(text)) + SLACK
        probes += [(number, label, tokens, must, overlap, width, word) for word in ordered[: len(ordered) - overlap + 1]]
    prefixes = docs.sparkSession.createDataFrame(probes, "template int, label string, tokens array<string>, must array<string>, overlap int, width int, word string")
    anchors, widest = _listed(sorted({p[-1] for p in probes})), max(p[-2] for p in probes)

    # Only the words around an anchor leave the text, so that a long one isn't copied for each.
    places = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.array_contains(anchors, F.get("_words", i)))

    def around(i: Column) -> Column:
        first = F.greatest(i - (widest - 1), F.lit(0))
        return F.struct(F.get("_words", i).alias("word"), (i - first).alias("at"), F.slice("_words", first + 1, 2 * widest - 1).alias("near"))

    posted = found.select("_id", "_text_hash", F.inline(F.transform(places, around)))
    met = posted.join(F.broadcast(prefixes), "word")  # as small as the templates are
    # Of the words around the anchor those that a block of this template can have.
    start = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
    met = met.withColumn("near", F.slice("near", start + 1, F.col("at") - start + F.col("width"))).where(F.size(F.array_intersect("near", "tokens")) >= F.col("overlap"))
    blocks = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("width") + 1, F.lit(1)))

    def shared(i: Column) -> Column:
        block = F.slice("near", i, F.col("width"))
        return F.when(F.size(F.array_except("must", block)) == 0, F.size(F.array_intersect(block, "tokens"))).otherwise(0)

    met = met.withColumn("shared", F.array_max(F.transform(blocks, shared)))
    met = met.where(F.col("shared") >= F.col("overlap")).groupBy("_id", "_text_hash", "label", "template").agg(F.max(F.col("shared") / F.size("tokens")).alias("containment"))
    return met.withColumnRenamed("_id", "doc_id")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_text_hash"))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 with a base phrase, else the greatest containment found, or 0)."""
    rows = _plain(docs, id_col, text_col)
    base = rows.select("_id", "_text_hash", F.regexp_count("_text", F.lit(f"{_WORD}+")).cast("long").alias("n_words"), _places(F.col("_text"), phrases).alias("_by_phrase"))
    marks = [F.when(F.size(F.get("_by_phrase", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]
    base = base.select("_id", "_text_hash", "n_words", F.flatten("_by_phrase").alias("_places"), F.array_compact(F.array(*marks)).alias("_labels"))
    met = containment_join(docs, templates, threshold, id_col, text_col)
    met = met.groupBy(F.col("doc_id").alias("_met_id"), F.col("_text_hash").alias("_met_hash")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_containment"))
    joined = base.join(met, F.col("_id").eqNullSafe(F.col("_met_id")) & (F.col("_text_hash") == F.col("_met_hash")), "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    n_base = F.size("_places").cast("long")
    return joined.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        n_base.alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        listed(F.col("_labels")).alias("base_labels"),
        listed(F.concat("_labels", F.coalesce("_more", F.array().cast("array<string>")))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_containment", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same where each notice is on a line of its own, by comparing every line with every template."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    token_sets = [template_words(text) for _, text in TEMPLATES]
    overlaps = [needed(len(t), THRESHOLD) for t in token_sets]
    list_of = lambda words: f"[{', '.join(map(quoted, words))}]::VARCHAR[]"
    needs = required_words(token_sets, overlaps)
    sets = ", ".join(f"({i}, {quoted(label)}, {list_of(token_sets[i])}, {list_of(needs[i])}, {overlaps[i]})" for i, (label, _) in enumerate(TEMPLATES))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = f"regexp_extract_all(translate({{}}, '{_UPPER}', '{_LOWER}'), '{pattern}')"
    places, labels = [], []
    for phrase, label in PHRASES:
        same = " AND ".join(f"w[i + {k + 1}] = {quoted(word)}" for k, word in enumerate(phrase.split()))
        places.append(f"list_filter(range(len(w)), lambda i: {same})")
        labels.append(f"CASE WHEN len(list_filter(range(len(w)), lambda i: {same})) > 0 THEN {quoted(label)} END")
    return f"""
    WITH templates(template, label, tokens, must, overlap) AS (VALUES {sets}),
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    words AS (SELECT doc_id, {listed.format('t')} AS w FROM d),
    base AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, flatten([{', '.join(places)}]) AS places,
        list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL) AS base
      FROM words),
    lines AS (SELECT doc_id, list_distinct({listed.format('line')}) AS own FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
    met AS (
      SELECT doc_id, list(DISTINCT label) AS more, max(len(list_intersect(own, tokens)) / len(tokens)) AS containment
      FROM lines, templates WHERE len(own) >= overlap AND len(list_intersect(own, tokens)) >= overlap AND list_has_all(own, must) GROUP BY doc_id)
    SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
      array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
      CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
    FROM base LEFT JOIN met USING (doc_id)"""
