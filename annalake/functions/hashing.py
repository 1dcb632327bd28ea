"""Hash keys and hash diffs over rendered column text.

Rules shared by every hash in the warehouse:

* a NULL component counts as the empty string, so a hash is never NULL;
* the digest is rendered as upper-case hex without a prefix;
* key components are joined with ``^^``, diff components with nothing unless
  the caller passes a separator;
* ``encoding="UTF-8"`` hashes the UTF-8 bytes, ``"UTF-16LE"`` the bytes a
  two-byte character column has in the source database.

Doubles are rendered with all the digits that tell them apart, so any change of a
value changes its hash. Timestamps are rendered with six decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators and sentinel keys of the data model.
KEY_SEPARATOR = "^^"
MACRO_SEPARATOR = "||"
ZERO_KEY = "0" * 64
ERROR_KEY = "F" * 64

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
ENCODINGS = ("UTF-8", "UTF-16LE")


def text_of(df: DataFrame, name: str) -> Column:
    """Column ``name`` as hash input text, NULL as ''."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(col, TIMESTAMP_TEXT)
    elif isinstance(dtype, T.BooleanType):
        text = col.cast("int").cast("string")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def digest(text: Column, algorithm: str = "SHA", encoding: str = "UTF-8") -> Column:
    """Upper-case hex digest of a text column."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}, got {encoding!r}")
    source = text if encoding == "UTF-8" else F.encode(text, encoding)
    if algorithm == "SHA":
        return F.upper(F.sha2(source, 256))
    if algorithm == "MD5":
        return F.upper(F.md5(source))
    raise ValueError(f"algorithm must be 'SHA' or 'MD5', got {algorithm!r}")


def _joined(df: DataFrame, cols: Sequence[str], sep: str) -> Column:
    parts = [text_of(df, c) for c in cols]
    if not parts:
        raise ValueError("a hash needs at least one column")
    return parts[0] if len(parts) == 1 else F.concat_ws(sep, *parts)


def hash_key(
    df: DataFrame,
    cols: str | Sequence[str],
    sep: str = KEY_SEPARATOR,
    algorithm: str = "SHA",
    encoding: str = "UTF-8",
) -> Column:
    """Hash key over one business key column or several."""
    names = [cols] if isinstance(cols, str) else list(cols)
    return digest(_joined(df, names, sep), algorithm, encoding)


def hash_diff(
    df: DataFrame,
    cols: Sequence[str],
    sep: str = "",
    algorithm: str = "SHA",
    encoding: str = "UTF-8",
) -> Column:
    """Change fingerprint over an ordered attribute list.

    Without a separator ('ab','c') and ('a','bc') share a fingerprint; pass
    ``sep="^^"`` where that matters.
    """
    return digest(_joined(df, list(cols), sep), algorithm, encoding)


def fk_hash_key(df: DataFrame, col: str, algorithm: str = "SHA", encoding: str = "UTF-8") -> Column:
    """Foreign key hashed exactly as the target hub hashes its own key."""
    return hash_key(df, [col], algorithm=algorithm, encoding=encoding)


def link_hash_key(
    df: DataFrame,
    *sides: Sequence[str],
    sep: str = KEY_SEPARATOR,
    algorithm: str = "SHA",
    encoding: str = "UTF-8",
) -> Column:
    """Hash key of a link: the business keys of all sides, in order."""
    if len(sides) < 2:
        raise ValueError("a link joins at least two hubs")
    return hash_key(df, [c for side in sides for c in side], sep, algorithm, encoding)


def resolve_key(business_key: Column, valid: Column, key: Column) -> Column:
    """``key``, or the zero key for a missing and the error key for an invalid business key."""
    return (
        F.when(business_key.isNull(), F.lit(ZERO_KEY))
        .when(F.coalesce(valid, F.lit(False)), key)
        .otherwise(F.lit(ERROR_KEY))
    )
