"""Text scalars shared by the index, the mention linker and the fixtures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word runs of letters, digits and underscore, joined across a single inner apostrophe
# or period ("don't", "3.5"): the default analyser's word segmentation, lower-cased.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"
# The same rule in RE2 syntax, for the DuckDB oracle.
TOKEN_PATTERN_RE2 = r"[\pL\pN_]+(?:['.][\pL\pN_]+)*"


def tokens(col: Column) -> Column:
    """ARRAY<STRING> of lower-cased tokens, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), 0)


def collapse_ws(col: Column) -> Column:
    """Runs of HTML whitespace (space, tab, LF, CR, FF) to one blank, trimmed."""
    return F.trim(F.regexp_replace(col, r"[ \t\n\r\f]+", " "))


def first_sentence(col: Column) -> Column:
    """Text up to the first ``.``, ``!``, ``?`` or line break; null when empty."""
    s = F.trim(F.regexp_extract(col, r"^([^.!?\n]*)", 1))
    return F.when(s == F.lit(""), F.lit(None).cast("string")).otherwise(s)


def iso_utc(col: Column) -> Column:
    """Timestamp as ISO-8601 text with a ``Z`` suffix (second precision)."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
