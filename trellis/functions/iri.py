"""IRI templates (MAP1/MAP2): percent-encode what an IRI may not carry raw.

Kept raw: ASCII letters and digits, ``- . _ ~`` and every character from U+00A0 up
(IRI ``ucschar``). Everything else becomes ``%XX`` per UTF-8 byte, so a blank is
``%20`` (never ``+``) and ``#`` is ``%23``. Pure JVM expressions: safe values pass
through, printable ASCII goes through the form encoder, and only other values take the
per-character path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.vocab import NS

_SAFE_RUN = r"^[A-Za-z0-9._~\-\x{00A0}-\x{10FFFF}]*\z"
_SAFE_CHAR = r"^[A-Za-z0-9._~\-\x{00A0}-\x{10FFFF}]\z"
_ASCII_RUN = r"^[\x{0020}-\x{007E}]*\z"


def _encode_ascii(col: Column) -> Column:
    """Printable ASCII by the form encoder, with its three departures put right (blank, ``*``, ``~``)."""
    out = F.url_encode(col)
    for ch, ref in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(ch), F.lit(ref))
    return out


def iri_encode(col: Column) -> Column:
    chars = F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0))  # one element per code point
    encoded = F.array_join(
        F.transform(
            chars,
            lambda c: F.when(c.rlike(_SAFE_CHAR), c).otherwise(
                F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )
    return (F.when(col.rlike(_SAFE_RUN), col)
            .when(col.rlike(_ASCII_RUN), _encode_ascii(col))  # common case
            .otherwise(encoded))                              # control characters, or unsafe beside non-ASCII


def iri_template(col: Column, ns: str = NS) -> Column:
    """``ns{col}``; null or empty source gives no IRI (MAP5, M1)."""
    return F.when(col.isNull() | (col == F.lit("")), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(ns), iri_encode(col))
    )


def local_name(col: Column) -> Column:
    """Text after the last ``#`` (STRAFTER on ``#``); ``""`` when there is none."""
    return F.when(F.instr(col, "#") > 0, F.substring_index(col, "#", -1)).otherwise(F.lit(""))
