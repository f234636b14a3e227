"""SRC5: triples from a directory, as parquet (our format) or line-oriented N-Triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import with_once

_TERM = r'(?:<([^>]*)>|(_:[^\s]+))'
# possessive runs: recursion depth follows escape sequences, not characters (long texts)
_OBJ = r'(?:<([^>]*)>|(_:[^\s]+)|"((?:[^"\\]++|\\.)*+)"(?:@([A-Za-z0-9\-]+)|\^\^<([^>]*)>)?)'
_LINE = r"^\s*" + _TERM + r"\s*<([^>]*)>\s*" + _OBJ + r"\s*\.\s*(?:#.*)?$"
_NO_TRIPLE = r"^\s*(?:#.*)?$"


def _utf16_units(cp):
    """Hex of the UTF-16 code units of a code point column (one or a surrogate pair)."""
    hi = F.lit(0xD800) + F.shiftright(cp - F.lit(0x10000), 10)
    lo = F.lit(0xDC00) + (cp - F.lit(0x10000)).bitwiseAND(F.lit(0x3FF))
    h4 = lambda v: F.lpad(F.hex(v), 4, "0")
    return F.when(cp < F.lit(0x10000), h4(cp)).otherwise(F.concat(h4(hi), h4(lo)))


def _uchars(x):
    """``\\uXXXX`` / ``\\UXXXXXXXX`` escapes: every part is turned into UTF-16BE bytes (escapes
    as their code units, plain text re-encoded) and the byte string is decoded once, so
    surrogate pairs written as two escapes come out whole."""
    parts = F.split(x, r"(?=\\[uU])")

    def to_bytes(part):
        is_u = part.rlike(r"^\\u[0-9A-Fa-f]{4}")
        is_big = part.rlike(r"^\\U[0-9A-Fa-f]{8}")
        u_bytes = F.concat(F.unhex(F.substring(part, 3, 4)), F.encode(F.substring(part, 7, 1 << 30), "UTF-16BE"))
        cp = F.conv(F.substring(part, 3, 8), 16, 10).cast("int")
        big_bytes = F.concat(F.unhex(_utf16_units(cp)), F.encode(F.substring(part, 11, 1 << 30), "UTF-16BE"))
        return F.when(is_u, u_bytes).when(is_big, big_bytes).otherwise(F.encode(part, "UTF-16BE"))

    joined = F.aggregate(F.transform(parts, to_bytes), F.lit(b"").cast("binary"), lambda acc, b: F.concat(acc, b))
    return F.when(x.rlike(r"\\[uU]"), F.decode(joined, "UTF-16BE")).otherwise(x)


def _unescape(c):
    """Single pass in effect: split on escaped backslashes first, unescape the other
    sequences inside each piece, join the pieces with a plain backslash."""
    def piece(x):
        for pat, rep in ((r'\\"', '"'), (r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"),
                         (r"\\b", "\b"), (r"\\f", "\f"), (r"\\'", "'")):
            x = F.regexp_replace(x, pat, rep)
        return _uchars(x)

    return F.array_join(F.transform(F.split(c, r"\\\\"), piece), "\\")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, o_kind, o_lang, o_dtype``: one triple per line, a comment may follow; comment lines and blank lines
    are skipped, any other line fails the read. Typed literals keep the lexical form and the IRI of their datatype.

    A line is matched once: the groups come out between line feeds, which no line holds. Lines in the usual form (terms
    with one blank between, a literal without quotes or escapes inside) are cut at their brackets instead."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("<")) | ~F.col("value").rlike(_NO_TRIPLE))
    parts = F.split(F.regexp_replace("value", _LINE, "$1\n$2\n$3\n$4\n$5\n$6\n$7\n$8"), "\n")
    bad = F.raise_error(F.concat(F.lit("not a triple: "), F.substring(F.get("x", F.lit(0)), 1, 200))).cast("array<string>")
    # a generator's input is taken once, whatever columns are read later
    lines = with_once(lines, "h", F.split("value", ">", 3))
    s, p, rest = (F.get("h", F.lit(i)) for i in range(3))
    usual = F.startswith("value", F.lit("<")) & F.startswith(p, F.lit(" <")) & F.startswith(rest, F.lit(' "')) & F.endswith(rest, F.lit('" .')) & (F.length(rest) >= 5)
    iri = F.startswith("value", F.lit("<")) & F.startswith(p, F.lit(" <")) & F.startswith(rest, F.lit(" <")) & F.endswith(rest, F.lit("> ."))
    inner = lambda n: F.substring(rest, F.lit(3), F.length(rest) - n)
    lines = with_once(lines, "o", F.when(usual | iri, inner(5))).select("value", "h", "o")
    none = F.lit("")
    cut = lambda *o: F.array(F.substring(s, 2, 1 << 30), none, F.substring(p, 3, 1 << 30), *o)
    lines = with_once(lines, "x", F.when(usual & ~F.contains("o", F.lit('"')) & ~F.contains("o", F.lit("\\")), cut(none, none, F.col("o"), none, none))
                      .when(iri & ~F.contains("o", F.lit(">")), cut(F.col("o"), none, none, none, none)).otherwise(parts))
    lines = lines.select(F.explode(F.array(F.when(F.size("x") == 8, F.col("x")).otherwise(bad))).alias("x"))
    g = lambda i: F.get("x", F.lit(i - 1))
    nz = lambda i: F.when(g(i) != "", g(i))
    plain = F.when(F.contains(g(6), F.lit("\\")), _unescape(g(6))).otherwise(g(6))
    return lines.select(
        F.coalesce(nz(1), nz(2)).alias("s"),
        g(3).alias("p"),
        F.coalesce(nz(4), nz(5), plain).alias("o"),
        F.when(nz(4).isNotNull() | nz(5).isNotNull(), F.lit("iri")).otherwise(F.lit("literal")).alias("o_kind"),
        nz(7).alias("o_lang"),
        nz(8).alias("o_dtype"),
    )


def load_triples(spark: SparkSession, path: str, graph: str | None = None, fmt: str = "parquet") -> DataFrame:
    """All triples under ``path`` as one graph (column ``g`` when a name is given), with ``o_dtype`` where the files hold it."""
    df = spark.read.parquet(path) if fmt == "parquet" else read_ntriples(spark, path)
    df = df.select("s", "p", "o", "o_kind", "o_lang", *[c for c in ("o_dtype",) if c in df.columns])
    return df.withColumn("g", F.lit(graph)) if graph else df
