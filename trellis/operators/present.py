"""Presenting search results as columns (PRS1-PRS8).

Everything but the two HTML passes (block snippet, plain text) is a built-in
expression; the HTML passes run once per distinct text of the results in Arrow-batched tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions.text import collapse_ws
from trellis.operators.extract import html_text_and_blocks
from trellis.session import DEFAULT_BROADCAST_BYTES, broadcast_if_small, cut_lineage, estimated_bytes, joined_in_place, stored


def snippet(col: Column, chars: int = V.SNIPPET_CHARS) -> Column:
    """PRS6: whole text when shorter than ``chars``, else the first ``chars`` + '...'."""
    return F.when(F.length(col) < chars, col).otherwise(F.concat(F.substring(col, 1, chars), F.lit("...")))


def display_title(title: Column, types: Column, untitled: str = V.UNTITLED_POST) -> Column:
    """PRS1."""
    return F.when(title.isNotNull(), title).when(F.instr(types, "Post") > 0, F.lit(untitled))


def source_system(types: Column) -> Column:
    """PRS2."""
    return (F.when(F.instr(types, "Confluence") > 0, F.lit("Confluence"))
            .when(F.instr(types, "Teams") > 0, F.lit("Teams")).otherwise(F.lit("")))


def long_date(iso: Column) -> Column:
    """PRS3: ``5 March 2024``, the UTC date of the instant, whatever the session zone."""
    wall_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(iso).cast("timestamp_ntz"))
    return F.date_format(wall_utc, "d MMMM yyyy")


def breadcrumb(titles: Column, links: Column, sep: str = V.ANCESTOR_SEPARATOR) -> Column:
    """PRS7: ``ARRAY<STRUCT<title, link>>`` from the root down (the lists run from the nearest
    ancestor up); null when the lists differ in length."""
    t = F.split(titles, sep, -1)
    lk = F.split(links, sep, -1)
    z = F.reverse(F.arrays_zip(t.alias("title"), lk.alias("link")))
    return F.when(titles.isNotNull() & links.isNotNull() & (F.size(t) == F.size(lk)), z)


def date_line(created: Column, updated: Column) -> Column:
    """PRS8."""
    return (F.when(updated.isNotNull(), F.concat(F.lit("Updated "), long_date(updated)))
            .when(created.isNotNull(), F.concat(F.lit("Created "), long_date(created))))


def _parsed(texts: DataFrame, snippet_chars: int, blocks: int) -> DataFrame:
    """``_by_block, _whole`` instead of the ``_html`` of each row."""
    keep = [c for c in texts.columns if c != "_html"]
    parsed = html_text_and_blocks(texts, "_html", "_plain", "_blocks")
    block_snip = F.array_join(F.slice(F.col("_blocks"), 1, blocks), V.BLOCK_SEPARATOR)
    return parsed.select(*keep, snippet(block_snip, snippet_chars).alias("_by_block"), snippet(F.col("_plain"), snippet_chars).alias("_whole"))


def _has_markup(col: Column) -> Column:
    return F.coalesce(col.rlike("<|&[#A-Za-z]"), F.lit(False))


def shown_contents(contents: DataFrame, snippet_chars: int = V.SNIPPET_CHARS, blocks: int = V.SNIPPET_BLOCKS) -> DataFrame:
    """``s, content_id, _by_block, _whole`` of ``contents`` (s, content_id, content): what is shown of every content. A text with a tag
    or a possible character reference is parsed once, whoever has it; the others stay where they lie."""
    markup = _has_markup(F.col("content"))
    plain = contents.where(~markup).select("s", "content_id", _no_block(snippet_chars).alias("_by_block"), snippet(collapse_ws(F.col("content")), snippet_chars).alias("_whole"))
    html = contents.where(markup)
    parsed = _parsed(html.groupBy("content_id").agg(F.first("content").alias("_html")), snippet_chars, blocks)
    return plain.unionByName(html.select("s", "content_id").join(broadcast_if_small(cut_lineage(parsed)), "content_id"))


def _no_block(snippet_chars: int) -> Column:
    return F.lit("") if snippet_chars > 0 else snippet(F.lit(""), snippet_chars)


def present(results: DataFrame, snippet_chars: int = V.SNIPPET_CHARS, blocks: int = V.SNIPPET_BLOCKS,
            untitled: str = V.UNTITLED_POST, contents: DataFrame | None = None) -> DataFrame:
    """Adds display columns to search results (keeps every input column). Results without texts take what is shown of them from
    ``contents`` (s, content_id, content): snippets meet the results, not texts."""
    df = results.withColumn("source", source_system(F.col("types")))
    if "content" not in results.columns:
        wanted = broadcast_if_small(stored(results.where(F.col("content_id").isNotNull()).select("s").distinct()))
        shown = stored(shown_contents(contents.join(wanted, "s", "left_semi"), snippet_chars, blocks))
        if estimated_bytes(shown) <= DEFAULT_BROADCAST_BYTES:
            df = df.join(F.broadcast(shown), ["s", "content_id"], "left")
        else:
            df = joined_in_place(df, shown, "content_id", "left")
        whole = F.coalesce("_whole", snippet(F.lit(""), snippet_chars))
        return _displayed(df, whole, F.coalesce("_by_block", _no_block(snippet_chars)), untitled)
    # many results share a text: each text with a tag or a possible character reference is parsed once, known by its digest, and
    # only the snippets that come of it meet the results
    markup = _has_markup(F.col("content"))
    df = df.withColumn("_digest", F.when(markup, F.sha2(F.col("content").cast("binary"), 256)))
    texts = df.where(markup).groupBy("_digest").agg(F.first("content").alias("_html"))
    parsed = broadcast_if_small(cut_lineage(_parsed(texts, snippet_chars, blocks)))
    df = df.join(parsed, "_digest", "left")
    whole = F.when(markup, F.col("_whole")).otherwise(snippet(collapse_ws(F.coalesce("content", F.lit(""))), snippet_chars))
    by_block = F.when(markup, F.col("_by_block")).otherwise(_no_block(snippet_chars))
    return _displayed(df, whole, by_block, untitled).drop("_digest")


def _displayed(df: DataFrame, whole: Column, by_block: Column, untitled: str) -> DataFrame:
    """The display columns, from the two snippets of a result's content."""
    shown = F.when(F.col("source") == "Confluence", by_block).otherwise(whole)
    crumbs = breadcrumb(F.col("ancestorTitles"), F.col("ancestorLinks"))
    return (
        df.withColumn("displayTitle", display_title(F.col("title"), F.col("types"), untitled))
        .withColumn("snippet", shown)
        .withColumn("created", long_date(F.col("creationTime")))
        .withColumn("updated", long_date(F.col("lastUpdateTime")))
        .withColumn("dateLine", date_line(F.col("creationTime"), F.col("lastUpdateTime")))
        .withColumn("breadcrumb", crumbs)
        .withColumn("breadcrumbText", F.array_join(F.transform(crumbs, lambda x: x["title"]), V.BREADCRUMB_SEPARATOR))
        .withColumn("breadcrumbLinks", F.array_join(F.transform(crumbs, lambda x: x["link"]), V.BREADCRUMB_SEPARATOR))
        .drop("_by_block", "_whole")
    )
