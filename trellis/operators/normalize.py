"""Normalising raw entities (NRM1-NRM12): projections, filters and equi-joins.

Input rows come from :func:`trellis.sources.landed.flatten_responses`:
``(label, request_id, parent_key, page_no, item_no, item VARIANT)``. Output rows carry
``doc`` (VARIANT after key renaming), ``_json`` (its canonical text) and ``ext``
(``MAP<STRING,STRING>`` of keys the crawler adds: ``_id`` override, ``spaceId``,
``ancestor``, ``pageId``, ``teamId``), which the path getter reads first.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.jsonpath import is_object
from trellis.session import with_once

log = logging.getLogger(__name__)

_EMPTY_EXT = "map<string,string>"


def _get(col: str, path: str, t: str = "string"):
    return F.try_variant_get(F.col(col), path, t)


def clean_items(items: DataFrame) -> DataFrame:
    """NRM2 then NRM1: keep JSON objects only; rename the key ``id`` to ``_id`` at every
    depth and ``@odata.x`` to ``odatax``, on canonical JSON text (no blanks around
    ``:``), so the same text patterns as the source system apply; re-parse.

    Every item is written as text and parsed once."""
    keep = [c for c in items.columns if c != "item"]
    objects = with_once(items.where(is_object(F.col("item"))), "_text", F.replace(F.to_json("item"), F.lit('"id":'), F.lit('"_id":'))).drop("item")
    renamed = F.when(F.contains("_text", F.lit("@odata")), F.regexp_replace("_text", "@odata.", "odata")).otherwise(F.col("_text"))
    return (with_once(objects, "doc", F.try_parse_json(renamed)).select(*keep, "doc")
            .where(F.col("doc").isNotNull()).transform(with_derived))


def with_derived(items: DataFrame) -> DataFrame:
    """``_json`` and the empty ``ext`` of cleaned items."""
    return items.withColumn("_json", F.to_json("doc")).withColumn("ext", F.create_map().cast(_EMPTY_EXT))


def _with_ext(df: DataFrame, **kv) -> DataFrame:
    pairs = []
    for k, v in kv.items():
        pairs.append(F.map_from_arrays(F.array(F.lit(k)), F.array(v.cast("string"))))
    extra = F.map_filter(F.map_concat(*pairs), lambda k, v: v.isNotNull())
    return df.withColumn("ext", F.map_concat(F.map_filter(F.col("ext"), lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra))


def normalize_users(members: DataFrame) -> DataFrame:
    """NRM3: members of all groups having ``personalSpace``; one row per distinct user."""
    return members.where(_get("doc", "$.personalSpace", "variant").isNotNull()).dropDuplicates(["_json"])


def normalize_spaces(spaces: DataFrame) -> DataFrame:
    """NRM4: the id becomes the tail after the last ``/`` of ``_expandable.homepage``."""
    home = _get("doc", "$._expandable.homepage")
    return _with_ext(spaces, _id=F.substring_index(home, "/", -1))


def space_keys(spaces: DataFrame) -> DataFrame:
    return spaces.select(_get("doc", "$.key").alias("_space_key"), F.col("ext")["_id"].alias("_space_id"))


def normalize_pages(pages: DataFrame, spaces: DataFrame) -> DataFrame:
    """NRM5-NRM7: attach ``spaceId`` (pages are listed under their space key), drop the
    space home page, ``ancestor`` = id of the last element of ``ancestors`` or ``""``."""
    j = pages.join(space_keys(spaces), pages["parent_key"] == F.col("_space_key"), "inner")
    pid = _get("doc", "$._id")
    last = F.try_element_at(_get("doc", "$.ancestors", "array<variant>"), F.lit(-1))
    anc = F.coalesce(F.try_variant_get(last, "$._id", "string"), F.lit(""))
    out = _with_ext(j, spaceId=F.col("_space_id"), ancestor=anc)
    return out.where(pid.isNull() | (pid != F.col("_space_id"))).drop("_space_key", "_space_id")


def pages_with_comments(pages: DataFrame) -> DataFrame:
    """NRM8: ``children.comment.size > 0``; no ``children`` -> excluded."""
    return pages.where(F.coalesce(_get("doc", "$.children.comment.size", "bigint"), F.lit(0)) > 0)


def normalize_comments(comments: DataFrame, pages: DataFrame) -> DataFrame:
    """NRM9: comments are listed under their page; attach ``pageId`` and ``spaceId``
    of that page (only pages that have comments are asked)."""
    p = pages_with_comments(pages).select(_get("doc", "$._id").alias("_page_id"), F.col("ext")["spaceId"].alias("_page_space"))
    j = comments.join(p, comments["parent_key"] == F.col("_page_id"), "inner")
    return _with_ext(j, pageId=F.col("_page_id"), spaceId=F.col("_page_space")).drop("_page_id", "_page_space")


def normalize_channels(channels: DataFrame, teams: DataFrame) -> DataFrame:
    """NRM10: channels are listed under their team; attach ``teamId``."""
    t = teams.select(_get("doc", "$._id").alias("_team_id"))
    j = channels.join(t, channels["parent_key"] == F.col("_team_id"), "inner")
    return _with_ext(j, teamId=F.col("_team_id")).drop("_team_id")


def normalize_posts(posts: DataFrame) -> DataFrame:
    """NRM11: keep ``messageType = 'message'``."""
    return posts.where(_get("doc", "$.messageType") == F.lit("message"))


def retrieval_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """NRM12: rows retrieved per label in one aggregation over all labels; labels that
    retrieved nothing get a zero row, so they can be warned on."""
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for label, df in tables.items():
        r = df.select(F.lit(label).alias("label"))
        rows = r if rows is None else rows.unionByName(r)
    counted = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = spark.createDataFrame([(lb,) for lb in tables], "label string")
    return labels.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def warn_zero_counts(counts: DataFrame) -> list[str]:
    """NRM12: log a warning per label that retrieved nothing (one row per label)."""
    empty = [r["label"] for r in counts.where(F.col("n") == 0).collect()]
    for label in empty:
        log.warning("no %s were retrieved", label)
    return empty
