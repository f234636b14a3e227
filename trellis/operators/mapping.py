"""Mapping unified entities to triples (MAP1-MAP8).

A rule set is data: for one entity label, the class, the subject field and a list
of ``(predicate, kind, field)`` where kind is ``iri`` (object IRI from a template
over the field), ``literal`` (field value) or ``constant_iri``. One pass per
entity frame: every rule becomes an ``array<struct>`` of candidate triples, the
arrays are concatenated and inlined; null objects give no triple (MAP5) and array
fields give one triple per element (MAP6).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis import vocab as V
from trellis.functions.iri import iri_template

TRIPLE_COLUMNS = ("s", "p", "o", "o_kind", "o_lang")
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class EntityRules:
    label: str
    cls: str
    subject: str
    objects: tuple  # of (predicate IRI, kind, field), kind "iri" also (predicate IRI, kind, field, prefix of the template)
    prefix: str = ""  # of the subject template


# ---- fixed values: the seven entity rule sets --------------------------------------------
ENTITY_RULES = {
    "users": EntityRules("users", "Person", "name", (
        (V.TITLE, "literal", "name"),
        (V.EMAIL, "literal", "email"),
        (V.LINK, "literal", "link"),
    )),
    "spaces": EntityRules("spaces", "Space", "_id", (
        (V.OWL_SAMEAS, "iri", "name"),
        (V.TITLE, "literal", "name"),
        (V.LINK, "literal", "link"),
    )),
    "pages": EntityRules("pages", "Page", "_id", (
        (V.AUTHOR, "iri", "author"),
        (V.ANCESTOR, "iri", "ancestor"),
        (V.REFLEXIVE, "iri", "_id"),
        (V.TITLE, "literal", "title"),
        (V.LINK, "literal", "link"),
        (V.CONTENT, "literal", "content"),
        (V.CREATION_TIME, "literal", "creationTime"),
        (V.LAST_UPDATE_TIME, "literal", "lastUpdateTime"),
    )),
    "comments": EntityRules("comments", "Commentary", "_id", (
        (V.AUTHOR, "iri", "author"),
        (V.ANCESTOR, "iri", "ancestor"),
        (V.TITLE, "literal", "title"),
        (V.CONTENT, "literal", "content"),
        (V.LINK, "literal", "link"),
        (V.CREATION_TIME, "literal", "creationTime"),
        (V.LAST_UPDATE_TIME, "literal", "lastUpdateTime"),
    )),
    "teams": EntityRules("teams", "Team", "_id", (
        (V.OWL_SAMEAS, "iri", "name"),
        (V.TITLE, "literal", "name"),
        (V.CONTENT, "literal", "content"),
        (V.EMAIL, "literal", "email"),
        (V.LINK, "literal", "link"),
        (V.CREATION_TIME, "literal", "creationTime"),
    )),
    "channels": EntityRules("channels", "Channel", "_id", (
        (V.ANCESTOR, "iri", "ancestor"),
        (V.TITLE, "literal", "name"),
        (V.CONTENT, "literal", "content"),
        (V.EMAIL, "literal", "email"),
        (V.LINK, "literal", "link"),
        (V.CREATION_TIME, "literal", "creationTime"),
    )),
    "posts": EntityRules("posts", "Post", "_id", (
        (V.AUTHOR, "iri", "author"),
        (V.ANCESTOR, "iri", "ancestor"),
        (V.TITLE, "literal", "title"),
        (V.CONTENT, "literal", "content"),
        (V.LINK, "literal", "link"),
        (V.CREATION_TIME, "literal", "creationTime"),
        (V.LAST_UPDATE_TIME, "literal", "lastUpdateTime"),
    )),
}

_TRIPLE = T.StructType([
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("o_kind", T.StringType()),
    T.StructField("o_lang", T.StringType()),
])


def _struct(pred: str, obj: Column, kind: str) -> Column:
    return F.struct(
        F.lit(pred).alias("p"),
        obj.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"),
        F.lit(None).cast("string").alias("o_lang"),
    )


def _as_array(df: DataFrame, field: str) -> Column:
    """Field as ARRAY<STRING>: scalars wrapped, arrays kept, missing field -> empty."""
    if field not in df.columns:
        return F.array().cast("array<string>")
    dtype = df.schema[field].dataType
    col = F.col(field)
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(col.cast("array<string>"), F.array().cast("array<string>"))
    return F.when(col.isNull(), F.array().cast("array<string>")).otherwise(F.array(col.cast("string")))


def _template(col: Column, prefix: str, ns: str) -> Column:
    """IRI of a value after a prefix; none for an empty value."""
    return iri_template(F.concat(F.lit(prefix), F.when(col != "", col)) if prefix else col, ns)


def _subject(df: DataFrame, field: str, prefix: str, ns: str) -> Column:
    dtype = df.schema[field].dataType
    col = F.col(field)
    if isinstance(dtype, T.ArrayType):
        col = F.try_element_at(col, F.lit(1))
    return _template(col.cast("string"), prefix, ns)


def _iri_fn(pred: str, prefix: str, ns: str):
    return lambda x: _struct(pred, _template(x, prefix, ns), "iri")


def _literal_fn(pred: str):
    return lambda x: _struct(pred, x, "literal")


def map_to_triples(df: DataFrame, rules: EntityRules, ns: str = V.NS) -> DataFrame:
    """Apply all rules of one entity in one projection (MAP7): scalar fields become one
    struct each in a single array (code-generated); array fields (MAP6) add one struct
    per element. Duplicates are removed once, when graphs are assembled (set semantics)."""
    return _inlined(_candidates(df, rules, ns))


def _candidates(df: DataFrame, rules: EntityRules, ns: str = V.NS) -> DataFrame:
    """``(s, _t)``: each row's subject and the array of its triples, null objects among them."""
    scalars = [_struct(V.RDF_TYPE, F.lit(ns + rules.cls), "iri")]
    arrays = []
    for pred, kind, field, *prefix in rules.objects:
        prefix = prefix[0] if prefix else ""
        if kind == "constant_iri":
            scalars.append(_struct(pred, F.lit(field), "iri"))
            continue
        if kind not in ("iri", "literal"):
            raise ValueError(f"unknown object kind {kind!r}")
        if field not in df.columns:
            continue
        is_array = isinstance(df.schema[field].dataType, T.ArrayType)
        if is_array:
            values = _as_array(df, field)
            arrays.append(F.transform(values, _iri_fn(pred, prefix, ns) if kind == "iri" else _literal_fn(pred)))
        else:
            col = F.col(field).cast("string")
            scalars.append(_struct(pred, _template(col, prefix, ns) if kind == "iri" else col, kind))
    triples = F.array(*scalars)
    if arrays:
        triples = F.concat(triples, *arrays)
    return df.select(_subject(df, rules.subject, rules.prefix, ns).alias("s"), triples.alias("_t")).where(F.col("s").isNotNull())


def _inlined(candidates: DataFrame) -> DataFrame:
    return candidates.select("s", F.inline("_t")).where(F.col("o").isNotNull()).select(*TRIPLE_COLUMNS)


def map_entities(frames: dict[str, DataFrame], rules: dict[str, EntityRules] = ENTITY_RULES) -> DataFrame:
    """All labels into one triple frame; a label without a frame is skipped (MAP8)."""
    out = None
    for label, rule in rules.items():
        df = frames.get(label)
        if df is None:
            log.warning("no %s to map; skipped", label)
            continue
        t = map_to_triples(df, rule)
        out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError("no entity frame to map")
    return out


def map_entities_dealt(frames: dict[str, DataFrame], parts: int, rules: dict[str, EntityRules] = ENTITY_RULES) -> DataFrame:
    """:func:`map_entities`, dealt by subject into ``parts``: whole rows are shuffled, not a row a triple."""
    rows = None
    for label, rule in rules.items():
        df = frames.get(label)
        if df is None:
            log.warning("no %s to map; skipped", label)
            continue
        t = _candidates(df, rule)
        rows = t if rows is None else rows.unionByName(t)
    if rows is None:
        raise ValueError("no entity frame to map")
    return _inlined(rows.repartition(parts, "s"))


def map_entities_set(frames: dict[str, DataFrame], rules: dict[str, EntityRules] = ENTITY_RULES) -> DataFrame:
    """:func:`map_entities` without duplicates. Equal triples share their subject, so whole rows are shuffled by subject,
    not a row a triple; only triples of subjects with several rows are compared."""
    rows = None
    for label, rule in rules.items():
        df = frames.get(label)
        if df is None:
            log.warning("no %s to map; skipped", label)
            continue
        t = _candidates(df, rule)
        predicates = [V.RDF_TYPE, *(o[0] for o in rule.objects)]
        if len(set(predicates)) < len(predicates) or any(isinstance(f.dataType, T.ArrayType) for f in df.schema):
            t = t.withColumn("_t", F.array_distinct("_t"))  # one row may give a triple twice
        rows = t if rows is None else rows.unionByName(t)
    if rows is None:
        raise ValueError("no entity frame to map")
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("s")))
    return _inlined(counted.where("_n = 1")).unionByName(_inlined(counted.where("_n > 1")).distinct())


def map_table_rows(rows: DataFrame, subject_header: str, title_header: str, prefix: str = "row_",
                   ns: str = V.NS) -> DataFrame:
    """MAP9: extracted table rows (``row`` = MAP<header, value>, one per body row) to
    content-graph triples: subject from one column's value, title from another;
    rows lacking either give no triple."""
    subj = iri_template(F.concat(F.lit(prefix), F.col("row")[subject_header]), ns)
    return (rows.select(subj.alias("s"), F.col("row")[title_header].alias("o"))
            .where(F.col("s").isNotNull() & F.col("o").isNotNull())
            .select("s", F.lit(V.TITLE).alias("p"), "o", F.lit("literal").alias("o_kind"),
                    F.lit(None).cast("string").alias("o_lang"))
            .distinct())


def map_rows(rows: DataFrame, rules: list[EntityRules], ns: str = V.NS) -> DataFrame:
    """MAP9 with whole rule sets: extracted table rows (``row`` = MAP<header, value>) to content-graph triples, a set.

    Fields are headers. A row without a rule's subject gives that rule nothing; a header that a table lacks, or an
    empty cell, gives no triple."""
    out = None
    for rule in rules:
        headers = dict.fromkeys([rule.subject, *(o[2] for o in rule.objects if o[1] != "constant_iri")])
        cells = rows.select(*[F.when(F.col("row")[h] != "", F.col("row")[h]).alias(h) for h in headers])
        t = map_to_triples(cells, rule, ns)
        out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError("no rules for table rows")
    return out.distinct()
