"""Dotted JSON path getter over VARIANT (UNI1), with the source's step rules:

* a step on SQL NULL (missing) stays NULL (C2);
* a step on an array maps over its elements with the key taken literally; a missing
  key gives JSON null; if any element is not an object the step is abandoned and
  the array stays as it was (C3);
* a ``key[*]`` step on a non-array value: ``[*]`` is stripped, the member must be an
  array; a missing member gives NULL; a member that is not an array, or a value that
  is not an object, leaves the value unchanged (C4, C5);
* a plain step on an object takes the member (missing -> NULL);
* a plain step on a primitive or JSON null leaves it unchanged (C1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _member_path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def is_object(v: Column) -> Column:
    # a cast to an empty struct succeeds only on objects and extracts no member
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def json_null() -> Column:
    return F.parse_json(F.lit("null"))


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, _member_path(key), "variant")


def step(v: Column, key: str) -> Column:
    arr = F.try_variant_get(v, "$", "array<variant>")
    mapped = F.to_variant_object(F.transform(arr, lambda e: F.coalesce(member(e, key), json_null())))
    over_array = F.when(F.forall(arr, lambda e: is_object(e)), mapped).otherwise(v)
    if "[*]" in key:
        m = member(v, key.replace("[*]", ""))
        other = (F.when(~is_object(v), v).when(m.isNull(), F.lit(None).cast("variant"))
                 .when(is_array(m), m).otherwise(v))
    else:
        other = F.when(is_object(v), member(v, key)).otherwise(v)
    return F.when(v.isNull(), F.lit(None).cast("variant")).when(arr.isNotNull(), over_array).otherwise(other)


def _step_once(v: Column, key: str) -> Column:
    """``step`` with ``v`` computed once, and outside generated code: what is seldom read would swell it."""
    return F.element_at(F.transform(F.array(v), lambda x: step(x, key)), 1)


def path_value(v: Column, path: str) -> Column:
    """The value at a dotted path. A member of objects within objects, the common case, is taken in one go; whatever is not
    found so (or has a ``[*]``) goes step by step."""
    keys = path.split(".")
    slow = v
    for key in keys:
        slow = _step_once(slow, key)
    if any("[*]" in k for k in keys):
        return slow
    return F.coalesce(F.try_variant_get(v, "$" + "".join(_member_path(k)[1:] for k in keys), "variant"), slow)


def with_paths(df: DataFrame, doc: str, paths: dict[str, str], overrides: str | None = None) -> DataFrame:
    """Adds one VARIANT column per ``{out_name: path}``. ``overrides`` (MAP<STRING,STRING>) holds top-level string keys
    added by normalisation; a path whose first key is there reads it from the map (further steps leave a string as it is)."""
    out = []
    for name, path in paths.items():
        value = path_value(F.col(doc), path)
        first = path.split(".")[0]
        if overrides is not None and "[*]" not in first:
            o = F.try_element_at(F.col(overrides), F.lit(first))
            value = F.when(o.isNotNull(), o.cast("variant")).otherwise(value)
        out.append(value.alias(name))
    return df.select(*[c for c in df.columns if c not in paths], *out)


def variant_strings(v: Column) -> Column:
    """ARRAY<STRING> view of a value: array -> elements, JSON null/NULL -> empty,
    anything else -> one element (strings unquoted, others as JSON text)."""
    def one(e):
        s = F.try_variant_get(e, "$", "string")
        return F.when(F.is_variant_null(e), F.lit(None).cast("string")).otherwise(F.coalesce(s, F.to_json(e)))

    arr = F.try_variant_get(v, "$", "array<variant>")
    as_list = F.filter(F.transform(arr, one), lambda x: x.isNotNull())
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return (F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<string>"))
            .when(arr.isNotNull(), as_list).otherwise(F.array(text)))
