"""Metadata columns: JSON texts, read and merged as VARIANT values, so that types survive."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Under this key a merge keeps a text that is no JSON.
UNPARSED = "unparsed"


def value(metadata: Column, key: str, kind: str = "string") -> Column:
    """The entry of a key in a type; null where there is none, or where it can't be cast."""
    return F.try_variant_get(F.try_parse_json(metadata), f'$["{key}"]', kind)


def repaired(text: str) -> str:
    """JSON that VARIANT refuses: of repeated keys the last stays, in the place of the first; other texts become an entry."""
    try:
        return json.dumps(json.loads(text, object_pairs_hook=dict), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except (ValueError, RecursionError):
        return json.dumps({UNPARSED: text}, ensure_ascii=False, separators=(",", ":"))


def _quoted(v: Column) -> Column:
    return F.coalesce(F.to_json(v.cast("variant")), F.lit("null"))


def merged(rows: DataFrame, new: dict[str, Column], column: str = "metadata") -> DataFrame:
    """``rows`` with entries added to the JSON in ``column``: of two values of one key the new one stays, in its place at the end.

    Null and blank texts are empty objects.  Numbers, lists, objects, booleans and nulls keep their types, and other keys their order.  A list gets the new entries
    as a further element; a bare value becomes a list with them.  Of repeated keys the last value stays.  A text that is no JSON is kept whole under ``UNPARSED``.
    Only texts that VARIANT refuses pass through Python.
    """
    text = F.coalesce(F.nullif(F.trim(F.col(f"`{column}`").cast("string")), F.lit("")), F.lit("{}"))
    # A whole value; VARIANT overlooks what follows one.
    whole = text.rlike(r'(?s)^(\{.*\}|\[.*\]|".*"|[^\s{}\[\]"]+)$')
    mend = F.pandas_udf(lambda s: s.map(repaired, na_action="ignore"), "string")
    kept = {c: F.col(f"`{c}`") for c in rows.columns if c != column}
    out = rows.select(*kept.values(), *[v.alias(f"_new{i}") for i, v in enumerate(new.values())], text.alias("_text"), (whole & F.try_parse_json(text).isNotNull()).alias("_fine"))
    out = out.withColumn("_mended", mend(F.when(~F.col("_fine"), F.col("_text"))))
    out = out.withColumn("_text", F.coalesce("_mended", "_text")).withColumn("_v", F.try_parse_json("_text")).withColumn("_kind", F.schema_of_variant("_v"))
    entries = F.when(F.col("_kind").startswith("OBJECT"), F.col("_v").cast("map<string,variant>"))
    out = out.withColumns({"_entries": entries, "_keys": F.array_distinct(F.json_object_keys("_text"))})
    old = F.transform(F.filter("_keys", lambda k: ~k.isin(*new)), lambda k: F.concat(_quoted(k), F.lit(":"), F.coalesce(F.to_json(F.element_at("_entries", k)), F.lit("null"))))
    added = [F.concat(F.lit(json.dumps(k) + ":"), _quoted(F.col(f"_new{i}"))) for i, k in enumerate(new)]
    object_ = F.concat(F.lit("{"), F.array_join(F.concat(old, F.array(*added)), ","), F.lit("}"))
    entry = F.concat(F.lit("{"), F.concat_ws(",", *added), F.lit("}"))
    listed = F.to_json("_v")
    list_ = F.when(listed == "[]", F.concat(F.lit("["), entry, F.lit("]"))).otherwise(F.concat(F.substring(listed, F.lit(1), F.length(listed) - 1), F.lit(","), entry, F.lit("]")))
    bare = F.concat(F.lit("["), F.coalesce(listed, F.lit("null")), F.lit(","), entry, F.lit("]"))
    result = F.when(F.col("_kind").startswith("OBJECT"), object_).when(F.col("_kind").startswith("ARRAY"), list_).otherwise(bare)
    return out.select(*[result.alias(c) if c == column else F.col(f"`{c}`") for c in rows.columns])
