"""Records of a contract: projection of parsed JSON, typed cells, shape checks.

Values keep their JSON text and a type tag from reading to scoring, so a string in a
number's place is seen as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.values import tag_json

_ANY_MAP = "map<string,string>"


def entries(obj: Column) -> Column:
    """A JSON object's members as a map of names to JSON text; null for anything else.

    Nested values and numbers keep their text; strings lose their quotes, so use
    :func:`tagged_entries` where types matter.
    """
    return F.from_json(obj, _ANY_MAP)


def tagged_entries(obj: Column) -> Column:
    """A map of names to struct(t, s): the type tag and the text of each member.

    A member written as a string is one even if it looks like a number: its raw text, found
    through the variant's type, tells.
    """
    variant = F.try_parse_json(obj)
    members = F.coalesce(F.from_json(obj, _ANY_MAP), F.create_map().cast(_ANY_MAP))
    types = F.schema_of_variant(variant)
    # OBJECT<a: STRING, b: BIGINT>: a member is text exactly if its type says so
    is_text = lambda k: F.regexp_like(types, F.concat(F.lit("[<,] ?`?\\Q"), k, F.lit("\\E`?: STRING[,>]")))
    tag = lambda k, v: F.when(v.isNull(), "null").when(F.coalesce(is_text(k), F.lit(False)), "str").otherwise(tag_json(v))
    return F.transform_values(members, lambda k, v: F.struct(tag(k, v).alias("t"), v.alias("s")))


def coerce_list(value: Column) -> tuple[Column, Column]:
    """(array of JSON texts, original type): a list as it is, an object as its only entry, anything else empty."""
    t = tag_json(value)
    listed = F.when(t == "list", F.from_json(value, "array<string>")).when(t == "dict", F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(listed, F.array().cast("array<string>")), t


def project_entries(items: Column, allowed: list[str]) -> tuple[Column, Column]:
    """(objects cut to the allowed keys, issues): entries that are no objects are dropped, every issue names its position."""
    names = F.array(*[F.lit(k) for k in allowed])
    is_object = lambda x: F.coalesce(tag_json(x) == "dict", F.lit(False))
    objects = F.transform(F.filter(items, is_object), lambda x: F.map_filter(F.from_json(x, _ANY_MAP), lambda k, v: F.array_contains(names, k)))

    def issue(x: Column, i: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))
        extra, missing = F.array_except(keys, names), F.array_except(names, keys)
        said = F.concat_ws("; ", F.when(F.size(extra) > 0, F.concat(F.lit("extra: "), F.array_join(F.array_sort(extra), ","))), F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ","))))
        return F.when(~is_object(x), F.concat(i.cast("string"), F.lit(": not an object"))).when(said != "", F.concat(i.cast("string"), F.lit(": "), said))

    return objects, F.filter(F.transform(items, issue), lambda s: s.isNotNull())


def clean_extras(obj: Column, registry: list[str]) -> tuple[Column, Column, Column]:
    """(members without nulls, dropped null keys, kept keys that no registry names)."""
    m = F.coalesce(entries(obj), F.create_map().cast(_ANY_MAP))
    is_null = lambda v: v.isNull() | (v == "null")
    kept = F.map_filter(m, lambda k, v: ~is_null(v))
    return kept, F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: is_null(v)))), F.array_sort(F.array_except(F.map_keys(kept), F.array(*[F.lit(k) for k in registry])))


def to_contract(parsed: DataFrame, json: str, contract: list[str]) -> DataFrame:
    """One text column for each key of the contract, in its order, with the missing and the extra keys."""
    from tallyspark.operators.repair import contract_keys

    missing, extra = contract_keys(F.col(json), contract)
    m = entries(F.col(json))
    rest = [c for c in parsed.columns if c != json]
    return parsed.withColumns({"__m": m, "missing_keys": missing, "extra_keys": extra}).select(*rest, *[F.try_element_at("__m", F.lit(k)).alias(k) for k in contract], "missing_keys", "extra_keys")


def registry_from_markdown(text: str) -> list[str]:
    """The keys in back ticks before the first dash of each bullet."""
    import re

    out: list[str] = []
    for line in text.splitlines():
        if line.lstrip().startswith(("- ", "* ")):
            out += re.findall(r"`([^`]+)`", line.split("—")[0])
    return list(dict.fromkeys(out))


def parse_summary(parsed: DataFrame, status: str = "status") -> DataFrame:
    """Counts by status, and how many documents each repair touched."""
    return parsed.groupBy(status).agg(F.count("*").alias("n"), F.count_if("fence").alias("fences"), F.count_if("extracted").alias("extracted"), F.coalesce(F.sum("trailing_commas"), F.lit(0)).alias("trailing_commas"), F.count_if(F.size("duplicate_keys") > 0).alias("with_duplicates"))
