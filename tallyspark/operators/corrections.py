"""Conflict-checked corrections of gold values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"^(?P<name>[A-Za-z_][A-Za-z0-9_]*)(?:\[(?P<key>[A-Za-z_][A-Za-z0-9_]*)=(?P<value>[^\]]*)\])?$")


def parse_path(path: str) -> list[tuple[str, str | None, str | None]]:
    """``a.b[key=value].c`` as (name, key, value); the last segment must be plain."""
    out, depth, part = [], 0, ""
    parts = []
    for c in path:
        depth += (c == "[") - (c == "]")
        if c == "." and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    for p in [*parts, part]:
        m = _SEGMENT.match(p)
        if not m:
            raise ValueError(f"bad path segment {p!r} in {path!r}")
        out.append((m["name"], m["key"], m["value"]))
    if out[-1][1] is not None:
        raise ValueError(f"the last segment of {path!r} selects an entry; it must name a value")
    return out


_PART = r"([A-Za-z_][A-Za-z0-9_]*)(?:\[([A-Za-z_][A-Za-z0-9_]*)=([^\]]*)\])?"


def path_segments(path: Column) -> Column:
    """:func:`parse_path` of a column: an array of ``name, key, value``, null where the path is bad."""
    ok = path.rlike(rf"^{_PART}(?:\.{_PART})*\z") & ~path.endswith("]")
    part = lambda x, i: F.when(F.contains(x, F.lit("[")), F.regexp_extract(x, _PART, i))
    found = F.transform(F.regexp_extract_all(path, F.lit(_PART), F.lit(0)), lambda x: F.struct(F.substring_index(x, "[", 1).alias("name"), part(x, 2).alias("key"), part(x, 3).alias("value")))
    return F.when(ok, found)


def _object(node: Column) -> Column:
    """A VARIANT's keys and values, null if it is no object."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def _is_text(node: Column, text: Column) -> Column:
    return F.coalesce((F.try_variant_get(node, "$", "string") == text) & (F.schema_of_variant(node) == "STRING"), F.lit(False))


def _selected(element: Column, key: Column, text: Column) -> Column:
    """Whether a list's element has the text under the key; ``name`` also meets ``name_new`` where there is no ``name``."""
    is_it = lambda fields: F.coalesce(F.when(F.map_contains_key(fields, key), _is_text(F.try_element_at(fields, key), text)).otherwise((key == "name") & _is_text(F.try_element_at(fields, F.lit("name_new")), text)), F.lit(False))
    return F.element_at(F.transform(F.array(_object(element)), is_it), 1)


def resolve(record: Column, path: Column) -> Column:
    """``struct<value VARIANT, found, error>``: what a path of each row leads to in that row's VARIANT.

    The last segment names a value of an object; if the object lacks it, ``found`` is false
    and there is no error. Any other segment must exist, ``[key=value]`` must select exactly
    one element of a list, and everything on the way must be an object; else ``error`` says
    what is wrong and ``value`` is null.
    """
    state = lambda node, error: F.struct(node.alias("node"), error.alias("error"))
    nothing, fine = F.lit(None).cast("variant"), F.lit(None).cast("string")
    # computed once, however often the body asks for it: bodies of such functions share nothing by themselves
    bound = lambda x, body: F.element_at(F.transform(F.array(x), body), 1)

    def chosen(hits: Column, seg: Column) -> Column:
        size = F.size(hits)
        return F.when(size != 1, state(nothing, F.concat(F.lit("["), seg.key, F.lit("="), seg.value, F.lit("] matches "), size.cast("string")))).otherwise(state(F.try_element_at(hits, F.lit(1)), fine))

    def selected(items: Column, seg: Column) -> Column:
        return F.when(items.isNull(), state(nothing, F.concat(seg["name"], F.lit(" is no list")))).otherwise(bound(F.filter(items, lambda e: _selected(e, seg.key, seg.value)), lambda hits: chosen(hits, seg)))

    def entered(fields: Column, seg: Column) -> Column:
        child = F.try_element_at(fields, seg["name"])
        return (
            F.when(F.coalesce(~F.map_contains_key(fields, seg["name"]), F.lit(True)), state(nothing, F.concat(F.lit("no key "), seg["name"])))
            .when(seg.key.isNull(), state(child, fine))
            .otherwise(bound(F.try_variant_get(child, "$", "array<variant>"), lambda items: selected(items, seg)))
        )

    def step(s: Column, seg: Column) -> Column:
        return F.when(s.error.isNotNull(), s).otherwise(bound(_object(s.node), lambda fields: entered(fields, seg)))

    def walked(segments: Column) -> Column:
        last = F.element_at(segments, -1)["name"]
        parent = F.aggregate(F.slice(segments, F.lit(1), F.size(segments) - 1), state(record, fine), step)
        return bound(parent, lambda p: bound(_object(p.node), lambda fields: answer(p, fields, last)))

    def answer(p: Column, fields: Column, last: Column) -> Column:
        error = F.when(p.error.isNotNull(), p.error).when(fields.isNull(), F.concat(F.lit("the parent of "), last, F.lit(" is no object")))
        return F.struct(F.when(error.isNull(), F.try_element_at(fields, last)).alias("value"), (error.isNull() & F.coalesce(F.map_contains_key(fields, last), F.lit(False))).alias("found"), error.alias("error"))

    bad = F.struct(nothing.alias("value"), F.lit(False).alias("found"), F.lit("bad path").alias("error"))
    return bound(path_segments(path), lambda segments: F.when(segments.isNull(), bad).otherwise(walked(segments)))


def resolve_all(record: Column, paths: Column) -> Column:
    """An array of ``path, value, found, error`` (:func:`resolve`) for an array of paths into one record, which is computed once."""
    one = lambda r: F.transform(paths, lambda p: _with_path(p, resolve(r, p)))
    return F.element_at(F.transform(F.array(record), one), 1)


def _with_path(path: Column, x: Column) -> Column:
    return F.element_at(F.transform(F.array(x), lambda x: F.struct(path.alias("path"), x.value.alias("value"), x.found.alias("found"), x.error.alias("error"))), 1)


def correction_status(current: Column, expected_old: Column, new: Column) -> Column:
    """already_ok if the new value is there, apply if the expected old one is, else conflict."""
    return F.when(current.eqNullSafe(new), "already_ok").when(current.eqNullSafe(expected_old), "apply").otherwise("conflict")


def plan(cells: DataFrame, corrections: DataFrame, key: list[str], value: str, order: str | None = None) -> DataFrame:
    """Each correction with the cell's value when its turn comes, its status, and ``turn``, its place among those of its cell.

    Corrections of one cell are made one after another by ``order`` (by what they expect and
    set where none is given), each on what the ones before it have left.
    """
    joined = corrections.join(cells.select(*key, F.col(value).alias("stored"), F.lit(True).alias("found")), key, "left")
    turn = Window.partitionBy(*key).orderBy(*([order] if order else []), "expected_old", "new")
    earlier = F.collect_list(F.struct("expected_old", "new")).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    current = F.aggregate("earlier", F.struct(F.col("stored").alias("v")), lambda s, c: F.when(s.v.eqNullSafe(c.expected_old), F.struct(c.new.alias("v"))).otherwise(s)).v
    joined = joined.withColumns({"turn": F.row_number().over(turn), "earlier": earlier}).withColumn("current", current)
    status = F.when(F.col("found").isNull(), "conflict").otherwise(correction_status(F.col("current"), F.col("expected_old"), F.col("new")))
    return joined.withColumn("status", status).drop("found", "stored", "earlier")


def apply_all(cells: DataFrame, planned: DataFrame, key: list[str], value: str) -> DataFrame:
    """The cells with all corrections, or an error if one conflicts; a cell that several correct has the last one's value."""
    if planned.filter("status = 'conflict'").limit(1).count():
        raise ValueError("a correction conflicts; nothing is applied")
    todo = planned.filter("status = 'apply'").groupBy(*key).agg(F.max_by(F.struct(F.col("new").alias("new")), "turn").alias("__last"))
    joined = cells.join(todo, key, "left")
    return joined.withColumn(value, F.when(F.col("__last").isNotNull(), F.col("__last.new")).otherwise(F.col(value))).select(cells.columns)
