"""How values are printed in notices, and text prepared for finding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swiss_date(iso: Column) -> Column:
    """YYYY-MM-DD as DD.MM.YYYY; anything else is null."""
    return F.when(iso.rlike(r"^.{4}-[^-]{2}-[^-]{2}$"), F.concat_ws(".", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.left(iso, F.lit(4))))


def swiss_number(x: Column, decimals: int = 0) -> Column:
    """Thousands parted by an apostrophe: 1'000 or 189'123.50."""
    return F.replace(F.format_number(x, decimals), F.lit(","), F.lit("'"))


def renderings(kind: str, x: Column) -> Column:
    """The distinct texts under which a value of a kind (str, date, int, number) may be printed; null gives none."""
    plain = x.cast("string")
    other = {"date": lambda: swiss_date(plain), "int": lambda: swiss_number(x.cast("bigint")), "number": lambda: swiss_number(x.cast("double"), 2)}.get(kind, lambda: F.lit(None).cast("string"))()
    return F.array_distinct(F.array_compact(F.array(plain, other)))


def join_address_lines(text: Column) -> Column:
    """Address blocks on one line: a postcode's line goes to the line before it, the line after "c/o" to that one; never across blank lines."""
    care = F.regexp_replace(text, r"(?im)^([^\S\n]*c/o [^\n]*\S[^\S\n]*)\n[^\S\n]*(?=\S)", "$1, ")
    return F.regexp_replace(care, r"(?<=\S)([^\S\n]*)\n[^\S\n]*(?=[0-9]{4} \S)", "$1, ")


def first_line(text: Column) -> Column:
    """The first line, its white space collapsed."""
    return F.trim(F.regexp_replace(F.try_element_at(F.split(text, r"\R"), F.lit(1)), r"(?U)\s+", " "))


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """Placeholders replaced literally, in the order given."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit(name), value)
    return out


def fold_provider(slug: Column) -> Column:
    """The name before any slash, letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.try_element_at(F.split(slug, "/"), F.lit(1)), r"[^\p{L}\p{N}]", ""))


def provider_mismatch(pinned: Column, served: Column) -> Column:
    """Whether another provider served than was asked for; unknown if either is."""
    return fold_provider(pinned) != fold_provider(served)
