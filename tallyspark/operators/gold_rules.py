"""Consistency of gold records with their notices, and of their fields with one another.

``notices`` rows hold a record's fields as columns (lists of people as arrays of structs,
``extras`` as a map of text) beside ``text``. Every rule is one predicate with its
evidence; :func:`rules.sweep` tests them all in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.rules import Rule, sweep, violations

RADIUS = 120

# Phrases that the rules look for.
_OLD_CITATION = r"SHAB Nr\.\s*[0-9]+\s+vom\s+[0-9]{2}\.[0-9]{2}\.[0-9]{4},\s*S\.\s*([0-9]+)"
_BISHER_ADDRESS = r"\[bisher:[^\]]*\b[0-9]{4}\s+[A-ZÄÖÜ][^\]]*\]"
_LABEL = r"(?:^|[.;]\s)([A-ZÄÖÜ][\w\- ]{2,60}?):"
_NOT_THE_COMPANY = ["Weitere Adressen", "Eingetragene Personen", "Ausgeschiedene Personen", "Zweigniederlassung", "Hauptsitz", "Firma Hauptsitz"]
_SEAT_MOVE = r"\bSitz neu:|Verlegung des Sitzes"
_INFLECTED = r"(?:isch|deutsch)(?:e|er|en|es)$"
_OPTING_OUT = r"(?s)eingeschränkte Revision verzichtet|verzichtet\b.{0,200}?auf eine eingeschränkte Revision"
_NOMINAL = r"zu je CHF|(?:[Aa]ktien|Stammanteil)[^.;\]]{0,80}?zu CHF\s*[0-9]"
_MUTATING = "Eingetragene Personen neu oder mutierend:"


def around(text: Column, found: Column, radius: int = RADIUS) -> Column:
    """The surroundings of a literal piece of the text, white space collapsed; '' if it is absent."""
    at = F.position(found, text)
    start = F.greatest(F.lit(1), at - radius)
    cut = F.substring(text, start, at - start + F.length(found) + radius)
    return F.when((at > 0) & (found != ""), F.trim(F.regexp_replace(cut, r"(?U)\s+", " "))).otherwise("")


def find(text: Column, pattern: str) -> Column:
    """The first match of a pattern, or ''."""
    return F.regexp_extract(text, "(?U)" + pattern, 0)


def with_parts(notices: DataFrame, text: str = "text") -> DataFrame:
    """``header`` and ``bisher`` lines and the ``body`` of each notice; the headline itself is in neither."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    blank = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), F.lit(""))
    end = F.when(blank > 0, blank.cast("int")).otherwise(F.size(lines))
    header = F.slice(lines, F.lit(2), F.greatest(end - 1, F.lit(0)))
    raw = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    body = F.array_join(F.slice(raw, end + 1, F.size(raw)), "\n")
    at = F.array_position(header, F.lit("Bisher")).cast("int")
    return notices.withColumns({"header": header, "bisher": F.when(at > 0, F.slice(header, at + 1, F.size(header))).otherwise(F.array().cast("array<string>")), "body": body})


def inline_address(body: Column) -> Column:
    """The first bracketed previous address whose last label before it is not somebody else's, or null."""
    found = F.regexp_extract_all(body, F.lit("(?U)" + _BISHER_ADDRESS), 0)
    # the text before a bracket ends where its first occurrence starts; equal brackets share their fate
    before = lambda m: F.substring(body, F.lit(1), F.position(m, body) - 1)
    label = lambda m: F.coalesce(F.try_element_at(F.regexp_extract_all(before(m), F.lit("(?U)" + _LABEL), 1), F.lit(-1)), F.lit(""))
    foreign = lambda m: F.regexp_like(label(m), F.lit("^(" + "|".join(_NOT_THE_COMPANY) + ")"))
    return F.try_element_at(F.filter(found, lambda m: ~foreign(m)), F.lit(1))


def split_entries(section: Column) -> Column:
    """Entries between semicolons outside square brackets."""
    marked = F.regexp_replace(section, r";(?![^\[]*\])", "\u001f")
    parts = F.transform(F.split(marked, "\u001f"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def mutating_entries(body: Column) -> Column:
    """The entries under the heading of new and changed people, up to the next heading or line."""
    section = F.regexp_extract(body, r"(?U)" + _MUTATING + r"((?:(?!Eingetragene Personen[^:]*:|Ausgeschiedene Personen[^:]*:)[^\n])*)", 1)
    return split_entries(section)


def sure(field: str) -> Column:
    """The record does not call the field uncertain."""
    return ~F.coalesce(F.array_contains("uncertain", field), F.lit(False))


def extra(key: str) -> Column:
    return F.try_element_at("extras", F.lit(key))


def notice_rules() -> list[Rule]:
    """The rules on a frame of :func:`with_parts`; people's nationalities are in :func:`sweep_gold`."""
    t, body = F.col("text"), F.col("body")
    cited = F.regexp_extract(t, "(?U)" + _OLD_CITATION, 1)
    new_domicile = F.contains(body, F.lit("Domizil neu:"))
    old_block = F.exists("bisher", lambda x: F.regexp_like(x, F.lit(r"(?U)^[0-9]{4}\s+\S")))
    inline = inline_address(body)
    trigger = new_domicile | old_block | inline.isNotNull()
    why = F.when(new_domicile, around(body, F.lit("Domizil neu:"))).when(old_block, F.concat(F.lit("Bisher | "), F.array_join("bisher", " | "))).when(inline.isNotNull(), around(body, inline)).otherwise(F.array_join("header", " | "))
    collapse = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    reason, news, page = extra("loeschung_reason"), extra("mitteilungen"), extra("prior_publication_page")
    moved, says_moved = find(body, _SEAT_MOVE), F.coalesce(F.array_contains("act_subtypes", "sitzverlegung"), F.lit(False))
    waived, nominal = find(t, _OPTING_OUT), find(t, _NOMINAL)
    return [
        Rule("prior_publication_page", "extras.prior_publication_page", sure("extras") & (cited != "") & ~F.coalesce(F.trim(page) == cited, F.lit(False)), around(t, find(t, _OLD_CITATION))),
        Rule("domicile", "domicile_new", sure("domicile_new") & (trigger == F.col("domicile_new").isNull()), why),
        Rule("domicile", "domicile_previous", sure("domicile_previous") & F.when(trigger, F.col("domicile_previous").isNull() & (old_block | inline.isNotNull())).otherwise(F.col("domicile_previous").isNotNull()), why),
        Rule("loeschung_reason", "extras.loeschung_reason", sure("extras") & reason.isNotNull() & ~F.contains(collapse(t), collapse(reason)), around(body, find(body, "gelöscht|Löschung"))),
        Rule("mitteilungen", "extras.mitteilungen", sure("extras") & F.startswith(F.trim(news), F.lit("Mitteilungen")), around(body, F.lit("Mitteilungen"))),
        Rule("sitzverlegung", "act_subtypes", sure("act_subtypes") & (says_moved != (moved != "")), F.when(moved != "", around(body, moved)).otherwise(around(body, find(body, "Sitz|Domizil")))),
        Rule("revision", "extras.revision", sure("extras") & (waived != "") & ~F.coalesce(extra("revision") == "opting-out", F.lit(False)), around(t, waived)),
        Rule("nominal_value_chf", "extras.nominal_value_chf", sure("extras") & (nominal != "") & extra("nominal_value_chf").isNull(), around(t, nominal)),
    ]


PEOPLE = {"persons_added": ("name", ["nationality"]), "persons_removed": ("name", ["nationality"]), "persons_changed": ("name_new", ["nationality_new", "nationality_previous"])}


def sweep_gold(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, rule, field, evidence`` of all findings."""
    df = with_parts(records)
    out = sweep(df, [key], notice_rules())
    for field, (name, attributes) in PEOPLE.items():
        people = df.filter(sure(field)).select(key, "text", "body", F.explode(field).alias("p"))
        label = F.coalesce(F.col(f"p.{name}"), F.col("p.name_previous") if field == "persons_changed" else F.lit(None), F.lit(""))
        for a in attributes:
            at = F.concat(F.lit(f"{field}["), label, F.lit(f"].{a}"))
            hit = people.filter(F.regexp_like(F.trim(F.col(f"p.{a}")), F.lit(_INFLECTED)))
            out = out.unionByName(hit.select(key, F.lit("nationality").alias("rule"), at.alias("field"), around(F.col("text"), F.substring_index(label, ",", 1)).alias("evidence")))
    changed = df.filter(sure("persons_changed")).select(key, mutating_entries(F.col("body")).alias("entries"), F.explode("persons_changed").alias("p")).filter("p.nationality_new IS NULL")
    starts = lambda e, n: F.coalesce((n != "") & F.startswith(e, n), F.lit(False))
    entry = F.try_element_at(F.filter("entries", lambda e: starts(e, F.col("p.name_new")) | starts(e, F.col("p.name_previous"))), F.lit(1))
    hit = changed.withColumn("entry", entry).filter(F.contains(F.regexp_replace("entry", r"\[[^\]]*\]", ""), F.lit("Staatsangehörig")))
    label = F.concat(F.lit("persons_changed["), F.coalesce("p.name_new", "p.name_previous", F.lit("")), F.lit("].nationality_new"))
    return out.unionByName(hit.select(key, F.lit("persons_changed").alias("rule"), label.alias("field"), F.trim(F.regexp_replace("entry", r"(?U)\s+", " ")).alias("evidence")))


# --- coherence of a record's own fields ---------------------------------------------


def coherence(records: DataFrame, fields: list[str], subtypes: list[str], key: str = "doc_id", version: str | None = None, verified: bool = False) -> DataFrame:
    """``key, field, reason`` where dates, acts, people or paired fields contradict one another.

    ``fields`` are the names that ``uncertain`` may hold, ``subtypes`` the vocabulary that must
    not show up among alternative names. ``version`` and ``verified`` add those gates.
    """
    date = lambda c: F.when(F.col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    has_people = filled("persons_added") | filled("persons_removed") | filled("persons_changed")
    changes = F.coalesce(F.array_contains("act_subtypes", "organaenderung"), F.lit(False))
    mutation = F.col("act_type") == "mutation"
    names = lambda words: F.array(*[F.lit(w) for w in words])
    unknown, leaked = F.array_except("uncertain", names(fields)), F.array_intersect("alternative_names", names(subtypes))
    checks = {
        "prior_publication_date": F.when(~(date("prior_publication_date") < date("tagesregister_date")), "must be before tagesregister_date"),
        "act_date": F.when(~(date("act_date") <= date("tagesregister_date")), "must not be after tagesregister_date"),
        "persons_added": F.when((F.col("act_type") == "loeschung") & filled("persons_added"), "must be empty on a deletion"),
        "act_subtypes": F.when(mutation & has_people & ~changes, "people change without organaenderung").when(mutation & changes & ~has_people, "organaenderung without people"),
        "uncertain": F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))),
        "alternative_names": F.when(F.size(leaked) > 0, F.concat(F.lit("subtypes among names: "), F.array_join(leaked, ", "))),
    }
    for a, b in (("canton_previous", "canton_new"), ("domicile_previous", "domicile_new")):
        for there, absent in ((a, b), (b, a)):
            checks[absent] = F.when(F.col(there).isNotNull() & F.col(absent).isNull() & sure(absent), f"must not be null when {there} is set")
    if version is not None:
        checks["schema_version"] = F.when(F.col("schema_version") != version, f"is not {version}")
    if verified:
        checks["_verified"] = F.when(~F.col("_verified").eqNullSafe(True), "must be true")
    return violations(records, [key], checks)
