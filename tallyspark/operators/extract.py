"""Header fields of commercial-register notices, as expressions over the whole text.

A notice is blocks of lines between blank lines: a headline block with the address, a body
with the company's number, and reference lines. Every extractor takes the first match and
gives null where there is none; nothing here needs Python.

What several fields use is a column of its own, made in a projection before them: as the
optimizer does not merge projections whose columns are used more than once, a text is split
once, however many fields look at the pieces. Expressions that repeat their argument take
columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabulary and tables of the register.
LEGAL_FORMS = {
    "Aktiengesellschaft": "AG",
    "Gesellschaft mit beschränkter Haftung": "GmbH",
    "Einzelunternehmen": "Einzelunternehmen",
    "Genossenschaft": "Genossenschaft",
    "Stiftung": "Stiftung",
    "Verein": "Verein",
    "Kollektivgesellschaft": "Kollektivgesellschaft",
    "Kommanditgesellschaft": "Kommanditgesellschaft",
    "Zweigniederlassung": "Zweigniederlassung",
}
ACT_TYPES = {"mutation": "mutation", "neueintragung": "neueintragung", "löschung": "loeschung"}
CANTON_ALIASES = {"Oberwallis": "VS", "Unterwallis": "VS"}
CANTONS = {
    "Aargau": "AG", "Appenzell Ausserrhoden": "AR", "Appenzell Innerrhoden": "AI", "Basel-Landschaft": "BL", "Basel-Stadt": "BS", "Bern": "BE", "Freiburg": "FR", "Genf": "GE", "Glarus": "GL",
    "Graubünden": "GR", "Jura": "JU", "Luzern": "LU", "Neuenburg": "NE", "Nidwalden": "NW", "Obwalden": "OW", "Schaffhausen": "SH", "Schwyz": "SZ", "Solothurn": "SO", "St. Gallen": "SG",
    "Tessin": "TI", "Thurgau": "TG", "Uri": "UR", "Wallis": "VS", "Waadt": "VD", "Zug": "ZG", "Zürich": "ZH",
}
#: Postcodes, or their first three digits, whose canton is certain.
POSTCODE_CANTONS = {"455": "SO", "462": "SO", "6052": "NW"}

# How the register writes numbers, days and sections.
UID_FORMAT = "CHE-[0-9]{3}[.][0-9]{3}[.][0-9]{3}"
DAY_FORMAT = "[0-9]{2}[.][0-9]{2}[.][0-9]{4}"
LABELS = {"register": "Tagesregister-Nr.", "prior": "Vorangehende Publikation im SHAB:", "publication": "Publ.", "authority": "Kontaktstelle:", "moved": "bisher in "}
ACT_NOTES = ["SHAB", "Neueintragung"]
QUALIFIERS = ["schweizerische", "ausländische"]
SUFFIXES = ["in Liquidation", "in Liq."]
CORRECTION, PREVIOUS = "Berichtigung", "bisher"


#: Unicode's white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def _some(x: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def _words(x: Column) -> Column:
    # printable ASCII is ruled out first; a single space needs no regular expression
    return F.split(F.regexp_replace(strip(x), f"[[^!-~]&&[{SPACES}]]+", " "), " ")


def after(text: Column, label: str) -> Column:
    """What follows the first occurrence of a label, null without one."""
    return F.when(F.contains(text, F.lit(label)), F.substring(text, F.locate(label, text) + len(label), 1 << 30))


def to_line_end(x: Column) -> Column:
    return F.element_at(F.split(x, "[\r\n]", 2), 1)


def day(x: Column) -> Column:
    """A word that is a day, else null."""
    return F.when(F.regexp_like(x, F.lit(f"^{DAY_FORMAT}$")), x)


def iso_date(x: Column) -> Column:
    """DD.MM.YYYY as YYYY-MM-DD, not checked against the calendar; other texts as they are."""
    return F.regexp_replace(x, r"^([0-9]{2})[.]([0-9]{2})[.]([0-9]{4})\z", "$3-$2-$1")


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key) if table else F.lit(None)


def blocks(text: Column) -> Column:
    """Blocks of consecutive lines that hold more than white space."""
    for end in ("\r\n", *"\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"):
        text = F.replace(text, F.lit(end), F.lit("\n"))
    blank = lambda line: F.when(F.btrim(line, F.lit(SPACES + "\x1f")) == "", "").otherwise(line)
    lines = F.array_join(F.transform(F.split(text, "\n"), blank), "\n")
    return F.filter(F.split(F.btrim(lines, F.lit("\n")), r"\n{2,}"), lambda b: b != "")


def canton_of(authority: Column) -> Column:
    """The first name of the tables, aliases before cantons, that the authority's name holds."""
    out = F.lit(None).cast("string")
    for name, code in reversed([*CANTON_ALIASES.items(), *CANTONS.items()]):
        out = F.when(F.contains(authority, F.lit(name)), code).otherwise(out)
    return out


def canton_of_postcode(postcode: Column) -> Column:
    """A whole postcode is more certain than its first digits; others have no canton."""
    return F.coalesce(lookup(postcode, POSTCODE_CANTONS), lookup(F.left(postcode, F.lit(3)), POSTCODE_CANTONS))


def _first(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(1))


def _last(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))


def line_kind(line: Column, words: Column) -> Column:
    """What a line of the headline block holds, by its first and last words: names, care, town, street or text."""
    first, last, several = F.element_at(words, 1), F.element_at(words, -1), F.size(words) > 1
    return (
        F.when(line.startswith("(") & line.endswith(")"), "names")
        .when((F.lower(first) == "c/o") & several, "care")
        .when(F.regexp_like(first, F.lit("^[0-9]{4}$")) & several, "town")
        .when(F.regexp_like(last, F.lit("^[0-9]+[A-Za-z]?$")) & several, "street")
        .otherwise("text")
    )


def bracketed(line: Column) -> Column:
    """The contents of a line's brackets, in order."""
    opened = F.slice(F.split(line, "[(]"), 2, 1 << 30)
    return F.transform(opened, lambda x: strip(F.substring_index(x, ")", 1)))


def without_brackets(name: Column) -> Column:
    """A name without the bracketed names after it."""
    return F.when(name.endswith(")"), strip(F.substring_index(name, "(", 1))).otherwise(name)


def _steps(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """One projection for each step; its columns are for the steps after it."""
    for columns in steps:
        df = df.withColumns({f"__{name}": value for name, value in columns.items()})
    return df


def _of(name: str) -> Column:
    return F.col(f"__{name}")


def header_steps() -> list[dict[str, Column]]:
    """Act type, alternative names and address from the lines of the column ``header``.

    The headline's first word is the act. The line after it repeats the company's name if it
    is of no other kind. The line ``Bisher`` ends the current address and begins the previous
    one. Of several lines of a kind the last one holds, of streets the first.
    """
    kinds = lambda part, kind: F.transform(F.filter(part, lambda t: t.kind == kind), lambda t: t.line)
    rest = lambda line: _some(F.substring(line, 5, 1 << 30))
    return [
        {"lines": F.transform(F.split(_of("header"), "\n"), strip)},
        {"line_words": F.transform(_of("lines"), _words)},
        {"typed": F.slice(F.transform(_of("lines"), lambda x, i: F.struct(line_kind(x, F.get(_of("line_words"), i)).alias("kind"), x.alias("line"))), 2, 1 << 30)},
        {"turn": F.array_position(F.transform(_of("typed"), lambda t: F.lower(t.line)), F.lit(PREVIOUS)).cast("int"), "second": F.try_element_at(_of("typed"), F.lit(1))},
        {"now": F.when(_of("turn") > 0, F.slice(_of("typed"), F.lit(1), _of("turn") - 1)).otherwise(_of("typed")), "company": F.when(_of("second").kind == "text", _of("second").line)},
        {
            "town": _last(kinds(_of("now"), "town")),
            "old_town": F.when(_of("turn") > 0, _first(kinds(F.slice(_of("typed"), _of("turn") + 1, F.lit(1 << 30)), "town"))),
            "company_names": F.when(_of("company").endswith(")"), bracketed(_of("company"))).otherwise(F.array().cast("array<string>")),
        },
        {
            "act_type": lookup(F.lower(F.get(F.get(_of("line_words"), F.lit(0)), F.lit(0))), ACT_TYPES),
            "alternative_names": F.concat(_of("company_names"), F.flatten(F.transform(kinds(_of("now"), "names"), bracketed))),
            "address_care_of": _some(F.substring(_last(kinds(_of("now"), "care")), 4, 1 << 30)),
            "address_street": _first(kinds(_of("now"), "street")),
            "address_postcode": F.left(_of("town"), F.lit(4)),
            "address_municipality": rest(_of("town")),
            "previous_postcode": F.left(_of("old_town"), F.lit(4)),
        },
    ]


def act_steps() -> list[dict[str, Column]]:
    """Name, seat and legal form from the sentence around the company's number in the column ``body``.

    It reads ``name, in town, number, address, form (note)``. What stands before the number
    is cut at commas: the last piece is the seat, all before it the name, whatever commas it
    has. What stands after it is cut likewise; the piece before the note is the form. A
    correction begins with a preamble that ends in a day: the name follows it, and where
    there is none, there is no name rather than half of one.
    """
    words, said, form, right = _of("name_words"), _of("said"), _of("form_words"), _of("right")
    noted = F.lit(False)
    for note in ACT_NOTES:
        noted = noted | _of("note").startswith(note)
    last_day = F.size(words) - F.array_position(F.reverse(_of("days")), F.lit(True)).cast("int") + 1
    told = F.when(F.array_contains(_of("days"), True), F.array_join(F.slice(words, last_day + 1, F.lit(1 << 30)), " "))
    has_seat = (F.try_element_at(_of("seat_words"), F.lit(1)) == "in") & (F.size(_of("seat_words")) > 1) & (F.size(_of("pieces")) > 1) & (F.size(_of("sides")) > 1)
    return [
        {"sides": F.split(_of("body"), UID_FORMAT, 2)},
        {"pieces": F.split(F.regexp_replace(F.element_at(_of("sides"), 1), r"(?U),\s*$", ""), ","), "right": F.try_element_at(_of("sides"), F.lit(2))},
        {"said": _words(F.element_at(_of("pieces"), -1)), "note": F.element_at(F.split(right, "[(]", 2), -1), "form_said": _words(F.element_at(F.split(F.substring_index(right, "(", 1), ","), -1))},
        {"seat_words": F.when(F.element_at(said, 1) == PREVIOUS, F.slice(said, 2, 1 << 30)).otherwise(said), "form_words": F.when(F.element_at(_of("form_said"), 1).isin(QUALIFIERS), F.slice(_of("form_said"), 2, 1 << 30)).otherwise(_of("form_said"))},
        {"has_seat": F.coalesce(has_seat, F.lit(False))},
        {"seat": F.when(_of("has_seat"), F.array_join(F.slice(_of("seat_words"), 2, 1 << 30), " ")), "before": F.when(_of("has_seat"), strip(F.array_join(F.slice(_of("pieces"), F.lit(1), F.size(_of("pieces")) - 1), ",")))},
        {"name_words": _words(_of("before"))},
        {"days": F.transform(words, lambda w: day(w).isNotNull())},
        {"called": F.when(F.element_at(words, 1) == CORRECTION, told).otherwise(_of("before"))},
        {"name": F.nullif(without_brackets(_of("called")), F.lit("")), "legal_form": F.when(noted & right.startswith(","), lookup(F.array_join(form, " "), LEGAL_FORMS))},
    ]


def notice_fields(notices: DataFrame, text: str = "text") -> DataFrame:
    """``notices`` with a column for every extracted header field.

    A null text, or one that is no notice, has null fields and no alternative names. A
    relocation names the seat before the act, whose canton is that of the previous postcode;
    the authority is already the new one.
    """
    t, original = F.col(text), notices.columns
    label = lambda name: to_line_end(after(t, LABELS[name]))
    df = _steps(
        notices,
        {"blocks": blocks(t)},
        {"header": F.coalesce(_first(_of("blocks")), F.lit("")), "body": F.coalesce(_first(F.filter(_of("blocks"), lambda b: F.regexp_like(b, F.lit(UID_FORMAT)))), F.lit(""))},
        *header_steps(),
        *act_steps(),
    )
    name, register, number, dated = _of("name"), _of("register"), _of("number"), _of("dated")
    suffix = F.lit(None).cast("string")
    for x in reversed(SUFFIXES):
        suffix = F.when(F.contains(name, F.lit(x)), x).otherwise(suffix)
    base = name
    for x in SUFFIXES:
        base = strip(F.replace(base, F.lit(x), F.lit("")))
    df = _steps(
        df,
        {
            "moved": _some(F.element_at(F.split(after(t, LABELS["moved"]), ",", 2), 1)),
            "authority": _some(label("authority")),
            "register": _words(label("register")),
            "prior": F.transform(F.split(label("prior"), ","), _words),
            "publication": strip(F.element_at(F.split(after(t, LABELS["publication"]), "[)]", 2), 1)),
        },
        {"registered": day(F.try_element_at(register, F.lit(3))), "number": F.try_element_at(_of("prior"), F.lit(1)), "dated": F.try_element_at(_of("prior"), F.lit(2))},
        {"entered": _of("registered").isNotNull() & (F.try_element_at(register, F.lit(2)) == "vom"), "published": day(F.try_element_at(dated, F.lit(2))), "shab_nr": F.try_element_at(number, F.lit(2)).try_cast("bigint")},
        {"ok": _of("published").isNotNull() & _of("shab_nr").isNotNull() & (F.element_at(number, 1) == "Nr.") & (F.element_at(dated, 1) == "Datum:")},
    )
    return df.select(
        *original,
        F.lit("de").alias("language"),
        _of("act_type").alias("act_type"),
        name.alias("company_name_full"),
        F.regexp_replace(base, ",+$", "").alias("company_name_base"),
        suffix.alias("status_suffix"),
        _of("alternative_names").alias("alternative_names"),
        F.nullif(F.regexp_extract(t, UID_FORMAT, 0), F.lit("")).alias("uid"),
        _of("legal_form").alias("legal_form"),
        F.coalesce(_of("moved"), _of("seat")).alias("seat_municipality"),
        F.when(_of("moved").isNotNull(), canton_of_postcode(_of("previous_postcode"))).otherwise(canton_of(_of("authority"))).alias("seat_canton"),
        *[_of(c).alias(c) for c in ("address_care_of", "address_street", "address_postcode", "address_municipality")],
        F.when(_of("entered"), F.element_at(register, 1)).alias("tagesregister_nr"),
        F.when(_of("entered"), iso_date(_of("registered"))).alias("tagesregister_date"),
        F.when(_of("ok"), _of("shab_nr")).alias("prior_publication_shab_nr"),
        F.when(_of("ok"), iso_date(_of("published"))).alias("prior_publication_date"),
        F.when(F.regexp_like(_of("publication"), F.lit("^[0-9]+$")), _of("publication")).alias("prior_publication_id"),
        _of("authority").alias("authority"),
    )
