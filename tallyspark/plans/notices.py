"""Notices, their records, damaged responses and files, made of the test tables.

A notice is put together from an order's key by SQL expressions that Spark and any other
engine read alike; the SQL of a query states the fields from the key, never from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import formats
from tallyspark.operators import extract, frame, gold_rules, records, repair
from tallyspark.plans.bindings import table
from tallyspark.plans.registry import Registry
from tallyspark.shared import new_path
from tallyspark.sources import listings, readers, versions, writers

REGISTRY = Registry()
query = REGISTRY.add


def _scratch(spark: SparkSession) -> str:
    return new_path(spark, "files")


# --- extraction ---------------------------------------------------------------------

_K = "o_orderkey"
_TEXT_K = f"cast({_K} as string)"
_NINE = f"lpad({_TEXT_K}, 9, '0')"
_KIND = f"({_K} % 5)"  # 1 moves, 2 is new, 3 is being wound up, 4 ends
_UID = f"('CHE-' || substr({_NINE}, 1, 3) || '.' || substr({_NINE}, 4, 3) || '.' || substr({_NINE}, 7, 3))"
_DD, _MM, _YY = f"lpad(cast({_K} % 28 + 1 as string), 2, '0')", f"lpad(cast({_K} % 12 + 1 as string), 2, '0')", f"lpad(cast({_K} % 30 as string), 2, '0')"
_DAY, _ISO = f"({_DD} || '.' || {_MM} || '.20' || {_YY})", f"('20' || {_YY} || '-' || {_MM} || '-' || {_DD})"
_BASE = f"('Probe ' || {_TEXT_K} || ' Werk' || CASE WHEN {_KIND} = 2 THEN ', Bau' ELSE '' END)"
_FULL = f"({_BASE} || CASE WHEN {_KIND} = 3 THEN ' in Liquidation' ELSE '' END)"
_OTHER = f"('Trial ' || {_TEXT_K} || ' Ltd')"
_TOWN = f"(CASE {_K} % 3 WHEN 0 THEN 'Uster' WHEN 1 THEN 'Bern' ELSE 'Brig-Glis' END)"
_FORM = f"(CASE {_K} % 4 WHEN 0 THEN 'Aktiengesellschaft' WHEN 1 THEN 'schweizerische Zweigniederlassung' WHEN 2 THEN 'Verein' ELSE 'Gesellschaft mit beschränkter Haftung' END)"
_OFFICE = f"(CASE {_K} % 3 WHEN 0 THEN 'Handelsregisteramt des Kantons Zürich' WHEN 1 THEN 'Handelsregisteramt des Kantons Bern' ELSE 'Handelsregister Oberwallis' END)"
_NL = "chr(10)"
_NOTICE = f"""(CASE {_KIND} WHEN 2 THEN 'Neueintragung' WHEN 4 THEN 'Löschung' ELSE 'Mutation' END || ' ' || {_BASE} || {_NL}
 || {_FULL} || CASE WHEN {_KIND} = 3 THEN ' (' || {_OTHER} || ')' ELSE '' END || {_NL}
 || CASE WHEN {_K} % 7 = 0 THEN 'c/o Treuhand ' || {_TEXT_K} || {_NL} ELSE '' END
 || 'Langer Weg ' || cast({_K} % 90 + 1 as string) || {_NL} || '80' || lpad(cast({_K} % 100 as string), 2, '0') || ' ' || {_TOWN}
 || CASE WHEN {_KIND} = 1 THEN {_NL} || 'Bisher' || {_NL} || 'Gasse 1' || {_NL} || CASE {_K} % 3 WHEN 0 THEN '4551 Altdorf' WHEN 1 THEN '6052 Neudorf' ELSE '3000 Mitteldorf' END ELSE '' END
 || {_NL} || {_NL}
 || CASE WHEN {_K} % 11 = 0 THEN 'Berichtigung des Eintrags vom 05.05.2025 ' ELSE '' END
 || {_FULL} || CASE WHEN {_KIND} = 3 THEN ' (' || {_OTHER} || ')' ELSE '' END || ', ' || CASE WHEN {_KIND} = 1 THEN 'bisher ' ELSE '' END || 'in ' || {_TOWN} || ', ' || {_UID} || ', ' || {_FORM}
 || CASE WHEN {_KIND} = 2 THEN ' (Neueintragung)' ELSE ' (SHAB Nr. ' || cast({_K} % 250 + 1 as string) || ' vom ' || {_DAY} || ', Publ. 10' || {_NINE} || ')' END || '. Zweck: Probe.'
 || {_NL} || '   ' || {_NL} || 'Tagesregister-Nr. ' || {_TEXT_K} || ' vom ' || {_DAY}
 || CASE WHEN {_KIND} <> 2 THEN {_NL} || {_NL} || 'Vorangehende Publikation im SHAB: Nr. ' || cast({_K} % 250 + 1 as string) || ', Datum: ' || {_DAY} ELSE '' END
 || {_NL} || {_NL} || 'Kontaktstelle: ' || {_OFFICE})"""

_FIELDS = [
    "doc_id", "language", "act_type", "company_name_full", "company_name_base", "status_suffix", "alternative_names", "uid", "legal_form", "seat_municipality", "seat_canton",
    "address_care_of", "address_street", "address_postcode", "address_municipality", "tagesregister_nr", "tagesregister_date", "prior_publication_shab_nr", "prior_publication_date",
    "prior_publication_id", "authority",
]


@query(f"""SELECT {_K} AS doc_id, 'de' AS language, CASE {_KIND} WHEN 2 THEN 'neueintragung' WHEN 4 THEN 'loeschung' ELSE 'mutation' END AS act_type, {_FULL} AS company_name_full, {_BASE} AS company_name_base,
  CASE WHEN {_KIND} = 3 THEN 'in Liquidation' END AS status_suffix, CASE WHEN {_KIND} = 3 THEN {_OTHER} ELSE '' END AS alternative_names, {_UID} AS uid,
  CASE {_K} % 4 WHEN 0 THEN 'AG' WHEN 1 THEN 'Zweigniederlassung' WHEN 2 THEN 'Verein' ELSE 'GmbH' END AS legal_form, {_TOWN} AS seat_municipality,
  CASE WHEN {_KIND} = 1 THEN CASE {_K} % 3 WHEN 0 THEN 'SO' WHEN 1 THEN 'NW' END ELSE CASE {_K} % 3 WHEN 0 THEN 'ZH' WHEN 1 THEN 'BE' ELSE 'VS' END END AS seat_canton,
  CASE WHEN {_K} % 7 = 0 THEN 'Treuhand ' || {_TEXT_K} END AS address_care_of, 'Langer Weg ' || cast({_K} % 90 + 1 as string) AS address_street, '80' || lpad(cast({_K} % 100 as string), 2, '0') AS address_postcode, {_TOWN} AS address_municipality,
  {_TEXT_K} AS tagesregister_nr, {_ISO} AS tagesregister_date, CASE WHEN {_KIND} <> 2 THEN cast({_K} % 250 + 1 as string) END AS prior_publication_shab_nr, CASE WHEN {_KIND} <> 2 THEN {_ISO} END AS prior_publication_date,
  CASE WHEN {_KIND} <> 2 THEN '10' || {_NINE} END AS prior_publication_id, {_OFFICE} AS authority FROM orders""")
def notice_header(spark: SparkSession, d: str) -> DataFrame:
    """Every header field of a notice for each order."""
    notices = table(spark, d, "orders").select(F.col(_K).alias("doc_id"), F.expr(_NOTICE).alias("text"))
    out = extract.notice_fields(notices).withColumn("alternative_names", F.array_join("alternative_names", "|"))
    return out.withColumn("prior_publication_shab_nr", F.col("prior_publication_shab_nr").cast("string")).select(*_FIELDS)


# --- consistency rules --------------------------------------------------------------

_PERSON = "struct<name:string,nationality:string>"
_CHANGE = "struct<name_new:string,name_previous:string,nationality_new:string,nationality_previous:string>"
_BODY = f"""(CASE {_K} % 13 WHEN 2 THEN 'Domizil neu: Gasse 2, 8001 Ort.' WHEN 3 THEN 'Sitz neu: Bern.' WHEN 4 THEN 'Es wird auf eine eingeschränkte Revision verzichtet.' WHEN 5 THEN '100 Namenaktien zu CHF 10.'
 WHEN 11 THEN 'Weitere Adressen: y [bisher: Gasse 2, 8001 Zürich].' WHEN 12 THEN 'Eingetragene Personen neu oder mutierend: Rot, Eva, deutsche Staatsangehörige, in Bern; Blau, Max, in Chur.' ELSE 'Zweck neu.' END)"""


@query(f"""SELECT {_K} AS doc_id, CASE {_K} % 13 WHEN 1 THEN 'prior_publication_page' WHEN 2 THEN 'domicile' WHEN 3 THEN 'sitzverlegung' WHEN 4 THEN 'revision' WHEN 5 THEN 'nominal_value_chf' WHEN 6 THEN 'mitteilungen' WHEN 7 THEN 'loeschung_reason' WHEN 8 THEN 'nationality' WHEN 9 THEN 'domicile' ELSE 'persons_changed' END AS rule,
  CASE {_K} % 13 WHEN 1 THEN 'extras.prior_publication_page' WHEN 2 THEN 'domicile_new' WHEN 3 THEN 'act_subtypes' WHEN 4 THEN 'extras.revision' WHEN 5 THEN 'extras.nominal_value_chf' WHEN 6 THEN 'extras.mitteilungen' WHEN 7 THEN 'extras.loeschung_reason' WHEN 8 THEN 'persons_added[Gelb, Ida].nationality' WHEN 9 THEN 'domicile_new' ELSE 'persons_changed[Rot, Eva].nationality_new' END AS field
  FROM orders WHERE {_K} % 13 NOT IN (0, 10, 11)""")
def gold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The ten consistency rules over a record for each order, of which most break one."""
    k = F.col(_K) % 13
    text = F.concat(F.lit("Mutation Muster AG\nMuster AG\nWeg 1\n8000 Zürich\n\nMuster AG, in Zürich (SHAB Nr. 3 vom 01.02.2020, S. 12). "), F.expr(_BODY), F.lit("\n"))
    page = F.when((k == 1) | (k == 10), F.lit(None)).otherwise("12")
    extras = F.map_from_arrays(F.array(F.lit("prior_publication_page"), F.lit("mitteilungen"), F.lit("loeschung_reason")), F.array(page, F.when(k == 6, "Mitteilungen per Brief"), F.when(k == 7, "steht nirgends")))
    none = lambda t: F.array().cast(f"array<{t}>")
    people = F.array(F.struct(F.lit("Gelb, Ida").alias("name"), F.when(k == 8, "deutsche").otherwise("Deutschland").alias("nationality"))).cast(f"array<{_PERSON}>")
    changes = F.array(*[F.struct(F.lit(n).alias("name_new"), F.lit(None).cast("string").alias("name_previous"), F.lit(None).cast("string").alias("nationality_new"), F.lit(None).cast("string").alias("nationality_previous")) for n in ("Rot, Eva", "Blau, Max")])
    rows = table(spark, d, "orders").select(
        F.col(_K).alias("doc_id"), text.alias("text"), F.map_filter(extras, lambda _, v: v.isNotNull()).alias("extras"), F.when(k == 10, F.array(F.lit("extras"))).otherwise(none("string")).alias("uncertain"),
        none("string").alias("act_subtypes"), F.when(k == 9, "Weg 9, 8000 Zürich").alias("domicile_new"), F.lit(None).cast("string").alias("domicile_previous"),
        people.alias("persons_added"), none(_PERSON).alias("persons_removed"), F.when(k == 12, changes).otherwise(none(_CHANGE)).alias("persons_changed"),
    )
    return gold_rules.sweep_gold(rows).select("doc_id", "rule", "field")


@query(f"""WITH v AS (SELECT {_K} AS doc_id, unnest(CASE {_K} % 9 WHEN 1 THEN ['prior_publication_date'] WHEN 2 THEN ['act_date'] WHEN 3 THEN ['persons_added'] WHEN 4 THEN ['act_subtypes'] WHEN 5 THEN ['canton_previous', 'uncertain'] WHEN 6 THEN ['alternative_names', 'schema_version'] WHEN 7 THEN ['_verified', 'act_subtypes', 'domicile_new'] ELSE [] END) AS field FROM orders)
  SELECT doc_id, field FROM v""")
def record_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Dates, acts, people, paired fields, vocabularies and gates of a record for each order."""
    k = F.col(_K) % 9
    none = F.array().cast("array<string>")
    some = lambda on, *values: F.when(on, F.array(*[F.lit(v) for v in values])).otherwise(none)
    rows = table(spark, d, "orders").select(
        F.col(_K).alias("doc_id"), F.when(k == 6, "0.9").otherwise("1.0").alias("schema_version"), F.when(k == 3, "loeschung").otherwise("mutation").alias("act_type"), some(k == 7, "organaenderung").alias("act_subtypes"),
        some(k == 6, "fusion", "Name").alias("alternative_names"), F.when(k == 2, "2025-01-03").when(k == 8, "2025-02-30").otherwise("2025-01-01").alias("act_date"), F.lit("2025-01-02").alias("tagesregister_date"),
        F.when(k == 1, "2025-01-02").otherwise("2024-12-31").alias("prior_publication_date"), F.lit(None).cast("string").alias("canton_previous"), F.when(k == 5, "BE").alias("canton_new"),
        F.lit(None).cast("string").alias("domicile_new"), F.when(k == 7, "x").alias("domicile_previous"), some(k == 3, "p").alias("persons_added"), some(k == 4, "p").alias("persons_removed"), none.alias("persons_changed"),
        some(k == 5, "nonsense", "extras").alias("uncertain"), F.when(k != 7, F.lit(True)).alias("_verified"),
    )
    return gold_rules.coherence(rows, ["canton_previous", "extras"], ["fusion", "organaenderung"], version="1.0", verified=True).select("doc_id", "field")


# --- responses ----------------------------------------------------------------------


@query(f"""SELECT {_K} AS doc_id, CASE WHEN {_K} % 6 = 4 THEN 'no_response' WHEN {_K} % 6 = 5 THEN 'failed' ELSE 'ok' END AS status, {_K} % 6 = 1 AS fence, {_K} % 6 = 2 AS extracted, CASE WHEN {_K} % 6 = 3 THEN 2 ELSE 0 END AS trailing_commas,
  CASE WHEN {_K} % 6 < 4 THEN o_orderstatus END AS state, CASE WHEN {_K} % 6 < 4 THEN {_TEXT_K} END AS number, CASE WHEN {_K} % 6 < 4 THEN 'note' ELSE 'note,number,state' END AS missing, CASE WHEN {_K} % 6 < 4 THEN 'list' ELSE '' END AS extra FROM orders""")
def response_contract(spark: SparkSession, d: str) -> DataFrame:
    """Responses wrapped, fenced, with trailing commas, empty or cut off: repaired and projected to a contract."""
    k = F.col(_K) % 6
    body = F.concat(F.lit('{"state": "'), F.col("o_orderstatus"), F.lit('", "list": [1, 2], "number": '), F.col(_K).cast("string"), F.lit("}"))
    loose = F.replace(F.replace(body, F.lit("2]"), F.lit("2, ]")), F.lit("}"), F.lit(",\n}"))
    text = F.when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(k == 2, F.concat(F.lit("I say "), body, F.lit(" and more"))).when(k == 3, loose).when(k == 4, "  ").when(k == 5, F.replace(body, F.lit("}"), F.lit(""))).otherwise(body)
    r = table(spark, d, "orders").select(F.col(_K).alias("doc_id"), repair.repair_json(text).alias("r")).select("doc_id", "r.*")
    out = records.to_contract(r, "json", ["state", "number", "note"])
    return out.select("doc_id", "status", "fence", "extracted", "trailing_commas", "state", "number", F.array_join(F.array_sort("missing_keys"), ",").alias("missing"), F.array_join(F.array_sort("extra_keys"), ",").alias("extra"))


@query(f"""SELECT {_K} AS doc_id, CASE {_K} % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'dict' ELSE 'str' END AS kind, CASE {_K} % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE {_K} % 3 WHEN 0 THEN '0: extra: z|1: not an object' WHEN 1 THEN '0: missing: b' ELSE '' END AS issues,
  CASE {_K} % 3 WHEN 2 THEN '' ELSE {_TEXT_K} END AS first_a, 'kept,odd' AS kept, 'gone' AS dropped, 'odd' AS unregistered FROM orders""")
def entry_projection(spark: SparkSession, d: str) -> DataFrame:
    """Lists coerced, their entries cut to allowed keys with every issue named, extras cleaned against a registry."""
    k, key = F.col(_K) % 3, F.col(_K).cast("string")
    value = F.when(k == 0, F.concat(F.lit('[{"a": '), key, F.lit(', "b": 2, "z": 3}, 7]'))).when(k == 1, F.concat(F.lit('{"a": '), key, F.lit("}"))).otherwise(F.lit('"text"'))
    items, kind = records.coerce_list(value)
    objects, issues = records.project_entries(items, ["a", "b"])
    kept, dropped, unregistered = records.clean_extras(F.lit('{"kept": 1, "gone": null, "odd": "x"}'), ["kept", "gone"])
    return table(spark, d, "orders").select(
        F.col(_K).alias("doc_id"), kind.alias("kind"), F.size(items).alias("n"), F.array_join(issues, "|").alias("issues"), F.coalesce(F.try_element_at(F.try_element_at(objects, F.lit(1)), F.lit("a")), F.lit("")).alias("first_a"),
        F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"), F.array_join(dropped, ",").alias("dropped"), F.array_join(unregistered, ",").alias("unregistered"),
    )


# --- printed values -----------------------------------------------------------------


@query("""SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%d.%m.%Y') AS day, replace(format('{:,}', o_orderkey * 1000), ',', '''') AS whole, replace(format('{:,}', o_orderkey), ',', '''') || '.50' AS amount,
  o_orderkey::VARCHAR || CASE WHEN o_orderkey >= 1000 THEN '|' || replace(format('{:,}', o_orderkey), ',', '''') ELSE '' END AS ways, 'Head ' || o_orderpriority AS head, 'Notice ' || o_orderkey::VARCHAR || ' of ' || o_orderstatus AS filled, 'deepinfra' AS provider, o_orderkey % 2 = 1 AS mismatch,
  'Amt' || chr(10) || chr(10) || 'c/o Eva, Weg 1, 8000 Ort' AS address FROM orders""")
def printed_values(spark: SparkSession, d: str) -> DataFrame:
    """Dates, numbers, first lines, templates, providers and address lines as notices print them."""
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.alias("doc_id"), formats.swiss_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), formats.swiss_number(key * 1000).alias("whole"), formats.swiss_number(key + F.lit(0.5), 2).alias("amount"),
        F.array_join(formats.renderings("int", key), "|").alias("ways"), formats.first_line(F.concat(F.lit("  Head \t"), F.col("o_orderpriority"), F.lit(" \nrest"))).alias("head"),
        formats.fill_template("Notice {{ID}} of {{STATE}}", {"{{ID}}": key.cast("string"), "{{STATE}}": F.col("o_orderstatus")}).alias("filled"), formats.fold_provider(F.lit("Deep-Infra/turbo")).alias("provider"),
        formats.provider_mismatch(F.lit("deepinfra/fp8"), F.when(key % 2 == 1, "NextBit").otherwise("DeepInfra")).alias("mismatch"), formats.join_address_lines(F.lit("Amt\n\nc/o Eva\nWeg 1\n8000 Ort")).alias("address"),
    )


# --- files --------------------------------------------------------------------------


@query("SELECT n_name AS doc_id, n_nationkey, n_regionkey, n_nationkey * 10 AS prompt_tokens, n_nationkey / 4.0 AS usage_cost, (n_nationkey % 2 = 0) AS listed FROM nation")
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """A record, a response and a manifest's entry for each nation, written as JSON files and read back: all readers of files, complete or an error."""
    path = _scratch(spark)
    nations = table(spark, d, "nation").collect()  # one file each
    for n in nations:
        writers.write_json({"n_nationkey": n.n_nationkey, "n_regionkey": n.n_regionkey}, f"{path}/gold/{n.n_name}.json", spark)
        writers.write_json({"run_id": "r1", "doc_id": n.n_name, "status": "ok", "usage": {"prompt_tokens": n.n_nationkey * 10, "cost": n.n_nationkey / 4}}, f"{path}/runs/{n.n_nationkey}.json", spark)
    writers.write_json({"records": [{"doc_id": n.n_name, "ord": n.n_nationkey} for n in nations if n.n_nationkey % 2 == 0]}, f"{path}/manifest.json", spark)
    gold = readers.json_records(spark, f"{path}/gold", "doc_id string, n_nationkey int, n_regionkey int")
    raw = readers.raw_json(spark, f"{path}/gold").filter("json LIKE '{%}'")
    answers = readers.responses(spark, f"{path}/runs").select("doc_id", "prompt_tokens", "usage_cost")
    listed = readers.manifest(spark, f"{path}/manifest.json", "doc_id:string,ord:int").select("doc_id", F.lit(True).alias("listed"))
    readers.require_complete(gold, answers, raw)
    wanted = readers.select_docs(readers.discover(raw, gold), sorted(n.n_name for n in nations))
    out = wanted.join(gold, "doc_id").join(answers, "doc_id").join(listed, "doc_id", "left")
    return out.select("doc_id", "n_nationkey", "n_regionkey", "prompt_tokens", "usage_cost", F.coalesce("listed", F.lit(False)).alias("listed"))


_VALUE = f"(CASE {_K} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a\"b, ' || chr(10) || ' c' ELSE ' x' || {_TEXT_K} END)"


@query(f"SELECT o_orderstatus AS run_id, {_TEXT_K} AS doc_id, {_VALUE} AS value FROM orders")
def cell_files(spark: SparkSession, d: str) -> DataFrame:
    """Cells written below a folder per run and as an audit's CSV, read back: null and empty text, quotes and line breaks stay apart."""
    path = _scratch(spark)
    writers.write_by_run(table(spark, d, "orders").select(F.col("o_orderstatus").alias("run_id"), F.expr(_TEXT_K).alias("doc_id"), F.expr(_VALUE).alias("value")), f"{path}/runs")
    back = spark.read.schema("doc_id string, value string, run_id string").parquet(f"{path}/runs")
    writers.write_audit(back.select("run_id", "doc_id", "value"), f"{path}/audit")
    return readers.cell_table(spark, f"{path}/audit", "run_id string, doc_id string, value string")


@query("""SELECT s_suppkey, unnest([1, 2])::INTEGER AS position, unnest(['e' || s_suppkey::VARCHAR, NULL]) AS id, unnest(['HR02-' || s_suppkey::VARCHAR, 'HR03-1']) AS publication_number, unnest([s_name || ' & Co "x"', 'Second one']) AS title,
  unnest(['/n/' || s_suppkey::VARCHAR, '/m']) AS url, unnest(['2026-08-18', NULL]) AS date, unnest(['Amtsblatt', NULL]) AS source, 2 AS total FROM supplier""")
def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a listing page for each supplier, with the number that the page states."""
    key = F.col("s_suppkey").cast("string")
    html = F.concat(
        F.lit('<html><p>2 Treffer</p><div class="list entry" id="e'), key, F.lit('"><div><div>x</div><br></div><span class="nr"> HR02-'), key, F.lit('</span><span class="date">18.08.2026</span> <span class="source">Amtsblatt</span><a class="t" href="/n/'), key, F.lit('"><b>'), F.col("s_name"),
        F.lit('</b>\n &amp; Co &quot;x&quot;</a></div><div class="entry" data-number="HR03-1"><a href="/m">Second <i>one</i></a></div></html>'),
    )
    pages = table(spark, d, "supplier").select("s_suppkey", html.alias("html"), readers.reported_total(html).alias("total"))
    rows = listings.listing_entries(pages)
    return rows.select("s_suppkey", "position", "id", "publication_number", "title", "url", "date", "source", "total")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 17 <> 0 THEN 2 + (s_suppkey % 10 = 0)::INTEGER ELSE -1 END AS total, 2::BIGINT AS n,
  CASE WHEN s_suppkey % 17 = 0 THEN 'no_counter' WHEN s_suppkey % 10 = 0 THEN 'incomplete' ELSE 'ok' END AS status FROM supplier""")
def listing_checks(spark: SparkSession, d: str) -> DataFrame:
    """Listings of every supplier against their own counters; some say too much, or nothing."""
    key = F.col("s_suppkey")
    counter = F.when(key % 17 != 0, F.concat((2 + (key % 10 == 0).cast("int")).cast("string"), F.lit(" Treffer"))).otherwise("")
    meta = F.concat(F.lit('<div class="list-entry list-entry-tenant"><div class="list-col"><div>18.08.2026 - HR02-1 - '), F.col("s_name"), F.lit('</div></div><a href="/1">A</a></div>'))
    html = F.concat(F.lit("<p>"), counter, F.lit("</p>"), meta, meta)
    pages = table(spark, d, "supplier").select("s_suppkey", html.alias("html"), readers.reported_total(html).alias("total"))
    entries = listings.listing_entries(pages).filter("publication_number = 'HR02-1' AND date = '2026-08-18'")
    return frame.count_checks(pages, entries, "s_suppkey", "total").fillna(-1, ["total"])


@query("""SELECT unnest([1, 2, 3]) AS version, unnest([(SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')]) AS n,
  unnest([(SELECT sum(o_orderkey) FROM orders WHERE o_orderstatus = 'O'), (SELECT sum(o_orderkey) FROM orders), (SELECT sum(o_orderkey) FROM orders WHERE o_orderstatus = 'F')])::BIGINT AS keys""")
def versioned_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders in three versions, the second beside the first and the third instead of both, each read as of its number."""
    path, orders = new_path(spark, "versions"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    parts = [(orders.filter("o_orderstatus = 'O'"), False), (orders.filter("o_orderstatus <> 'O'"), False), (orders.filter("o_orderstatus = 'F'"), True)]
    out = None
    for version in [versions.commit(rows, path, replace=replace) for rows, replace in parts]:
        one = versions.as_of(spark, path, version).agg(F.lit(version).alias("version"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out
