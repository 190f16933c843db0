"""Corpus statistics, text checks, rules, extraction and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.values import containment_match, hash_bucket, prefix_match, snippet
from tallyspark.operators import corrections, crosscheck, frame, repair, resample, rules, stats
from tallyspark.operators.order import global_index
from tallyspark.plans.bindings import bucket_sql, normalize_sql, table
from tallyspark.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.add


def _r(c, name: str):
    return F.round(c, 9).alias(name)


# --- distributions ------------------------------------------------------------------


@query("SELECT coalesce(l.quality::VARCHAR, '(null)') AS value, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 9) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def scalar_distribution(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    t = stats.scalar_distribution(docs.join(table(spark, d, "labels"), "doc_id", "left"), F.col("quality"), docs.count())
    return t.select("value", "n", _r(F.col("share"), "share"))


@query("WITH e AS (SELECT event_id, unnest(list_distinct([event_type, json_extract_string(props, '$.k'), event_type])) AS value FROM events) SELECT value, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 9) AS share FROM e GROUP BY value")
def membership_distribution(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = stats.membership_distribution(e, F.array("event_type", F.get_json_object("props", "$.k"), "event_type"))
    return t.select("value", "n", _r(F.col("share"), "share"))


@query("WITH s AS (SELECT o_orderstatus, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) SELECT o_orderstatus AS status, sum(n)::BIGINT AS total, round(avg(n), 9) AS per_record, count(*) FILTER (n = 0)::BIGINT AS empty, round(avg((n = 0)::INT), 9) AS empty_share FROM s GROUP BY 1")
def list_size_stats(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    s = table(spark, d, "orders").join(lines, "o_orderkey", "left").fillna(0, ["n"]).withColumnRenamed("o_orderstatus", "status")
    t = stats.list_size_stats(s, ["status"], F.col("n"))
    return t.select("status", "total", _r(F.col("per_record"), "per_record"), "empty", _r(F.col("empty_share"), "empty_share"))


@query("SELECT lang, sum(n_chars)::BIGINT AS chars, min(n_chars) AS least, max(n_chars) AS most, round(median(n_chars), 9) AS median FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(n).alias("chars"), F.min(n).alias("least"), F.max(n).alias("most"), _r(F.median(n), "median"))


_PAIR = "sha256(doc_id::VARCHAR || '|' || sha256(coalesce(text, '')))"


@query("WITH p AS (SELECT " + _PAIR + " AS h FROM documents) SELECT count(*)::BIGINT AS n, sha256(" + " || '|' || ".join(f"coalesce(sum(('0x' || substr(h, {i}, 12))::BIGINT)::VARCHAR, '')" for i in (1, 13, 25)) + ") AS digest FROM p")
def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_digest(table(spark, d, "documents"), "doc_id", F.col("text"))


# --- text checks --------------------------------------------------------------------

_HITS = "WITH h AS (SELECT b.item_id, d.doc_id, ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::BIGINT AS n, strpos(d.text, b.text)::BIGINT AS position FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("value"))


@query(_HITS + " SELECT b.item_id, coalesce(sum(h.n), 0)::BIGINT AS n, count(h.doc_id)::BIGINT AS docs, CASE WHEN coalesce(sum(h.n), 0) = 0 THEN 'missing' WHEN sum(h.n) = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY b.item_id")
def literal_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    hits = crosscheck.literal_hits(table(spark, d, "documents").select("doc_id", "text"), _items(spark, d)).groupBy("item_id").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    t = _items(spark, d).select("item_id").join(hits, "item_id", "left").fillna(0, ["n", "docs"])
    return t.withColumn("status", crosscheck.status(F.col("n")))


@query(_HITS + r" SELECT h.item_id, h.doc_id, h.position, trim(regexp_replace(substr(d.text, greatest(1, h.position - 40), h.position - greatest(1, h.position - 40) + length(b.text) + 40), '\s+', ' ', 'g')) AS snippet FROM h JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    hits = crosscheck.literal_hits(table(spark, d, "documents").select("doc_id", "text"), _items(spark, d)).join(_items(spark, d), "item_id")
    return hits.select("item_id", "doc_id", "position", snippet(F.col("text"), F.col("value")).alias("snippet"))


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_key FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return stats.duplicate_groups(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("""WITH p AS (SELECT doc_id, sha256(doc_id::VARCHAR || '|' || sha256(coalesce(text, ''))) AS h FROM documents), r AS (SELECT h, row_number() OVER (ORDER BY doc_id, h) - 1 AS pos FROM p),
a AS (SELECT pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM r GROUP BY pos // 1024), b AS (SELECT pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM a GROUP BY pos // 1024)
SELECT (SELECT count(*) FROM documents) AS n, CASE WHEN (SELECT count(*) FROM a) > 1 THEN (SELECT h FROM b) ELSE (SELECT h FROM a) END AS digest""")
def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    return stats.ordered_digest(table(spark, d, "documents"), "doc_id", F.col("text"))


_TREE = """WITH l AS (SELECT l_orderkey, l_partkey, count(*) AS n, min(l_quantity)::BIGINT::VARCHAR AS qty FROM lineitem GROUP BY ALL),
m AS (SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey AS doc_id, o_orderstatus AS status, part, n, qty FROM orders JOIN m ON o_orderkey = m.l_orderkey JOIN l ON l.l_orderkey = m.l_orderkey AND l.l_partkey = part)"""


@query(_TREE + """ SELECT doc_id, unnest(['status', 'lines[name=P' || part || '].qty', 'lines[name=none].qty', 'lines.qty', 'extras.note', 'note', 'lines[name=P' || part || ']']) AS path,
  unnest([status, CASE WHEN n = 1 THEN qty END, NULL, NULL, NULL, NULL, NULL]) AS value, unnest([true, n = 1, false, false, false, false, false]) AS found,
  unnest([NULL, CASE WHEN n <> 1 THEN '[name=P' || part || '] matches ' || n END, '[name=none] matches 0', 'the parent of qty is no object', 'no key extras', NULL, 'bad path']) AS error FROM j""")
def path_values(spark: SparkSession, d: str) -> DataFrame:
    """Paths into a record of each order and its lines, of which every second is named as a new one."""
    odd, name = F.col("l_linenumber") % 2 == 1, F.concat(F.lit("P"), F.col("l_partkey"))
    line = F.struct(F.when(odd, name).alias("name"), F.when(~odd, name).alias("name_new"), F.col("l_quantity").cast("bigint").alias("qty"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"), F.min("l_partkey").cast("string").alias("part"))
    records = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    record = F.parse_json(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "lines")))
    first = F.concat(F.lit("lines[name=P"), F.col("part"), F.lit("]"))
    paths = F.array(F.lit("status"), F.concat(first, F.lit(".qty")), F.lit("lines[name=none].qty"), F.lit("lines.qty"), F.lit("extras.note"), F.lit("note"), first)
    # all paths of a record are resolved where it is parsed, so it is parsed once
    out = records.select(F.col("o_orderkey").alias("doc_id"), F.explode(corrections.resolve_all(record, paths)).alias("x"))
    return out.select("doc_id", "x.path", F.try_variant_get("x.value", "$", "string").alias("value"), "x.found", "x.error")


@query("WITH k AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) SELECT host, count(*)::BIGINT AS n, count(*) FILTER (title = '')::BIGINT AS keyless, min(page_id) AS first_page FROM k GROUP BY host HAVING count(*) > 1")
def repeated_key(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return k.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("title") == "").alias("keyless"), F.min("page_id").alias("first_page")).filter("n > 1")


@query(rf"""WITH h AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS headline FROM pages),
o AS (SELECT title, max(page_id) AS owner FROM h WHERE title <> '' GROUP BY title)
SELECT h.page_id, o.owner, CASE WHEN o.owner IS NULL THEN 'unknown' WHEN o.owner = h.page_id THEN 'ok' ELSE 'mismatch' END AS status FROM h LEFT JOIN o ON o.title = h.headline""")
def headline_mismatch(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("headline"))
    owner = h.filter("title <> ''").groupBy(F.col("title").alias("headline")).agg(F.max("page_id").alias("owner"))  # of equal titles the last owns it
    status = F.when(F.col("owner").isNull(), "unknown").when(F.col("owner") == F.col("page_id"), "ok").otherwise("mismatch")
    return h.join(owner, "headline", "left").select("page_id", "owner", status.alias("status"))


_SWAP = rf"""WITH h AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
s AS (SELECT page_id, title, page_id + 1 - 2 * (page_id % 2) AS other FROM h), c AS (SELECT a.page_id, a.title, CASE WHEN {bucket_sql("'swap'", 'least(a.page_id, a.other)')} < 20 THEN b.title ELSE a.title END AS headline FROM s a JOIN s b ON a.other = b.page_id),
o AS (SELECT title AS headline, max(page_id) AS owner FROM c WHERE title <> '' GROUP BY title), j AS (SELECT page_id, owner FROM c JOIN o USING (headline))"""


@query(_SWAP + " SELECT page_id, owner, page_id <> owner AND EXISTS (SELECT 1 FROM j k WHERE k.page_id = j.owner AND k.owner = j.page_id) AS swapped FROM j")
def swapped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Headlines that some neighbouring pages have exchanged: who owns each, and which two own each other's."""
    h = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.col("page_id") + 1 - 2 * (F.col("page_id") % 2)).alias("other"))
    pair = h.join(h.select(F.col("page_id").alias("other"), F.col("title").alias("theirs")), "other")
    c = pair.withColumn("headline", F.when(hash_bucket("swap", F.least("page_id", "other")) < 20, F.col("theirs")).otherwise(F.col("title")))
    owner = c.filter("title <> ''").groupBy(F.col("title").alias("headline")).agg(F.max("page_id").alias("owner"))
    return frame.swapped(c.join(owner, "headline").select("page_id", "owner"), "page_id", "owner")


_PAIRS = rf"""WITH t AS (SELECT doc_id, text AS gold, CASE {bucket_sql("'cut'", 'doc_id')} % 4 WHEN 0 THEN substr(text, 1, 150) || '…' WHEN 1 THEN substr(text, 1, 60) WHEN 2 THEN '  ' || upper(text) ELSE 'x' || text END AS pred FROM documents),
n AS (SELECT doc_id, regexp_replace(rtrim({normalize_sql('gold')}), '(…|\.\.\.)$', '') AS g0, regexp_replace(rtrim({normalize_sql('pred')}), '(…|\.\.\.)$', '') AS p0, {normalize_sql('gold')} AS gn, {normalize_sql('pred')} AS pn FROM t),
s AS (SELECT doc_id, rtrim(g0) AS g, rtrim(p0) AS p, gn, pn FROM n)"""


def _cut(spark: SparkSession, d: str) -> DataFrame:
    x, b = F.col("text"), hash_bucket("cut", F.col("doc_id")) % 4
    pred = F.when(b == 0, F.concat(F.left(x, F.lit(150)), F.lit("…"))).when(b == 1, F.left(x, F.lit(60))).when(b == 2, F.concat(F.lit("  "), F.upper(x))).otherwise(F.concat(F.lit("x"), x))
    return table(spark, d, "documents").select("doc_id", x.alias("gold"), pred.alias("pred"))


@query(_PAIRS + " SELECT doc_id, left(g, least(length(g), length(p))) = left(p, least(length(g), length(p))) AND least(length(g), length(p)) >= least(100, length(g)) AS matches FROM s")
def prefix_matches(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("doc_id", prefix_match(F.col("gold"), F.col("pred")).alias("matches"))


@query(_PAIRS + " SELECT doc_id, CASE WHEN gn = '' OR pn = '' THEN gn = pn ELSE contains(gn, pn) OR contains(pn, gn) END AS matches FROM s")
def containment_matches(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("doc_id", containment_match(F.col("gold"), F.col("pred")).alias("matches"))


# --- rules and validation -----------------------------------------------------------

_RULES = [
    ("status_without_price", "price", "o_orderstatus = 'F' AND o_totalprice < 5000", "o_totalprice::DECIMAL(15,2)::VARCHAR"),
    ("urgent_and_open", "priority", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'", "o_orderpriority"),
    ("old_and_open", "date", "o_orderdate < TIMESTAMP '1993-01-01' AND o_orderstatus = 'O'", "o_orderdate::DATE::VARCHAR"),
]


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{n}' AS rule, '{f}' AS field, {e} AS evidence FROM orders WHERE {p}" for n, f, p, e in _RULES) + ") SELECT * FROM x")
def rule_sweep(spark: SparkSession, d: str) -> DataFrame:
    s, p, pr, dt = (F.col(f"o_{c}") for c in ("orderstatus", "totalprice", "orderpriority", "orderdate"))
    found = [
        rules.Rule("status_without_price", "price", (s == "F") & (p < 5000), p.cast("decimal(15,2)")),
        rules.Rule("urgent_and_open", "priority", (pr == "1-URGENT") & (s == "O"), pr),
        rules.Rule("old_and_open", "date", (dt.cast("date") < F.to_date(F.lit("1993-01-01"))) & (s == "O"), dt.cast("date")),
    ]
    return rules.sweep(table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id"), ["doc_id"], found)


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, unnest(['quantity', 'discount', 'returnflag']) AS field,
  unnest([CASE WHEN l_quantity < 1 OR l_quantity > 40 THEN 'out of range' END, CASE WHEN l_discount < 0 OR l_discount > 0.08 THEN 'out of range' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'not in vocabulary' END]) AS reason FROM lineitem)
SELECT field, reason, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM x WHERE reason IS NOT NULL GROUP BY ALL""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    checks = {"quantity": rules.check_range(F.col("l_quantity"), 1, 40), "discount": rules.check_range(F.col("l_discount"), 0, 0.08), "returnflag": rules.check_enum(F.col("l_returnflag"), ["A", "N"])}
    v = rules.violations(table(spark, d, "lineitem"), ["l_orderkey"], checks)
    return v.groupBy("field", "reason").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""WITH l AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT o.*, first_ship, n FROM orders o LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT rule, count(*)::BIGINT AS n, min(o_orderkey) AS first_key FROM (SELECT 'ships_before_order' AS rule, o_orderkey FROM j WHERE first_ship < o_orderdate UNION ALL SELECT 'closed_without_lines', o_orderkey FROM j WHERE o_orderstatus = 'F' AND n IS NULL) GROUP BY rule""")
def coherence(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"), F.count("*").alias("n"))
    j = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    found = rules.sweep(j, ["o_orderkey"], [rules.Rule("ships_before_order", "date", F.col("first_ship") < F.col("o_orderdate"), F.col("first_ship")), rules.Rule("closed_without_lines", "lines", (F.col("o_orderstatus") == "F") & F.col("n").isNull(), F.lit("0"))])
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


# --- extraction ---------------------------------------------------------------------

_EMAIL, _IP4, _LICENSE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"Licensed under the ([A-Za-z ]+), Version ([0-9.]+)"


@query(rf"""SELECT doc_id, nullif(regexp_extract(text, '{_EMAIL}'), '') AS email, nullif(regexp_extract(text, '{_IP4}'), '') AS ip, nullif(regexp_extract(text, '{_LICENSE}', 1), '') AS license, nullif(regexp_extract(text, '{_LICENSE}', 2), '') AS version, split_part(text, chr(10), 1) AS headline FROM documents""")
def extract_regex(spark: SparkSession, d: str) -> DataFrame:
    first = lambda p, g: F.nullif(F.regexp_extract("text", p, g), F.lit(""))
    return table(spark, d, "documents").select("doc_id", first(_EMAIL, 0).alias("email"), first(_IP4, 0).alias("ip"), first(_LICENSE, 1).alias("license"), first(_LICENSE, 2).alias("version"), F.substring_index("text", "\n", 1).alias("headline"))


_CODES = [("example.org", "ORG"), ("example.net", "NET"), ("blog.", "BLG"), ("example.com", "COM")]


@query("WITH c AS (SELECT * FROM (VALUES (1, 'example.org', 'ORG'), (2, 'example.net', 'NET'), (3, 'blog.', 'BLG'), (4, 'example.com', 'COM')) t(ord, name, code)) SELECT page_id, (SELECT arg_min(code, ord) FROM c WHERE contains(url, name)) AS code FROM pages")
def lookup_code(spark: SparkSession, d: str) -> DataFrame:
    """The first name of a fixed table that occurs in a text, in the table's order."""
    code = F.lit(None).cast("string")
    for name, c in reversed(_CODES):
        code = F.when(F.contains(F.col("url"), F.lit(name)), c).otherwise(code)
    return table(spark, d, "pages").select("page_id", code.alias("code"))


@query("""WITH a AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages) SELECT page_id, unnest(range(len(links)))::INTEGER AS position, unnest(links) AS href FROM a""")
def html_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("position", "href"))


@query("WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*)::BIGINT AS n, key <> 'k' AS unregistered FROM k GROUP BY key")
def json_keys_audit(spark: SparkSession, d: str) -> DataFrame:
    k = repair.key_frequencies(table(spark, d, "events").select(F.json_object_keys("props").alias("keys")), "keys")
    return k.withColumn("unregistered", F.col("key") != "k")


@query(f"""WITH e AS (SELECT {bucket_sql("'damage'", 'event_id')} % 6 AS damage FROM events)
SELECT damage, CASE WHEN damage = 5 THEN 'failed' ELSE 'ok' END AS status, count(*)::BIGINT AS n, count_if(damage = 1)::BIGINT AS fences, count_if(damage = 2)::BIGINT AS commas, count_if(damage = 4)::BIGINT AS with_duplicates FROM e GROUP BY damage""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Event properties damaged in six ways, repaired and counted."""
    e, p = table(spark, d, "events"), F.col("props")
    b = hash_bucket("damage", F.col("event_id")) % 6
    text = F.when(b == 0, p).when(b == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(b == 2, F.replace(p, F.lit("}"), F.lit(", }"))).when(b == 3, F.concat(F.lit("ok "), p, F.lit(" done"))).when(b == 4, F.replace(p, F.lit("}"), F.lit(', "k": 1}'))).otherwise(F.replace(p, F.lit("}"), F.lit("")))
    r = e.select(b.alias("damage"), repair.repair_json(text).alias("r")).select("damage", "r.*")
    return r.groupBy("damage", "status").agg(F.count("*").alias("n"), F.count_if("fence").alias("fences"), F.sum("trailing_commas").alias("commas"), F.count_if(F.size("duplicate_keys") > 0).alias("with_duplicates"))


# --- frames -------------------------------------------------------------------------

_UNION = """WITH u AS (SELECT page_id, url, 0 AS listing FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, url, 1 FROM pages WHERE page_id % 3 <> 1),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY listing, page_id) = 1 AS is_first, first_value(listing) OVER (PARTITION BY url ORDER BY listing, page_id) AS first_listing FROM u)"""


def _union(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    u = frame.union_listings([pages.filter("page_id % 3 <> 0"), pages.filter("page_id % 3 <> 1")])
    return frame.first_occurrences(u, "url", ["listing", "page_id"])


@query(_UNION + " SELECT page_id, url, listing, is_first, first_listing FROM f")
def frame_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _union(spark, d).select("page_id", "url", "listing", "is_first", "first_listing")


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), e AS (SELECT page_id, title FROM p WHERE {bucket_sql("'ex'", 'page_id')} < 10),
x AS (SELECT p.page_id, p.page_id IN (SELECT page_id FROM e) AS by_number, p.title IN (SELECT title FROM e) AS by_title FROM p) SELECT by_number, by_title, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def exclusion_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    e = p.filter(hash_bucket("ex", F.col("page_id")) < 10)
    x = p.join(e.select("page_id").withColumn("by_number", F.lit(True)), "page_id", "left").join(e.select("title").distinct().withColumn("by_title", F.lit(True)), "title", "left").fillna(False, ["by_number", "by_title"])
    return x.groupBy("by_number", "by_title").agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || page_id), page_id) AS r FROM pages) WHERE r <= 25")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return resample.checked_sample(table(spark, d, "pages").select("page_id", "url"), "page_id", 25, 42)


@query("WITH r AS (SELECT page_id, row_number() OVER (ORDER BY md5(page_id::VARCHAR), page_id) - 1 AS idx FROM pages) SELECT page_id, CASE WHEN length((121 + idx)::VARCHAR) >= 4 THEN (121 + idx)::VARCHAR ELSE lpad((121 + idx)::VARCHAR, 4, '0') END AS doc_id FROM r")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    indexed = global_index(table(spark, d, "pages").select("page_id"), F.md5(F.col("page_id").cast("string")), ["page_id"])
    return indexed.select("page_id", frame.numbered_ids(F.col("idx"), 121).alias("doc_id"))


@query("SELECT CASE WHEN instr(text, ' ') > 0 THEN substr(text, 1, instr(text, ' ') - 1) ELSE text END AS word, count(*)::BIGINT AS n FROM conversations WHERE text NOT LIKE 'The%' GROUP BY 1")
def foreign_first_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("text NOT LIKE 'The%'").groupBy(F.substring_index("text", " ", 1).alias("word")).agg(F.count("*").alias("n"))
