"""Registered queries of feed documents and of files as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.functions import text as X
from marketloom.operators import decisions, indicator_blocks, indicators, quality
from marketloom.plans import oracles as O
from marketloom.plans.news_and_quality import STAMP, XML
from marketloom.plans.registry import bars, register
from marketloom.sources import feed_xml, files
from marketloom.sources import tables as T
from marketloom.store import scratch

# ------------------------------------------------------------------------------------------------ feed documents

ITEM = f"<link>', {XML}, '</link>"
#: Documents of ten kinds, one per page, by the last digit of its number.
HARD = {
    0: f"'<rss xmlns:media=\"http://m\"><channel><item><media:title>wrong</media:title><title-short>wrong</title-short><title>Page ', page_id, '</title>{ITEM}<media:content>wrong</media:content><description>d</description></item></channel></rss>'",
    1: f"'<rss><channel><!-- <item><title>gone</title><link>x</link></item> --><item><title>A <![CDATA[<b>', page_id, '</b> & c]]> end</title>{ITEM}<description><![CDATA[x </description> y]]></description></item></channel></rss>'",
    2: f"'<feed xmlns=\"http://www.w3.org/2005/Atom\"><entry><title>Entry ', page_id, '</title><link rel=\"alternate\" href=\"', {XML}, '\"/><link href=\"http://second\"/><content>c</content></entry></feed>'",
    3: f"'<a:feed xmlns:a=\"http://www.w3.org/2005/Atom\"><a:group><a:entry><a:title>Deep ', page_id, '</a:title><a:link href=\"', {XML}, '\"/><a:summary>s</a:summary><a:updated>2024-02-03T04:05:06Z</a:updated></a:entry></a:group></a:feed>'",
    4: f"'<rss><channel><item><title>Broken ', page_id, '</title>{ITEM}</item></channel>'",
    5: f"'<?xml version=\"1.0\" encoding=\"ISO-8859-1\"?><rss><channel><item><title>Ünlü ', page_id, '</title>{ITEM}<description>é</description></item></channel></rss>'",
    6: f"'<rss><channel><item><title>Very <b>bold</b> ', page_id, '</title>{ITEM}<summary>t</summary><pubDate>Tue, 02 February 24 10:00 est</pubDate></item></channel></rss>'",
    7: f"'<rss><channel><item><title> </title><title>late ', page_id, '</title>{ITEM}</item></channel></rss>'",
    8: f"'<?xml version=\"1.0\" encoding=\"UTF-16\"?><rss xmlns:atom=\"http://www.w3.org/2005/Atom\"><channel><item><title>Şğ ', page_id, '</title><guid>http://guid</guid><atom:link href=\"', {XML}, '\"/></item></channel></rss>'",
    9: f"'<rss><item><title>Outside ', page_id, '</title>{ITEM}</item></rss>'",
}
CODED = {5: "ISO-8859-1", 8: "UTF-16"}
TITLES = {0: "'Page ' || page_id", 1: "'A <b>' || page_id || '</b> & c end'", 2: "'Entry ' || page_id", 3: "'Deep ' || page_id", 5: "'Ünlü ' || page_id", 6: "'Very bold ' || page_id", 8: "'Şğ ' || page_id"}
SUMMARIES = {0: "d", 1: "x </description> y", 2: "c", 3: "s", 5: "é", 6: "t"}


def _case(of: dict[int, str], quote: str = "") -> str:
    return "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {quote}{v}{quote}" for k, v in of.items()) + " END"


@register(
    "feed_parse_hard", "source_id outcome title url summary published",
    f"""SELECT CAST(page_id AS VARCHAR) AS source_id, CASE WHEN page_id % 10 = 4 THEN 'error' ELSE 'item' END AS outcome, {_case(TITLES)} AS title, CASE WHEN page_id % 10 <> 4 THEN trim(url) END AS url, {_case(SUMMARIES, "'")} AS summary,
    CASE page_id % 10 WHEN 3 THEN '2024-02-03 04:05:06' WHEN 6 THEN '2024-02-02 15:00:00' END AS published FROM pages WHERE page_id % 10 NOT IN (7, 9) AND (page_id % 10 = 4 OR trim(url) <> '')""",
)
def _(spark, d):
    """Documents with namespaces, comments, CDATA, nested elements, several links, declared encodings, and broken ones."""
    pages = T.table(spark, d, "pages")
    body = F.lit(None).cast("binary")
    for k, parts in HARD.items():
        body = F.when(F.col("page_id") % 10 == k, F.encode(F.expr(f"concat({parts})"), CODED.get(k, "UTF-8"))).otherwise(body)
    rows = feed_xml.parsed(pages.select(F.col("page_id").cast("string").alias("source_id"), body.alias("body")))
    return rows.withColumns({"outcome": F.when(F.col("error").isNull(), "item").otherwise("error"), "published": F.date_format(X.feed_timestamp("published"), STAMP)})


#: Ways to write one moment (2 February 2024 or 1999, 10:11:12), and how many minutes later UTC is; None: no way to write it.
FORMS = (
    ("Fri, {d} Feb 2024 {h}:11:12 GMT", 0), ("Fri, {d} Feb 2024 {h}:11:12 gmt", 0), ("{d} Feb 2024 {h}:11:12 UT", 0), ("{d} Feb 2024 {h}:11:12 Z", 0), ("{d} Feb 2024 {h}:11:12", 0), ("Fri, {d} Feb 2024 {h}:11:12 +0300", -180),
    ("Fri, {d} Feb 2024 {h}:11:12 -0730", 450), ("Fri, {d} Feb 2024 {h}:11:12 EST", 300), ("Fri, {d} Feb 2024 {h}:11:12 EDT", 240), ("Fri, {d} Feb 2024 {h}:11:12 cst", 360), ("{d} Feb 2024 {h}:11:12 CDT", 300), ("{d} Feb 2024 {h}:11:12 MST", 420),
    ("{d} Feb 2024 {h}:11:12 MDT", 360), ("{d} Feb 2024 {h}:11:12 PST", 480), ("{d} Feb 2024 {h}:11:12 PDT", 420), ("{d} Feb 2024 {h}:11:12 AST", 240), ("{d} Feb 2024 {h}:11:12 ADT", 180), ("{d} Feb 2024 {h}:11:12 CET", 0),
    ("Fri, {d} February 2024 {h}:11:12 GMT", 0), ("FRI, {d} FEB 24 {h}:11:12 GMT", 0), ("Friday, {d} feb 2024 {h}.11.12 +0000", 0), ("{d}-Feb-2024 {h}:11:12 GMT", 0), ("Feb {d} 2024 {h}:11:12 GMT", 0), ("{d} Feb 2024 {h}:11:12 +0100 (winter)", -60),
    ("2024-02-{d}T{h}:11:12Z", 0), ("2024-02-{d}T{h}:11:12+03:00", -180), ("2024-02-{d}T{h}:11:12-0500", 300), ("2024-02-{d} {h}:11:12", 0), ("Fri, {d} Foo 2024 {h}:11:12 GMT", None), ("Fri, {d} Feb 2024 {h}:61:12 GMT", None), ("soon, {h}:11 on {d}", None), ("2024-13-{d}", None),
)


def _form(form: str) -> F.Column:
    """A way of writing as a column: {d} is the day and {h} the hour that the row gives."""
    text = form.replace("{d}", "%1$02d").replace("{h}", "%2$02d")
    return F.format_string(text, (F.col("event_id") % 28 + 1).cast("int"), (F.col("event_id") % 24).cast("int"))


@register(
    "feed_timestamp_forms", "event_id published",
    "SELECT event_id, strftime(make_timestamp(2024, 2, CAST(event_id % 28 + 1 AS BIGINT), CAST(event_id % 24 AS BIGINT), 11, 12) + to_minutes(CAST(shift AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS published FROM "
    f"(SELECT event_id, CASE event_id % {len(FORMS)} {' '.join(f'WHEN {k} THEN {m}' for k, (_, m) in enumerate(FORMS) if m is not None)} END AS shift FROM events)",
)
def _(spark, d):
    which, text = F.col("event_id") % len(FORMS), F.lit(None).cast("string")
    for k, (form, _) in enumerate(FORMS):
        text = F.when(which == k, _form(form)).otherwise(text)
    return T.table(spark, d, "events").select("event_id", F.date_format(X.feed_timestamp(text), STAMP).alias("published"))


# ------------------------------------------------------------------------------------------------ lines of JSON

KINDS = 9


def _news_lines(spark, d):
    """The documents as lines of three files, one line each; some lack a field, have one of a wrong type, are blank, or aren't JSON."""
    n = F.col("doc_id")
    good = F.to_json(
        F.struct(
            F.col("source").alias("source_id"), F.when(n % KINDS == 1, " ").otherwise(F.concat(F.lit("T"), n.cast("string"))).alias("title"), F.when(n % KINDS != 2, F.concat(F.lit("http://x/"), n.cast("string"))).alias("url"), F.lit("2024-01-01T00:00:00Z").alias("fetched_timestamp"),
            F.when(n % KINDS == 3, "when").otherwise("2024-01-01T00:00:00Z").alias("published_timestamp"), F.col("lang").alias("language"), F.lit("c").alias("category"), F.lit("rss").alias("source_access"), F.lit("u").alias("raw_source_url"), (n % 7).alias("content_hash"),
        )
    )
    line = F.when(n % KINDS == 4, "  ").when(n % KINDS == 5, F.concat(F.lit("["), good, F.lit("]"))).when(n % KINDS == 6, F.concat(good, F.lit(","))).otherwise(good)
    rows = T.table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", (n % 3).alias("part"), line.alias("value"))
    path = scratch(spark, "news-lines")
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return path


LINES = f"""SELECT 'part=' || CAST(part AS VARCHAR) AS part, row_number, CASE k WHEN 1 THEN 'missing title' WHEN 2 THEN 'missing url' WHEN 3 THEN 'published_timestamp is no timestamp' WHEN 5 THEN 'not a JSON object' WHEN 6 THEN 'not a JSON object' END AS error, CASE WHEN k NOT IN (1, 2, 3, 5, 6) THEN 'T' || doc_id END AS title
    FROM (SELECT doc_id, doc_id % 3 AS part, doc_id % {KINDS} AS k, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS row_number FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) WHERE k <> 4"""


@register("jsonl_rows", "part #row_number error title", LINES)
def _(spark, d):
    right, wrong = files.jsonl(spark, _news_lines(spark, d), schemas.NEWS, files.OPTIONAL_NEWS)
    rows = right.select("file", "row", F.lit(None).cast("string").alias("error"), "title").unionByName(wrong.select("file", "row", "error", F.lit(None).cast("string").alias("title")))
    return rows.select(F.regexp_extract("file", "part=[0-9]+", 0).alias("part"), F.col("row").alias("row_number"), "error", "title")


# ------------------------------------------------------------------------------------------------ price files

#: What is spoiled in the file, by the symbol's number. Some go back inside a file, one from file to file.
FAULTS = ("SMALL", "DATE", "INSIDE", "ACROSS", "TWICE", "TEXT", "ZERO", "CROSSED", "VOLUME", "STAMP", "EARLY", "NONE")


def _price_files(spark, d):
    """Bars as CSV files of four parts by date, each symbol spoiled in its own way."""
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    fault = F.element_at(F.array(*map(F.lit, FAULTS)), number % len(FAULTS) + 1)
    b = bars(spark, d).select("*", fault.alias("_f"), (F.year("date") % 4).alias("_y"), F.dayofmonth("date").alias("_d"))
    is_ = lambda f: F.col("_f") == f
    text = lambda c: F.col(c).cast("string")
    some = F.col("_d") == 15
    spoil = {
        "date": F.when(is_("DATE") & some, "soon").otherwise(text("date")), "open": F.when(is_("ZERO") & some, "0").otherwise(text("open")), "close": F.when(is_("TEXT") & some, "n/a").otherwise(text("close")),
        "high": F.when(is_("CROSSED") & some, (F.col("low") - 1).cast("string")).otherwise(text("high")), "low": text("low"), "adj_close": text("close"), "volume": F.when(is_("VOLUME") & some, "-1").otherwise(text("volume")),
        "source": F.lit("file"), "download_timestamp": F.when(is_("STAMP") & some, "later").when(is_("EARLY"), "1990-01-01 00:00:00").otherwise("2030-01-01 00:00:00"),
    }
    part = F.year("date") - 1990
    rows = b.filter(~(is_("SMALL") & (F.col("_d") != 15))).withColumns({"_part": F.when(is_("ACROSS"), 20 - part).otherwise(part), "_key": F.when(is_("INSIDE"), -F.unix_date("date")).otherwise(F.unix_date("date")), "_n": F.when(is_("TWICE") & some, 2).otherwise(1)})
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).select("symbol", *[v.alias(c) for c, v in spoil.items()], F.format_string("%02d", F.col("_part")).alias("part"), "_key")
    path = scratch(spark, "price-files")
    rows.repartition("part").sortWithinPartitions("part", "symbol", "_key").drop("_key").write.partitionBy("part").option("header", True).csv(path)
    return path


MARK = f"CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INTEGER) % {len(FAULTS)}"
O.cte("fault_bar", f"SELECT symbol, date, low, {MARK} AS f, dayofmonth(date) AS dd, count(*) OVER (PARTITION BY symbol, year(date)) AS in_year FROM bar", "bar")


def _fault(number: int, code: str, severity: str, where: str) -> str:
    return f"SELECT DISTINCT symbol, '{severity}' AS severity, '{code}' AS code FROM fault_bar WHERE f = {number} AND {where}"


FILE_CODES = " UNION ALL ".join(
    [
        "SELECT symbol, 'warning' AS severity, 'SMALL_SAMPLE' AS code FROM fault_bar WHERE f <> 0 OR dd = 15 GROUP BY symbol HAVING count(*) + count(*) FILTER (f = 4 AND dd = 15) < 240",
        _fault(1, "INVALID_PRICE_DATE", "blocking", "dd = 15"),
        "SELECT symbol, 'blocking', 'DUPLICATE_PRICE_DATES' FROM fault_bar WHERE f = 1 AND dd = 15 GROUP BY symbol HAVING count(*) > 1",
        _fault(2, "NON_MONOTONIC_PRICE_DATES", "blocking", "in_year > 1"),
        "SELECT symbol, 'blocking', 'NON_MONOTONIC_PRICE_DATES' FROM fault_bar WHERE f = 3 GROUP BY symbol HAVING count(DISTINCT year(date)) > 1",
        _fault(4, "DUPLICATE_PRICE_DATES", "blocking", "dd = 15"),
        _fault(5, "INVALID_PRICE_VALUE", "blocking", "dd = 15"),
        _fault(6, "NON_POSITIVE_PRICE", "blocking", "dd = 15"),
        _fault(7, "HIGH_BELOW_LOW", "blocking", "dd = 15"),
        _fault(7, "NON_POSITIVE_PRICE", "blocking", "dd = 15 AND low - 1 <= 0"),
        _fault(8, "INVALID_VOLUME", "blocking", "dd = 15"),
        _fault(9, "INVALID_DOWNLOAD_TIMESTAMP", "blocking", "dd = 15"),
        _fault(10, "PRICE_DATE_AFTER_DOWNLOAD", "blocking", "date > DATE '1990-01-01'"),
        "SELECT 'NOBODY', 'blocking', 'EMPTY_PRICE_HISTORY'",
        "SELECT DISTINCT symbol, 'blocking', 'MISSING_PRICE_COLUMNS' FROM bar WHERE year(date) = 1995",
    ]
)


@register("price_file_audit", "symbol severity code #times", f"SELECT symbol, severity, code, count(*) AS times FROM ({FILE_CODES}) GROUP BY ALL", "fault_bar", "bar")
def _(spark, d):
    """All twelve codes, from files: their rows as they are written, and a file without some columns."""
    expected = T.universe(spark, d).select("symbol").unionByName(spark.createDataFrame([("NOBODY",)], "symbol string"))
    found = files.price_rows(spark, _price_files(spark, d))
    there = found.select("symbol").distinct()
    issues = quality.price_issues(found, 240, "_place", schemas.PRICE_NAMES, there.unionByName(expected.filter("symbol = 'NOBODY'")), ("_file", "_split"))
    narrow = scratch(spark, "narrow-prices")
    files.write_csv(bars(spark, d).filter("year(date) = 1995").select("symbol", F.col("date").cast("string").alias("date"), "close"), narrow)
    lacking = quality.price_issues(files.price_rows(spark, narrow), 240, "_place", schemas.PRICE_NAMES, within=("_file", "_split"))
    return issues.unionByName(lacking).groupBy("symbol", "severity", "code").agg(F.count("*").alias("times"))


# ------------------------------------------------------------------------------------------------ long histories

#: To a thousandth, which is nine digits of these values: sums in another order differ in the last ones.
THOUSANDTHS = ", ".join(f"floor({c} * 1000 + 0.5) / 1000 AS {c}" for c in indicators.RECURSIVE)


@register("indicators_in_blocks", f"symbol date {' '.join(indicators.RECURSIVE)}", f"SELECT symbol, date, {THOUSANDTHS} FROM recursive_ind", "recursive_ind")
def _(spark, d):
    """Blocks of at most 97 bars, so that each symbol has many."""
    rows = indicator_blocks.recursive(bars(spark, d), 97)
    return rows.withColumns({c: F.floor(F.col(c) * 1000 + 0.5) / 1000 for c in indicators.RECURSIVE})


# ------------------------------------------------------------------------------------------------ decision records


def _decision_log(spark, d):
    """A decision for each label, sealed and appended in two goes; some made inconsistent before, some changed or cut after it."""
    n = F.col("doc_id")
    kind = n % 8
    label = F.when(F.col("quality") == 1, "POTENTIAL_CATCH_UP_CANDIDATE").otherwise("INVESTIGATE")
    proof = F.sha2(n.cast("string"), 256)
    rows = T.table(spark, d, "labels").filter("doc_id IS NOT NULL").select(
        "doc_id", F.concat(F.lit("d"), n.cast("string")).alias("decision_id"), F.lit("2024-01-01T00:00:00+00:00").alias("created_at"), label.alias("output_label"), F.lit("Accept").alias("review_status"), F.lit(" someone ").alias("reviewer"), F.lit("é").alias("review_notes"),
        F.struct(label.alias("output_label"), F.when(kind == 3, "reject").otherwise("accept").alias("review_status")).alias("harness_snapshot"), F.when(kind != 4, F.create_map(F.lit("toxic"), F.col("toxic") / 4)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("inputs"),
        F.when(kind != 5, F.struct((n * 1e-7).alias("small"), F.lit(True).alias("ok"))).alias("tool_outputs"), proof.alias("evidence_hash"), F.struct(F.when(kind == 2, "other").otherwise(proof).alias("evidence_hash"), F.lit("PASS").alias("gate_status")).alias("quality_gate"), F.lit(True).alias("saved"),
    )
    path = scratch(spark, "decision-log")
    for half in (0, 1):
        own = rows.filter(n % 2 == half)
        sealed, _ = decisions.seal(own.drop("doc_id"))
        kind_ = F.substring("decision_id", 2, 20).cast("bigint") % 8
        line = F.when(kind_ == 1, F.regexp_replace("line", '"output_label":"[A-Z_]+","quality', '"output_label":"BUY","quality')).when(kind_ == 6, F.replace("line", F.lit('"reviewer":"someone",'), F.lit(""))).when(kind_ == 7, F.replace("line", F.lit("\\u00e9"), F.lit("e"))).otherwise(F.col("line"))
        decisions.append(sealed.withColumn("line", line), path)
    return path


DECIDED = r"""WITH r AS (SELECT doc_id, doc_id % 8 AS k, CASE WHEN quality = 1 THEN 'POTENTIAL_CATCH_UP_CANDIDATE' ELSE 'INVESTIGATE' END AS label, CASE coalesce(toxic, 0) WHEN 1 THEN '0.25' ELSE '0.0' END AS toxic, sha256(CAST(doc_id AS VARCHAR)) AS proof FROM labels WHERE doc_id IS NOT NULL),
    h AS (SELECT *, '{"created_at":"2024-01-01T00:00:00+00:00","decision_id":"d' || doc_id || '","evidence_hash":"' || proof || '","harness_snapshot":{"output_label":"' || label || '","review_status":"' || CASE k WHEN 3 THEN 'reject' ELSE 'accept' END || '"},"inputs":{' || CASE k WHEN 4 THEN '' ELSE '"toxic":' || toxic END
      || '},"output_label":"' || label || '","quality_gate":{"evidence_hash":"' || CASE k WHEN 2 THEN 'other' ELSE proof END || '","gate_status":"PASS"},"review_notes":"\u00e9","review_status":"accept","reviewer":"someone","schema_version":"1.0","tool_outputs":null}' AS canonical FROM r)
    SELECT 'd' || doc_id AS decision_id, CASE k WHEN 0 THEN 'ok' ELSE 'error' END AS replay_status, CASE WHEN k = 5 THEN sha256(canonical) END AS record_hash,
    CASE k WHEN 1 THEN 'the record was changed after it was sealed;the harness had another label' WHEN 2 THEN 'the gate judged other evidence' WHEN 3 THEN 'the harness had another review' WHEN 4 THEN 'inputs is empty' WHEN 5 THEN 'tool_outputs is empty' WHEN 7 THEN 'the record was changed after it was sealed' ELSE '' END AS messages FROM h WHERE k <> 6
    UNION ALL SELECT 'missing reviewer', CAST(count(*) AS VARCHAR), NULL, '' FROM h WHERE k = 6"""


@register("decision_records", "decision_id replay_status record_hash messages", DECIDED.replace("WITH r AS", "SELECT * FROM (WITH r AS", 1) + ")")
def _(spark, d):
    """Records read from a log and replayed; the hash is shown of those whose canonical text SQL can write."""
    right, wrong = decisions.read(spark, _decision_log(spark, d))
    k = F.substring("decision_id", 2, 20).cast("bigint") % 8
    rows = decisions.replay(right).select("decision_id", "replay_status", F.when(k == 5, F.col("recomputed_hash")).alias("record_hash"), F.array_join("messages", ";").alias("messages"))
    lost = wrong.groupBy(F.col("error").alias("decision_id")).agg(F.count("*").cast("string").alias("replay_status"))
    if lost.isEmpty():
        lost = spark.createDataFrame([("missing reviewer", "0")], "decision_id string, replay_status string")
    return rows.unionByName(lost.select("decision_id", "replay_status", F.lit(None).cast("string").alias("record_hash"), F.lit("").alias("messages")))
