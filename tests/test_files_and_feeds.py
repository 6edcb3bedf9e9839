"""Feed documents as XML, lines with their numbers, files before anything is dropped, and tables of several threads."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from marketloom import schemas, store
from marketloom.operators import news, quality
from marketloom.sources import feed_xml, files, lines, providers

ATOM = 'xmlns="http://www.w3.org/2005/Atom"'


def items(xml):
    return feed_xml.items(xml if isinstance(xml, bytes) else xml.encode())


def rss(inner, root='<rss xmlns:media="http://m" xmlns:atom="http://www.w3.org/2005/Atom">'):
    return f"{root}<channel><item>{inner}</item></channel></rss>"


def test_fields_are_direct_children_without_prefix():
    assert items(rss("<media:title>no</media:title><media:group><title>no</title></media:group><title>yes</title><link>u</link><media:content>no</media:content>")) == [("yes", "u", None, None)]
    assert items(rss("<title-short>no</title-short><title>yes</title><guid>g</guid>")) == [("yes", "g", None, None)]


def test_comments_cdata_and_nested_elements():
    got = items(rss("<!-- <title>no</title> --><title>a <![CDATA[<b> & ]]>c <i>d</i>&amp;lt;</title><link>u</link><description><![CDATA[x</description>y]]></description>"))
    assert got == [("a <b> & c d&lt;", "u", "x</description>y", None)]


def test_links():
    assert items(rss('<title>t</title><link>u</link><atom:link href=" v "/><atom:link href="w"/>')) == [("t", "v", None, None)]
    assert items(rss('<title>t</title><link>u</link><atom:link rel="self"/>')) == [("t", "u", None, None)]
    assert items(f'<feed {ATOM}><a><entry><title>t</title><link href="u"/><updated>2024</updated><published>2023</published></entry></a></feed>') == [("t", "u", None, "2023")]
    assert items("<rss><item><title>t</title><link>u</link></item></rss>") == [] and items(rss("<title> </title><title>t</title><link>u</link>")) == []


def test_declared_encodings():
    for code in ("iso-8859-9", "windows-1254", "utf-16", "utf-8"):
        assert items(f'<?xml version="1.0" encoding="{code}"?>{rss("<title>Şirket ğüş</title><link>u</link>")}'.encode(code)) == [("Şirket ğüş", "u", None, None)]


class Client:
    def fetch(self, url):
        return {
            "http://latin": '<?xml version="1.0" encoding="iso-8859-9"?>'.encode() + rss("<title>Döviz ğ</title><link>u</link><pubDate>Mon, 01 Jan 2024 09:30:00 EST</pubDate>").encode("iso-8859-9"),
            "http://broken": b"<rss><channel><item><title>x</title>",
            "http://odd": b'<?xml version="1.0" encoding="no-such"?><rss>\xff</rss>',
            "http://none": b"<rss><channel/></rss>",
        }[url]


def test_a_broken_document_is_an_error_of_its_source(spark):
    sources = spark.createDataFrame([(k, f"http://{k}", "tr", "x") for k in ("latin", "broken", "odd", "none", "gone")], "source_id string, url string, language string, category string")
    docs, failed = providers.feeds(spark, sources, Client(), "2024-01-03T00:00:00Z")
    got = news.parse_feeds(docs).collect()
    assert [(r.title, r.language, str(r.published_timestamp)) for r in got] == [("Döviz ğ", "tr", "2024-01-01 14:30:00")]
    errors = news.feed_errors(docs)
    assert {r.source_id for r in errors.collect()} == {"broken", "odd"}
    status = news.fetch_status(sources, news.parse_feeds(docs), failed.unionByName(errors))
    assert {r.source_id: r.fetch_status for r in status.collect()} == {"latin": "pass", "broken": "error", "odd": "error", "none": "warning", "gone": "error"}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "50"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_lines_are_numbered_across_splits(spark, small_splits, tmp_path):
    ends = {"a.txt": "\n", "b.txt": "\r\n"}
    for name, end in ends.items():
        (tmp_path / name).write_bytes(end.join("" if k % 7 == 3 else f"{name} line {k} " + "x" * (k % 40) for k in range(1, 301)).encode())
    got = lines.numbered(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = got.collect()
    assert len(rows) == 600 and {(r.file.rsplit("/", 1)[-1], r.row) for r in rows} == {(n, k) for n in ends for k in range(1, 301)}
    assert all(r.line == "" if r.row % 7 == 3 else r.line.startswith(f"{r.file.rsplit('/', 1)[-1]} line {r.row} ") for r in rows)


GOOD = {"source_id": "s", "title": "t", "url": "u", "fetched_timestamp": "2024-01-01T00:00:00Z", "language": "en", "category": "c", "source_access": "rss", "raw_source_url": "r", "content_hash": 7}


def test_json_lines_name_what_is_wrong(spark, small_splits, tmp_path):
    wrong = {
        "missing title": GOOD | {"title": " \t"}, "missing url": {k: v for k, v in GOOD.items() if k != "url"}, "missing language": GOOD | {"language": None},
        "fetched_timestamp is no timestamp": GOOD | {"fetched_timestamp": "soon"}, "missing fetched_timestamp": GOOD | {"fetched_timestamp": ""}, "published_timestamp is no timestamp": GOOD | {"published_timestamp": {"a": 1}},
    }
    plain = [json.dumps(v) for v in wrong.values()] + ["5", "[1]", "null", '{"a":', json.dumps(GOOD) + json.dumps(GOOD), json.dumps(GOOD) + ","]
    (tmp_path / "n.jsonl").write_text("\n".join([json.dumps(GOOD), "", *plain, "  ", json.dumps(GOOD | {"summary": None, "more": 1})]))
    right, bad = files.jsonl(spark, str(tmp_path), schemas.NEWS, files.OPTIONAL_NEWS)
    assert sorted((r.row, r.content_hash, r.summary) for r in right.collect()) == [(1, "7", None), (len(plain) + 4, "7", None)]
    assert {r.row: r.error for r in bad.collect()} == dict(enumerate([*wrong, *["not a JSON object"] * 6], 3))
    with pytest.raises(Exception, match=r"n\.jsonl row \d+ (missing|not a|\w+ is no)"):
        files.news(spark, str(tmp_path)).select("url").collect()
    (tmp_path / "n.jsonl").write_text(json.dumps(GOOD) + "\n")
    assert files.news(spark, str(tmp_path)).count() == 1
    (tmp_path / "n.jsonl").write_text(json.dumps(GOOD | {"linked_entities": ["ticker:A"], "matched_terms": ["a", "b"]}) + "\n" + json.dumps(GOOD | {"linked_entities": "x", "matched_terms": []}))
    right, bad = files.jsonl(spark, str(tmp_path), schemas.MATCHED_NEWS, files.OPTIONAL_NEWS)
    assert [(r.linked_entities, r.matched_terms) for r in right.collect()] == [(["ticker:A"], ["a", "b"])]
    assert [r.error for r in bad.collect()] == ["linked_entities is no array<string>"]


HEADER = "symbol,date,open,high,low,close,adj_close,volume,source,download_timestamp\n"


def price_line(symbol, day, close="5"):
    return f"{symbol},{day},5,6,4,{close},5,10,f,2030-01-01 00:00:00"


def test_sortedness_adds_up_over_splits_and_files(spark, small_splits, tmp_path):
    days = [f"2024-{1 + k // 28:02d}-{1 + k % 28:02d}" for k in range(120)]
    one = [price_line("UP", d) for d in days] + [price_line("DOWN", d) for d in days[60:] + days[:60]]
    (tmp_path / "1.csv").write_text(HEADER + "\n".join(one + [price_line("JOINT", d) for d in days[60:]]) + "\n")
    (tmp_path / "2.csv").write_text(HEADER + "\n".join([price_line("JOINT", d) for d in days[:60]] + [price_line("SAME", days[0])] * 2) + "\n")
    rows = files.price_rows(spark, str(tmp_path))
    assert rows.select("_file", "_split").distinct().count() > 10
    assert {r.symbol: r.back for r in quality.backward_dates(rows, "_place", ("_file", "_split")).collect()} == {"UP": 0, "DOWN": 1, "JOINT": 1, "SAME": 0}
    codes = {(r.symbol, r.code) for r in quality.price_issues(rows, 2, "_place", within=("_file", "_split")).collect()}
    assert codes == {("DOWN", "NON_MONOTONIC_PRICE_DATES"), ("JOINT", "NON_MONOTONIC_PRICE_DATES"), ("SAME", "DUPLICATE_PRICE_DATES")}
    audit = quality.market_audit(rows, rows.select("symbol").distinct(), 2, "_place", ("_file", "_split"))
    assert {r.symbol: r.status for r in audit.collect()} == {"UP": "pass", "DOWN": "error", "JOINT": "error", "SAME": "error"}


def test_bad_price_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "p.csv").write_text(HEADER + "\n".join([price_line("A", "2024-01-01"), price_line("A", "soon"), price_line("A", "2024-01-03", "x")]) + "\n")
    bars, rejected = files.import_prices(spark, str(tmp_path))
    assert [str(r.date) for r in bars.collect()] == ["2024-01-01"] and bars.columns == list(schemas.PRICE_NAMES)
    assert {(r.date, tuple(r.errors)) for r in rejected.collect()} == {("soon", ("date is not a date",)), ("2024-01-03", ("close is not a number",))}
    bad_rate = spark.createDataFrame([("usd_try", "soon", 1.0), ("usd_try", "2024-01-01", 2.0)], "indicator string, date string, close double")
    assert files.fx_context(bad_rate, "2024-02-01 00:00:00").count() == 1
    wide = spark.createDataFrame([("A", "Total Revenue", "1", "2")], "ticker string, label string, TTM string, `2024-01-01` string")
    assert [str(r.period_end) for r in files.statements(wide, {"revenue": ("Total Revenue",)}).collect()] == ["2024-01-01"]


def test_freed_spares_tables_of_other_threads(spark):
    with ThreadPoolExecutor(1) as other:
        with store.freed(spark):
            theirs = other.submit(lambda: store.stored(spark.range(4), "theirs")).result()
            mine, helped = store.together(lambda: store.stored(spark.range(2), "mine"), lambda: store.stored(spark.range(3), "helped"))
            paths = [t.inputFiles()[0].rsplit("/", 1)[0] for t in (mine, helped)]
        assert theirs.count() == 4
    for path in paths:
        with pytest.raises(Exception, match="(?i)not.*exist"):
            spark.read.parquet(path).count()
