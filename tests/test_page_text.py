"""Pages that are cut inside an entity give the text that the query's SQL gives."""

import html

import duckdb
import pandas as pd

import __spark_entry__ as entry
from marketloom.functions import text as X

#: The entities of the generated pages: whole, and cut before white space, a tag, a letter, another entity or the end.
PAGES = [
    "<p>token = &quot p{margin:0}</p>", "a &quot", "&quot<b>x</b>", "&quota; &quotation; &quo; &qu ot;", "&copy 2024 &cop &copy; &copyx", "&middot &middo; &middot;x",
    "&amp &amp; &ampere; &am p; &a &", "&amp;quot; &ampquot; &amp;quot &amp;amp; &ampamp", "&quot&quot; &quot&amp;; &a&amp;mp;", "no & none", "plain", "", None,
]


def test_page_text_as_its_sql(spark, tmp_path):
    pd.DataFrame({"page_id": range(len(PAGES)), "html": PAGES}).to_parquet(tmp_path / "pages.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = dict(con.execute(entry.oracle_sql()["page_text"]).fetchall())
    assert {r.page_id: r.page_text for r in entry.queries()["page_text"](spark, str(tmp_path)).collect()} == want
    assert want[0] == "token = &quot p{margin:0}"


def test_closed_entities_of_the_full_table(spark):
    texts = [*filter(None, PAGES), "&euro; &lt;&#8364;&#x20AC; &AMP; &nbsp;.", "&euro;&quot &#39 &notin; &not &notit; &ampere; &amp;lt; &lt"]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.unescaped("t", closed=True).alias("h")).collect()]
    assert got == [X.unescape_closed(t) for t in texts]
    assert got[-2] == html.unescape(texts[-2])
    assert got[-1] == "€&quot &#39 ∉ &not &notit; &ere; &lt; &lt"
