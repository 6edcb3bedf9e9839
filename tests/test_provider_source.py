"""Providers read by ``spark.read.format``: partitions, filters that reach them, keys that fail."""

import datetime as dt

import pandas as pd
import pytest

from marketloom.sources import provider_source as P


class Prices:
    """Bars of each day of the span, which say what was asked for; END is the span's end where none is given."""

    END = dt.date(2024, 1, 20)

    def download(self, symbol, start, end):
        if symbol == "BAD":
            raise OSError("no network")
        if symbol == "NONE":
            return pd.DataFrame()
        first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end) if end else self.END
        days = pd.date_range(first, last, inclusive="left")
        odd = ["soon" if k == 0 and symbol == "ODD" else str(d.date()) for k, d in enumerate(days)]
        return pd.DataFrame({"Date": odd, "Open": 1.0, "High": "2", "Low": "x", "Close": float(first.toordinal()), "Adj Close": float("nan"), "Volume": float(last.toordinal())})


class Lines:
    def download(self, symbol):
        return pd.DataFrame({"label": ["Total Revenue"], "period_end": ["2024-03-31"], "value": [5]})


@pytest.fixture(scope="module")
def source(spark):
    P.register(spark, Prices(), P.BARS, "test_prices")
    P.register(spark, Lines(), P.STATEMENTS, "test_statements")
    return lambda **o: spark.read.format("test_prices").options(start="2024-01-01", **o).load()


def test_a_partition_for_each_key(source):
    df = source(keys="A, B,A,BAD,NONE")
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert {r.symbol: r.error for r in rows if r.error} == {"BAD": "OSError: no network", "NONE": "ValueError: nothing was returned"}
    good = [r for r in rows if not r.error]
    assert len(good) == 38 and {(r.symbol, r.open, r.high, r.low, r.adj_close) for r in good} == {("A", 1.0, 2.0, None, None), ("B", 1.0, 2.0, None, None)}


def test_filters_reach_the_provider(source):
    df = source(keys="A,B,BAD").filter("symbol = 'A' AND date >= DATE '2024-01-05' AND date < DATE '2024-01-08'")
    assert df.rdd.getNumPartitions() == 1
    rows = df.collect()
    assert [r.date.day for r in sorted(rows)] == [5, 6, 7]
    assert {(r.close, r.volume) for r in rows} == {(dt.date(2024, 1, 5).toordinal(), dt.date(2024, 1, 9).toordinal())}
    assert source(keys="A,B,C").filter("symbol IN ('B', 'C', 'Z')").rdd.getNumPartitions() == 2
    assert [r.symbol for r in source(keys="A,BAD").filter("error IS NOT NULL").collect()] == ["BAD"]
    assert source(keys="A").filter("date = DATE '2024-01-03'").count() == 1


def test_bad_values_cost_a_value_and_no_keys_no_rows(source, spark):
    rows = source(keys="ODD", end="2024-01-04").collect()
    assert sorted(str(r.date) for r in rows) == ["2024-01-02", "2024-01-03", "None"] and not any(r.error for r in rows)
    assert source(keys="").collect() == []
    assert [tuple(r) for r in spark.read.format("test_statements").option("keys", "A").load().collect()] == [("A", "Total Revenue", dt.date(2024, 3, 31), 5.0, None)]
