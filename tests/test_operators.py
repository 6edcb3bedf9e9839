"""Operators on small fixtures with values worked out by hand or by plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import text as X
from marketloom.operators import asof, backtest, catch_up, events, evidence, fundamentals, indicators, news, quality, reports, reversals, signals, splits, variants, views, weekday
from marketloom.operators.harness import Harness
from marketloom.operators.tools import NAMES, Tools
from marketloom.sources import files, settings
from marketloom.streaming import news as stream


def days(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bars_of(spark, closes, symbol="AAA", sector="Sector A", open_=None):
    rows = [(symbol, sector, d, float(c - 0.5) if open_ is None else float(o), float(c) + 1, float(c) - 1, float(c), 1000 + 10 * k) for k, (d, c, o) in enumerate(zip(days(len(closes)), closes, open_ or closes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, sector string, date date, open double, high double, low double, close double, volume long")


@pytest.fixture(scope="module")
def wavy(spark):
    rng = np.random.default_rng(4)
    return bars_of(spark, list(np.round(100 + np.cumsum(rng.normal(0, 1.5, 140)), 2)))


def column(df, *names):
    return np.array(df.orderBy("date").select(*names).toPandas(), float).T


def test_recursive_indicators_against_loops(wavy):
    close, high, low = column(wavy, "close", "high", "low")
    out = indicators.recursive(wavy)
    n = len(close)

    def smooth(x, a, least):
        y, seen = np.full(len(x), np.nan), 0
        now = np.nan
        for k, v in enumerate(x):
            if not math.isnan(v):
                now = v if math.isnan(now) else (1 - a) * now + a * v
                seen += 1
            if seen >= least:
                y[k] = now
        return y

    ema20, macd_line, signal = smooth(close, 2 / 21, 20), smooth(close, 2 / 13, 12) - smooth(close, 2 / 27, 26), None
    signal = smooth(macd_line, 2 / 10, 9)
    step = np.r_[np.nan, np.diff(close)]
    gain, loss = smooth(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), 1 / 14, 14), smooth(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), 1 / 14, 14)
    rsi = 100 - 100 / (1 + gain / loss)
    kama = np.full(n, np.nan)
    kama[10] = close[10]
    for k in range(11, n):
        path = sum(abs(close[j] - close[j - 1]) for j in range(k - 9, k + 1))
        er = abs(close[k] - close[k - 10]) / path if path else 0
        kama[k] = kama[k - 1] + (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (close[k] - kama[k - 1])
    got = column(out, "ema_20", "macd", "macd_signal", "rsi_14", "kama_10")
    for g, w in zip(got, (ema20, macd_line, signal, rsi, kama), strict=True):
        np.testing.assert_allclose(g, w, rtol=1e-9, equal_nan=True)


def test_all_gains_give_rsi_100_and_flat_prices_hold_kama(spark):
    assert column(indicators.recursive(bars_of(spark, list(range(100, 130)))), "rsi_14")[0][-1] == 100
    flat = column(indicators.recursive(bars_of(spark, [100.0] * 30)), "kama_10", "rsi_14")
    assert flat[0][-1] == 100 and flat[1][-1] == 100


def test_windows_need_all_their_rows(spark):
    rows = bars_of(spark, [100 + k / 2 for k in range(25)])
    sma = column(indicators.sma(rows, 20), "sma_20")[0]
    assert math.isnan(sma[18]) and sma[19] == pytest.approx(np.mean([100 + k / 2 for k in range(20)]))
    assert column(indicators.true_range(rows), "true_range")[0][0] == 2.0
    assert not any(np.isfinite(column(indicators.simple(rows), "sma_50")[0]))


def test_appending_bars_changes_nothing_before(wavy):
    cut = days(120)[-1]
    names = [c for c in indicators.SIMPLE + indicators.RECURSIVE if c != "ichimoku_lagging"]
    long, short = indicators.add_all(wavy).filter(F.col("date") <= cut), indicators.add_all(wavy.filter(F.col("date") <= cut))
    np.testing.assert_allclose(column(long, *names), column(short, *names), rtol=1e-9, equal_nan=True)
    seen = lambda df, **k: {tuple(r) for r in events.detect(df, **k).filter(F.col("event_date") <= cut).select("event_type", "event_date").collect()}
    a, b = seen(indicators.add_all(wavy), strict_point_in_time=True), seen(indicators.add_all(wavy.filter(F.col("date") <= cut)), strict_point_in_time=True)
    assert a == b


def test_families_without_columns_are_errors(wavy):
    frame = indicators.support_resistance(wavy)
    found, errors = events.detect_available(frame)
    assert set(errors) == {"bollinger", "rsi", "supertrend", "kama", "ichimoku"}
    assert found.count() >= 0


def test_catch_up(spark):
    rows = bars_of(spark, [100, 90, 95, 98, 102, 105]).unionByName(bars_of(spark, [100, 110, 111, 112, 113, 114], "BBB")).unionByName(bars_of(spark, [50, 51, 52, 53, 54, 55], "CCC", "Sector B"))
    out = {(r.symbol, r.date): r for r in catch_up.observations(rows, 1, (2,)).collect()}
    a = out["AAA", days(2)[1]]
    assert a.status == "ok" and a.is_laggard and a.peer_count == 1 and a.rank_in_sector == 2
    assert a.lookback_return == pytest.approx(-0.1) and a.peer_median_lookback_return == pytest.approx(0.1) and a.catch_up_score == pytest.approx(-0.2)
    assert a.future_relative_return == pytest.approx(98 / 90 - 112 / 110) and not a.false_positive
    assert out["AAA", days(1)[0]].status == "insufficient_history"
    assert out["AAA", days(6)[5]].status == "insufficient_peer_forward_history"
    assert out["CCC", days(3)[2]].status == "insufficient_peers" and out["CCC", days(6)[5]].status == "insufficient_forward_history"


def test_peer_median_is_that_of_the_others(spark):
    rng = np.random.default_rng(2)
    rows = [(f"S{k}", "x", dt.date(2024, 1, 1), float(v) if k % 5 else None) for k, v in enumerate(rng.integers(0, 9, 23))]
    df = spark.createDataFrame(rows, "symbol string, sector string, date date, v double")
    for r in catch_up.peer_medians(df, m="v").collect():
        assert r.m == np.median([v for s, _, _, v in rows if s != r.symbol and v is not None])


def test_weekday(spark):
    rows = bars_of(spark, [100 + k for k in range(35)])
    bench = spark.createDataFrame([(d, 100 + 0.25 * k) for k, d in enumerate(days(35))], "date date, close double")
    out = weekday.observations(rows, bench, (1, 5), unseen_start_date="2024-02-01")
    got = {(r.date, r.holding_days): r for r in out.collect()}
    monday = got[dt.date(2024, 1, 29), 5]
    assert (monday.pattern_name, monday.status, monday.period_split, monday.market_regime) == ("Monday_5d_hold", "ok", "selection", "rising")
    assert monday.gross_return == pytest.approx(125 / 120 - 1) and monday.cost_adjusted_return == pytest.approx(125 / 120 - 1 - 0.0015)
    assert got[days(1)[0], 1].status == "insufficient_regime_history" and got[days(35)[-1], 1].status == "insufficient_forward_history"
    assert weekday.summary(out).agg(F.sum("observation_count")).first()[0] == sum(r.status == "ok" for r in got.values())


def test_next_bar_is_strictly_later(spark):
    rows = bars_of(spark, [100, 101, 103, 102])
    first = days(4)
    asked = spark.createDataFrame([("AAA", first[0], 2), ("AAA", dt.date(2023, 12, 1), 1), ("AAA", first[3], 1), ("AAA", first[2], 1), ("ZZZ", first[0], 1), ("AAA", dt.date(2024, 1, 2), 1)], "symbol string, known date, horizon int")
    got = {(r.symbol, r.known): (r.entry_date, r.exit_date) for r in asof.next_bar(asked, rows, "known", (1, 2)).collect()}
    assert got["AAA", first[0]] == (first[1], first[3]) and got["AAA", dt.date(2023, 12, 1)] == (first[0], first[1])
    assert got["AAA", first[3]] == (None, None) and got["AAA", first[2]] == (first[3], None) and got["ZZZ", first[0]] == (None, None)


def test_reversals_and_combined_events(spark):
    rows = bars_of(spark, [100, 101, 103, 102, 106, 108, 107, 110, 112, 111, 115, 118])
    ev = [("AAA", "f", "b", days(1)[0], "k1"), ("AAA", "g", "a", days(1)[0], "k2"), ("AAA", "f", "b", days(5)[4], "k3")]
    df = spark.createDataFrame(ev, "symbol string, event_family string, event_type string, event_date date, known_at string")
    out = reversals.observations(rows, df, None, (1, 3), 2).collect()
    comb = [r for r in out if r.signal_group == "combined"]
    assert {(r.event_type, r.known_at) for r in comb} == {("a+b", "k2")} and len(out) == 8
    r = next(r for r in out if r.event_date == days(5)[4] and r.horizon == 3)
    assert (r.entry_close, r.exit_close, r.bounce, r.status, r.market_regime) == (108.0, 112.0, True, "ok", "rising")


def prices_like_the_reference(spark):
    return bars_of(spark, [100, 101, 103, 106, 110, 111, 115])


def test_backtest(spark):
    rows = prices_like_the_reference(spark)
    bench = spark.createDataFrame([(d, 1000.0 + 5 * k) for k, d in enumerate(days(7))], "date date, close double")
    sector = spark.createDataFrame([("S", d, 200.0 + 2 * k) for k, d in enumerate(days(7))], "sector string, date date, close double")
    sig = spark.createDataFrame(
        [("a", "AAA", "2024-01-01T18:10:00+03:00", "long", 2), ("b", "AAA", "2024-01-01T23:50:00+03:00", "short", 2), ("c", "ZZZ", "2024-01-01", "long", 2), ("d", "AAA", "2024-01-08", None, 2), ("e", "AAA", "2024-01-09", "long", None)],
        "signal_id string, symbol string, known_at string, direction string, horizon int",
    )
    out = {r.signal_id: r for r in backtest.run(sig, rows, bench, sector, spark.createDataFrame([("AAA", "S")], "symbol string, sector string"), horizons=(2,)).collect()}
    a = out["a"]
    assert (a.entry_date, a.entry_price, a.exit_date, a.exit_price) == (days(2)[1], 100.5, days(4)[3], 106.0)
    assert a.gross_return == pytest.approx(106 / 100.5 - 1) and a.cost_adjusted_return == pytest.approx(106 / 100.5 - 1 - 0.0015)
    assert a.benchmark_return == pytest.approx(1015 / 1005 - 1) and a.sector_benchmark_return == pytest.approx(206 / 202 - 1) and a.buy_hold_return == pytest.approx(0.06)
    assert [out[k].status for k in "bcde"] == ["unsupported_direction", "missing_price_history", "insufficient_forward_history", "insufficient_forward_history"]
    with pytest.raises(ValueError, match="costs"):
        backtest.run(sig, rows, trading_cost_bps=0, slippage_bps=0)
    twice = rows.unionByName(rows.limit(1))
    assert backtest.run(sig.filter("signal_id = 'a'"), twice).first().status == "missing_price_history"


def test_risk(spark):
    t = [("s1", "ok", dt.date(2024, 1, 2), 0.1, 0.05, 1), ("s2", "ok", dt.date(2024, 1, 3), -0.2, 0.0, 1), ("s3", "ok", dt.date(2024, 1, 4), 0.05, None, None), ("s4", "x", None, None, None, 1)]
    trades = spark.createDataFrame(t, "signal_id string, status string, exit_date date, cost_adjusted_return double, benchmark_return double, horizon int")
    r = backtest.risk_metrics(trades).first()
    assert r.cumulative_return == pytest.approx(1.1 * 0.8 * 1.05 - 1) and r.win_rate == pytest.approx(2 / 3)
    assert r.maximum_drawdown == pytest.approx(-0.2) and r.cumulative_benchmark_return == pytest.approx(0.05)
    x = np.array([0.1, -0.2, 0.05])
    assert r.sharpe_ratio == pytest.approx(x.mean() / x.std(ddof=1) * 3**0.5)
    ruin = backtest.drawdown_curve(spark.createDataFrame([(dt.date(2024, 1, k), v) for k, v in ((1, 0.5), (2, -1.0), (3, 0.5))], "exit_date date, strategy_return double"))
    assert [v.drawdown for v in ruin.orderBy("exit_date").collect()] == [0.0, -1.0, -1.0]


def test_signals_first_wins_and_combined_switch(spark):
    obs = spark.createDataFrame([("AAA", "f", "t", days(1)[0], "k", g, 5, "ok") for g in ("individual", "combined")], "symbol string, event_family string, event_type string, event_date date, known_at string, signal_group string, horizon int, status string")
    assert [r.signal_id.split(":")[3] for r in signals.assemble(technical_rows=obs).collect()] == ["combined"]
    assert signals.assemble(technical_rows=obs.filter("signal_group = 'individual'").unionByName(obs.filter("signal_group = 'individual'"))).count() == 1


def test_stability_labels(spark):
    rows = [(g, s, "ok", v) for g, a, b in (("p", 1.0, 2.0), ("n", -1.0, -2.0), ("f", 1.0, -1.0), ("z", 0.0, 1.0)) for s, v in (("selection", a), ("unseen", b))] + [("u", "selection", "ok", 1.0), ("p", "unseen", "bad", 9.0), (None, "unseen", "ok", 1.0)]
    df = spark.createDataFrame(rows, "g string, period_split string, status string, v double")
    assert {r.g: r.stability_label for r in splits.stability(df, ["g"], "v").collect()} == {"p": "stable_positive", "n": "stable_negative", "f": "sign_flip", "z": "inconclusive", "u": "unavailable"}


def test_variants(spark):
    sig = spark.createDataFrame([("x", "AAA", "2024-01-01", "long", 2, "technical_reversal_fixed"), ("y:z", "AAA", "2024-01-02", "long", 2, "sector_catch_up_laggard"), ("w", "AAA", "2024-01-02", "long", 2, "weekday_monday_fixed")], "signal_id string, symbol string, known_at string, direction string, horizon int, source string")
    comp = variants.component_signals(sig)
    got = {r.variant: r for r in variants.compare(comp, prices_like_the_reference(spark)).collect()}
    assert [(got[v].status, got[v].missing_components, got[v].trade_count) for v in "ABC"] == [("ok", "", 1), ("ok", "", 2), ("unavailable", "fundamentals", None)]
    t = variants.trades(comp, prices_like_the_reference(spark), horizons=(2,)).collect()
    assert {(r.variant, r.component, r.component_signal_id) for r in t} == {("A", "technical", "x"), ("B", "technical", "x"), ("B", "sector", "y:z")}


def test_fundamentals(spark):
    q = [dt.date(2023, 3, 31), dt.date(2023, 6, 30), dt.date(2023, 9, 30), dt.date(2023, 12, 31), dt.date(2024, 3, 31)]
    rows = [("T", "T", "S", "industrial", d, "quarterly", "2024-01-05T18:30:00+03:00", "src", 100.0 + 10 * k, 40.0, 0.0 if k == 4 else 20.0) for k, d in enumerate(q)]
    names = "ticker string, symbol string, sector string, metric_profile string, period_end date, period_type string, disclosure_timestamp string, source string, revenue double, gross_profit double, operating_profit double"
    df = spark.createDataFrame(rows, names)
    for c in ("net_income", "net_interest_income", "total_assets", "total_liabilities", "total_equity", "total_debt", "operating_cash_flow", "free_cash_flow"):
        df = df.withColumn(c, F.lit(0.0))
    last = fundamentals.with_changes(df).filter(F.col("period_end") == q[-1]).first()
    assert last.revenue_qoq_change == pytest.approx((140 - 130) / 130) and last.revenue_yoy_change == pytest.approx(0.4)
    assert last.net_income_qoq_change is None and last.debt_to_assets is None
    out = fundamentals.observations(df, bars_of(spark, [100 + k for k in range(30)], "T", "S"), None, (1, 40))
    ok = out.filter("metric_name = 'revenue' AND horizon = 1").first()
    assert ok.status == "ok" and ok.sector_peer_count == 0 and ok.entry_date == dt.date(2024, 1, 8)
    assert out.filter("horizon = 40").select("status").distinct().first()[0] == "insufficient_forward_history"


def test_greedy_dedup_is_not_one_pass_per_key(spark):
    rows = [("A", "s", "U1/", "T1", 1), ("B", "s", "u2", "t1", 2), ("C", "s", "u2", "t3", 3), ("D", "s", "u9", "t9", 4), ("E", "s", "", "t8", 5), ("F", "s", "", "t7", 6)]
    df = spark.createDataFrame(rows, "id string, source_id string, url string, title string, published_timestamp long").withColumn("summary", F.lit(None).cast("string"))
    assert {r.id for r in news.deduplicate(df, "id").collect()} == {"A", "C", "D", "E", "F"}


def test_text(spark):
    df = spark.createDataFrame([("Türk Hava Yolları döviz", "Mon, 01 Jan 2024 09:30:00 +0300", " HTTP://A/B// ", "a &amp; <b>b</b>\n c"), (None, "2024-01-01T00:00:00Z", None, None), ("İŞ ß é", "nonsense", "", "")], "t string, s string, u string, h string")
    got = df.select(X.match_text("t").alias("m"), F.lit(None).cast("string").alias("n"), F.date_format(X.feed_timestamp("s"), "yyyy-MM-dd HH:mm").alias("s"), X.url_key("u").alias("u"), X.clean(X.unescaped("h")).alias("h")).collect()
    assert got[0] == ("turk hava yollari doviz", None, "2024-01-01 06:30", "http://a/b", "a & b c")
    assert got[1].m is None and got[1].s == "2024-01-01 00:00" and got[2].m == "is ss e" and got[2].s is None


def test_price_issues(spark):
    rows = [("A", "2024-01-02", "1", "2", "1", "1", "5", "2024-01-03", 1), ("A", "2024-01-01", "0", "1", "2", "1", "-1", "2023-01-01", 2), ("A", "2024-01-01", "x", "2", "1", "1", "5", "bad", 3)]
    df = spark.createDataFrame(rows, "symbol string, date string, open string, high string, low string, close string, volume string, download_timestamp string, n int").withColumn("date", F.col("date").cast("date"))
    assert {r.code for r in quality.price_issues(df, 20, "n").collect()} == {"SMALL_SAMPLE", "NON_MONOTONIC_PRICE_DATES", "DUPLICATE_PRICE_DATES", "INVALID_PRICE_VALUE", "HIGH_BELOW_LOW", "INVALID_VOLUME", "INVALID_DOWNLOAD_TIMESTAMP"}
    assert quality.outcome_columns(["future_return", "rsi_14", "ichimoku_lagging", "Next_x"]) == ["future_return", "ichimoku_lagging", "Next_x"]


def test_evidence_and_replay(spark):
    rows = spark.createDataFrame([("a", 1.0, "s"), ("b", None, None)], "record_id string, f double, src string")
    e = evidence.bundle(rows, ["f"], ["src"])
    one, two = evidence.commit(e).first()[0], evidence.commit(e.orderBy(F.desc("evidence_id"))).first()[0]
    assert one == two and evidence.commit(e.filter("evidence_id = 'a'")).first()[0] != one
    open_ = evidence.gate(e, ["f"]).first()  # rows without features or source warn; they don't block
    assert (open_.verdict, open_.warned, open_.without_features) == ("ANALYSIS_SAFE", True, 1)
    assert evidence.gate(e.filter("evidence_id = 'a'"), ["future_x"]).first().verdict == "ANALYSIS_UNSAFE"
    log = spark.createDataFrame([("d", "x")], "id string, body string").withColumn("record_hash", evidence.record_hash("id", "body"))
    assert evidence.replay(log, "id", "body").first().replay_status == "ok"
    assert evidence.replay(log.withColumn("body", F.lit("y")), "id", "body").first().replay_status == "tampered"


def test_harness():
    h = Harness()
    assert h.call("backtest")[0] == "error" and h.advance("backtest")[0] == "error"
    while h.state != "risk_gate":
        h.advance()
    h.apply_gate("ANALYSIS_UNSAFE")
    h.advance()
    assert h.set_label("INVESTIGATE") == ("ok", "ANALYSIS_UNSAFE")
    h.advance()
    h.review("approved")
    h.advance()
    assert h.save()[0] == "ok" and h.advance()[0] == "warning"


def test_tools(spark):
    t = Tools()
    assert tuple(t.list()) == NAMES and t.call("nothing")["status"] == "error" and t.call("market_history", nope=1)["status"] == "error"
    assert t.call("market_history", bars=prices_like_the_reference(spark))["data"].first().row_count == 7


def test_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,yahoo_symbol,sector\n AAA ,AAA.IS,Banking\nAAA,BBB,\n")
    u = files.universe(spark, str(tmp_path / "u.csv"))
    assert {r.code for r in files.universe_issues(u).collect()} == {"WRONG_SIZE", "DUPLICATE_TICKER", "BLANK_FIELD", "WRONG_SUFFIX"}
    assert files.resolve_member(u, "aaa.is").count() == 2
    assert files.optional(files.universe, spark, str(tmp_path / "none.csv")) is None
    wide = spark.createDataFrame([("T", "Total Revenue", 5.0, None), ("T", "Net Income", 1.0, None)], "ticker string, label string, `2024-03-31` double, `2023-12-31` double")
    got = files.statements(wide, {"revenue": ("Operating Revenue", "Total Revenue"), "net_income": ("NetIncome",)}).collect()
    assert [(r.revenue, r.net_income) for r in got] == [(5.0, 1.0)]
    out = str(tmp_path / "prices")
    files.write_prices(prices_like_the_reference(spark), out)
    assert spark.read.parquet(out).filter("symbol = 'AAA'").count() == 7
    files.write_csv(spark.createDataFrame([(["a", "b"],)], "x array<string>"), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first()[0] == "a;b"
    reports.markdown(str(tmp_path / "r.md"), "T", {"rows": 1}, {"Universe": (u, ["ticker"])})
    assert "| AAA | AAA.IS | Banking |" in (tmp_path / "r.md").read_text()
    reports.dashboard(str(tmp_path / "r.html"), "T", {"Universe": u})
    assert "<td>Banking</td>" in (tmp_path / "r.html").read_text()


#: The header lines of the files that people fill in.
CONTEXT_HEADER = "context_id,context_type,scope,ticker,sector,indicator,value,unit,observed_period_start,observed_period_end,publication_timestamp,download_timestamp,source,source_url,source_access,title,claim,video_timestamp,notes"
FUNDAMENTALS_HEADER = "ticker,yahoo_symbol,sector,metric_profile,period_end,period_type,disclosure_timestamp,download_timestamp,source,currency,revenue,gross_profit,operating_profit,net_income,net_interest_income,total_assets,total_liabilities,total_equity,total_debt,cash_and_equivalents,operating_cash_flow,free_cash_flow"


def test_context_files(spark, tmp_path):
    at = "2024-01-01,2024-01-31,2024-02-02T10:00:00+03:00,2024-02-03T00:00:00Z"
    rows = [
        f"m1,Macro,Macro,,,tuik_inflation,4.5,%,{at},src,,PUBLIC,,,,",
        f"m2,macro,macro,,,tuik_inflation,x,%,{at},src,,public,,,,",
        f"m3,macro,macro,,,TUIK_INFLATION,1,%,{at},src,,public,,,,",
        f"m4,macro,,,,usd_try,1,,{at},src,,public,,,,",
        f"m5,macro,macro,,,usd_try,1,,{at},src,,stolen,,,,",
        f'n1,news,ticker,AAA,,,,,{at},src,http://x,licensed,"A ""title"", with\na break",claim,,note',
        f"v1,video,ticker,AAA,,,,,{at},src,http://x,public,t,c,,",
        "n2,news,ticker,,,,,,2024-01-01,2024-01-31,bad,,src,http://x,public,t,c,,",
    ]
    path = tmp_path / "c.csv"
    path.write_text("\n".join([CONTEXT_HEADER, *rows]) + "\n")
    ok, bad = files.context(spark, str(path))
    got = {r.context_id: r for r in ok.collect()}
    assert ok.columns == CONTEXT_HEADER.split(",") and set(got) == {"m1", "n1"}
    assert (got["m1"].scope, got["m1"].value, got["m1"].source_access, got["m1"].observed_period_end) == ("macro", 4.5, "public", dt.date(2024, 1, 31))
    assert got["n1"].title == 'A "title", with\na break' and got["m1"].publication_timestamp == dt.datetime(2024, 2, 2, 7)
    assert {r.context_id: len(r.errors) for r in bad.collect()} == {"m2": 2, "m3": 1, "m4": 1, "m5": 1, "v1": 1, "n2": 2}
    assert files.known_by(ok, "2024-02-02 06:59:59").count() == 0 and files.known_by(ok, "2024-02-02 07:00:00").count() == 2
    names = CONTEXT_HEADER.split(",")
    turned = [",".join(reversed(r.split(","))) for r in rows[:1]]
    path.write_text("\n".join([",".join(reversed(names)), *turned]) + "\n")
    assert [r.value for r in files.context(spark, str(path))[0].collect()] == [4.5]
    path.write_text("context_id,scope\na,b\n")
    with pytest.raises(ValueError, match="source_access"):
        files.context(spark, str(path))
    files.write_header(str(path), files.schemas.CONTEXT)
    assert path.read_text() == CONTEXT_HEADER + "\n" and [x.count() for x in files.context(spark, str(path))] == [0, 0]


def test_fundamentals_files(spark, tmp_path):
    members = spark.createDataFrame([("AAA", "AAA.IS", "Private Banking"), ("BBB", "BBB.IS", "Retail")], "ticker string, yahoo_symbol string, sector string")
    rows = [
        "aaa,,,,2024-03-31,Quarterly,2024-05-10T18:30:00+03:00,2024-06-01T00:00:00Z,src,,100,,,10,,,,,,7.5,,",
        "BBB,,,,2024-03-31,annual,2024-05-10T18:30:00+03:00,2024-06-01T00:00:00Z,src,USD,1,2,3,4,5,6,7,8,9,10,11,12",
        "CCC,,,,2024-03-31,monthly,x,2024-06-01T00:00:00Z,,,1,,,,,,,,,z,,",
    ]
    path = tmp_path / "f.csv"
    path.write_text("\n".join([FUNDAMENTALS_HEADER, *rows]) + "\n")
    ok, bad = files.fundamentals(spark, str(path), members)
    got = {r.ticker: r for r in ok.collect()}
    assert ok.columns == FUNDAMENTALS_HEADER.split(",")
    a, b = got["AAA"], got["BBB"]
    assert (a.yahoo_symbol, a.metric_profile, a.currency, a.revenue, a.gross_profit, a.cash_and_equivalents, a.period_type) == ("AAA.IS", "bank", "TRY", 100.0, None, 7.5, "quarterly")
    assert (b.metric_profile, b.currency, b.free_cash_flow, b.disclosure_timestamp) == ("industrial", "USD", 12.0, dt.datetime(2024, 5, 10, 15, 30))
    assert [len(r.errors) for r in bad.collect()] == [5]
    path.write_text("ticker,period_end,period_type,disclosure_timestamp,download_timestamp,source\nBBB,2024-03-31,annual,2024-05-10T18:30:00+03:00,2024-06-01T00:00:00Z,src\n")
    assert files.fundamentals(spark, str(path), members)[0].first().revenue is None


def test_macro_rows(spark):
    rates = spark.createDataFrame([("usd_try", "2024-01-01", 30.0), ("usd_try", "2024-01-02", float("nan")), ("usd_try", "2024-01-03", 31.0)], "indicator string, date string, close double")
    got = files.fx_context(rates, "2024-01-04 05:00:00").collect()
    assert [(r.context_id, r.publication_timestamp) for r in got] == [("macro-usd_try-2024-01-01", dt.datetime(2024, 1, 2, 6))]
    curated = files.curated_macro(spark, "2026-09-20 00:00:00")
    assert {r.indicator: r.value for r in curated.collect()} == {"tcmb_policy_rate": 37.0, "tuik_inflation": 31.51, "fed_policy_rate": 3.875}
    text = curated.select(*[F.col(c).cast("string").alias(c) for c in curated.columns])
    assert [x.count() for x in files.normalize_context(text)] == [3, 0]


def test_price_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,symbol,close,open,high,low,adj_close,volume,source,download_timestamp\n2024-01-02,AAA,5,4,6,3,,,x,2024-01-03\nbad,AAA,1,1,1,1,1,1,x,2024-01-03\n")
    got = files.prices(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.symbol, r.open, r.high, r.low, r.close, r.adj_close, r.volume) for r in got] == [("AAA", 4.0, 6.0, 3.0, 5.0, 5.0, 0)]


def test_matching_form_of_every_character(spark):
    points = [n for n in (*range(0x20, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800))]
    texts = ["".join(f"x{chr(n)}y " for n in points[k : k + 40]) for k in range(0, len(points), 40)] + ["été über señor STRASSE Straße ẞ", "e\u0301a ＜b＞c", "<i>a</i>b", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.match_text("t").alias("m")).collect()
    assert [r.t for r in got if r.m != X.normalize_match_text(r.t)] == []
    assert X.normalize_match_text(texts[-4]) == "ete uber senor strasse strasse ss"


def test_entities(spark):
    import html

    texts = ["a &amp;lt; b", "&copy; &middot; &quot;x&quot; &#39; &#x27; &nbsp;.", "&amp b &am", "&euro;&lt;&#8364;", "no", "&", "& b", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.unescaped("t").alias("h"), X.clean(X.unescaped("t")).alias("c")).collect()
    assert [r.h for r in got] == [None if t is None else html.unescape(t) for t in texts]
    assert got[1].c == "© · \"x\" ' ' ."


def greedy_by_hand(rows):
    urls, titles, kept = set(), set(), set()
    for i, u, t in rows:
        u, t = u.strip().lower().rstrip("/"), t.lower()
        if not (u and u in urls) and not (t and t in titles):
            kept.add(i)
            urls |= {u} - {""}
            titles |= {t} - {""}
    return kept


def test_dedup_of_long_chains_and_large_groups(spark):
    import random

    rng = random.Random(1)
    chain = [(k, f"u{(k + 1) // 2}", f"t{k // 2}") for k in range(10_000)]
    group = [(20_000 + k, "same" if k % 3 else f"v{rng.randrange(4000)}", f"w{rng.randrange(9000)}" if k % 2 else "") for k in range(100_000)]
    rows = chain + group + [(200_000 + k, "", "") for k in range(50)]
    df = spark.createDataFrame([(i, "s", u, t, i) for i, u, t in rows], "id long, source_id string, url string, title string, published_timestamp long")
    assert {r.id for r in news.deduplicate(df, "id").collect()} == greedy_by_hand(rows)
    for order in range(3):
        some = [(k, rng.choice(["", "a", "b", "c/", "C", "d"]), rng.choice(["", "T", "t", "u", "v", "w", "x"])) for k in range(60)]
        df = spark.createDataFrame([(i, "s", u, t, i) for i, u, t in some], "id long, source_id string, url string, title string, published_timestamp long")
        assert {r.id for r in news.deduplicate(df, "id", rounds=order).collect()} == greedy_by_hand(some)


def test_components(spark):
    from marketloom.operators.graph import components

    edges = [(k, k + 1) for k in range(0, 500) if k % 100 != 99] + [(1000, k) for k in range(2000, 2300)] + [(7, 7), (3000, 2999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: k // 100 * 100 for k in range(501)} | {k: 1000 for k in (1000, *range(2000, 2300))} | {3000: 2999, 2999: 2999}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_aliases_of_any_length(spark):
    items = spark.createDataFrame([(1, "AB Bank of the North opens", None), (2, "bank", "of the north"), (3, "Banks of the north", ""), (4, None, None)], "id long, title string, summary string")
    long = "one two three four five six seven eight nine"
    items = items.unionByName(spark.createDataFrame([(5, long, "ten")], items.schema))
    names = [("ticker", "A", "Bank of the North"), ("ticker", "A", "bank"), ("sector", "B", "bank"), ("macro", "C", long), ("macro", "D", "the north opens"), ("macro", "E", "")]
    al = spark.createDataFrame(names, "entity_type string, entity_id string, alias string").withColumn("normalized_alias", X.match_text("alias"))
    got = {tuple(r) for r in news.match_aliases(items, al, "id").collect()}
    both = {("ticker", "A", "Bank of the North"), ("ticker", "A", "bank"), ("sector", "B", "bank")}
    assert got == {(1, *x) for x in both | {("macro", "D", "the north opens")}} | {(2, *x) for x in both} | {(5, "macro", "C", long)}


def test_peer_medians_against_all_pairs(spark):
    import random
    import statistics

    from marketloom.operators import catch_up

    rng = random.Random(6)
    rows = [(f"s{k}", f"g{rng.randrange(6)}", rng.choice([None, 1.0, 2.0, rng.random()])) for k in range(40)]
    got = catch_up.peer_medians(spark.createDataFrame(rows, "symbol string, sector string, v double"), ("sector",), m="v").collect()
    for r in got:
        rest = [v for s, g, v in rows if g == r.sector and s != r.symbol and v is not None]
        assert r.m == (pytest.approx(statistics.median(rest)) if rest else None)


def test_kept_tables_follow_their_source(spark, tmp_path):
    from marketloom import store

    built = []

    @store.kept("test-table")
    def build(s, d):
        built.append(d)
        return s.read.parquet(f"{d}/t.parquet")

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert build(spark, str(tmp_path)).count() == 3 and build(spark, str(tmp_path)).count() == 3 and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert build(spark, str(tmp_path)).count() == 5
    store.release(spark)
    assert build(spark, str(tmp_path)).count() == 5 and len(built) == 3


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("backtest:\n  trading_cost_bps: 7\n  horizons: [1, 5]\nexperiment:\n  unseen_start_date: \"2025-10-01\"\n  regime_lookback_days: 10  # days\n")
    s = settings.load(str(tmp_path / "s.yaml"))
    assert (s.trading_cost_bps, s.horizons, s.unseen_start_date, s.regime_lookback_days, s.slippage_bps) == (7.0, (1, 5), "2025-10-01", 10, 5.0)


def test_stream_first_seen(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([("s", "HTTP://a/", 1), ("s", "http://a", 2), ("s", "http://b", 3)], "source_id string, url string, t int").withColumn("published_timestamp", F.timestamp_seconds(F.lit(1704067200) + F.col("t"))).drop("t")
    df.write.parquet(str(src))
    q = stream.first_seen(spark.readStream.schema(df.schema).parquet(str(src))).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2


def test_views(spark):
    rows = bars_of(spark, [100 + k for k in range(30)]).unionByName(bars_of(spark, [100 - k for k in range(30)], "BBB"))
    snap = views.snapshot(rows, indicators.add_all(rows), events.detect(indicators.bollinger(rows), ("bollinger",)))
    got = {r.symbol: r for r in snap.collect()}
    assert got["BBB"].catch_up_gap < 0 < got["AAA"].catch_up_gap and got["AAA"].peer_median_return == pytest.approx(got["BBB"].return_20)


def test_explanations():
    from marketloom.operators import explain

    assert explain.command_symbol(["Analyze", "abc.is"]) == "ABC.IS" and explain.command_symbol("xyz") == "XYZ"
    with pytest.raises(ValueError, match="no symbol"):
        explain.command_symbol("what is this?")
    a = explain.offline("ABC", "INVESTIGATE", ["e1"], "ANALYSIS_SAFE")
    assert explain.contract_issues(a, {"e1"}) == [] and explain.contract_issues(a | {"label": "BUY"}, set()) == ["unknown label: BUY", "unknown evidence: e1"]
    assert explain.parse_answer('text ```json\n{"a": 1}\n``` more') == {"a": 1}
    assert explain.offline("ABC", "INVESTIGATE", ["e1"], "ANALYSIS_UNSAFE")["label"] == "ANALYSIS_UNSAFE"


def test_workflow_writes_reports(spark, tmp_path, wavy):
    from marketloom.plans import workflows

    s = settings.Settings(unseen_start_date="2024-04-01")
    bench = wavy.select("date", "close")
    both = wavy.unionByName(wavy.withColumns({"symbol": F.lit("BBB"), "close": F.col("close") * 1.01 + F.dayofmonth("date")}))
    study = workflows.research(both, bench, None, s)
    paths = workflows.write_reports(study, workflows.trades(study, s), s, str(tmp_path))
    assert len(paths) == 6 and "technical_reversal_fixed" in (tmp_path / "backtest.md").read_text()


def test_feed_sources(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("polling:\n  minutes: 15\n\nsources:\n  - id: a\n    url: https://x/y?z=1#frag\n    language: tr\n    category: economy\n    enabled: true\n  - id: b\n    url: 'http://b'\n    language: en\n    category: c # later\n    enabled: false\n")
    assert settings.feed_sources(str(path)) == (settings.FeedSource("a", "https://x/y?z=1#frag", "tr", "economy"),)
    path.write_text("sources:\n- id: a\n  url: u\n  language: tr\n")
    with pytest.raises(ValueError, match="feed 1"):
        settings.feed_sources(str(path))
    path.write_text("polling:\n  minutes: 15\n")
    with pytest.raises(ValueError, match="no feeds"):
        settings.feed_sources(str(path))
    assert settings.parse("a:\n  - 1\n  - x: 2\n    y: [3, 'q']\nb: \"# no\"\nc:\n") == {"a": [1, {"x": 2, "y": [3, "q"]}], "b": "# no", "c": None}


class Prices:
    def download(self, symbol, start, end):
        import pandas as pd

        if symbol == "BAD":
            raise OSError("no network")
        n = 0 if symbol == "NONE" else 3
        return pd.DataFrame({"Date": pd.date_range(start, periods=n), "Open": [1.0] * n, "High": [2.0] * n, "Low": [0.5] * n, "Close": [1.5] * n, "Adj Close": [1.4] * n, "Volume": [float("nan")] * n})


class Feeds:
    def fetch(self, url):
        if url == "http://bad":
            raise TimeoutError("late")
        return b"<rss><channel><item><title>T</title><link>http://a</link></item></channel></rss>"


def test_providers(spark):
    from marketloom.sources import providers

    bars, lost = providers.prices(spark, ["A", "BAD", "A", "NONE"], Prices(), "2024-01-01", None, "p", "2024-02-01 00:00:00")
    got = bars.collect()
    assert bars.columns == [c.split()[0] for c in files.schemas.PRICES.split(", ")] and len(got) == 3
    assert (got[0].symbol, got[0].adj_close, got[0].volume, got[0].source) == ("A", 1.4, 0, "p") and min(r.date for r in got) == dt.date(2024, 1, 1)
    assert {r.symbol: r.reason for r in lost.collect()} == {"BAD": "OSError: no network", "NONE": "ValueError: nothing was returned"}
    rates, failed = providers.rates(spark, {"usd_try": "A", "eur_try": "BAD"}, Prices(), "2024-01-01", None)
    assert rates.count() == 3 and [r.indicator for r in failed.collect()] == ["eur_try"]
    assert files.fx_context(rates, "2024-01-03 12:00:00").count() == 2
    sources = spark.createDataFrame([("a", "http://a", "en", "x"), ("b", "http://bad", "en", "x")], "source_id string, url string, language string, category string")
    docs, failed = providers.feeds(spark, sources, Feeds(), "2024-01-03T00:00:00Z")
    status = news.fetch_status(sources, news.parse_feeds(docs), failed)
    assert {r.source_id: (r.fetch_status, r.item_count) for r in status.collect()} == {"a": ("warning", 1), "b": ("error", 0)}


def test_empty_and_narrow_histories(spark):
    bars = prices_like_the_reference(spark)
    want = spark.createDataFrame([("AAA",), ("ZZZ",)], "symbol string")
    assert {(r.symbol, r.code) for r in quality.price_issues(bars, 1, expected=want).collect()} >= {("ZZZ", "EMPTY_PRICE_HISTORY")}
    assert {r.code for r in quality.price_issues(bars, 1, required=("close", "adj_close", "source")).collect()} == {"MISSING_PRICE_COLUMNS"}


def test_bars_outside_the_universe_are_an_error(spark):
    bars = prices_like_the_reference(spark)
    members = spark.createDataFrame([("AAA", "AAA", "S")], "ticker string, yahoo_symbol string, sector string")
    assert files.with_members(bars, members).filter("sector = 'S'").count() == bars.count()
    with pytest.raises(Exception, match="not in the universe: BBB"):
        files.with_members(bars.withColumn("symbol", F.lit("BBB")), members).collect()


def test_gate_and_commit(spark):
    from marketloom.operators import evidence

    rows = spark.createDataFrame([("a", 1.0, "s"), ("b", None, None), ("b", None, None)], "record_id string, x double, source string")
    bundle = evidence.bundle(rows, ["x"], ["source"])
    one = evidence.gate(bundle, ["x"], 5).first()
    assert (one.evidence_count, one.without_features, one.without_source, one.warned, one.verdict) == (3, 2, 2, True, "ANALYSIS_SAFE")
    assert sorted(r.code for r in evidence.gate_issues(bundle, ["x", "future_x"], 5).collect()) == ["FUTURE_OUTCOME_FEATURE", "MISSING_SOURCE", "MISSING_SOURCE", "NO_OBSERVED_FEATURES", "NO_OBSERVED_FEATURES", "SMALL_EVIDENCE_SET"]
    assert evidence.gate(bundle, ["future_x"]).first().verdict == "ANALYSIS_UNSAFE"
    reports_ = spark.createDataFrame([("blocking",), ("warning",)], "severity string")
    assert evidence.gate(bundle, ["x"], 1, reports_).first().verdict == "ANALYSIS_UNSAFE" and evidence.gate(None, ["x"], 1, reports_).first().verdict == "ANALYSIS_UNSAFE"
    a, b = evidence.commit(bundle).first(), evidence.commit(bundle.orderBy(F.desc("evidence_id"))).first()
    assert a == b and a.evidence_count == 3 and evidence.commit(bundle.limit(1)).first() != a
    odd = spark.createDataFrame([({"a": "1;b=2"},), ({"a": "1", "b": "2"},)], "m map<string,string>").select(F.lit("i").alias("record_id"), F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))
    assert evidence.bundle(odd, ["a", "b"], []).select("evidence_hash").distinct().count() == 2


def test_labels_of_an_analysis(spark):
    from marketloom.operators import symbol

    base = dict(market_status="pass", sector_status="pass", technical_status="pass", fundamentals_status="pass", macro_status="pass", backtest_status="pass", backtest_codes=[], hard_risk=False, supertrend="bullish", rsi_14=60.0, lower_band_event=False, primary_yoy=0.1, primary_qoq=None, operating_margin_change=None, lag_score=0.1, median_after=None)
    cases = [
        ({}, "PASS", symbol.CATCH_UP), ({"primary_yoy": -0.1}, "PASS", symbol.LOOK), ({"primary_yoy": None, "lag_score": -0.1, "median_after": 0.02}, "PASS", symbol.CATCH_UP),
        ({"supertrend": "bearish"}, "PASS", symbol.LOOK), ({"supertrend": "bearish", "rsi_14": 44.0}, "PASS", symbol.CATCH_UP), ({"supertrend": "unknown", "rsi_14": None, "lower_band_event": True}, "PASS", symbol.CATCH_UP),
        ({"market_status": "missing"}, "FAIL", symbol.GAP), ({"hard_risk": True}, "PASS_WITH_WARNINGS", symbol.LOOK), ({"sector_status": "inconclusive"}, "PASS_WITH_WARNINGS", symbol.LOOK),
        ({"backtest_status": "warning", "backtest_codes": ["UNREALISTIC_CUMULATIVE_RETURN"]}, "INVESTIGATE", symbol.LOOK), ({"backtest_status": "warning", "backtest_codes": ["LARGE_SHARPE_RATIO"]}, "PASS_WITH_WARNINGS", symbol.LOOK),
    ]
    kinds = ", ".join(f"{k} {'array<string>' if k == 'backtest_codes' else 'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'double'}" for k, v in base.items())
    rows = spark.createDataFrame([(n, *(base | c).values()) for n, (c, _, _) in enumerate(cases)], "n int, " + kinds)
    got = {r.n: (r.quality_status, r.label) for r in symbol.gated(rows).collect()}
    assert got == {n: (q, label) for n, (_, q, label) in enumerate(cases)}
    trends = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (1.0, 1.0), (None, 1.0)], "a double, b double").select(symbol.trend("a", "b").alias("t")).collect()
    assert [r.t for r in trends] == ["improving", "weakening", "flat", "unknown"]


def test_report_files(spark, tmp_path):
    from marketloom.plans import report_files as R

    status = spark.createDataFrame([("a", "pass", 3, "x|y"), ("b", "error", 0, "late")], "source_id string, fetch_status string, item_count long, fetch_detail string")
    path = str(tmp_path / "fetch.md")
    R.fetch_status(path, status)
    back = reports.scanned_tables(spark, path).collect()
    assert [(r.heading, r.row, r.cells["source_id"], r.cells["fetch_detail"]) for r in back] == [("Sources", 1, "a", "x|y"), ("Sources", 2, "b", "late")]
    entry = {k: "x" for k in reports.MANIFEST} | {"path": "fetch.md"}
    lacking = entry | {"path": "none.md", "source": " "}
    assert reports.manifest_issues([entry], str(tmp_path)) == [] and len(reports.manifest_issues([lacking], str(tmp_path))) == 2
    reports.index(str(tmp_path / "index.md"), [entry])
    assert "Nothing." in R.final(str(tmp_path / "final.md"), str(tmp_path), [entry]).read_text()
    (tmp_path / "u.csv").write_text("ticker,yahoo_symbol,sector\nAAA,AAA.IS,S\n")
    (tmp_path / "s.yaml").write_text("validation:\n  expected_universe_size: 1\n")
    files.write_csv(prices_like_the_reference(spark).withColumns({"symbol": F.lit("AAA.IS"), "adj_close": F.col("close"), "source": F.lit("x"), "download_timestamp": F.lit("2024-02-01"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(1)}).select(*[c.split()[0] for c in files.schemas.PRICES.split(", ")]), str(tmp_path / "p"))
    checks = R.offline_checks(spark, str(tmp_path / "s.yaml"), str(tmp_path / "u.csv"), str(tmp_path / "p"), str(tmp_path), [entry], strict=True)
    assert [(n, s) for n, s, _ in checks] == [("settings", "pass"), ("universe", "pass"), ("prices", "pass"), ("reports", "pass")], checks
    assert R.demo(str(tmp_path / "demo.md"), checks)[1] == 0
    bad = R.offline_checks(spark, str(tmp_path / "no.yaml"), str(tmp_path / "no.csv"), str(tmp_path / "nop"), str(tmp_path), [lacking])
    assert [s for _, s, _ in bad] == ["fail", "fail", "warning", "fail"] and R.demo(str(tmp_path / "demo.md"), bad)[1] == 1
    assert reports.run_status(0, signal_count=0) == "inconclusive" and reports.run_status(0, signal_count=3) == "no_trades" and reports.run_status(2, 1) == "measured_partial"
    assert reports.safe_name("A.IS/x") == "A_IS_x" and reports.percent(0.1234) == "12.34%" and reports.percent(None) == "n/a"
    wide = spark.createDataFrame([("rss", "e", 3), ("rss", "f", 0)], "entity_type string, entity_id string, news_count long")
    assert "| rss | e | 3 |" in R.context_sources(str(tmp_path / "c.md"), wide).read_text()


def test_freed_tables_are_gone(spark):
    from marketloom import store

    with store.freed(spark):
        inner = store.stored(spark.range(3), "inner")
        path = inner.inputFiles()[0]
        assert inner.count() == 3
    outer = store.stored(spark.range(3), "outer")
    with pytest.raises(Exception, match="(?i)not.*exist|FAILED_READ_FILE"):
        spark.read.parquet(path.rsplit("/", 1)[0]).count()
    assert outer.count() == 3
