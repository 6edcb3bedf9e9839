"""DuckDB SQL of the registered queries, assembled from named common table expressions."""

from __future__ import annotations

UNSEEN = "1999-01-01"
DECISION = "2024-01-15 00:00:00"

#: Read once per step of a recursion.
STEPPED = {"ordered", "step", "line", "item"}
#: name: (what it needs, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def query(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in CTES[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STEPPED else ''}({CTES[n][1]})" for n in order) + "\n" + body


cte(
    "trade",
    """SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
VWAP = "CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / (100 * sum(quantity))"
cte("day", f"SELECT symbol, sector, date, {VWAP} AS close, max(price) AS high, min(price) AS low, CAST(sum(quantity) AS BIGINT) AS volume FROM trade GROUP BY symbol, sector, date", "trade")
cte("bar", "SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) AS open, row_number() OVER (PARTITION BY symbol ORDER BY date) AS idx FROM day", "day")
cte("bench", f"SELECT date, {VWAP} AS close FROM trade GROUP BY date", "trade")
cte("sector_bench", f"SELECT sector, date, {VWAP} AS close FROM trade GROUP BY sector, date", "trade")
cte("regime", "SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS regime_return FROM bench", "bench")
REGIME = "CASE WHEN regime_return >= 0 THEN 'rising' WHEN regime_return < 0 THEN 'falling' ELSE 'unknown' END"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {over(n)} = {n} THEN {agg}({c}) {over(n)} END"


def mid(n: int) -> str:
    return f"(({full('max', 'high', n)}) + ({full('min', 'low', n)})) / 2"


LAG = "OVER (PARTITION BY symbol ORDER BY date)"
cte("ranged", f"SELECT *, greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS tr FROM bar", "bar")
cte(
    "window1",
    f"""SELECT *, {full('avg', 'close', 20)} AS sma_20, {full('avg', 'close', 50)} AS sma_50, {full('avg', 'tr', 14)} AS atr_14, {full('avg', 'tr', 10)} AS atr_10,
    {full('stddev_samp', 'close', 20)} AS sd, {mid(9)} AS ichimoku_conversion, {mid(26)} AS ichimoku_base, {mid(52)} AS span_b,
    {full('min', 'low', 20)} AS support, {full('max', 'high', 20)} AS resistance, {full('avg', 'volume', 20)} AS volume_sma FROM ranged""",
    "ranged",
)
cte(
    "ind",
    f"""SELECT *, sma_20 AS bb_middle, sma_20 + 2.0 * sd AS bb_upper, sma_20 - 2.0 * sd AS bb_lower, ((sma_20 + 2.0 * sd) - (sma_20 - 2.0 * sd)) / nullif(sma_20, 0) AS bb_width,
    lag((ichimoku_conversion + ichimoku_base) / 2, 26) {LAG} AS ichimoku_span_a, lag(span_b, 26) {LAG} AS ichimoku_span_b, lead(close, 26) {LAG} AS ichimoku_lagging,
    (close - support) / nullif(close, 0) AS support_distance, (resistance - close) / nullif(close, 0) AS resistance_distance, volume / nullif(volume_sma, 0) AS relative_volume FROM window1""",
    "window1",
)
cte(
    "step",
    f"""SELECT symbol, idx, date, high, low, close, atr_10, close - lag(close) {LAG} AS d,
    abs(close - lag(close, 10) {LAG}) AS moved, sum(abs_d) {over(10)} AS path FROM (SELECT *, abs(close - lag(close) {LAG}) AS abs_d FROM window1)""",
    "window1",
)
cte(
    "rec",
    """SELECT symbol, idx, date, close, close AS e20, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, CAST(NULL AS DOUBLE) AS kama,
      CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS way FROM step WHERE idx = 1
    UNION ALL
    SELECT s.symbol, s.idx, s.date, s.close, (1 - 2.0 / 21) * r.e20 + (2.0 / 21) * s.close, (1 - 2.0 / 13) * r.e12 + (2.0 / 13) * s.close, (1 - 2.0 / 27) * r.e26 + (2.0 / 27) * s.close,
      CASE WHEN r.gain IS NULL THEN greatest(s.d, 0) ELSE (1 - 1.0 / 14) * r.gain + (1.0 / 14) * greatest(s.d, 0) END,
      CASE WHEN r.loss IS NULL THEN -least(s.d, 0) ELSE (1 - 1.0 / 14) * r.loss + (1.0 / 14) * -least(s.d, 0) END,
      CASE WHEN s.idx < 11 THEN NULL WHEN s.idx = 11 THEN s.close ELSE r.kama + power(coalesce(s.moved / nullif(s.path, 0), 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (s.close - r.kama) END,
      CASE WHEN s.atr_10 IS NULL THEN NULL WHEN r.up IS NULL OR (s.high + s.low) / 2 + 3 * s.atr_10 < r.up OR r.close > r.up THEN (s.high + s.low) / 2 + 3 * s.atr_10 ELSE r.up END,
      CASE WHEN s.atr_10 IS NULL THEN NULL WHEN r.lo IS NULL OR (s.high + s.low) / 2 - 3 * s.atr_10 > r.lo OR r.close < r.lo THEN (s.high + s.low) / 2 - 3 * s.atr_10 ELSE r.lo END,
      CASE WHEN s.atr_10 IS NULL THEN NULL WHEN r.up IS NULL OR s.close > r.up THEN 1.0 WHEN s.close < r.lo THEN -1.0 ELSE r.way END
    FROM rec r JOIN step s ON s.symbol = r.symbol AND s.idx = r.idx + 1""",
    "step",
)
cte("line", "SELECT *, CASE WHEN idx >= 26 THEN e12 - e26 END AS m FROM rec", "rec")
cte(
    "sig",
    """SELECT symbol, idx, m AS signal FROM line WHERE idx = 26
    UNION ALL SELECT l.symbol, l.idx, (1 - 2.0 / 10) * s.signal + (2.0 / 10) * l.m FROM sig s JOIN line l ON l.symbol = s.symbol AND l.idx = s.idx + 1""",
    "line",
)
cte(
    "recursive_ind",
    """SELECT l.symbol, l.date, l.idx, l.close, CASE WHEN l.idx >= 20 THEN e20 END AS ema_20, kama AS kama_10,
    CASE WHEN l.idx >= 15 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi_14,
    m AS macd, CASE WHEN l.idx >= 34 THEN signal END AS macd_signal, CASE WHEN l.idx >= 34 THEN m - signal END AS macd_histogram,
    CASE WHEN way = 1 THEN lo ELSE up END AS supertrend, way AS supertrend_direction, up AS supertrend_upper, lo AS supertrend_lower
    FROM line l LEFT JOIN sig s ON s.symbol = l.symbol AND s.idx = l.idx""",
    "line",
    "sig",
)
KNOWN = "strftime({}, '%Y-%m-%d') || 'T18:10:00+03:00'"


def events(family: str, rows: list[tuple[str, str, str, str]], source: str) -> str:
    known = KNOWN.format("date")
    return "\nUNION ALL\n".join(
        f"SELECT symbol, '{family}' AS event_family, '{kind}' AS event_type, date AS event_date, {known} AS known_at, CAST({value} AS DOUBLE) AS value, CAST({ref} AS DOUBLE) AS reference, 'known_after_daily_close' AS details FROM {source} WHERE {mask}"
        for kind, mask, value, ref in rows
    )


cte(
    "ev_base",
    f"""SELECT *, lag(close) {LAG} AS c1, lag(bb_lower) {LAG} AS l1, lag(bb_middle) {LAG} AS m1, lag(bb_upper) {LAG} AS u1, lag(ichimoku_conversion) {LAG} AS v1, lag(ichimoku_base) {LAG} AS b1,
    greatest(ichimoku_span_a, ichimoku_span_b) AS top, least(ichimoku_span_a, ichimoku_span_b) AS bottom, lag(greatest(ichimoku_span_a, ichimoku_span_b)) {LAG} AS top1, lag(least(ichimoku_span_a, ichimoku_span_b)) {LAG} AS bottom1 FROM ind""",
    "ind",
)
cte("rounded", "SELECT symbol, date, close, round(rsi_14, 9) AS r, round(kama_10, 9) AS k, supertrend_direction AS w FROM recursive_ind", "recursive_ind")
cte(
    "rec_base",
    f"""SELECT *, lag(close) {LAG} AS c1, lag(r) {LAG} AS r1, lead(r) {LAG} AS r_next, lag(k) {LAG} AS k1, lag(w) {LAG} AS w1,
    round(k - lag(k) {LAG}, 9) AS slope, round(lag(k) {LAG} - lag(k, 2) {LAG}, 9) AS slope1 FROM rounded""",
    "rounded",
)
cte("ev_bollinger", events("bollinger", [("lower_band_touch", "close <= bb_lower AND c1 > l1", "close", "bb_lower"), ("middle_cross_up", "close >= bb_middle AND c1 < m1", "close", "bb_middle"), ("middle_cross_down", "close <= bb_middle AND c1 > m1", "close", "bb_middle"), ("upper_band_touch", "close >= bb_upper AND c1 < u1", "close", "bb_upper")], "ev_base"), "ev_base")
cte("ev_ichimoku", events("ichimoku", [("conversion_cross_above_base", "ichimoku_conversion >= ichimoku_base AND v1 < b1", "ichimoku_conversion", "ichimoku_base"), ("conversion_cross_below_base", "ichimoku_conversion <= ichimoku_base AND v1 > b1", "ichimoku_conversion", "ichimoku_base"), ("price_breaks_above_cloud", "close > top AND c1 <= top1", "close", "top"), ("price_breaks_below_cloud", "close < bottom AND c1 >= bottom1", "close", "bottom")], "ev_base"), "ev_base")
cte("ev_support_resistance", events("support_resistance", [("support_touch", "abs(close - support) / close <= 0.005", "close", "support"), ("resistance_touch", "abs(resistance - close) / close <= 0.005", "close", "resistance")], "ev_base"), "ev_base")
cte("ev_rsi", events("rsi", [("overbought_peak", "r1 < r AND r_next < r AND r >= 70", "r", "70.0"), ("oversold_trough", "r1 > r AND r_next > r AND r <= 30", "r", "30.0"), ("oversold_exit", "r > 30 AND r1 <= 30", "r", "30.0"), ("overbought_exit", "r < 70 AND r1 >= 70", "r", "70.0")], "rec_base"), "rec_base")
cte("ev_supertrend", events("supertrend", [("flip_up", "w = 1 AND w1 = -1", "w", "w1"), ("flip_down", "w = -1 AND w1 = 1", "w", "w1")], "rec_base"), "rec_base")
cte("ev_kama", events("kama", [("price_cross_up", "close >= k AND c1 < k1", "close", "k"), ("price_cross_down", "close <= k AND c1 > k1", "close", "k"), ("slope_turn_up", "slope > 0 AND slope1 <= 0", "k", "k1"), ("slope_turn_down", "slope < 0 AND slope1 >= 0", "k", "k1")], "rec_base"), "rec_base")
cte("ev_simple", "SELECT * FROM ev_bollinger UNION ALL SELECT * FROM ev_ichimoku UNION ALL SELECT * FROM ev_support_resistance", "ev_bollinger", "ev_ichimoku", "ev_support_resistance")
cte("ev_all", "SELECT * FROM ev_simple UNION ALL SELECT * FROM ev_rsi UNION ALL SELECT * FROM ev_supertrend UNION ALL SELECT * FROM ev_kama", "ev_simple", "ev_rsi", "ev_supertrend", "ev_kama")


def combined(source: str) -> str:
    return f"""SELECT symbol, 'combined' AS event_family, array_to_string(list_sort(list_distinct(list(event_type))), '+') AS event_type, event_date, max(known_at) AS known_at
    FROM {source} GROUP BY symbol, event_date HAVING count(*) >= 2"""


cte("ev_simple_combined", combined("ev_simple"), "ev_simple")
cte("ev_combined", combined("ev_all"), "ev_all")

HORIZONS = (5, 10, 20)
cte("panel0", f"SELECT symbol, sector, date, close, close / lag(close, 20) {LAG} - 1 AS lookback_return, " + ", ".join(f"lead(close, {h}) {LAG} / close - 1 AS f{h}" for h in HORIZONS) + " FROM bar", "bar")
cte("panel1", "SELECT *, count(symbol) OVER (PARTITION BY sector, date) - 1 AS peer_count, CASE WHEN lookback_return IS NOT NULL THEN row_number() OVER (PARTITION BY sector, date ORDER BY lookback_return DESC NULLS LAST, symbol) END AS rank_in_sector FROM panel0", "panel0")
cte("peer", "SELECT a.symbol, a.date, median(b.lookback_return) AS pl, " + ", ".join(f"median(b.f{h}) AS p{h}" for h in HORIZONS) + " FROM panel0 a JOIN panel0 b ON a.sector = b.sector AND a.date = b.date AND a.symbol <> b.symbol GROUP BY a.symbol, a.date", "panel0")
cte("panel", " UNION ALL ".join(f"SELECT p.symbol, p.sector, p.date, p.close, lookback_return, peer_count, pl AS peer_median_lookback_return, lookback_return - pl AS catch_up_score, rank_in_sector, {h} AS horizon, f{h} AS future_return, p{h} AS peer_median_future_return, f{h} - p{h} AS future_relative_return FROM panel1 p LEFT JOIN peer q ON p.symbol = q.symbol AND p.date = q.date" for h in HORIZONS), "panel1", "peer")
cte(
    "catch_up",
    """SELECT *, coalesce(status = 'ok' AND is_laggard AND future_relative_return <= 0, FALSE) AS false_positive FROM (SELECT *, coalesce(catch_up_score < 0, FALSE) AS is_laggard,
    CASE WHEN peer_median_future_return IS NULL AND peer_count >= 1 THEN 'insufficient_peer_forward_history' WHEN future_return IS NULL THEN 'insufficient_forward_history'
    WHEN lookback_return IS NULL THEN 'insufficient_history' WHEN peer_count < 1 THEN 'insufficient_peers' ELSE 'ok' END AS status FROM panel)""",
    "panel",
)
cte("held", " UNION ALL ".join(f"SELECT symbol, date, {h} AS holding_days, close AS entry_close, lead(close, {h}) {LAG} AS exit_close, {REGIME} AS market_regime FROM bar LEFT JOIN regime USING (date)" for h in range(1, 6)), "bar", "regime")
cte(
    "weekdays",
    f"""SELECT *, gross_return - 0.0015 AS cost_adjusted_return, avg(gross_return) OVER (PARTITION BY symbol, holding_days) AS unconditional_mean_return,
    CASE WHEN holding_days = 1 THEN 'weekday' ELSE 'multi_day' END AS pattern_type, CASE WHEN holding_days = 1 THEN weekday ELSE weekday || '_' || holding_days || 'd_hold' END AS pattern_name,
    CASE WHEN market_regime = 'unknown' THEN 'insufficient_regime_history' WHEN exit_close IS NULL THEN 'insufficient_forward_history' ELSE 'ok' END AS status,
    CASE WHEN date >= DATE '{UNSEEN}' THEN 'unseen' ELSE 'selection' END AS period_split, 10.0 AS cost_bps, 5.0 AS slippage_bps
    FROM (SELECT *, dayname(date) AS weekday, exit_close / entry_close - 1 AS gross_return FROM held)""",
    "held",
)
ENTRY = """LEFT JOIN bar b ON b.symbol = a.symbol AND b.date = (SELECT min(date) FROM bar c WHERE c.symbol = a.symbol AND c.date > a.{known})"""


def entered(source: str, known: str) -> str:
    """Rows of a source with the first bar after ``known`` (e_idx, entry_date, ...) by an as-of join."""
    return f"""SELECT a.*, b.idx AS e_idx, b.date AS entry_date, b.open AS entry_open, b.close AS entry_close FROM {source} a
    ASOF LEFT JOIN bar b ON a.symbol = b.symbol AND a.{known} < b.date"""


def reversal(prefix: str, source: str, comb: str) -> None:
    cte(f"{prefix}_asked", f"SELECT symbol, event_family, event_type, event_date, known_at, signal_group, h AS horizon FROM (SELECT symbol, event_family, event_type, event_date, known_at, 'individual' AS signal_group FROM {source} UNION ALL SELECT *, 'combined' FROM {comb}) CROSS JOIN (VALUES (1), (3), (5), (10)) t(h)", source, comb)
    cte(f"{prefix}_in", entered(f"{prefix}_asked", "event_date"), f"{prefix}_asked", "bar")
    cte(
        f"{prefix}_reversal",
        f"""SELECT i.symbol, event_family, event_type, event_date, known_at, signal_group, horizon,
        CASE WHEN x.date IS NULL THEN 'insufficient_forward_history' WHEN regime_return IS NULL THEN 'insufficient_regime_history' ELSE 'ok' END AS status,
        entry_date, entry_close, x.date AS exit_date, x.close AS exit_close, x.close / entry_close - 1 AS forward_return, coalesce(x.close / entry_close - 1 > 0, FALSE) AS bounce, {REGIME} AS market_regime
        FROM {prefix}_in i LEFT JOIN bar x ON x.symbol = i.symbol AND x.idx = i.e_idx + i.horizon LEFT JOIN regime g ON g.date = i.entry_date""",
        f"{prefix}_in", "bar", "regime",
    )



reversal("all", "ev_all", "ev_combined")

NET = "l_extendedprice * (1 - l_discount)"
CENTS = "sum(CAST(round(({}) * 100) AS BIGINT))"
cte(
    "quarter",
    f"""SELECT n_name AS ticker, r_name AS sector, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST({CENTS.format(NET)} AS BIGINT) AS net, CAST({CENTS.format(NET + ' * l_tax')} AS BIGINT) AS tax, CAST({CENTS.format('l_extendedprice')} AS BIGINT) AS gross, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
)
cte(
    "fund",
    """SELECT *, gross_profit / nullif(revenue, 0) AS gross_margin, operating_profit / nullif(revenue, 0) AS operating_margin, total_debt / nullif(total_assets, 0) AS debt_to_assets,
    total_assets / nullif(total_equity, 0) AS assets_to_equity, total_liabilities / nullif(total_assets, 0) AS liabilities_to_assets FROM (
    SELECT ticker, ticker AS symbol, sector, CASE WHEN sector = 'EUROPE' THEN 'bank' ELSE 'industrial' END AS metric_profile, CAST(quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, 'quarterly' AS period_type,
    strftime(CAST(quarter + INTERVAL 3 MONTH + INTERVAL 39 DAY AS DATE), '%Y-%m-%d') || 'T18:30:00+03:00' AS disclosure_timestamp, CAST(quarter + INTERVAL 3 MONTH + INTERVAL 39 DAY AS DATE) AS known, 'orders' AS source,
    net / 100.0::DOUBLE AS revenue, (net - tax) / 100.0::DOUBLE AS gross_profit, (net - 2 * tax) / 100.0::DOUBLE AS operating_profit, (net - 3 * tax) / 100.0::DOUBLE AS net_income, tax / 100.0::DOUBLE AS net_interest_income,
    (2 * gross) / 100.0::DOUBLE AS total_assets, (gross + tax) / 100.0::DOUBLE AS total_liabilities, (gross - tax) / 100.0::DOUBLE AS total_equity, (tax * 5) / 100.0::DOUBLE AS total_debt,
    (net - lines * 100) / 100.0::DOUBLE AS operating_cash_flow, (net - lines * 300) / 100.0::DOUBLE AS free_cash_flow FROM quarter)""",
    "quarter",
)
INDUSTRIAL = ("revenue", "gross_margin", "operating_margin", "net_income", "debt_to_assets", "operating_cash_flow", "free_cash_flow")
BANK = ("net_interest_income", "net_income", "assets_to_equity", "liabilities_to_assets")
QW = "OVER (PARTITION BY ticker, period_type ORDER BY period_end, disclosure_timestamp)"
cte(
    "metric",
    " UNION ALL ".join(
        f"SELECT ticker, symbol, sector, metric_profile, period_end, disclosure_timestamp, known, source, '{m}' AS metric_name, {m} AS current_value, ({m} - lag({m}) {QW}) / nullif(lag({m}) {QW}, 0) AS qoq_change, ({m} - lag({m}, 4) {QW}) / nullif(lag({m}, 4) {QW}, 0) AS yoy_change FROM fund WHERE metric_profile = '{p}'"
        for p, names in (("industrial", INDUSTRIAL), ("bank", BANK))
        for m in names
    ),
    "fund",
)
cte("f_asked", "SELECT DISTINCT symbol, sector, known, h AS horizon FROM fund CROSS JOIN (VALUES (1), (5), (20)) t(h)", "fund")
cte("f_pair", "SELECT a.symbol AS owner, a.known, a.horizon, p.symbol FROM f_asked a JOIN (SELECT DISTINCT symbol, sector FROM fund) p ON p.sector = a.sector AND p.symbol <> a.symbol", "f_asked", "fund")
cte("f_in", entered("f_asked", "known"), "f_asked", "bar")
cte("f_pair_in", entered("f_pair", "known"), "f_pair", "bar")
cte("f_peer", "SELECT owner AS symbol, known, horizon, count(x.close / entry_close - 1) AS n, median(x.close / entry_close - 1) AS m FROM f_pair_in i LEFT JOIN bar x ON x.symbol = i.symbol AND x.idx = i.e_idx + i.horizon GROUP BY 1, 2, 3", "f_pair_in", "bar")
cte("bench_idx", "SELECT *, row_number() OVER (ORDER BY date) AS idx FROM bench", "bench")
cte("f_bench", "SELECT a.known, a.horizon, x.close / e.close - 1 AS r FROM (SELECT DISTINCT known, horizon FROM f_asked) a ASOF LEFT JOIN bench_idx e ON a.known < e.date LEFT JOIN bench_idx x ON x.idx = e.idx + a.horizon", "f_asked", "bench_idx")
cte(
    "reaction",
    """SELECT m.ticker, m.symbol, m.sector, metric_profile, period_end, disclosure_timestamp, source, metric_name, current_value, qoq_change, yoy_change, i.horizon,
    CASE WHEN x.date IS NULL THEN 'insufficient_forward_history' ELSE 'ok' END AS status, i.entry_date, i.entry_close, x.date AS exit_date, x.close AS exit_close, x.close / i.entry_close - 1 AS post_disclosure_return,
    CASE WHEN x.date IS NOT NULL THEN b.r END AS benchmark_return, x.close / i.entry_close - 1 - b.r AS benchmark_relative_return,
    CASE WHEN x.date IS NOT NULL THEN coalesce(p.n, 0) ELSE 0 END AS sector_peer_count, CASE WHEN x.date IS NOT NULL THEN p.m END AS sector_peer_median_return, x.close / i.entry_close - 1 - p.m AS sector_relative_return
    FROM metric m JOIN f_in i ON i.symbol = m.symbol AND i.known = m.known LEFT JOIN bar x ON x.symbol = i.symbol AND x.idx = i.e_idx + i.horizon
    LEFT JOIN f_peer p ON p.symbol = m.symbol AND p.known = m.known AND p.horizon = i.horizon LEFT JOIN f_bench b ON b.known = m.known AND b.horizon = i.horizon""",
    "metric", "f_in", "bar", "f_peer", "f_bench",
)


def signals(name: str, reversals: str) -> None:
    known = KNOWN.format("date")
    cte(
        name,
        f"""SELECT 'sector_catch_up:' || symbol || ':' || date || ':h5' AS signal_id, symbol, {known} AS known_at, 'long' AS direction, 5 AS horizon, 'sector_catch_up_laggard' AS source FROM catch_up WHERE status = 'ok' AND horizon = 5 AND is_laggard
        UNION ALL SELECT 'weekday_monday:' || symbol || ':' || date || ':h5', symbol, {known}, 'long', 5, 'weekday_monday_fixed' FROM weekdays WHERE status = 'ok' AND holding_days = 5 AND pattern_name = 'Monday_5d_hold'
        UNION ALL SELECT 'technical_reversal:' || symbol || ':' || event_date || ':' || signal_group || ':' || event_family || ':' || event_type || ':h5', symbol, known_at, 'long', 5, 'technical_reversal_fixed' FROM {reversals} WHERE status = 'ok' AND horizon = 5 AND signal_group = 'combined'
        UNION ALL SELECT 'fundamentals_positive_change:' || symbol || ':' || period_end || ':' || metric_name || ':h20', symbol, disclosure_timestamp, 'long', 20, 'fundamentals_positive_change' FROM reaction WHERE status = 'ok' AND horizon = 20 AND (coalesce(qoq_change > 0, FALSE) OR coalesce(yoy_change > 0, FALSE))""",
        "catch_up", "weekdays", reversals, "reaction",
    )


signals("signal", "all_reversal")


def traded(name: str, source: str, *needs: str) -> None:
    cte(f"{name}_known", f"SELECT *, CAST(substr(known_at, 1, 10) AS DATE) AS known FROM {source}", *needs)
    cte(f"{name}_in", entered(f"{name}_known", "known"), f"{name}_known", "bar")
    cte(
        name,
        f"""SELECT *, gross_return - 0.0015 AS cost_adjusted_return, gross_return - benchmark_return AS benchmark_relative_return, gross_return - sector_benchmark_return AS sector_relative_return FROM (
        SELECT i.*, u.sector, CASE WHEN x.date IS NULL THEN 'insufficient_forward_history' ELSE 'ok' END AS status, entry_open AS entry_price, x.date AS exit_date, x.close AS exit_price, x.close / entry_open - 1 AS gross_return,
        coalesce(x.close, i.entry_close) / f.close - 1 AS buy_hold_return, bx.close / be.close - 1 AS benchmark_return, sx.close / se.close - 1 AS sector_benchmark_return
        FROM {name}_in i LEFT JOIN bar x ON x.symbol = i.symbol AND x.idx = i.e_idx + i.horizon LEFT JOIN bar f ON f.symbol = i.symbol AND f.idx = 1
        LEFT JOIN (SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey) u ON u.symbol = i.symbol
        LEFT JOIN bench be ON be.date = i.entry_date LEFT JOIN bench bx ON bx.date = x.date
        LEFT JOIN sector_bench se ON se.sector = u.sector AND se.date = i.entry_date LEFT JOIN sector_bench sx ON sx.sector = u.sector AND sx.date = x.date)""",
        f"{name}_in", "bar", "bench", "sector_bench",
    )


traded("trades", "signal", "signal")
RATE = "CASE WHEN {0} IS NOT NULL THEN power(greatest(1 + {0}, 0), 1.0 / greatest(horizon, 1)) - 1 END"


def risky(name: str, trades: str, keys: str = "") -> None:
    """Exit-date returns, drawdown and summary of a trades table, by keys that end in a comma."""
    part = f"PARTITION BY {keys.rstrip(', ')} " if keys else ""
    by = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    cte(f"{name}_days", f"SELECT {keys} exit_date, avg({RATE.format('cost_adjusted_return')}) AS strategy_return, avg({RATE.format('benchmark_return')}) AS benchmark_return, count(*) AS trade_count FROM {trades} WHERE status = 'ok' GROUP BY {keys} exit_date", trades)
    run = f"OVER ({part}ORDER BY exit_date ROWS UNBOUNDED PRECEDING)"
    cte(f"{name}_equity", f"SELECT *, exp(sum(ln(1 + strategy_return)) {run}) AS equity FROM {name}_days", f"{name}_days")
    cte(f"{name}_curve", f"SELECT *, max(equity) {run} AS peak, equity / max(equity) {run} - 1 AS drawdown FROM {name}_equity", f"{name}_equity")
    cte(
        f"{name}_risk",
        f"""SELECT {keys} product(1 + strategy_return) - 1 AS cumulative_return, CASE WHEN count(*) >= 2 THEN avg(strategy_return) / nullif(stddev_samp(strategy_return), 0) * sqrt(count(*)) END AS sharpe_ratio,
        min(drawdown) AS maximum_drawdown, count(*) FILTER (strategy_return > 0) / count(*) AS win_rate, product(1 + benchmark_return) - 1 AS cumulative_benchmark_return,
        product(1 + strategy_return) - product(1 + benchmark_return) AS benchmark_difference FROM {name}_curve {by}""",
        f"{name}_curve",
    )
    cte(
        f"{name}_summary",
        f"""SELECT {keys} 'ok' AS status, count(*) AS signal_count, count(*) FILTER (status = 'ok') AS trade_count, count(DISTINCT symbol) FILTER (status = 'ok') AS symbol_count,
        avg(gross_return) FILTER (status = 'ok') AS average_gross_return, median(gross_return) FILTER (status = 'ok') AS median_gross_return, avg(cost_adjusted_return) FILTER (status = 'ok') AS average_cost_adjusted_return,
        median(cost_adjusted_return) FILTER (status = 'ok') AS median_cost_adjusted_return, avg(benchmark_relative_return) FILTER (status = 'ok') AS average_benchmark_relative_return, avg(sector_relative_return) FILTER (status = 'ok') AS average_sector_relative_return
        FROM {trades} {by}""",
        trades,
    )


risky("bt", "trades")
cte("variant", "SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3)) v(variant, n) JOIN (VALUES ('technical', 1, 'technical_reversal_fixed'), ('sector', 2, 'sector_catch_up_laggard'), ('fundamentals', 3, 'fundamentals_positive_change')) c(component, k, src) ON k <= n")
cte("variant_signal", "SELECT variant, component, signal_id AS component_signal_id, variant || ':' || component || ':' || signal_id AS signal_id, symbol, known_at, direction, horizon, component AS source FROM signal JOIN variant ON src = source", "signal", "variant")
traded("variant_trades", "variant_signal", "variant_signal")
risky("va", "variant_trades", "variant, ")
cte("labelled", f"SELECT t.*, g.regime_return, CASE WHEN known >= DATE '{UNSEEN}' THEN 'unseen' ELSE 'selection' END AS period_split, {REGIME} AS market_regime FROM trades t LEFT JOIN regime g ON g.date = t.known WHERE status = 'ok'", "trades", "regime")
