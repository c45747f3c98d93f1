"""The queries of this package as SQL for an independent engine: common table expressions that build on each other."""

from __future__ import annotations

from .queries import DAY, DAY0, HORIZON, MINUTE, SCORED_FROM, SCORED_TO, SECOND, SETTINGS

_CTE: dict[str, str] = {}
_CTE["ta"] = """SELECT event_type AS symbol, event_id AS agg_trade_id, CAST(1000 + value AS DECIMAL(18,8)) AS price,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS DECIMAL(18,8)) AS quantity, user_id % 2 = 0 AS is_buyer_maker, epoch_us(ts) AS event_us FROM events"""
_CTE["tb"] = f"SELECT * REPLACE ({DAY0} + (event_us - {DAY0}) // 720 AS event_us) FROM ta"
_CTE["arr"] = """SELECT *, event_us + CASE WHEN (agg_trade_id * 104729) % 1000 < 20
    THEN floor(-ln(1 - ((agg_trade_id * 7919 + 13) % 100000 + 0.5::DOUBLE) / 100000) * 10::DOUBLE * 1e6)::BIGINT ELSE 0 END AS arrival_us FROM tb"""
_CTE["bat"] = """SELECT * EXCLUDE (slot), (dense_rank() OVER (ORDER BY slot) - 1)::INTEGER AS batch_id, (SELECT min(event_us) FROM arr) + (slot + 1) * 500000 AS clock_us
    FROM (SELECT *, (arrival_us - (SELECT min(event_us) FROM arr)) // 500000 AS slot FROM arr)"""


def _silver(lateness: float) -> dict[str, str]:
    us = int(lateness * SECOND)
    ohlcv = """arg_min(price, agg_trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, agg_trade_id) AS close, sum(quantity)::DECIMAL(24,8) AS volume,
    sum(price::DECIMAL(19,8) * quantity::DECIMAL(19,8))::DECIMAL(28,8) AS quote_volume, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END)::DECIMAL(24,8) AS sell_volume, count(*) AS trade_count"""
    emit = "coalesce((SELECT min_by(clock, batch_id) FROM wm WHERE wm.wm >= b.bar_us + {step}), (SELECT max_by(clock, batch_id) FROM wm))"
    return {
        "wm": f"""SELECT batch_id, clock, min_event, wm, lag(wm) OVER (ORDER BY batch_id) AS pwm FROM (SELECT batch_id, max(clock_us) AS clock, min(event_us) AS min_event,
    max(max(event_us)) OVER (ORDER BY batch_id) - {us} AS wm FROM bat GROUP BY batch_id)""",
        "sp": f"""SELECT bat.*, event_us - event_us % {SECOND} AS bar_us, pwm, coalesce(event_us - event_us % {SECOND} + {SECOND} <= pwm, false) AS late FROM bat JOIN wm USING (batch_id)""",
        "ends": f"SELECT end_us, min_by(clock, batch_id) AS clock FROM (SELECT unnest(generate_series(coalesce(pwm - pwm % {SECOND} + {SECOND}, min_event - min_event % {SECOND}), wm - wm % {SECOND}, {SECOND})) AS end_us, clock, batch_id FROM wm) GROUP BY end_us",
        "b1": f"SELECT symbol, bar_us, {ohlcv} FROM sp WHERE NOT late GROUP BY symbol, bar_us",
        "base": f"SELECT b.*, coalesce(e.clock, (SELECT max_by(clock, batch_id) FROM wm)) AS emitted_us FROM b1 b LEFT JOIN ends e ON e.end_us = b.bar_us + {SECOND}",
        "u1": f"""SELECT symbol, bar_us - bar_us % {MINUTE} AS m, arg_min(open, bar_us) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_us) AS close, sum(volume)::DECIMAL(24,8) AS volume,
    sum(quote_volume)::DECIMAL(28,8) AS quote_volume, sum(sell_volume)::DECIMAL(24,8) AS sell_volume, sum(trade_count)::BIGINT AS trade_count, count(*) AS active_bars FROM base GROUP BY 1, 2""",
        "roll": f"""SELECT b.* EXCLUDE (m), (quote_volume::DOUBLE / volume::DOUBLE)::DECIMAL(18,8) AS vwap, {emit.format(step=MINUTE)} AS emitted_us
    FROM (SELECT m AS bar_us, * FROM u1 WHERE m >= (SELECT min_by(min_event, batch_id) - min_by(min_event, batch_id) % {MINUTE} FROM wm)) b""",
        "truth": f"SELECT symbol, event_us - event_us % {MINUTE} AS bar_us, {ohlcv} FROM tb GROUP BY 1, 2",
        "cmp": """SELECT t.*, b.volume AS bv, greatest(abs(b.open::DOUBLE / t.open::DOUBLE - 1), abs(b.high::DOUBLE / t.high::DOUBLE - 1), abs(b.low::DOUBLE / t.low::DOUBLE - 1), abs(b.close::DOUBLE / t.close::DOUBLE - 1)) AS po,
    abs(b.volume::DOUBLE / t.volume::DOUBLE - 1) AS vo, abs(b.sell_volume::DOUBLE / b.volume::DOUBLE - t.sell_volume::DOUBLE / t.volume::DOUBLE) AS so FROM truth t LEFT JOIN roll b USING (symbol, bar_us)""",
    }


_OHLCV_A = """arg_min(price, agg_trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, agg_trade_id) AS close, sum(quantity)::DECIMAL(24,8) AS volume,
    sum(price::DECIMAL(19,8) * quantity::DECIMAL(19,8))::DECIMAL(28,8) AS quote_volume, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END)::DECIMAL(24,8) AS sell_volume, count(*) AS trade_count"""
_CTE["ma"] = f"SELECT symbol, event_us - event_us % {MINUTE} AS bar_us, {_OHLCV_A} FROM ta GROUP BY 1, 2"
_CTE["scored"] = f"SELECT * FROM ma WHERE bar_us >= {SCORED_FROM} AND bar_us < {SCORED_TO}"
_CTE["prof"] = f"""SELECT symbol, day, hour, count(DISTINCT own) AS days, count(*) AS bars, median(volume) AS volume_median, stddev_samp(ret) AS ret_std FROM (
    SELECT symbol, (bar_us % {DAY} // 3600000000)::INTEGER AS hour, bar_us // {DAY} AS own, volume::DOUBLE AS volume, close::DOUBLE / lag(close::DOUBLE) OVER (PARTITION BY symbol ORDER BY bar_us) - 1 AS ret
    FROM ma) JOIN (SELECT unnest(generate_series({SCORED_FROM // DAY}, {SCORED_TO // DAY - 1})) AS day) ON day - own BETWEEN 1 AND 7 GROUP BY symbol, day, hour"""
_CTE["grid"] = f"""SELECT g.symbol, g.bar_us, (last_value(s.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar_us ROWS UNBOUNDED PRECEDING))::DOUBLE AS close,
    coalesce(s.volume, 0) AS volume, coalesce(s.sell_volume, 0) AS sell_volume FROM (SELECT symbol, unnest(generate_series(min(bar_us), {HORIZON}, {MINUTE})) AS bar_us FROM scored GROUP BY symbol) g LEFT JOIN scored s USING (symbol, bar_us)"""
_CTE["f0"] = """SELECT *, close / lag(close, 60) OVER w - 1 AS ret_60, CASE WHEN count(*) OVER (w ROWS 59 PRECEDING) >= 60 THEN (sum(volume) OVER (w ROWS 59 PRECEDING))::DOUBLE END AS vol_60,
    CASE WHEN count(*) OVER (w ROWS 119 PRECEDING) >= 120 THEN (sum(volume) OVER (w ROWS 119 PRECEDING))::DOUBLE END AS vol_120,
    CASE WHEN count(*) OVER (w ROWS 119 PRECEDING) >= 120 THEN (sum(sell_volume) OVER (w ROWS 119 PRECEDING))::DOUBLE END AS sell_120 FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY bar_us)"""
_INF = "CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'infinity'::DOUBLE WHEN {a} < 0 THEN '-infinity'::DOUBLE END ELSE {a} / {b} END"
_CTE["feat"] = f"""SELECT f0.*, CASE WHEN vol_120 <> 0 THEN sell_120 / vol_120 END AS sell_share_120, {_INF.format(a='ret_60', b='ret_std')} AS ret_60_ref_z,
    {_INF.format(a='vol_60', b='volume_median')} AS vol_60_ref_ratio, {_INF.format(a='vol_120', b='(2 * volume_median)')} AS vol_120_ref_ratio
    FROM f0 LEFT JOIN prof ON f0.symbol = prof.symbol AND (f0.bar_us % {DAY} // 3600000000) = prof.hour AND f0.bar_us // {DAY} = prof.day"""
_CTE["nb"] = f"""SELECT slot, (SELECT min(event_us) FROM ta) + (slot + 1) * {MINUTE} AS clock, min_event, wm, lag(wm) OVER (ORDER BY slot) AS pwm FROM (
    SELECT slot, min(event_us) AS min_event, max(max(event_us)) OVER (ORDER BY slot) - {10 * SECOND} AS wm FROM (SELECT event_us, (event_us - (SELECT min(event_us) FROM ta)) // {MINUTE} AS slot FROM ta) GROUP BY slot)"""
_CTE["ne"] = f"""SELECT end_us, min(clock) AS clock FROM (SELECT unnest(generate_series(coalesce(pwm - pwm % {MINUTE} + {MINUTE}, min_event - min_event % {MINUTE}), wm - wm % {MINUTE}, {MINUTE})) AS end_us, clock FROM nb) GROUP BY end_us"""
_CTE["kn"] = f"""SELECT bar_us, first_value(e IGNORE NULLS) OVER (ORDER BY bar_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS known_us FROM (SELECT DISTINCT bar_us FROM grid) LEFT JOIN (
    SELECT DISTINCT bar_us, coalesce(clock, (SELECT max(clock) FROM nb)) AS e FROM scored LEFT JOIN ne ON end_us = bar_us + {MINUTE}) USING (bar_us)"""
_CTE["cond"] = """SELECT c.*, known_us FROM (SELECT symbol, bar_us AS t_us, 'price_shock' AS rule, 0 AS place, 'high' AS severity, true AS opens FROM feat WHERE abs(ret_60_ref_z) > 4
    UNION ALL SELECT symbol, bar_us, 'volume_burst', 1, 'medium', false FROM feat WHERE vol_60_ref_ratio > 4
    UNION ALL SELECT symbol, bar_us, 'one_sided_flow', 2, 'medium', false FROM feat WHERE (sell_share_120 > 0.8 OR sell_share_120 < 0.2) AND vol_120_ref_ratio > 2) c LEFT JOIN kn ON kn.bar_us = t_us"""
_CTE["al"] = f"""SELECT *, row_number() OVER (ORDER BY fired_us, symbol, place)::INTEGER AS alert_no FROM (
    SELECT symbol, rule, place, severity, opens, min(t_us) AS fired_us, coalesce(arg_min(known_us, t_us), min(t_us) + {MINUTE}) AS detected_us, CASE WHEN max(t_us) + 300000000 <= {HORIZON} THEN max(t_us) + 300000000 END AS cleared_us, least(max(t_us) + 300000000 - {MINUTE}, {HORIZON}) AS active_until FROM (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, rule ORDER BY t_us) AS ep FROM (
    SELECT *, t_us - lag(t_us) OVER (PARTITION BY symbol, rule ORDER BY t_us) AS gap FROM cond)) GROUP BY symbol, rule, place, severity, opens, ep)"""
_CTE["inc"] = f"""SELECT symbol, min(fired_us) AS opened_us, max(active_until) AS last_active_us, arg_min(detected_us, (fired_us, place)) AS detected_us, count(*) AS opening_alerts, CASE WHEN max(active_until) + 900000000 <= {HORIZON} THEN max(active_until) + 900000000 END AS resolved_us,
    CASE WHEN max(active_until) + 900000000 <= {HORIZON} THEN 'resolved' ELSE 'open' END AS status, row_number() OVER (ORDER BY min(fired_us), symbol)::INTEGER AS incident_no FROM (
    SELECT *, sum(CASE WHEN before IS NULL OR fired_us > before + 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY fired_us, place) AS n FROM (
    SELECT *, max(active_until) OVER (PARTITION BY symbol ORDER BY fired_us, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM al WHERE opens)) GROUP BY symbol, n"""
_CTE["linked"] = """SELECT al.*, (SELECT arg_min(incident_no, opened_us) FROM inc WHERE inc.symbol = al.symbol AND opened_us - 300000000 <= fired_us AND (resolved_us IS NULL OR fired_us <= resolved_us)) AS incident_no FROM al"""
_CTE["win"] = "SELECT incident_no, symbol, opened_us - 60000000 AS w0, last_active_us AS w1, opened_us FROM inc"
_CTE["flow"] = """SELECT incident_no, sum(volume)::DOUBLE AS volume, CASE WHEN sum(volume) <> 0 THEN sum(sell_volume)::DOUBLE / sum(volume)::DOUBLE END AS sell_share, sum(trade_count)::BIGINT AS trades, arg_max(close, bar_us)::DOUBLE AS price_at_end
    FROM win JOIN scored USING (symbol) WHERE bar_us BETWEEN w0 AND w1 GROUP BY incident_no"""
_CTE["ext"] = """SELECT i.*, a.price_at_open, x.* EXCLUDE (incident_no) FROM inc i LEFT JOIN (SELECT symbol, bar_us, close / (1 + ret_60) AS price_at_open FROM feat) a ON a.symbol = i.symbol AND a.bar_us = i.opened_us
    LEFT JOIN (SELECT incident_no, min(close) AS price_low, max(close) AS price_high, arg_max(close, bar_us) AS price_last, coalesce(max(abs(ret_60_ref_z)), 0) AS max_z, coalesce(max(vol_60_ref_ratio), 0) AS max_v,
    max(sell_share_120) AS max_s, min(sell_share_120) AS min_s FROM (SELECT DISTINCT l.incident_no, f.* FROM linked l JOIN feat f ON f.symbol = l.symbol AND f.bar_us BETWEEN l.fired_us AND l.active_until WHERE l.opens AND l.incident_no IS NOT NULL) GROUP BY 1) x USING (incident_no)"""
_CTE["size"] = """SELECT incident_no, floor(max(q) / sum(q) * 100 * 100 + 0.5) / 100 AS largest_trade_pct, floor(sum(CASE WHEN r <= 10 THEN q END) / sum(q) * 100 * 10 + 0.5) / 10 AS top10_pct, median(q) AS median_trade_size FROM (
    SELECT incident_no, quantity::DOUBLE AS q, row_number() OVER (PARTITION BY incident_no ORDER BY quantity DESC, agg_trade_id) AS r FROM win JOIN ta USING (symbol) WHERE event_us BETWEEN w0 AND w1) GROUP BY 1"""
_CTE["ov"] = "SELECT a.incident_no, list(b.incident_no ORDER BY b.incident_no) AS o FROM win a JOIN win b ON a.symbol <> b.symbol AND b.w0 <= a.w1 + 300000000 AND b.w1 >= a.w0 - 300000000 GROUP BY 1"
_CTE["ev"] = f"SELECT alert_no AS event_id, symbol, rule, fired_us, detected_us, detected_us - detected_us % {MINUTE} + {MINUTE} AS entry_us FROM linked"
_CTE["ret"] = "SELECT ev.*, " + ", ".join(f"(g{h}.close / g0.close - 1) * 100 AS ret_{h}m" for h in (5, 15, 60)) + " FROM ev LEFT JOIN grid g0 ON g0.symbol = ev.symbol AND g0.bar_us = entry_us " + " ".join(f"LEFT JOIN grid g{h} ON g{h}.symbol = ev.symbol AND g{h}.bar_us = entry_us + {h * MINUTE}" for h in (5, 15, 60))
_CTE["pool"] = f"SELECT symbol, bar_us FROM grid g WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = g.symbol AND g.bar_us BETWEEN detected_us - detected_us % {MINUTE} - {60 * MINUTE} AND detected_us - detected_us % {MINUTE} + {60 * MINUTE})"
_CTE["runs"] = """SELECT *, CASE WHEN n % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n % 5 = 0 THEN finished_at END AS bronze_purged_at FROM (
    SELECT ts::DATE AS trade_date, strftime(ts, '%Y%m%d') || '-' || (user_id % 3) AS run_id, count(*) AS n, max(ts) AS finished_at, max(ts) FILTER (WHERE event_type = 'error') AS created_at FROM events GROUP BY 1, 2)"""
_CTE["briefs"] = "SELECT trade_date, run_id, CASE n % 3 WHEN 0 THEN 'written' WHEN 1 THEN 'quiet' ELSE 'awaiting_analyst' END AS status, created_at FROM runs WHERE created_at IS NOT NULL"
_CTE["noted"] = f"SELECT fired_us // {DAY} AS d, incident_no AS x, count(*) AS times FROM linked WHERE incident_no IS NOT NULL AND rule <> 'volume_burst' GROUP BY 1, 2"
_CTE["opened"] = f"SELECT opened_us // {DAY} AS d, incident_no AS x FROM inc"
_CTE["off"] = "SELECT trade_date, arg_max(run_id, finished_at) AS run_id FROM runs WHERE status = 'completed' GROUP BY 1"

_A = ["ta", "ma", "scored", "prof", "grid", "f0", "feat", "nb", "ne", "kn", "cond", "al", "inc", "linked", "win", "flow", "ext", "size", "ov", "ev", "ret", "pool"]


def _sql(final: str, *names: str, lateness: float | None = None) -> str:
    parts = {n: _CTE[n] for n in names}
    if lateness is not None:
        parts = {n: _CTE[n] for n in ("ta", "tb", "arr", "bat")} | _silver(lateness)
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n" + final


def _r(c: str, digits: int = 6, name: str | None = None) -> str:
    return f"CASE WHEN abs({c}) < 1e9 THEN floor(({c}) * 1e{digits} + 0.5) / 1e{digits} ELSE {c} END AS {name or c}"


def _d(*names: str) -> str:
    return ", ".join(f"{n}::DOUBLE AS {n}" for n in names)


_P = _d("open", "high", "low", "close", "volume", "quote_volume", "sell_volume")
_TO = {name: _A[: _A.index(name) + 1] for name in _A}
_STUDY = f"count(x) AS n, {_r('avg(x)', 6, 'mean')}, {_r('avg(CASE WHEN x > 0 THEN 100.0::DOUBLE ELSE 0 END)', 6, 'hit_rate')}, {_r('avg(CASE WHEN x > 0 THEN 100.0::DOUBLE WHEN x IS NOT NULL THEN 0 END)', 6, 'hit_rate_known')}"
_SET = f"CASE WHEN entry_us // {DAY} < (SELECT list_sort(list(DISTINCT bar_us // {DAY}))[(count(DISTINCT bar_us // {DAY}) * 2) // 3 + 1] FROM scored) THEN 'discovery' ELSE 'holdout' END AS dataset"


def _long(rows: str, sign: str) -> str:
    return " UNION ALL ".join(f"SELECT *, {h} AS horizon, {sign.format(x=f'ret_{h}m')} AS x FROM ({rows})" for h in (5, 15, 60))


def _sweep() -> str:
    one = [
        f"(SELECT {s}::DOUBLE AS lateness_s, (SELECT count(*) FROM sp WHERE NOT late) AS accepted, (SELECT count(*) FROM sp WHERE late) AS dropped, count(*) AS bars, count(*) FILTER (WHERE bv IS NULL) AS missing_bars, "
        f"count(*) FILTER (WHERE po > 0 OR vo > 0) AS wrong_bars, count(*) FILTER (WHERE vo > 0.01) AS volume_off_1pct FROM cmp)"
        for s in SETTINGS
    ]
    return " UNION ALL ".join("(" + _sql(q, lateness=s) + ")" for q, s in zip(one, SETTINGS))


_CONTROLS = f"""SELECT event_id, symbol, entry_us FROM (SELECT event_id, e.symbol, p.bar_us AS entry_us, row_number() OVER (PARTITION BY event_id ORDER BY step) AS k
    FROM (SELECT *, unnest(generate_series(0, least(n, 80) - 1)) AS step FROM (SELECT event_id, ev.symbol, entry_us % {DAY} // 3600000000 AS hour, entry_us // {DAY} AS day, ('0x' || substring(md5(event_id::VARCHAR), 1, 13))::BIGINT AS start FROM ev) JOIN
      (SELECT symbol, bar_us % {DAY} // 3600000000 AS hour, count(*) AS n FROM pool GROUP BY 1, 2) USING (symbol, hour)) e
    JOIN (SELECT symbol, bar_us, bar_us % {DAY} // 3600000000 AS hour, row_number() OVER (PARTITION BY symbol, bar_us % {DAY} // 3600000000 ORDER BY md5(bar_us::VARCHAR), bar_us) - 1 AS at FROM pool) p
    ON p.symbol = e.symbol AND p.hour = e.hour AND p.at = (e.start + e.step) % e.n WHERE e.day <> p.bar_us // {DAY}) WHERE k <= 20"""

SQL: dict[str, str] = {
    "trades_normalized": _sql(f"SELECT symbol, agg_trade_id, {_d('price', 'quantity')}, is_buyer_maker, event_us FROM ta", "ta"),
    "ts_unit_detection": _sql("SELECT agg_trade_id, raw, CASE WHEN raw > 100000000000000 THEN raw ELSE raw * 1000 END AS event_us FROM (SELECT agg_trade_id, CASE WHEN agg_trade_id % 2 = 0 THEN event_us ELSE event_us // 1000 END AS raw FROM ta)", "ta"),
    "window_filter": _sql(f"SELECT symbol, agg_trade_id, event_us FROM ta WHERE event_us >= {DAY0 + DAY} AND event_us < {DAY0 + 2 * DAY}", "ta"),
    "arrivals_batches": _sql("SELECT agg_trade_id, event_us, arrival_us, batch_id, clock_us FROM bat", lateness=10),
    "delivery_reconcile": _sql("SELECT (SELECT count(*) FROM tb) AS emitted, count(*) AS landed, count(DISTINCT (symbol, agg_trade_id)) AS distinct_rows, (SELECT count(*) FROM tb) = count(*) AND count(*) = count(DISTINCT (symbol, agg_trade_id)) AS ok FROM bat", lateness=10),
    "bars_base": _sql(f"SELECT symbol, bar_us, {_P}, trade_count, emitted_us FROM base", lateness=10),
    "bars_rollup": _sql(f"SELECT symbol, bar_us, {_P}, trade_count, active_bars, vwap::DOUBLE AS vwap, emitted_us FROM roll", lateness=10),
    "late_trades": _sql("SELECT symbol, agg_trade_id, event_us, arrival_us, batch_id, pwm AS watermark_us FROM sp WHERE late", lateness=10),
    "build_stats": _sql("SELECT count(*) FILTER (WHERE NOT late) AS accepted, count(*) FILTER (WHERE late) AS dropped, 100 * (count(*) FILTER (WHERE late))::DOUBLE / count(*)::DOUBLE AS dropped_pct FROM sp", lateness=10),
    "truth_bars": _sql(f"SELECT symbol, bar_us, {_P}, trade_count FROM truth", lateness=10),
    "lateness_compare": _sql(f"SELECT count(*) AS bars, count(*) FILTER (WHERE bv IS NULL) AS missing_bars, count(*) FILTER (WHERE po > 0 OR vo > 0) AS wrong_bars, count(*) FILTER (WHERE vo > 0.01) AS volume_off_1pct, {_r('max(po * 10000)', 4, 'max_price_bps')}, {_r('max(vo * 100)', 4, 'max_volume_pct')}, {_r('max(so * 100)', 4, 'max_share_pp')} FROM cmp", lateness=2),
    "lateness_sweep": _sweep(),
    "bar_delay": _sql(f"SELECT {_r('quantile_cont(d, 0.5)', 4, 'p50_s')}, {_r('quantile_cont(d, 0.95)', 4, 'p95_s')} FROM (SELECT (emitted_us - bar_us - {SECOND}) / 1e6::DOUBLE AS d FROM base)", lateness=10),
    "klines": _sql(f"SELECT symbol, bar_us, {_d('open', 'high', 'low', 'close', 'volume', 'quote_volume')}, trade_count, (volume - sell_volume)::DOUBLE AS taker_buy_volume FROM ma", "ta", "ma"),
    "hour_profile": _sql(f"SELECT symbol, day, hour, days, bars, volume_median, {_r('ret_std')} FROM prof", *_TO["prof"]),
    "returns_lag": _sql(f"SELECT symbol, bar_us, {_r('ret', 9)} FROM (SELECT symbol, bar_us, close::DOUBLE / lag(close::DOUBLE) OVER (PARTITION BY symbol ORDER BY bar_us) - 1 AS ret FROM ma)", "ta", "ma"),
    "bars_vs_klines": _sql("SELECT count(*) AS bars, count(*) FILTER (WHERE p) AS prices_equal, count(*) FILTER (WHERE v) AS volume_equal, count(*) FILTER (WHERE bb) AS buy_volume_equal, count(*) FILTER (WHERE p AND v AND bb) AS all_equal FROM (SELECT r.open = t.open AND r.high = t.high AND r.low = t.low AND r.close = t.close AS p, r.volume = t.volume AS v, r.volume - r.sell_volume = t.volume - t.sell_volume AS bb FROM roll r JOIN truth t USING (symbol, bar_us))", lateness=2),
    "profile_missing_days": "SELECT s AS symbol, d::VARCHAR AS day FROM (VALUES ('click'), ('error'), ('view')) a(s), (SELECT (DATE '2024-01-05' - i::INTEGER)::DATE AS d FROM range(1, 8) t(i)) WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = s AND ts::DATE = d)",
    "dense_grid": _sql(f"SELECT symbol, bar_us, close, {_d('volume', 'sell_volume')} FROM grid", *[n for n in _TO["grid"] if n != "prof"]),
    "known_at": _sql(f"""SELECT g.symbol, g.bar_us, k.known_us FROM (SELECT symbol, unnest(generate_series(min(bar_us), (SELECT max(bar_us) FROM base), {SECOND})) AS bar_us FROM base GROUP BY symbol) g
    JOIN (SELECT t.bar_us, first_value(e IGNORE NULLS) OVER (ORDER BY t.bar_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS known_us FROM (SELECT unnest(generate_series(min(bar_us), max(bar_us), {SECOND})) AS bar_us FROM base) t
    LEFT JOIN (SELECT bar_us, min(emitted_us) AS e FROM base GROUP BY 1) m ON m.bar_us = t.bar_us) k ON k.bar_us = g.bar_us""", lateness=10),
    "features_ref": _sql(f"SELECT symbol, bar_us, {_r('ret_60', 9)}, vol_60, vol_120, {_r('sell_share_120')}, {_r('ret_60_ref_z', 4)}, {_r('vol_60_ref_ratio', 4)}, {_r('vol_120_ref_ratio', 4)} FROM feat", *_TO["feat"]),
    "features_rolling": _sql(f"""SELECT symbol, bar_us, {_r('ret_60 / nullif(z, 0)', 4, 'ret_60_z')}, {_r('vol_60 / nullif(m60, 0)', 4, 'vol_60_ratio')}, {_r('vol_120 / nullif(m120, 0)', 4, 'vol_120_ratio')} FROM (SELECT *,
    CASE WHEN count(ret_60) OVER a >= 600 THEN stddev_samp(ret_60) OVER a END AS z, CASE WHEN count(vol_60) OVER a >= 600 THEN quantile_cont(vol_60, 0.5) OVER a END AS m60, CASE WHEN count(vol_120) OVER b >= 600 THEN quantile_cont(vol_120, 0.5) OVER b END AS m120
    FROM feat WINDOW a AS (PARTITION BY symbol ORDER BY bar_us ROWS BETWEEN 1859 PRECEDING AND 60 PRECEDING), b AS (PARTITION BY symbol ORDER BY bar_us ROWS BETWEEN 1919 PRECEDING AND 120 PRECEDING))""", *_TO["feat"]),
    "rule_conditions": _sql("SELECT symbol, t_us, rule FROM cond", *_TO["cond"]),
    "alerts": _sql("SELECT alert_no, symbol, rule, severity, fired_us, detected_us, cleared_us, incident_no FROM linked", *_TO["linked"]),
    "incidents": _sql("SELECT incident_no, symbol, opened_us, last_active_us, detected_us, opening_alerts, resolved_us, status FROM inc", *_TO["inc"]),
    "incident_events": _sql("SELECT incident_no, opened_us AS at_us, 'opened' AS event, NULL::INTEGER AS alert_no FROM inc UNION ALL SELECT incident_no, fired_us, 'alert_attached', alert_no FROM linked WHERE incident_no IS NOT NULL UNION ALL SELECT incident_no, resolved_us, 'resolved', NULL FROM inc WHERE resolved_us IS NOT NULL", *_TO["linked"]),
    "incident_rules": _sql("SELECT incident_no, string_agg(rule, ',' ORDER BY late, k, p, rule) AS rules FROM (SELECT *, row_number() OVER (PARTITION BY incident_no, rule ORDER BY late, k, p) AS nth FROM (SELECT l.incident_no, rule, fired_us >= opened_us AS late, CASE WHEN fired_us < opened_us THEN -fired_us ELSE fired_us END AS k, CASE WHEN fired_us < opened_us THEN -place ELSE place END AS p FROM linked l JOIN inc USING (incident_no))) WHERE nth = 1 GROUP BY 1", *_TO["linked"]),
    "incident_extremes": _sql(f"SELECT incident_no, {_r('price_at_open')}, price_low, price_high, price_last, {_r('max_z', 4, 'max_abs_ret_60_ref_z')}, {_r('max_v', 4, 'max_vol_60_ref_ratio')}, {_r('max_s', 6, 'max_sell_share')}, {_r('min_s', 6, 'min_sell_share')} FROM ext", *_TO["ext"]),
    "incident_flow": _sql(f"SELECT incident_no, volume, {_r('sell_share')}, trades, price_at_end FROM flow", *_TO["flow"]),
    "price_after": _sql(f"SELECT incident_no, max(close) FILTER (WHERE m = 30) AS price_30m_after, max(close) FILTER (WHERE m = 60) AS price_60m_after FROM (SELECT incident_no, symbol, m, w1 - w1 % {MINUTE} + m * {MINUTE} AS bar_us FROM win, (VALUES (30::BIGINT), (60)) t(m)) LEFT JOIN grid USING (symbol, bar_us) GROUP BY 1", *_TO["win"]),
    "other_symbol": _sql(f"SELECT incident_no, s AS other_symbol, {_r('r', 9, 'other_return')} FROM (SELECT incident_no, scored.symbol AS s, arg_max(close, bar_us)::DOUBLE / arg_min(open, bar_us)::DOUBLE - 1 AS r FROM win JOIN scored ON win.symbol <> scored.symbol AND bar_us BETWEEN w0 AND w1 GROUP BY 1, 2)", *_TO["win"]),
    "overlap_pairs": _sql("SELECT incident_no, array_to_string(o, ',') AS overlapping FROM ov", *_TO["win"], "ov"),
    "alert_timeline": _sql("SELECT incident_no, string_agg(rule || '@' || ((fired_us - opened_us) // 1000000)::VARCHAR, ',' ORDER BY fired_us, alert_no) AS timeline FROM linked l JOIN inc USING (incident_no) GROUP BY 1", *_TO["linked"]),
    "incident_evidence": _sql("""SELECT incident_no, e.symbol, status, strftime(make_timestamp(opened_us), '%H:%M:%S') AS opened_utc, floor((last_active_us - opened_us) / 60000000.0::DOUBLE * 10 + 0.5) / 10 AS active_minutes,
    floor((price_at_end / price_at_open - 1) * 100 * 100 + 0.5) / 100 AS move_at_end_pct, floor(sell_share * 100 * 10 + 0.5) / 10 AS sell_pct, volume, trades, coalesce(len(o), 0)::INTEGER AS n_overlapping,
    CASE WHEN coalesce(len(o), 0) > 0 THEN 'market_wide' ELSE 'single_asset' END AS scope, largest_trade_pct, top10_pct, median_trade_size FROM ext e LEFT JOIN flow USING (incident_no) LEFT JOIN ov USING (incident_no) LEFT JOIN size USING (incident_no)""", *_TO["ov"]),
    "trade_concentration": _sql("SELECT * FROM size", "ta", *[n for n in _TO["win"] if n != "ta"], "size"),
    "day_summary": _sql(f"""SELECT symbol, day, o AS open, c AS close, floor((c / o - 1) * 100 * 100 + 0.5) / 100 AS day_return_pct, floor((h / l - 1) * 100 * 100 + 0.5) / 100 AS range_pct, floor(v / normal * 100 + 0.5) / 100 AS volume_vs_normal_x FROM (
    SELECT symbol, bar_us // {DAY} AS day, arg_min(open, bar_us)::DOUBLE AS o, arg_max(close, bar_us)::DOUBLE AS c, max(high)::DOUBLE AS h, min(low)::DOUBLE AS l, sum(volume)::DOUBLE AS v FROM scored GROUP BY 1, 2) LEFT JOIN (SELECT symbol, day, sum(volume_median * 60) AS normal FROM prof GROUP BY 1, 2) USING (symbol, day)""", *_TO["prof"]),
    "alerts_by_rule": _sql("SELECT rule, count(*) AS alerts, count(*) FILTER (WHERE incident_no IS NULL) AS not_in_any_incident FROM linked GROUP BY 1", *_TO["linked"]),
    "official_runs": _sql("SELECT trade_date::VARCHAR AS trade_date, run_id FROM off", "runs", "off"),
    "audit_list": _sql("SELECT run_id, status FROM runs ORDER BY finished_at DESC, run_id LIMIT 30", "runs"),
    "retention_candidates": _sql("SELECT run_id FROM runs WHERE trade_date < DATE '2024-01-25' - 7 AND bronze_purged_at IS NULL", "runs"),
    "official_events": _sql("SELECT run_id, trade_date::VARCHAR AS trade_date, n FROM runs JOIN off USING (run_id, trade_date)", "runs", "off"),
    "catchup_days": _sql("SELECT trade_date::VARCHAR AS trade_date, run_id FROM off WHERE NOT EXISTS (SELECT 1 FROM (SELECT run_id, arg_max(status, created_at) AS status FROM briefs GROUP BY 1) b WHERE b.run_id = off.run_id AND b.status IN ('written', 'quiet'))", "runs", "briefs", "off"),
    "briefs_join": _sql("SELECT incident_no, symbol, note FROM inc LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS note FROM conversations WHERE role = 'assistant' GROUP BY 1) t ON conv_id = incident_no", *_TO["inc"]),
    "briefing_validation": _sql("""SELECT w.d::INTEGER AS briefing_id, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM noted n WHERE n.d = w.d AND NOT list_contains(w.i, x)), '') AS unknown,
    coalesce((SELECT string_agg(o.x, ',' ORDER BY o.x) FROM opened o WHERE o.d = w.d AND NOT EXISTS (SELECT 1 FROM noted n WHERE n.d = w.d AND n.x = o.x)), '') AS missing, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM noted n WHERE n.d = w.d AND times > 1), '') AS duplicate
    FROM (SELECT d, list(x) AS i FROM opened GROUP BY 1) w""", *_TO["linked"], "noted", "opened"),
    "scope_of": _sql("SELECT inc.incident_no, CASE WHEN o IS NULL THEN 'single_asset' ELSE 'market_wide' END AS scope FROM inc LEFT JOIN ov USING (incident_no)", *_TO["win"], "ov"),
    "quiet_summary": _sql(f"""SELECT d::VARCHAR AS trade_date, CASE WHEN i = 0 THEN 'No incidents on ' || d::VARCHAR || ' for ' || s || '; ' || a || ' context alerts.' ELSE i || ' incidents on ' || d::VARCHAR || ' for ' || s || ' await an analyst.' END AS summary FROM (
    SELECT make_timestamp(day * {DAY})::DATE AS d, s, (SELECT count(*) FROM inc WHERE opened_us // {DAY} = day) AS i, (SELECT count(*) FROM linked WHERE fired_us // {DAY} = day) AS a
    FROM (SELECT bar_us // {DAY} AS day, string_agg(DISTINCT symbol, ', ' ORDER BY symbol) AS s FROM scored GROUP BY 1))""", *_TO["linked"]),
    "event_log": _sql("SELECT incident_no, opened_us AS at_us, 'opened' AS event, NULL::INTEGER AS alert_no, detected_us, NULL::VARCHAR AS rule FROM inc UNION ALL SELECT incident_no, fired_us, 'alert_attached', alert_no, detected_us, rule FROM linked WHERE incident_no IS NOT NULL UNION ALL SELECT incident_no, resolved_us, 'resolved', NULL, known_us, NULL FROM inc LEFT JOIN kn ON bar_us = resolved_us WHERE resolved_us IS NOT NULL", *_TO["linked"]),
    "alert_features": _sql(f"SELECT alert_no, {_r('close', 6)}, {_r('vol_60', 6)} FROM linked l LEFT JOIN feat f ON f.symbol = l.symbol AND f.bar_us = l.fired_us", *_TO["linked"]),
    "forward_returns": _sql(f"SELECT event_id, symbol, rule, entry_us, {_r('ret_5m', 9)}, {_r('ret_15m', 9)}, {_r('ret_60m', 9)} FROM ret", *_TO["linked"], "ev", "ret"),
    "study_controls": _sql(f"""SELECT rule, dataset, h::INTEGER AS horizon, count(x) AS controls, {_r('avg(x)', 6, 'control')} FROM (
    SELECT e.rule, e.dataset, h, abs(b.close / a.close - 1) * 100 AS x FROM ({_CONTROLS}) c JOIN (SELECT event_id, rule, {_SET} FROM ev) e USING (event_id) CROSS JOIN (VALUES (5::BIGINT), (15), (60)) t(h)
    LEFT JOIN grid a ON a.symbol = c.symbol AND a.bar_us = c.entry_us LEFT JOIN grid b ON b.symbol = c.symbol AND b.bar_us = c.entry_us + h * {MINUTE}) GROUP BY 1, 2, 3""", *_TO["linked"], "ev", "pool"),
    "control_pool": _sql("SELECT symbol, bar_us FROM pool", *_TO["linked"], "ev", "pool"),
    "controls_sample": _sql(_CONTROLS, *_TO["linked"], "ev", "pool"),
    "study_size": _sql(f"SELECT rule, dataset, horizon, {_STUDY} FROM ({_long(f'SELECT rule, {_SET}, ret_5m, ret_15m, ret_60m FROM ret', 'abs({x})')}) GROUP BY 1, 2, 3", *_TO["linked"], "ev", "ret"),
    "study_direction": _sql(f"SELECT dataset, horizon, {_STUDY} FROM ({_long(f'SELECT {_SET}, ret_5m, ret_15m, ret_60m, CASE WHEN sell_share_120 < 0.5 THEN 1 ELSE -1 END AS sg FROM ret LEFT JOIN feat f ON f.symbol = ret.symbol AND f.bar_us = fired_us WHERE rule = ' + chr(39) + 'one_sided_flow' + chr(39), 'sg * {x}')}) GROUP BY 1, 2", *_TO["linked"], "ev", "ret"),
    "study_shock": _sql(f"SELECT dataset, horizon, {_STUDY} FROM ({_long(f'SELECT {_SET}, ret_5m, ret_15m, ret_60m, sign(ret_60) AS sg FROM ret LEFT JOIN feat f ON f.symbol = ret.symbol AND f.bar_us = fired_us WHERE rule = ' + chr(39) + 'price_shock' + chr(39), 'sg * {x}')}) GROUP BY 1, 2", *_TO["linked"], "ev", "ret"),
}
