"""Bars, rules and research against small state machines and hand-built cases."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.columns import MINUTE, SECOND
from tapeloom.operators import bars as B
from tapeloom.operators import features as X
from tapeloom.operators import replay, research, rules
from tapeloom.plans import briefing
from tapeloom.sources import tape
from tapeloom.sources.store import Store, latest

TRADE = "batch_id long, clock_us long, symbol string, agg_trade_id long, price decimal(18,8), quantity decimal(18,8), is_buyer_maker boolean, event_us long, arrival_us long"


def batches_of(spark, batches):
    rows, n = [], 0
    for b, times in enumerate(batches):
        for t in times:
            rows.append((b, (b + 1) * SECOND, "x", n, Decimal(100 + n % 7), Decimal(1 + n % 3), n % 2 == 0, int(t * SECOND), (b + 1) * SECOND))
            n += 1
    return spark.createDataFrame(rows, TRADE)


def test_late_boundary(spark):
    b = batches_of(spark, [[100], [95.5, 97.5, 98.5, 200], [150.5, 300], [301]])
    late = {r.event_us / SECOND for r in B.late_trades(b, 2, SECOND).collect()}
    assert late == {95.5, 97.5, 150.5}
    assert B.build_stats(b, 2, SECOND).first().accepted == 5


def machine(batches, lateness):
    """Row-at-a-time bars: accepted counts by second with the batch that emits them."""
    wm, open_bars, out, late = None, {}, {}, []
    for k, times in enumerate(batches):
        for t in times:
            bar = int(t)
            if wm is not None and bar + 1 <= wm:
                late.append(t)
            else:
                open_bars[bar] = open_bars.get(bar, 0) + 1
        top = max(times) - lateness
        wm = top if wm is None else max(wm, top)
        for bar in [b for b in open_bars if b + 1 <= wm]:
            out[bar] = (open_bars.pop(bar), k)
    for bar, n in open_bars.items():
        out[bar] = (n, len(batches) - 1)
    return out, late


@pytest.mark.parametrize("seed", range(4))
def test_bars_equal_machine(spark, seed):
    rng = random.Random(seed)
    now, batches = 100.0, []
    for _ in range(8):
        now += rng.random() * 6
        batches.append([round(now - rng.choice([0, 0, 0, 1, 4, 9]) * rng.random(), 3) for _ in range(rng.randint(1, 6))])
    lateness = rng.choice([0, 2, 5])
    b = batches_of(spark, batches)
    want, late = machine(batches, lateness)
    got = {r.bar_us // SECOND: (r.trade_count, r.emitted_us // SECOND - 1) for r in B.base_bars(b, lateness, SECOND).collect()}
    assert got == want
    assert sorted(r.event_us / SECOND for r in B.late_trades(b, lateness, SECOND).collect()) == sorted(late)


def test_huge_lateness_equals_truth(spark):
    b = batches_of(spark, [[60.5, 61], [50, 125.2], [130, 200]])
    up = B.rolled_up(B.base_bars(b, 1000, SECOND), b, 1000, MINUTE)
    c = B.compared(B.trade_bars(b.where("event_us >= 60000000"), MINUTE), up).first()
    assert c.wrong_bars == 0 and c.missing_bars == 0


def test_arrivals_delivery_and_units(spark):
    t = batches_of(spark, [[1, 2, 3]]).drop("batch_id", "clock_us", "arrival_us")
    assert replay.delivery(t, replay.batched(replay.arrivals(t))).first().ok
    assert replay.random_arrivals(t, 1.0, 5.0).where("arrival_us < event_us").count() == 0
    us = spark.createDataFrame([(1_700_000_000_000,), (1_700_000_000_000_000,)], "t long").select(tape.unit_micros(F.col("t")).alias("u")).distinct()
    assert [r.u for r in us.collect()] == [1_700_000_000_000_000]


def alert_machine(true_at, clear, horizon, tick):
    out = []
    for t in sorted(true_at):
        if out and t - out[-1][1] <= clear:
            out[-1][1] = t
        else:
            out.append([t, t])
    return [(a, b + clear if b + clear <= horizon else None, min(b + clear - tick, horizon)) for a, b in out]


@pytest.mark.parametrize("seed", range(3))
def test_alerts_equal_machine(spark, seed):
    rng = random.Random(seed)
    true_at = sorted(rng.sample(range(0, 2000), 40))
    rows = [("x", t * SECOND, "r", 0, 60 * SECOND, True, "high") for t in true_at]
    df = spark.createDataFrame(rows, "symbol string, t_us long, rule string, place int, clear_us long, opens boolean, severity string")
    got = [(r.fired_us, r.cleared_us, r.active_until) for r in rules.alerts(df, 2000 * SECOND).orderBy("fired_us").collect()]
    assert got == [tuple(v * SECOND if v is not None else None for v in x) for x in alert_machine(true_at, 60, 2000, 1)]


def test_incident_edges(spark):
    book = rules.RuleBook.parse()
    sec = lambda *ts: [("x", t * SECOND, "price_shock", 0, 60 * SECOND, True, "high") for t in ts]
    schema = "symbol string, t_us long, rule string, place int, clear_us long, opens boolean, severity string"
    horizon = 10_000 * SECOND

    def count(rows):
        a = rules.alerts(spark.createDataFrame(rows, schema), horizon)
        return rules.incidents(a, book, horizon).count(), a

    assert count(sec(0, 59 + 900))[0] == 1  # just at the end of quiet
    assert count(sec(0, 59 + 901))[0] == 2
    rows = sec(1000) + [("x", t * SECOND, "volume_burst", 1, 60 * SECOND, False, "medium") for t in (700, 500)]
    n, a = count(rows)
    hit = {r.fired_us // SECOND: r.incident_no for r in rules.attached(a, rules.incidents(a, book, horizon), book).collect()}
    assert n == 1 and hit == {1000: 1, 700: 1, 500: None}


def test_zero_profile_fires_and_missing_hour_does_not(spark):
    grid = spark.createDataFrame([("x", k * SECOND, 100.0 + k, Decimal(1), Decimal(0)) for k in range(130)], "symbol string, bar_us long, close double, volume decimal(24,8), sell_volume decimal(24,8)")
    profile = spark.createDataFrame([("x", 0, 0.0, 0.0)], "symbol string, hour int, volume_median double, ret_std double")
    f = X.features(grid, profile).orderBy("bar_us").collect()
    assert f[58].vol_60 is None and f[59].vol_60 == 60 and f[59].ret_60 is None
    assert f[60].ret_60_ref_z == float("inf") and f[60].vol_60_ref_ratio == float("inf")
    none = X.features(grid, profile.where("hour = 5"))
    assert rules.conditions(none, rules.RuleBook.parse()).count() == 0


def test_rolling_features_need_warmup(spark):
    rows = [("x", k * SECOND, 0.001 * (k % 5), float(k % 7), float(k % 3)) for k in range(900)]
    f = X.rolling_features(spark.createDataFrame(rows, "symbol string, bar_us long, ret_60 double, vol_60 double, vol_120 double"))
    seen = {r.bar_us // SECOND: r.vol_60_ratio for r in f.collect()}
    assert seen[658] is None and seen[659] is not None


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda run, no, rule: spark.createDataFrame([(run, no, rule)], "run_id string, alert_no long, rule string")
    assert store.read("ops/alerts").count() == 0
    store.append("ops/alerts", row("a", 1, "x").union(row("b", 1, "y")))
    store.replace("ops/alerts", row("a", 2, "z"))
    assert {(r.run_id, r.alert_no) for r in store.read("ops/alerts").collect()} == {("a", 2), ("b", 1)}
    store.upsert("ops/alerts", row("a", 2, "new").union(row("a", 3, "more")), ["run_id", "alert_no"])
    assert {(r.run_id, r.alert_no, r.rule) for r in store.read("ops/alerts").collect()} == {("a", 2, "new"), ("a", 3, "more"), ("b", 1, "y")}
    assert store.purge("ops/alerts", "run_id", ["a"]) == 2 and store.read("ops/alerts").count() == 1
    runs = spark.createDataFrame([("d", "r1", 1), ("d", "r2", 2)], "day string, run string, at int")
    assert latest(runs, ["day"], "at").first().run == "r2"


def test_csv_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,100.5,2,1,1,1700000000000,true,true\n2,101,1,2,2,1700000000000001,false,true\n")
    t = tape.read_trades(spark, {"x": str(tmp_path / "t.csv")})
    assert [r.event_us for r in t.orderBy("agg_trade_id").collect()] == [1_700_000_000_000_000, 1_700_000_000_000_001]
    assert tape.between(t, 1_700_000_000_000_000, 1_700_000_000_000_001).count() == 1
    (tmp_path / "k.csv").write_text("1700000000000,1,2,0.5,1.5,10,1700000059999,15,3,4,6,0\n")
    assert tape.read_klines(spark, "x", str(tmp_path / "k.csv")).first().trade_count == 3


def test_answers_and_status():
    calls = []
    log = lambda m, s, e: calls.append((m, s))

    def ask(model, evidence):
        if model == "a":
            raise ConnectionError("503")
        return {"summary": "ok"}

    assert briefing.answered(ask, ["a", "b"], {}, log, 3, wait_s=0) == {"summary": "ok"} and calls == [("a", "failed"), ("b", "ok")]
    assert briefing.briefing_status(0, 0, None) == "quiet" and briefing.briefing_status(1, 3, {}) == "awaiting_analyst" and briefing.briefing_status(1, 0, {}) == "written"


def test_bootstrap_needs_five(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(10)] + [("b", 1.0)], "k string, x double")
    got = {r.k: r for r in research.bootstrap_ci(rows, ["k"], "x", draws=200).collect()}
    assert got["b"].ci_lo is None and got["a"].ci_lo < 4.5 < got["a"].ci_hi


def test_daily_job(spark, tmp_path):
    from tapeloom.plans import daily

    store = Store(spark, str(tmp_path))
    base = int(datetime(2024, 1, 15).timestamp()) * SECOND
    rows = [("x", k, Decimal(100 + k % 9), Decimal(1), k, k, k % 2 == 0, base + k * SECOND * 3) for k in range(200)]
    load = lambda d: spark.createDataFrame(rows, "symbol string, agg_trade_id long, price decimal(18,8), quantity decimal(18,8), first_trade_id long, last_trade_id long, is_buyer_maker boolean, event_us long")
    profile = spark.createDataFrame([("x", h, 1.0, 0.001) for h in range(24)], "symbol string, hour int, volume_median double, ret_std double")
    book = rules.RuleBook.parse()
    assert daily.run_day(spark, store, date(2024, 1, 15), load, profile, book) == "completed"
    assert daily.run_day(spark, store, date(2024, 1, 15), load, profile, book) == "skipped"
    assert store.read("silver/bars").where("step_s = 1").count() == 200
    inc = store.read("ops/incidents").select("incident_no", "symbol", F.lit(None).cast("array<int>").alias("overlapping"))
    ask = lambda model, shown: {"summary": "calm", "notes": [{"incident_no": r["incident_no"], "note": "n"} for r in shown["incidents"]]}
    n = inc.count()
    assert briefing.catch_up(store, lambda run: inc, ask, ["m"], 0) == [(date(2024, 1, 15), "written" if n else "quiet")]
    assert briefing.catch_up(store, lambda run: inc, ask, ["m"], 0) == [] and store.read("gold/incident_briefs").count() == n
    one = spark.createDataFrame([(7, "x")], "incident_no int, symbol string")
    assert briefing.write_briefing(store, date(2024, 1, 14), "r", one, lambda m, e: {"summary": "", "notes": []}, ["m"], 0) == "awaiting_analyst"
    assert briefing.publish_research(store, spark.createDataFrame([("size", 5)], "section string, horizon int")) == 1
    assert briefing.publish_research(store, spark.createDataFrame([("size", 5)], "section string, horizon int")) == 2
    assert daily.purge_old(store, date(2024, 1, 30)) == 200 and daily.purge_old(store, date(2024, 1, 30)) == 0

    def gone(day):
        raise FileNotFoundError("no file")

    assert daily.run_day(spark, store, date(2024, 1, 16), gone, profile, book) == "source_missing"
    assert daily.run_days(lambda day, force: "completed", ["--date", "2024-01-16"]) == 0
    asked = []
    job = lambda day, force: asked.append((day.day, force)) or ("failed" if day.day == 12 else "skipped")
    assert daily.run_days(job, ["--force"], today=date(2024, 1, 16)) == 1 and asked == [(k, True) for k in range(9, 16)]


def test_daily_job_with_candles_and_rules(spark, tmp_path):
    """A day that fires: detection by the closing batch, features, events, counts, reconciliation, audit, study inputs."""
    import json

    from tapeloom.plans import daily

    store, day, base = Store(spark, str(tmp_path)), date(2024, 1, 15), int(datetime(2024, 1, 15).timestamp()) * SECOND
    price = lambda k: Decimal(100 if k < 700 else 130)
    rows = [("x", k, price(k), Decimal(1 if k < 700 else 9), k, k, k % 2 == 0, base + k * SECOND + 1000) for k in range(0, 2400) if not 706 <= k < 712]
    schema = "symbol string, agg_trade_id long, price decimal(18,8), quantity decimal(18,8), first_trade_id long, last_trade_id long, is_buyer_maker boolean, event_us long"
    trades = spark.createDataFrame(rows, schema)
    candles = B.trade_bars(trades, MINUTE).select("symbol", F.col("bar_us").alias("open_us"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count", (F.col("volume") - F.col("sell_volume")).cast("decimal(24,8)").alias("taker_buy_volume"))
    asked = []

    def candles_of(symbol, d):
        asked.append(d)
        back = (date(2024, 1, 15) - d).days * 86_400 * SECOND
        return candles.withColumn("open_us", F.col("open_us") - back).withColumn("close", (100 + F.pmod(F.floor(F.col("open_us") / MINUTE), F.lit(3)) * 0.01).cast("decimal(18,8)"))

    profile = lambda d: daily.profile_of(store, ["x"], d, candles_of)
    book = rules.RuleBook.parse()
    assert daily.run_day(spark, store, day, lambda d: trades, profile, book, candles=lambda d: candles) == "completed"
    assert len(asked) == 7 and store.read("reference/klines").select("day").distinct().count() == 8
    daily.load_candles(store, candles)
    audit = store.read("ops/daily_runs").first()
    assert audit.minutes_checked == audit.minutes_matching == 40 and audit.trades == len(rows) and audit.alerts == store.read("ops/alerts").count() > 0
    alerts = {r.rule: r for r in store.read("ops/alerts").collect()}
    emitted = {r.bar_us: r.emitted_us for r in store.read("silver/bars").where("step_s = 1").collect()}
    shock = alerts["price_shock"]
    assert shock.fired_us == base + 700 * SECOND and shock.detected_us == emitted[shock.fired_us] >= shock.fired_us + 11 * SECOND
    assert json.loads(shock.features)["ret_60"] == 0.3 and json.loads(shock.features)["ret_60_z"] is None
    inc = store.read("ops/incidents").first()
    assert inc.alert_count == sum(a.incident_no == 1 for a in alerts.values()) and inc.detected_us == shock.detected_us and inc.status == "resolved"
    log = {r.event: r for r in store.read("ops/incident_events").where("event <> 'alert_attached'").collect()}
    assert log["opened"].detected_us == shock.detected_us and log["resolved"].detected_us == emitted[log["resolved"].at_us] and log["resolved"].at_us == inc.resolved_us
    run = store.read("ops/rule_runs").first()
    assert run.rules_text == book.text and run.incidents == 1 and run.steps_evaluated == 2400
    state = daily.runs(store).first()
    assert state.status == "completed" and state.events_emitted == len(rows) and state.symbols == ["x"]
    briefing.mark_incidents(store, run.run_id, "analysed")
    assert store.read("ops/incidents").first().agent_status == "analysed" and not [p for p in tmp_path.iterdir() if p.name.startswith("_staged")]
    official = briefing.official_runs(store.read("ops/daily_runs"))
    assert research.of_official_runs(store.read("ops/alerts"), official).where(F.col("trade_date") == F.lit(day)).count() == len(alerts)
    with pytest.raises(ValueError):
        store.append("ops/alerts", spark.createDataFrame([("r", 1)], "run_id string, unheard_of int"))


@pytest.mark.parametrize("block", [200, 14_400])
def test_blocks_change_nothing(spark, block):
    """Grids, known times and features by blocks, against one pass over each symbol's rows."""
    rng = random.Random(3)
    at = {s: sorted(rng.sample(range(50, 1500), 60)) for s in "xy"}
    at["y"] = [t + 700 for t in at["y"]]
    rows = [(s, t * SECOND, Decimal(100 + t % 17), Decimal(t % 5), Decimal(t % 3), (t + rng.randint(1, 9)) * SECOND) for s in at for t in at[s]]
    bars = spark.createDataFrame(rows, "symbol string, bar_us long, close decimal(18,8), volume decimal(24,8), sell_volume decimal(24,8), emitted_us long").cache()
    grid = X.dense_grid(bars, SECOND, block=block)
    known = {}
    for r in rows:
        known[r[1]] = min(known.get(r[1], r[5]), r[5])
    horizon, want = max(r[1] for r in rows), []
    for s in at:
        close = None
        for t in range(at[s][0], horizon // SECOND + 1):
            own = next((r for r in rows if r[0] == s and r[1] == t * SECOND), None)
            close = float(own[2]) if own else close
            want.append((s, t * SECOND, close, float(own[3]) if own else 0.0, known[min(k for k in known if k >= t * SECOND)]))
    got = X.known_at(grid, bars, SECOND, block).collect()
    assert sorted((r.symbol, r.bar_us, r.close, float(r.volume), r.known_us) for r in got) == sorted(want)
    profile = spark.createDataFrame([("x", 0, 1.0, 0.01)], "symbol string, hour int, volume_median double, ret_std double")
    by = {}
    for s, t, c, v, _ in want:
        by.setdefault(s, []).append((t, c, v))
    for r in X.features(grid, profile, SECOND, block).collect():
        i = (r.bar_us - by[r.symbol][0][0]) // SECOND
        series = by[r.symbol]
        assert r.vol_120 == (sum(x[2] for x in series[i - 119 : i + 1]) if i >= 119 else None)
        assert r.ret_60 == (pytest.approx(series[i][1] / series[i - 60][1] - 1) if i >= 60 else None)


def test_long_medians_by_blocks(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"symbol": "x", "bar_us": np.arange(5000) * SECOND, "ret_60": rng.normal(size=5000), "vol_60": rng.random(5000), "vol_120": rng.random(5000)})
    got = X.rolling_features(spark.createDataFrame(pdf), 300, 100, SECOND, 420).toPandas().sort_values("bar_us")
    want = pdf["vol_120"] / pdf["vol_120"].rolling(300, min_periods=100).median().shift(120)
    np.testing.assert_allclose(got["vol_120_ratio"].astype(float), want, rtol=1e-12)
    z = pdf["ret_60"] / pdf["ret_60"].rolling(300, min_periods=100).std().shift(60)
    np.testing.assert_allclose(got["ret_60_z"].astype(float), z, rtol=1e-8)


def test_interval_joins(spark):
    from tapeloom.operators import intervals

    rng = random.Random(1)
    spans = [(k, rng.choice("xy"), a, a + rng.choice([-1, 0, 5, 30, 200])) for k, a in enumerate(rng.choices(range(-50, 300), k=60))]
    points = [(rng.choice("xy"), t) for t in rng.choices(range(-60, 520), k=200)]
    s, p = spark.createDataFrame(spans, "k int, symbol string, a long, b long"), spark.createDataFrame(points, "symbol string, t long")
    got = sorted((r.k, r.symbol, r.t) for r in intervals.within(s, p, "a", "b", "t", ["symbol"], 40).collect())
    assert got == sorted((k, x, t) for k, x, a, b in spans for y, t in points if x == y and a <= t <= b)
    left = s.where("a <= b").selectExpr("k", "a as l_start", "b as l_end")
    got = sorted((r.k, r.k2) for r in intervals.overlapping(left, left.selectExpr("k as k2", "l_start as r_start", "l_end as r_end"), 40).collect())
    assert got == sorted((k, m) for k, _, a, b in spans for m, _, c, d in spans if a <= b and c <= d and a <= d and c <= b)


def test_bootstrap_is_near_resampling_and_agrees_on_reruns(spark):
    import numpy as np

    x = np.random.default_rng(1).gamma(2.0, size=400)
    rows = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("b", k, None) for k in range(9)], "k string, id int, x double")
    ci = lambda parts: {r.k: (r.ci_lo, r.ci_hi) for r in research.bootstrap_ci(rows.repartition(parts), ["k"], "x", 2000, row_id="id").collect()}
    one = ci(1)
    rng = np.random.default_rng(2)
    lo, hi = np.percentile([rng.choice(x, len(x)).mean() for _ in range(2000)], [2.5, 97.5])
    assert abs(one["a"][0] - lo) < 0.03 and abs(one["a"][1] - hi) < 0.03 and one["b"] == (None, None)
    again = ci(5)
    assert one["a"] == pytest.approx(again["a"]) and again["b"] == (None, None)


def test_stream_bars_equal_batch(spark, tmp_path):
    from tapeloom.streaming import live

    b = batches_of(spark, [[100], [95.5, 97.5, 98.5, 200], [150.5, 300], [301], [9000]])
    live.write_batches(b, str(tmp_path / "in"))
    live.run_to_table(live.stream_bars(live.trade_stream(spark, str(tmp_path / "in")), 2, 1), "streamed", str(tmp_path / "cp"))
    got = {r.bar_us // SECOND: r.trade_count for r in spark.table("streamed").collect()}
    want = {r.bar_us // SECOND: r.trade_count for r in B.base_bars(b, 2, SECOND).collect()}
    assert got == {k: v for k, v in want.items() if k < 9000}


def test_stream_alerts(spark, tmp_path):
    from tapeloom.streaming import live

    for k, ts in enumerate(([0, 60], [121, 300])):
        spark.createDataFrame([("x", "r", t * SECOND, True) for t in ts], "symbol string, rule string, t_us long, is_true boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("symbol string, rule string, t_us long, is_true boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_to_table(live.stream_alerts(s), "fired", str(tmp_path / "cp"))
    assert {r.fired_us // SECOND for r in spark.table("fired").collect()} == {0, 121, 300}


def test_incident_lists_a_rule_once(spark):
    inc = spark.createDataFrame([(1, 100)], "incident_no int, opened_us long")
    rows = [(1, "b", 1, 90), (1, "a", 0, 100), (1, "b", 1, 120), (1, "c", 2, 130), (1, "a", 0, 140)]
    hit = spark.createDataFrame(rows, "incident_no int, rule string, place int, fired_us long")
    assert rules.rules_of_incidents(inc, hit).collect()[0].rules == ["b", "a", "c"]


def test_daily_profiles_equal_one_day_at_a_time(spark):
    day = 86_400_000_000
    rows = [("s", d * day + h * 3_600_000_000, 100.0 + d * h % 7, float(1 + (d * 5 + h) % 9)) for d in range(20, 33) for h in range(0, 24, 5)]
    candles = spark.createDataFrame(rows, "symbol string, bar_us long, close double, volume double")
    got = {(r.day, r.hour): (r.days, r.bars, r.volume_median) for r in X.daily_profiles(candles, 27 * day, 33 * day).collect()}
    want = {(d, r.hour): (r.days, r.bars, r.volume_median) for d in range(27, 33) for r in X.hour_profile(candles, (d - 7) * day, d * day).collect()}
    assert got == want
