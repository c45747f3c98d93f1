"""Streams against the batch form of the same tape: bars of both sizes, late trades, alerts, incidents, flushes and runs."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.columns import MINUTE, SECOND
from tapeloom.operators import bars as B
from tapeloom.operators import rules
from tapeloom.sources.store import Store
from tapeloom.streaming import live, stateful

T0 = 1_704_067_200 * SECOND
TRADE = "batch_id long, clock_us long, symbol string, agg_trade_id long, price decimal(18,8), quantity decimal(18,8), is_buyer_maker boolean, event_us long, arrival_us long"


def tape(spark, seed, n_batches=10):
    """Batches with late trades of two symbols, some on the very border of a bar."""
    rng, rows, now, n = random.Random(seed), [], 40_000, 0
    for b in range(n_batches):
        now += rng.choice([300, 2_000, 9_000, 31_000])
        for _ in range(rng.randint(1, 9)):
            ms = max(0, now - rng.choice([0, 0, 0, 500, 4_000, 5_000, 15_000, 40_000]) - rng.randint(0, 900) * rng.randint(0, 1))
            rows.append((b, T0 + (now + 1000) * 1000, rng.choice("xy"), n, Decimal(rng.randint(10_000, 99_999)) / 100, Decimal(rng.randint(1, 9_999)) / 1000, rng.random() < 0.5, T0 + ms * 1000, T0 + now * 1000))
            n += 1
    rows.append((n_batches, T0 + (now + 2000) * 1000, "x", n, Decimal(5), Decimal(1), True, T0 + (now // 1000) * 1_000_000, T0 + now * 1000))
    return spark.createDataFrame(rows, TRADE)


BARS = ("symbol", "bar_us", "open", "high", "low", "close", "volume", "quote_volume", "sell_volume", "trade_count")


@pytest.mark.parametrize("seed, lateness", [(0, 2.0), (1, 3.0), (2, 0.0)])
def test_tape_equals_batch(spark, tmp_path, seed, lateness):
    b = tape(spark, seed).cache()
    live.write_batches(b, str(tmp_path / "in"))
    live.close_tape(b, str(tmp_path / "in"), lateness, MINUTE)
    first = live.first_bar(b, MINUTE)
    out = stateful.stream_tape(live.trade_stream(spark, str(tmp_path / "in")), lateness, SECOND, MINUTE, first)
    live.run_to_table(out, f"tape_{seed}", str(tmp_path / "cp"))
    got = spark.table(f"tape_{seed}").cache()
    base = B.base_bars(b, lateness, SECOND)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(got.where("kind = 'bar'"), *BARS) == rows(base, *BARS)
    larger = (*BARS, "active_bars", "vwap")
    assert rows(got.where("kind = 'larger'"), *larger) == rows(B.rolled_up(base, b, lateness, MINUTE), *larger)
    late = ("symbol", "agg_trade_id", "quantity", "event_us", "arrival_us", "watermark_us")
    want = rows(B.late_trades(b, lateness, SECOND), *late)
    assert rows(got.where("kind = 'late'"), *late) == want and want


CONDITION = "symbol string, t_us long, rule string, place int, clear_us long, opens boolean, severity string, known_us long"
KINDS = {"shock": (0, 60, True, "high"), "burst": (1, 30, False, "medium"), "flow": (2, 45, True, "low")}


@pytest.mark.parametrize("seed", range(3))
def test_incidents_equal_batch(spark, tmp_path, seed):
    rng, rows = random.Random(seed), []
    for symbol in "xy":
        for rule, (place, clear, opens, severity) in KINDS.items():
            t = 0
            while t < 20_000:
                t += rng.choice([1, 1, 30, 45, 60, 61, 400, 959, 960, 961, 1500, 2500, 4000])
                rows.append((symbol, T0 + t * SECOND, rule, place, clear * SECOND, opens, severity, T0 + (t + rng.randint(1, 15)) * SECOND))
    horizon = T0 + (20_000 + rng.choice([0, 500, 4000])) * SECOND
    rows = [r for r in rows if r[1] <= horizon]
    df = spark.createDataFrame(rows, CONDITION).cache()
    book = rules.RuleBook((), 900, 300, "")
    alerts = rules.alerts(df, horizon)
    inc = rules.incidents(alerts, book, horizon)
    linked = rules.attached(alerts, inc, book)

    # batches out of order within themselves, in order between them
    for k in range(7):
        part = df.where((F.col("t_us") > T0 + (k * 4000 - 4000) * SECOND) & (F.col("t_us") <= T0 + k * 4000 * SECOND)).withColumn("closing", F.lit(False))
        part.orderBy(F.rand(seed)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ends = df.select("symbol").distinct().select("symbol", F.lit(horizon).alias("t_us"), F.lit("").alias("rule"), F.lit(-1).alias("place"), F.lit(0).cast("long").alias("clear_us"), F.lit(False).alias("opens"), F.lit("").alias("severity"), F.lit(None).cast("long").alias("known_us"), F.lit(True).alias("closing"))
    ends.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CONDITION + ", closing boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = []
    out = stateful.stream_incidents(stream, SECOND, 900, 300)
    q = out.writeStream.foreachBatch(lambda rows, k: changes.extend((k, n, r) for n, r in enumerate(rows.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for _, _, r in changes:
        last[(r.kind, r.symbol, r.rule, r.fired_us, r.opened_us)] = r
    got = sorted((r.symbol, r.opened_us, r.last_active_us, r.detected_us, r.opening_alerts, r.resolved_us, r.status) for r in last.values() if r.kind == "incident")
    want = sorted((r.symbol, r.opened_us, r.last_active_us, r.detected_us, r.opening_alerts, r.resolved_us, r.status) for r in inc.collect())
    assert got == want and len(want) > 4
    opened = {r.incident_no: r.opened_us for r in inc.collect()}
    got = sorted((r.symbol, r.rule, r.fired_us, r.detected_us, r.cleared_us or 0, r.incident_us or 0) for r in last.values() if r.kind == "alert")
    assert got == sorted((r.symbol, r.rule, r.fired_us, r.detected_us, r.cleared_us or 0, opened.get(r.incident_no, 0)) for r in linked.collect())


def bursts(closed):
    """Conditions on bars: a step with at least two trades."""
    known = F.col("bar_us") + SECOND
    return closed.where("trade_count >= 2").select("symbol", F.col("bar_us").alias("t_us"), F.lit("burst").alias("rule"), F.lit(0).alias("place"), F.lit(5 * SECOND).alias("clear_us"), F.lit(True).alias("opens"), F.lit("high").alias("severity"), known.alias("known_us"), F.lit(False).alias("closing"))


def test_live_run_to_its_end(spark, tmp_path):
    b = tape(spark, 0).cache()
    folder, said = str(tmp_path / "in"), []
    live.write_batches(b, folder)
    store = Store(spark, str(tmp_path / "store"))
    write_run = lambda status, events, sim_us, detail: said.append((status, events, sim_us))
    args = (spark, store, "r", folder, str(tmp_path / "cp"), bursts, write_run, live.first_bar(b, MINUTE))
    run = live.start_live(*args, lateness_s=2.0, trigger_s=0.1, beat_s=0.0)
    run.queries[0].processAllAvailable()
    assert not run.wait(1)  # no closing row yet
    run.stop()
    n, clock = b.count(), b.agg(F.max("arrival_us")).first()[0]
    assert said[0][0] == "running" and said[-1] == ("interrupted", n, clock)
    before = store.read("live/bars").where("step_s = 1").count()
    live.close_tape(b, folder, 2.0, MINUTE)
    run = live.start_live(*args, lateness_s=2.0, trigger_s=0.1, beat_s=0.0)
    assert run.wait(60)
    for q in run.queries:
        q.processAllAvailable()
    run.stop()
    assert said[-1][0] == "completed"
    base = B.base_bars(b, 2.0, SECOND)
    bars = store.read("live/bars")
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(bars.where("step_s = 1"), *BARS) == rows(base, *BARS) and 0 < before < base.count()
    assert rows(bars.where("step_s = 60"), *BARS, "vwap") == rows(B.rolled_up(base, b, 2.0, MINUTE), *BARS, "vwap")
    assert store.read("live/late_trades").count() == B.late_trades(b, 2.0, SECOND).count()
    horizon = base.agg(F.max("bar_us")).first()[0]
    alerts = rules.alerts(bursts(base).drop("closing"), horizon, SECOND)
    got = live.current(store, "live/alerts", live.ALERT_KEY)
    assert rows(got, "symbol", "fired_us", "detected_us") == rows(alerts, "symbol", "fired_us", "detected_us") and got.count() > 1
    kept = ("symbol", "opened_us", "last_active_us", "opening_alerts", "status")
    assert rows(live.current(store, "live/incidents", live.INCIDENT_KEY), *kept) == rows(rules.incidents(alerts, rules.RuleBook((), 900, 300, ""), horizon), *kept)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    write = live.flush_rules(store, "r")
    row = lambda fired, cleared, opened=None: ("alert" if opened is None else "incident", "x", "shock", "high", 0, True, fired, cleared, None, opened, opened, opened, 1, None, "open")
    batch = lambda *rows: spark.createDataFrame(list(rows), stateful.RULES_OUT).coalesce(1)
    first, second = batch(row(1, None), row(5, None), row(5, 9), row(None, None, 3)), batch(row(1, 7))
    state = lambda: sorted((r.fired_us, r.cleared_us) for r in live.current(store, "live/alerts", live.ALERT_KEY).collect())
    write(first, 0)
    assert state() == [(1, None), (5, 9)]
    write(second, 1)
    once = state()
    write(second, 1)
    write(first, 0)
    assert state() == once == [(1, 7), (5, 9)] and live.current(store, "live/incidents", live.INCIDENT_KEY).count() == 1
    tape_rows = spark.createDataFrame([("late", "x", 1)], "kind string, symbol string, event_us long")
    wide = spark.createDataFrame([], stateful.TAPE_OUT).unionByName(tape_rows, allowMissingColumns=True)
    for _ in range(2):
        live.flush_tape(store, "r", 2.0, SECOND, MINUTE)(wide, 4)
    assert store.read("live/late_trades").count() == 1 and store.read("live/bars").count() == 0
