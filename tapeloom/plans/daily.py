"""The daily batch: bronze, silver, rules and evidence of one day, with an audit row and idempotent writes."""

from __future__ import annotations

import argparse
import secrets
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MINUTE, SECOND
from ..operators import bars as B
from ..operators import features as X
from ..operators import replay, rules
from ..sources.stage import staged
from ..sources.store import Store, latest
from ..sources.tape import missing_days
from .briefing import official_runs, retention_candidates


def new_run_id(now: datetime | None = None) -> str:
    return f"{(now or datetime.now(UTC)):%Y%m%dT%H%M%S}-{secrets.token_hex(3)}"


def _micros(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp()) * SECOND


def register(store: Store, run_id: str, day: date, status: str, purged_at: datetime | None = None, events: int | None = None, sim_us: int | None = None, symbols: list[str] | None = None) -> None:
    """A row a change of a run's state, its heartbeats included; the latest one counts."""
    row = (run_id, day, status, datetime.now(), purged_at, events, sim_us, symbols)
    store.append("bronze/replay_runs", store.spark.createDataFrame([row], "run_id string, trade_date date, status string, written_at timestamp, bronze_purged_at timestamp, events_emitted long, sim_us long, symbols array<string>"))


def runs(store: Store) -> DataFrame:
    return latest(store.read("bronze/replay_runs"), ["run_id"], "written_at")


def load_candles(store: Store, candles: DataFrame) -> None:
    """Official candles (read_klines) into the candle table; the symbols' days that they bring are replaced whole."""
    us = F.col("open_us")
    store.replace("reference/klines", candles.select(F.to_date(F.timestamp_micros(us)).alias("day"), us.alias("bar_us"), *[c for c in candles.columns if c != "open_us"]))


def profile_of(store: Store, symbols: list[str], day: date, candles_of: Callable[[str, date], DataFrame], back: int = 7) -> DataFrame:
    """The hour-of-day profile for scoring a day from the days before it. Days that the candle table lacks are loaded
    first; that list is of symbols times back at most."""
    for r in missing_days(store.read("reference/klines").select("symbol", "day"), symbols, day, back).collect():
        load_candles(store, candles_of(r.symbol, r.day))
    own = store.read("reference/klines").where(F.col("symbol").isin(symbols) & F.col("day").between(F.lit(day - timedelta(days=back)), F.lit(day - timedelta(days=1))))
    return X.hour_profile(own, _micros(day - timedelta(days=back)), _micros(day))


def reconcile(store: Store, run_id: str, lateness_s: float) -> DataFrame:
    """A run's minute bars against the candle table: counts of equal bars."""
    minutes = store.read("silver/bars").where((F.col("run_id") == run_id) & (F.col("lateness_s") == lateness_s) & (F.col("step_s") == 60))
    official = store.read("reference/klines").withColumn("sell_volume", (F.col("volume") - F.col("taker_buy_volume")).cast("decimal(24,8)"))
    return X.reconciled(minutes, official)


def evaluate(store: Store, run_id: str, lateness_s: float, profile: DataFrame, book: rules.RuleBook) -> tuple[int, int]:
    """Alerts, incidents, their events and the evaluation itself of a run's second bars; counts of alerts and incidents.
    Rows of an earlier evaluation of the run are replaced. The rules' text is stored with the evaluation."""
    began, mine = datetime.now(), {"run_id": F.lit(run_id)}
    bars = store.read("silver/bars").where((F.col("run_id") == run_id) & (F.col("lateness_s") == lateness_s) & (F.col("step_s") == 1))
    grid = X.dense_grid(bars, SECOND)
    featured = staged(X.known_at(X.features(grid, profile), bars, SECOND), "features")
    steps, horizon = featured.agg(F.count(F.lit(1)), F.max("bar_us")).first()
    found = staged(rules.alerts(rules.conditions(featured, book), horizon or 0), "alerts")
    inc = staged(rules.incidents(found, book, horizon or 0), "incidents")
    linked = staged(rules.with_features(rules.attached(found, inc, book), featured), "linked")
    store.replace("ops/alerts", linked.withColumns(mine))
    seen = rules.extremes(inc, linked, featured).join(rules.rules_of_incidents(inc, linked), "incident_no", "left").join(rules.alert_counts(linked), "incident_no", "left")
    observed = F.to_json(F.struct("price_at_open", "price_low", "price_high", "price_last", "max_abs_ret_60_ref_z", "max_vol_60_ref_ratio", "max_sell_share", "min_sell_share"), {"ignoreNullFields": "false"})
    rows = seen.withColumns(mine | {"observed": observed, "agent_status": F.lit("pending")})
    store.replace("ops/incidents", rows.select(*[c for c in store.columns("ops/incidents") if c in rows.columns]))
    store.replace("ops/incident_events", rules.event_log(inc, linked, featured).withColumns(mine))
    counts = (linked.count(), inc.count())
    row = (run_id, float(lateness_s), began, datetime.now(), "offline", steps, *counts, book.text)
    store.replace("ops/rule_runs", store.spark.createDataFrame([row], "run_id string, lateness_s double, started_at timestamp, finished_at timestamp, mode string, steps_evaluated long, alerts long, incidents long, rules_text string"))
    return counts


def run_day(spark: SparkSession, store: Store, day: date, load: Callable[[date], DataFrame], profile: DataFrame | Callable[[date], DataFrame], book: rules.RuleBook, lateness_s: float = 10.0, tick_s: float = 10.0, force: bool = False, candles: Callable[[date], DataFrame] | None = None) -> str:
    """completed, skipped (an official run exists), source_missing or failed; reason and counts go to the audit row. With
    candles, the day's official ones are loaded and the run's minutes are checked against them."""
    if not force and official_runs(store.read("ops/daily_runs")).where(F.col("trade_date") == F.lit(day)).take(1):
        return "skipped"
    run_id, status, detail, facts = new_run_id(), "completed", None, {}
    register(store, run_id, day, "running")
    try:
        trades = load(day)
        batches = replay.batched(replay.arrivals(trades, late_permille=0), tick_s)
        store.replace("bronze/trade_events", batches.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ingested_at"), *[c for c in store.columns("bronze/trade_events") if c in batches.columns]))
        landed = store.read("bronze/trade_events").where(F.col("run_id") == run_id)
        sent = replay.delivery(trades, landed).first()
        detail = None if sent.ok else f"emitted {sent.emitted}, landed {sent.landed}, distinct {sent.distinct_rows}"
        clock, symbols = landed.agg(F.max("arrival_us"), F.array_sort(F.collect_set("symbol"))).first()
        register(store, run_id, day, "running", events=sent.emitted, sim_us=clock, symbols=symbols)
        batches = replay.batched(landed.drop("batch_id"), tick_s)
        base = staged(B.base_bars(batches, lateness_s, SECOND), "base")
        minutes = B.rolled_up(base, batches, lateness_s, MINUTE)
        for step, rows in ((1, base), (60, minutes.drop("vwap", "active_bars"))):
            store.replace("silver/bars", rows.withColumns({"run_id": F.lit(run_id), "lateness_s": F.lit(lateness_s), "step_s": F.lit(step)}))
        late = B.late_trades(batches, lateness_s, SECOND).withColumns({"run_id": F.lit(run_id), "lateness_s": F.lit(lateness_s)})
        store.replace("silver/late_trades", late.select(*store.columns("silver/late_trades")))
        accepted, dropped, _ = B.build_stats(batches, lateness_s, SECOND).first()
        build = (run_id, float(lateness_s), datetime.now(), accepted, dropped)
        store.replace("silver/builds", spark.createDataFrame([build], "run_id string, lateness_s double, built_at timestamp, trades_accepted long, trades_dropped long"))
        facts = {"trades": sent.emitted}
        facts["alerts"], facts["incidents"] = evaluate(store, run_id, lateness_s, profile(day) if callable(profile) else profile, book)
        if candles is not None:
            load_candles(store, candles(day))
            check = reconcile(store, run_id, lateness_s).first()
            facts |= {"minutes_checked": check.bars, "minutes_matching": check.all_equal}
        facts["bronze_rows_purged"] = purge_old(store, day)
        register(store, run_id, day, "completed", events=sent.emitted, sim_us=clock, symbols=symbols)
    except Exception as e:  # the audit row must tell; the next day's job goes on
        missing = isinstance(e, FileNotFoundError) or (isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND")
        status, detail = ("source_missing", str(e)[:500]) if missing else ("failed", str(e)[-2000:])
        register(store, run_id, day, status)
    kinds = "trade_date date, run_id string, status string, finished_at timestamp, detail string, trades long, alerts long, incidents long, minutes_checked long, minutes_matching long, bronze_rows_purged long"
    values = [facts.get(c.split()[0]) for c in kinds.split(", ")[5:]]
    store.append("ops/daily_runs", spark.createDataFrame([(day, run_id, status, datetime.now(), detail, *values)], kinds))
    return status


def due_days(today: date, heal: int = 7, first: date | None = None) -> list[date]:
    """Yesterday and the days before it that a missed run left out."""
    days = [today - timedelta(days=k) for k in range(heal, 0, -1)]
    return [d for d in days if first is None or d >= first]


def purge_old(store: Store, today: date, days: int = 7) -> int:
    """Drops raw trades of runs past retention and stamps those runs; returns the rows gone. One row a run is read."""
    old = retention_candidates(runs(store), today, days).select("run_id", "trade_date", "status", "events_emitted", "sim_us", "symbols").collect()
    gone = store.purge("bronze/trade_events", "run_id", [r.run_id for r in old]) if old else 0
    for r in old:
        register(store, r.run_id, r.trade_date, r.status, datetime.now(), r.events_emitted, r.sim_us, r.symbols)
    return gone


def run_days(job: Callable[[date, bool], str], argv: list[str], brief: Callable[[], list[tuple[date, str]]] | None = None, today: date | None = None) -> int:
    """The scheduled job's command line: --date (default: yesterday), --days (default: one with --date, else a week, so that
    missed days fill in), --force, --no-briefing. job runs a day; 0 where every day is done, else 1."""
    p = argparse.ArgumentParser(description=run_days.__doc__)
    p.add_argument("--date", type=date.fromisoformat)
    p.add_argument("--days", type=int)
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-briefing", action="store_true")
    a = p.parse_args(argv)
    last = a.date or (today or datetime.now(UTC).date()) - timedelta(days=1)
    days = due_days(last + timedelta(days=1), a.days or (1 if a.date else 7))
    done = {day: job(day, a.force) for day in days}
    notes = [] if a.no_briefing or brief is None else brief()
    print("days: " + ", ".join(f"{d} {s}" for d, s in done.items()) + ("; briefings: " + ", ".join(f"{d} {s}" for d, s in notes) if notes else ""))
    return 0 if all(s in ("completed", "skipped") for s in done.values()) else 1
