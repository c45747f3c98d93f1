"""Briefings and run bookkeeping: validation of answers, scope, summaries, official runs, retention, catch-up."""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store, latest

#: Calls to a model a day, failed ones included.
CALLS_A_DAY = 3
TERMINAL = ("written", "quiet")


def validated(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """answers (briefing_id, noted array<int>) against expected (briefing_id, incidents array<int>): incident numbers that
    are unknown, missing or noted twice."""
    j = expected.join(answers, "briefing_id", "left").withColumn("noted", F.coalesce("noted", F.array().cast("array<int>")))
    twice = F.array_distinct(F.filter("noted", lambda x: F.size(F.filter("noted", lambda y: y == x)) > 1))
    return j.select("briefing_id", F.array_sort(F.array_except("noted", "incidents")).alias("unknown"), F.array_sort(F.array_except("incidents", "noted")).alias("missing"), F.array_sort(twice).alias("duplicate"))


def scope(overlapping: Column) -> Column:
    return F.when(F.size(overlapping) > 0, "market_wide").otherwise("single_asset")


def quiet_summary(days: DataFrame) -> DataFrame:
    """days (trade_date, symbols, incidents, alerts): the text for days without incidents, or with deferred ones."""
    names = F.array_join("symbols", ", ")
    quiet = F.format_string("No incidents on %s for %s; %d context alerts.", F.col("trade_date").cast("string"), names, F.col("alerts"))
    deferred = F.format_string("%d incidents on %s for %s await an analyst.", F.col("incidents"), F.col("trade_date").cast("string"), names)
    return days.select("trade_date", F.when(F.col("incidents") == 0, quiet).otherwise(deferred).alias("summary"))


def official_runs(daily_runs: DataFrame) -> DataFrame:
    """(trade_date, run_id, finished_at): the latest completed run of each day."""
    return latest(daily_runs.where("status = 'completed'").select("trade_date", "run_id", "finished_at"), ["trade_date"], "finished_at").select("trade_date", "run_id", "finished_at")


def retention_candidates(runs: DataFrame, today: date, days: int = 7) -> DataFrame:
    return runs.where((F.col("trade_date") < F.date_sub(F.lit(today), days)) & F.col("bronze_purged_at").isNull())


def without_briefing(official: DataFrame, briefings: DataFrame) -> DataFrame:
    """Official runs, newest first, whose latest briefing is not final. Keyed by day and run, so a rerun is briefed anew."""
    last = latest(briefings.select("trade_date", "run_id", "status", "created_at"), ["trade_date", "run_id"], "created_at").where(F.col("status").isin(*TERMINAL))
    return official.join(last, ["trade_date", "run_id"], "left_anti").orderBy(F.col("trade_date").desc())


def answered(ask: Callable[[str, dict], dict], models: list[str], evidence: dict, log: Callable[[str, str, str | None], None], calls_left: int, retries: int = 2, wait_s: float = 1.0) -> dict | None:
    """The first model's valid answer; each failed attempt is logged and counts. ask raises ConnectionError for what may
    be tried again."""
    for model in models[: max(0, calls_left)]:
        for attempt in range(retries + 1):
            try:
                out = ask(model, evidence)
                log(model, "ok", None)
                return out
            except ConnectionError as e:
                if attempt == retries:
                    log(model, "failed", str(e)[:500])
                else:
                    time.sleep(wait_s * 2**attempt)
            except ValueError as e:
                log(model, "failed", str(e)[:500])
                break
    return None


def briefing_status(incidents: int, calls_today: int, answer: dict | None) -> str:
    """quiet without incidents; written with an answer; else it waits for an analyst."""
    if incidents == 0:
        return "quiet"
    return "written" if answer is not None and calls_today < CALLS_A_DAY else "awaiting_analyst"


def problems(noted: list[int], expected: list[int]) -> list[str]:
    """What validated() finds, for one answer on the driver."""
    out = [f"unknown incident {n}" for n in sorted(set(noted) - set(expected))]
    out += [f"missing incident {n}" for n in sorted(set(expected) - set(noted))]
    return out + [f"incident {n} noted twice" for n, k in sorted(Counter(noted).items()) if k > 1]


def mark_incidents(store: Store, run_id: str, status: str) -> None:
    """What an analyst has done with the incidents of a run."""
    rows = store.read("ops/incidents").where(F.col("run_id") == run_id).withColumn("agent_status", F.lit(status))
    store.upsert("ops/incidents", rows, ["run_id", "incident_no"])


def write_briefing(store: Store, day: date, run_id: str, evidence: DataFrame, ask: Callable[[str, dict], dict], models: list[str], wait_s: float = 1.0) -> str:
    """Stores the briefing of a run and the notes on its incidents; returns its status. evidence has one row an incident of
    the day, which is what a model is shown."""
    spark, shown = store.spark, [json.loads(x) for x in evidence.toJSON().collect()]
    expected = [r["incident_no"] for r in shown]
    calls = store.read("ops/llm_calls").where(F.to_date("called_at") == F.current_date()).count()

    def log(model: str, status: str, error: str | None) -> None:
        store.append("ops/llm_calls", spark.createDataFrame([(datetime.now(), day, model, status, error)], "called_at timestamp, trade_date date, model string, status string, error string"))

    def checked(model: str, what: dict) -> dict:
        answer = ask(model, what)
        if found := problems([n["incident_no"] for n in answer.get("notes", [])], expected):
            raise ValueError("; ".join(found))
        return answer

    answer = answered(checked, models, {"trade_date": day.isoformat(), "incidents": shown}, log, CALLS_A_DAY - calls, wait_s=wait_s) if shown else None
    status = briefing_status(len(shown), calls, answer)
    text = answer["summary"] if status == "written" else f"{len(shown)} incidents on {day}" + ("" if status == "quiet" else ", waiting for an analyst")
    row = (day, run_id, status, text, json.dumps(shown), datetime.now())
    store.append("gold/daily_briefings", spark.createDataFrame([row], "trade_date date, run_id string, status string, summary string, evidence string, created_at timestamp"))
    if shown:
        mark_incidents(store, run_id, "analysed" if status == "written" else "awaiting_analyst")
    if status == "written":
        wide = {r["incident_no"]: "market_wide" if r.get("overlapping") else "single_asset" for r in shown}
        notes = [(run_id, n["incident_no"], n.get("headline", ""), n.get("note", ""), wide[n["incident_no"]]) for n in answer.get("notes", [])]
        store.replace("gold/incident_briefs", spark.createDataFrame(notes, "run_id string, incident_no long, headline string, note string, scope string"))
    return status


def catch_up(store: Store, evidence_of: Callable[[str], DataFrame], ask: Callable[[str, dict], dict], models: list[str], wait_s: float = 1.0) -> list[tuple[date, str]]:
    """Briefs official runs that lack a final briefing, newest first, and stops at the first that must wait."""
    done = []
    for r in without_briefing(official_runs(store.read("ops/daily_runs")), store.read("gold/daily_briefings")).collect():
        done.append((r.trade_date, write_briefing(store, r.trade_date, r.run_id, evidence_of(r.run_id), ask, models, wait_s)))
        if done[-1][1] not in TERMINAL:
            break
    return done


def publish_research(store: Store, rows: DataFrame) -> int:
    """Appends a study as the next version of the snapshot table."""
    last = store.read("gold/signal_research").agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    store.append("gold/signal_research", rows.withColumn("version", F.lit(version)))
    return version
