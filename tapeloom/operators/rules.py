"""Configured rules over features: alert episodes, incidents and their events, as windows instead of a state machine."""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DAY, SECOND, rounded
from .intervals import within

#: The shipped rules.
DEFAULT_RULES = """
features: {baseline_window_s: 1800, warmup_s: 600}
rules:
  price_shock: {condition: abs(ret_60_ref_z) > 10, severity: high, clear_after_s: 60}
  volume_burst: {condition: vol_60_ref_ratio > 20, severity: medium, clear_after_s: 60, opens_incident: false}
  one_sided_flow: {condition: (sell_share_120 > 0.8 or sell_share_120 < 0.2) and vol_120_ref_ratio > 10, severity: medium, clear_after_s: 60, opens_incident: false}
incidents: {resolve_after_s: 900, context_lookback_s: 300}
"""


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    severity: str
    clear_after_s: int
    opens: bool
    place: int


@dataclass(frozen=True)
class RuleBook:
    rules: tuple[Rule, ...]
    resolve_after_s: int
    lookback_s: int
    text: str

    @classmethod
    def parse(cls, text: str = DEFAULT_RULES) -> "RuleBook":
        """The text itself is kept, as it is stored with every evaluation."""
        c = yaml.safe_load(text)
        rules = tuple(Rule(name, r["condition"], r["severity"], int(r["clear_after_s"]), bool(r.get("opens_incident", True)), k) for k, (name, r) in enumerate(c["rules"].items()))
        return cls(rules, int(c["incidents"]["resolve_after_s"]), int(c["incidents"]["context_lookback_s"]), text)


def conditions(featured: DataFrame, book: RuleBook) -> DataFrame:
    """(symbol, t_us, rule, place, clear_us, opens, severity) of every true rule, with known_us where the features have it;
    an unknown condition is not true."""
    fired = F.array(*[
        F.when(F.coalesce(F.expr(r.condition), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.place).alias("place"), F.lit(r.clear_after_s * SECOND).alias("clear_us"), F.lit(r.opens).alias("opens"), F.lit(r.severity).alias("severity")))
        for r in book.rules
    ])
    known = [c for c in ("known_us",) if c in featured.columns]
    return featured.select("symbol", F.col("bar_us").alias("t_us"), *known, F.explode(F.array_compact(fired)).alias("r")).select("symbol", "t_us", *known, "r.*")


def alerts(true_rows: DataFrame, horizon_us: int, tick_us: int = SECOND) -> DataFrame:
    """Episodes: true steps no more than clear_after apart are one alert. cleared_us is null while it may go on.
    detected_us: known_us of the step that fired, when the batch that closed it was in; where that is unknown, the step's
    end."""
    if "known_us" not in true_rows.columns:
        true_rows = true_rows.withColumn("known_us", F.lit(None).cast("long"))
    true_rows = true_rows.withColumn("known_us", F.coalesce("known_us", F.col("t_us") + tick_us))
    by = Window.partitionBy("symbol", "rule").orderBy("t_us")
    gap = F.col("t_us") - F.lag("t_us").over(by) > F.col("clear_us")
    rows = true_rows.withColumn("episode", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(by))
    e = rows.groupBy("symbol", "rule", "place", "clear_us", "opens", "severity", "episode").agg(F.min("t_us").alias("fired_us"), F.max("t_us").alias("last_us"), F.min_by("known_us", "t_us").alias("detected_us"))
    end = F.col("last_us") + F.col("clear_us")
    e = e.withColumn("cleared_us", F.when(end <= horizon_us, end)).withColumn("active_until", F.least(end - tick_us, F.lit(horizon_us)))
    return numbered(e, "fired_us", ["fired_us", "symbol", "place"], "alert_no").drop("episode", "clear_us", "last_us")


def numbered(rows: DataFrame, time: str, order: list[str], name: str) -> DataFrame:
    """rows with their number in an order that begins with time, from 1 without gaps: counted within days, and the days
    before are added, one row a day."""
    rows = rows.withColumn("_day", F.floor(F.col(time) / DAY))
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_day").orderBy(*order)))
    return placed.join(before, "_day").withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_day", "_before", "_at")


def incidents(found: DataFrame, book: RuleBook, horizon_us: int) -> DataFrame:
    """Opening alerts of a symbol that follow one another within resolve_after of quiet are one incident."""
    quiet = book.resolve_after_s * SECOND
    by = Window.partitionBy("symbol").orderBy("fired_us", "place")
    before = F.max("active_until").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("fired_us") > before + quiet, F.lit(True))
    rows = found.where("opens").withColumn("n", F.sum(new.cast("int")).over(by))
    inc = rows.groupBy("symbol", "n").agg(F.min("fired_us").alias("opened_us"), F.max("active_until").alias("last_active_us"), F.min_by("detected_us", F.struct("fired_us", "place")).alias("detected_us"), F.count(F.lit(1)).alias("opening_alerts"))
    end = F.col("last_active_us") + quiet
    inc = inc.withColumn("resolved_us", F.when(end <= horizon_us, end)).withColumn("status", F.when(end <= horizon_us, "resolved").otherwise("open"))
    return numbered(inc, "opened_us", ["opened_us", "symbol"], "incident_no").drop("n")


def attached(found: DataFrame, inc: DataFrame, book: RuleBook) -> DataFrame:
    """Alerts with the earliest incident of their symbol that is open when they fire or opens within the lookback."""
    last = found.agg(F.max("fired_us").alias("_last"))  # one row: the end of incidents that are still open
    i = inc.crossJoin(F.broadcast(last)).select("symbol", "incident_no", "opened_us", (F.col("opened_us") - book.lookback_s * SECOND).alias("_from"), F.coalesce("resolved_us", "_last").alias("_to"))
    hit = within(i, found.select("symbol", "alert_no", "fired_us"), "_from", "_to", "fired_us", ["symbol"]).groupBy("alert_no").agg(F.min_by("incident_no", F.struct("opened_us", "incident_no")).alias("incident_no"))
    return found.join(hit, "alert_no", "left")


def extremes(inc: DataFrame, with_incident: DataFrame, featured: DataFrame) -> DataFrame:
    """Running extremes of an incident over the steps inside its opening alerts, and the price before it opened."""
    spans = with_incident.where("opens and incident_no is not null").select("incident_no", "symbol", "fired_us", "active_until")
    steps = within(spans, featured, "fired_us", "active_until", "bar_us", ["symbol"]).dropDuplicates(["incident_no", "bar_us"])
    seen = steps.groupBy("incident_no").agg(
        F.min("close").alias("price_low"), F.max("close").alias("price_high"), F.max_by("close", "bar_us").alias("price_last"), F.coalesce(F.max(F.abs("ret_60_ref_z")), F.lit(0.0)).alias("max_abs_ret_60_ref_z"),
        F.coalesce(F.max("vol_60_ref_ratio"), F.lit(0.0)).alias("max_vol_60_ref_ratio"), F.max("sell_share_120").alias("max_sell_share"), F.min("sell_share_120").alias("min_sell_share"),
    )
    at = featured.select(F.col("symbol"), F.col("bar_us").alias("opened_us"), (F.col("close") / (1 + F.col("ret_60"))).alias("price_at_open"))
    return inc.join(at, ["symbol", "opened_us"], "left").join(seen, "incident_no", "left")


def events(inc: DataFrame, with_incident: DataFrame) -> DataFrame:
    """(incident_no, at_us, event, alert_no): opened, each attached alert, resolved."""
    none = F.lit(None).cast("int")
    opened = inc.select("incident_no", F.col("opened_us").alias("at_us"), F.lit("opened").alias("event"), none.alias("alert_no"))
    hit = with_incident.where("incident_no is not null").select("incident_no", F.col("fired_us").alias("at_us"), F.lit("alert_attached").alias("event"), "alert_no")
    done = inc.where("resolved_us is not null").select("incident_no", F.col("resolved_us").alias("at_us"), F.lit("resolved").alias("event"), none.alias("alert_no"))
    return opened.unionByName(hit).unionByName(done)


#: What an alert remembers of the step that fired it.
REMEMBERED = ("close", "ret_60", "ret_60_z", "vol_60", "vol_60_ratio", "sell_share_120", "vol_120_ratio", "ret_60_ref_z", "vol_60_ref_ratio", "vol_120_ref_ratio")


def with_features(found: DataFrame, featured: DataFrame) -> DataFrame:
    """Alerts with the features of the step that fired, as JSON; unknown ones are null in it."""
    shown = F.to_json(F.struct(*[rounded(F.col(c), 6).alias(c) if c in featured.columns else F.lit(None).cast("double").alias(c) for c in REMEMBERED]), {"ignoreNullFields": "false"})
    return found.join(featured.select("symbol", F.col("bar_us").alias("fired_us"), shown.alias("features")), ["symbol", "fired_us"], "left")


def event_log(inc: DataFrame, with_incident: DataFrame, known: DataFrame) -> DataFrame:
    """events() with the rule of each alert and when each event was known. known: (symbol, bar_us, known_us) of every step."""
    log = events(inc, with_incident).join(inc.select("incident_no", "symbol", F.col("detected_us").alias("_opened")), "incident_no")
    log = log.join(with_incident.select("alert_no", "rule", F.col("detected_us").alias("_fired")), "alert_no", "left")
    log = log.join(known.select("symbol", F.col("bar_us").alias("at_us"), "known_us"), ["symbol", "at_us"], "left")
    detected = F.when(F.col("event") == "opened", F.col("_opened")).when(F.col("event") == "resolved", F.col("known_us")).otherwise(F.col("_fired"))
    return log.select("incident_no", "at_us", "event", "alert_no", detected.alias("detected_us"), "rule")


def alert_counts(with_incident: DataFrame) -> DataFrame:
    """(incident_no, alert_count): alerts that belong to an incident, context alerts included."""
    return with_incident.where("incident_no is not null").groupBy("incident_no").agg(F.count(F.lit(1)).alias("alert_count"))


def rules_of_incidents(inc: DataFrame, with_incident: DataFrame) -> DataFrame:
    """(incident_no, rules): alerts before the opening newest first, then the opener, then later ones; each rule once, where
    it comes first."""
    j = with_incident.where("incident_no is not null").join(inc.select("incident_no", "opened_us"), "incident_no")
    early = F.col("fired_us") < F.col("opened_us")
    order = F.struct((~early).alias("late"), F.when(early, -F.col("fired_us")).otherwise(F.col("fired_us")).alias("at"), F.when(early, -F.col("place")).otherwise(F.col("place")).alias("place"), F.col("rule").alias("rule"))
    return j.groupBy("incident_no").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["rule"])).alias("rules"))
