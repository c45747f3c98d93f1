"""Queries over the events table as a tape, by name. Second-based operators run on the compressed clock, rules and
research on the native clock with minutes as base steps."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY, MINUTE, SECOND
from ..operators import bars as B
from ..operators import evidence as E
from ..operators import features as X
from ..operators import replay, research, rules
from ..sources import tape
from ..sources.stage import staged
from . import briefing

Query = Callable[[SparkSession, str], DataFrame]

LATENESS, SETTINGS = 10.0, (0.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0)
DAY0 = tape.ORIGIN_US
#: Days that have seven days before them; each is scored against these.
SCORED_FROM, SCORED_TO = DAY0 + 7 * DAY, DAY0 + 30 * DAY
HORIZON = SCORED_TO - MINUTE
#: Thresholds and times at which rules fire on the test tape.
TAPE_RULES = """
features: {baseline_window_s: 1800, warmup_s: 600}
rules:
  price_shock: {condition: abs(ret_60_ref_z) > 4, severity: high, clear_after_s: 300}
  volume_burst: {condition: vol_60_ref_ratio > 4, severity: medium, clear_after_s: 300, opens_incident: false}
  one_sided_flow: {condition: (sell_share_120 > 0.8 or sell_share_120 < 0.2) and vol_120_ref_ratio > 2, severity: medium, clear_after_s: 300, opens_incident: false}
incidents: {resolve_after_s: 900, context_lookback_s: 300}
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _once(stage):
    """A stage that several parts of a query read: written once, then read."""
    name = stage.__name__

    def kept(self):
        if name not in self.stages:
            self.stages[name] = staged(stage(self), name)
        return self.stages[name]

    return kept


class Tape:
    """The stages of one run, each built on the one before."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        e = events(spark, sf_dir)
        self.spark, self.stages = spark, {}
        self.native, self.fast = tape.events_as_trades(e), tape.events_as_trades(e, compressed=True)

    def batches(self) -> DataFrame:
        return replay.batched(replay.arrivals(self.fast))

    def base(self, lateness: float = LATENESS) -> DataFrame:
        return B.base_bars(self.batches(), lateness, SECOND)

    def rolled(self, lateness: float = LATENESS) -> DataFrame:
        return B.rolled_up(self.base(lateness), self.batches(), lateness, MINUTE)

    @_once
    def minutes(self) -> DataFrame:
        """Minute bars of the native clock with the time at which a batch a minute, none of them late, closed them."""
        batches = replay.batched(replay.arrivals(self.native, late_permille=0), 60)
        return B.emitted(B.trade_bars(self.native, MINUTE), B.watermarks(batches, LATENESS), MINUTE)

    def scored(self) -> DataFrame:
        return self.minutes().where((F.col("bar_us") >= SCORED_FROM) & (F.col("bar_us") < SCORED_TO))

    def profile(self) -> DataFrame:
        return X.daily_profiles(self.minutes(), SCORED_FROM, SCORED_TO)

    def grid(self) -> DataFrame:
        return X.dense_grid(self.scored(), MINUTE, HORIZON)

    @_once
    def features(self) -> DataFrame:
        return X.known_at(X.features(self.grid(), self.profile(), MINUTE), self.scored(), MINUTE)

    def steps(self) -> DataFrame:
        """The grid, where the features are read too."""
        return self.features().select("symbol", "bar_us", "close", "volume", "sell_volume")

    @_once
    def alerts(self) -> DataFrame:
        return rules.alerts(rules.conditions(self.features(), BOOK), HORIZON, MINUTE)

    @_once
    def incidents(self) -> DataFrame:
        return rules.incidents(self.alerts(), BOOK, HORIZON)

    @_once
    def linked(self) -> DataFrame:
        return rules.attached(self.alerts(), self.incidents(), BOOK)

    def windows(self) -> DataFrame:
        return E.windows(self.incidents())

    def study_events(self) -> DataFrame:
        a = self.linked().select(F.col("alert_no").alias("event_id"), "symbol", "rule", "fired_us", "detected_us")
        return a.withColumn("entry_us", research.entry_minute(F.col("detected_us")))

    def returns(self) -> DataFrame:
        return research.forward_returns(self.study_events(), self.steps())


BOOK = rules.RuleBook.parse(TAPE_RULES)


def _double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


PRICES = ("open", "high", "low", "close", "volume", "quote_volume", "sell_volume")


def _near(c: str, digits: int = 6):
    """Rounded where finite and moderate."""
    scaled = F.floor(F.col(c) * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)
    return F.when(F.abs(F.col(c)) < 1e9, scaled).otherwise(F.col(c)).alias(c)


def trades_normalized(spark, d):
    return _double(Tape(spark, d).native, "price", "quantity").select("symbol", "agg_trade_id", "price", "quantity", "is_buyer_maker", "event_us")


def ts_unit_detection(spark, d):
    us = Tape(spark, d).native.select("agg_trade_id", F.when(F.col("agg_trade_id") % 2 == 0, F.col("event_us")).otherwise(F.floor(F.col("event_us") / 1000)).alias("raw"))
    return us.select("agg_trade_id", "raw", tape.unit_micros(F.col("raw")).alias("event_us"))


def window_filter(spark, d):
    return tape.between(Tape(spark, d).native, DAY0 + DAY, DAY0 + 2 * DAY).select("symbol", "agg_trade_id", "event_us")


def arrivals_batches(spark, d):
    return Tape(spark, d).batches().select("agg_trade_id", "event_us", "arrival_us", "batch_id", "clock_us")


def delivery_reconcile(spark, d):
    t = Tape(spark, d)
    return replay.delivery(t.fast, t.batches())


def bars_base(spark, d):
    return _double(Tape(spark, d).base(), *PRICES)


def bars_rollup(spark, d):
    return _double(Tape(spark, d).rolled(), *PRICES, "vwap")


def late_trades(spark, d):
    return B.late_trades(Tape(spark, d).batches(), LATENESS, SECOND).select("symbol", "agg_trade_id", "event_us", "arrival_us", "batch_id", "watermark_us")


def build_stats(spark, d):
    return B.build_stats(Tape(spark, d).batches(), LATENESS, SECOND)


def truth_bars(spark, d):
    return _double(B.trade_bars(Tape(spark, d).fast, MINUTE), *PRICES)


def lateness_compare(spark, d):
    t = Tape(spark, d)
    c = B.compared(B.trade_bars(t.fast, MINUTE), t.rolled(2.0))
    return c.select("bars", "missing_bars", "wrong_bars", "volume_off_1pct", *[_near(x, 4) for x in ("max_price_bps", "max_volume_pct", "max_share_pp")])


def lateness_sweep(spark, d):
    s = B.lateness_sweep(Tape(spark, d).batches(), list(SETTINGS), SECOND, MINUTE)
    return s.select("lateness_s", "accepted", "dropped", "bars", "missing_bars", "wrong_bars", "volume_off_1pct")


def bar_delay(spark, d):
    return B.bar_delay(Tape(spark, d).base(), SECOND).select(_near("p50_s", 4), _near("p95_s", 4))


def klines(spark, d):
    m = Tape(spark, d).minutes()
    return _double(m.withColumn("taker_buy_volume", F.col("volume") - F.col("sell_volume")), "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume").select("symbol", "bar_us", "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_volume")


def hour_profile(spark, d):
    return Tape(spark, d).profile().select("symbol", "day", "hour", "days", "bars", "volume_median", _near("ret_std"))


def returns_lag(spark, d):
    from pyspark.sql.window import Window

    m = Tape(spark, d).minutes()
    r = F.col("close").cast("double") / F.lag(F.col("close").cast("double")).over(Window.partitionBy("symbol").orderBy("bar_us")) - 1
    return m.select("symbol", "bar_us", r.alias("ret")).select("symbol", "bar_us", _near("ret", 9))


def bars_vs_klines(spark, d):
    t = Tape(spark, d)
    return X.reconciled(t.rolled(2.0), B.trade_bars(t.fast, MINUTE))


def profile_missing_days(spark, d):
    present = events(spark, d).select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"))
    return tape.missing_days(present, ["click", "error", "view"], date(2024, 1, 5)).select("symbol", F.col("day").cast("string"))


def dense_grid(spark, d):
    return _double(Tape(spark, d).grid(), "volume", "sell_volume")


def known_at(spark, d):
    t = Tape(spark, d)
    base = staged(t.base(), "base")
    return X.known_at(X.dense_grid(base, SECOND), base, SECOND).select("symbol", "bar_us", "known_us")


def features_ref(spark, d):
    f = Tape(spark, d).features()
    return f.select("symbol", "bar_us", _near("ret_60", 9), "vol_60", "vol_120", _near("sell_share_120"), _near("ret_60_ref_z", 4), _near("vol_60_ref_ratio", 4), _near("vol_120_ref_ratio", 4))


def features_rolling(spark, d):
    return X.rolling_features(Tape(spark, d).features(), step=MINUTE).select("symbol", "bar_us", _near("ret_60_z", 4), _near("vol_60_ratio", 4), _near("vol_120_ratio", 4))


def rule_conditions(spark, d):
    return rules.conditions(Tape(spark, d).features(), BOOK).select("symbol", "t_us", "rule")


def alerts(spark, d):
    return Tape(spark, d).linked().select("alert_no", "symbol", "rule", "severity", "fired_us", "detected_us", "cleared_us", "incident_no")


def incidents(spark, d):
    return Tape(spark, d).incidents().select("incident_no", "symbol", "opened_us", "last_active_us", "detected_us", "opening_alerts", "resolved_us", "status")


def incident_events(spark, d):
    t = Tape(spark, d)
    return rules.events(t.incidents(), t.linked())


def incident_rules(spark, d):
    t = Tape(spark, d)
    return rules.rules_of_incidents(t.incidents(), t.linked()).select("incident_no", F.array_join("rules", ",").alias("rules"))


def incident_extremes(spark, d):
    t = Tape(spark, d)
    x = rules.extremes(t.incidents(), t.linked(), t.features())
    return x.select("incident_no", _near("price_at_open"), "price_low", "price_high", "price_last", _near("max_abs_ret_60_ref_z", 4), _near("max_vol_60_ref_ratio", 4), _near("max_sell_share"), _near("min_sell_share"))


def incident_flow(spark, d):
    t = Tape(spark, d)
    return E.flow(t.windows(), t.scored()).select("incident_no", "volume", _near("sell_share"), "trades", "price_at_end")


def price_after(spark, d):
    t = Tape(spark, d)
    return E.price_after(t.windows(), t.steps())


def other_symbol(spark, d):
    t = Tape(spark, d)
    return E.other_symbols(t.windows(), t.scored()).select("incident_no", "other_symbol", _near("other_return", 9))


def overlap_pairs(spark, d):
    return E.overlaps(Tape(spark, d).windows()).select("incident_no", F.array_join(F.transform("overlapping", lambda x: x.cast("string")), ",").alias("overlapping"))


def alert_timeline(spark, d):
    t = Tape(spark, d)
    return E.timeline(t.incidents(), t.linked()).select("incident_no", F.array_join(F.transform("alert_timeline", lambda x: F.concat(x["rule"], F.lit("@"), x["seconds_from_open"].cast("string"))), ",").alias("timeline"))


def incident_evidence(spark, d):
    t = Tape(spark, d)
    x = rules.extremes(t.incidents(), t.linked(), t.features())
    e = E.incident_evidence(x, t.linked(), t.scored(), t.steps(), t.native)
    return e.select("incident_no", "symbol", "status", "opened_utc", "active_minutes", "move_at_end_pct", "sell_pct", "volume", "trades", F.size("overlapping").alias("n_overlapping"), briefing.scope(F.col("overlapping")).alias("scope"), "largest_trade_pct", "top10_pct", "median_trade_size")


def trade_concentration(spark, d):
    t = Tape(spark, d)
    return E.trade_sizes(t.windows(), t.native)


def day_summary(spark, d):
    t = Tape(spark, d)
    return E.day_summary(t.scored(), t.profile())


def alerts_by_rule(spark, d):
    return E.alerts_by_rule(Tape(spark, d).linked())


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Bookkeeping rows made of the events: each day's rows of a third of the users are a run."""
    e = events(spark, d).select(F.to_date("ts").alias("trade_date"), F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("run_id"), "ts", "event_type")
    g = e.groupBy("trade_date", "run_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("finished_at"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("created_at"))
    return g.withColumn("status", F.when(F.col("n") % 4 == 0, "failed").otherwise("completed")).withColumn("bronze_purged_at", F.when(F.col("n") % 5 == 0, F.col("finished_at")))


def _briefings(runs: DataFrame) -> DataFrame:
    """Briefings of the runs that have an error event."""
    kind = F.when(F.col("n") % 3 == 0, "written").when(F.col("n") % 3 == 1, "quiet").otherwise("awaiting_analyst")
    return runs.where("created_at is not null").select("trade_date", "run_id", kind.alias("status"), "created_at")


def official_runs(spark, d):
    return briefing.official_runs(_runs(spark, d)).select(F.col("trade_date").cast("string"), "run_id")


def audit_list(spark, d):
    return _runs(spark, d).orderBy(F.col("finished_at").desc(), "run_id").limit(30).select("run_id", "status")


def retention_candidates(spark, d):
    return briefing.retention_candidates(_runs(spark, d), date(2024, 1, 25)).select("run_id")


def catchup_days(spark, d):
    runs = _runs(spark, d)
    return briefing.without_briefing(briefing.official_runs(runs), _briefings(runs)).select(F.col("trade_date").cast("string"), "run_id")


def official_events(spark, d):
    """Events of each day's official run, by run."""
    own = events(spark, d).select(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("run_id"), "value")
    return research.of_official_runs(own, briefing.official_runs(_runs(spark, d))).groupBy("run_id", F.col("trade_date").cast("string").alias("trade_date")).agg(F.count(F.lit(1)).alias("n"))


def briefs_join(spark, d):
    """Incidents beside the notes on them: the first answer of the conversation of that number."""
    talk = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'")
    notes = talk.groupBy(F.col("conv_id").alias("incident_no")).agg(F.min_by("text", "turn").alias("note"))
    return Tape(spark, d).incidents().select("incident_no", "symbol").join(notes, "incident_no", "left")


def briefing_validation(spark, d):
    """What alerts of a day name as their incidents, against the incidents that opened on that day."""
    t = Tape(spark, d)
    day = lambda c: F.floor(F.col(c) / DAY).cast("int").alias("briefing_id")
    wanted = t.incidents().groupBy(day("opened_us")).agg(F.collect_list("incident_no").alias("incidents"))
    answers = t.linked().where("incident_no is not null and rule <> 'volume_burst'").groupBy(day("fired_us")).agg(F.collect_list("incident_no").alias("noted"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return briefing.validated(answers, wanted).select("briefing_id", join("unknown"), join("missing"), join("duplicate"))


def scope_of(spark, d):
    t = Tape(spark, d)
    j = t.incidents().join(E.overlaps(t.windows()), "incident_no", "left")
    return j.select("incident_no", briefing.scope(F.coalesce("overlapping", F.array().cast("array<int>"))).alias("scope"))


def quiet_summary(spark, d):
    t = Tape(spark, d)
    day = lambda c: F.floor(F.col(c) / DAY).alias("day")
    days = t.scored().groupBy(day("bar_us")).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    found = days.join(t.incidents().groupBy(day("opened_us")).agg(F.count(F.lit(1)).alias("incidents")), "day", "left").join(t.linked().groupBy(day("fired_us")).agg(F.count(F.lit(1)).alias("alerts")), "day", "left")
    rows = found.select(F.date_add(F.lit(date(1970, 1, 1)), F.col("day").cast("int")).alias("trade_date"), "symbols", F.coalesce("incidents", F.lit(0)).alias("incidents"), F.coalesce("alerts", F.lit(0)).alias("alerts"))
    return briefing.quiet_summary(rows).select(F.col("trade_date").cast("string"), "summary")


def forward_returns(spark, d):
    return Tape(spark, d).returns().select("event_id", "symbol", "rule", "entry_us", *[_near(f"ret_{h}m", 9) for h in research.HORIZONS])


def control_pool(spark, d):
    t = Tape(spark, d)
    return research.control_pool(t.steps(), t.study_events())


def controls_sample(spark, d):
    t = Tape(spark, d)
    return research.sampled_controls(t.study_events(), research.control_pool(t.steps(), t.study_events()))


def _split(df: DataFrame, t: "Tape") -> DataFrame:
    """With dataset: the last third of the scored days is the holdout."""
    days = t.scored().select(F.floor(F.col("bar_us") / DAY).alias("trade_date"))
    split = F.broadcast(research.split_day(days))  # one row
    return df.crossJoin(split).withColumn("dataset", F.when(F.floor(F.col("entry_us") / DAY) < F.col("split_day"), "discovery").otherwise("holdout")).drop("split_day")


def _study_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("mean", "hit_rate", "hit_rate_known")], _near("mean"), _near("hit_rate"), _near("hit_rate_known"))


def study_size(spark, d):
    t = Tape(spark, d)
    return _study_columns(research.study(_split(t.returns(), t), ["rule", "dataset"]))


def study_direction(spark, d):
    t = Tape(spark, d)
    f = t.features().select("symbol", F.col("bar_us").alias("fired_us"), "sell_share_120")
    rows = _split(t.returns().where("rule = 'one_sided_flow'"), t).join(f, ["symbol", "fired_us"], "left")
    return _study_columns(research.study(rows, ["dataset"], F.when(F.col("sell_share_120") < 0.5, 1).otherwise(-1)))


def study_shock(spark, d):
    t = Tape(spark, d)
    f = t.features().select("symbol", F.col("bar_us").alias("fired_us"), "ret_60")
    rows = _split(t.returns().where("rule = 'price_shock'"), t).join(f, ["symbol", "fired_us"], "left")
    return _study_columns(research.study(rows, ["dataset"], F.signum("ret_60")))


def _study_rows(t: Tape) -> DataFrame:
    at = t.features().select("symbol", F.col("bar_us").alias("fired_us"), "sell_share_120", "ret_60")
    return _split(t.returns(), t).join(at, ["symbol", "fired_us"], "left")


def study_controls(spark, d):
    """Moves after the control minutes of each rule's alerts."""
    t = Tape(spark, d)
    e = t.study_events()
    found = research.control_means(_split(e, t), research.sampled_controls(e, research.control_pool(t.steps(), e)), t.steps(), ["rule", "dataset"])
    return found.select("rule", "dataset", "horizon", "controls", _near("control"))


def study_table(spark, d):
    t = Tape(spark, d)
    e = t.study_events()
    return research.study_table(staged(_study_rows(t), "study"), staged(research.sampled_controls(e, research.control_pool(t.steps(), e)), "controls"), t.steps())


def event_log(spark, d):
    t = Tape(spark, d)
    return rules.event_log(t.incidents(), t.linked(), t.features())


def alert_features(spark, d):
    t = Tape(spark, d)
    f = rules.with_features(t.linked(), t.features())
    return f.select("alert_no", *[F.get_json_object("features", f"$.{c}").cast("double").alias(c) for c in ("close", "vol_60")])


def bootstrap_ci(spark, d):
    t = Tape(spark, d)
    one = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.abs(F.col(f"ret_{h}m")).alias("ret")) for h in research.HORIZONS]))
    rows = _split(t.returns(), t).select("rule", "dataset", "event_id", one.alias("r")).select("rule", "dataset", "r.*", F.concat_ws(":", "event_id", "r.horizon").alias("id"))
    return research.bootstrap_ci(rows, ["rule", "dataset", "horizon"], "ret", row_id="id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    trades_normalized, ts_unit_detection, window_filter, arrivals_batches, delivery_reconcile, bars_base, bars_rollup, late_trades, build_stats, truth_bars, lateness_compare,
    lateness_sweep, bar_delay, klines, hour_profile, returns_lag, bars_vs_klines, profile_missing_days, dense_grid, known_at, features_ref, features_rolling, rule_conditions,
    alerts, incidents, incident_events, incident_rules, incident_extremes, incident_flow, price_after, other_symbol, overlap_pairs, alert_timeline, incident_evidence,
    trade_concentration, day_summary, alerts_by_rule, official_runs, audit_list, retention_candidates, catchup_days, briefs_join, briefing_validation, scope_of, quiet_summary,
    forward_returns, control_pool, controls_sample, study_size, study_direction, study_shock, bootstrap_ci,
    official_events, study_controls, study_table, event_log, alert_features,
)}
