"""Tables as Parquet folders: append, idempotent replacement of a run's rows, upsert by key, purge, latest rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared tables: columns and the columns that partition them.
SCHEMAS = {
    "bronze/replay_runs": ("run_id string, trade_date date, symbols array<string>, speed double, tick_s double, started_at timestamp, status string, events_emitted long, sim_us long, bronze_purged_at timestamp, written_at timestamp", []),
    "bronze/trade_events": ("run_id string, batch_id int, symbol string, agg_trade_id long, price decimal(18,8), quantity decimal(18,8), first_trade_id long, last_trade_id long, is_buyer_maker boolean, event_us long, arrival_us long, ingested_at timestamp", ["run_id"]),
    "silver/bars": ("run_id string, lateness_s double, step_s int, symbol string, bar_us long, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(24,8), quote_volume decimal(28,8), sell_volume decimal(24,8), trade_count long, emitted_us long", ["run_id", "lateness_s", "step_s"]),
    "silver/late_trades": ("run_id string, lateness_s double, symbol string, agg_trade_id long, event_us long, arrival_us long, watermark_us long", ["run_id", "lateness_s"]),
    "silver/builds": ("run_id string, lateness_s double, built_at timestamp, trades_accepted long, trades_dropped long", ["run_id", "lateness_s"]),
    "reference/klines": ("symbol string, day date, bar_us long, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(24,8), quote_volume decimal(28,8), trade_count long, taker_buy_volume decimal(24,8)", ["symbol", "day"]),
    "live/bars": ("run_id string, lateness_s double, flush_id long, step_s int, symbol string, bar_us long, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(24,8), quote_volume decimal(28,8), sell_volume decimal(24,8), trade_count long, active_bars long, vwap decimal(18,8)", ["run_id", "lateness_s", "flush_id"]),
    "live/late_trades": ("run_id string, lateness_s double, flush_id long, symbol string, agg_trade_id long, quantity decimal(18,8), event_us long, arrival_us long, watermark_us long", ["run_id", "lateness_s", "flush_id"]),
    "live/alerts": ("run_id string, flush_id long, symbol string, rule string, severity string, place int, opens boolean, fired_us long, detected_us long, cleared_us long, incident_us long", ["run_id", "flush_id"]),
    "live/incidents": ("run_id string, flush_id long, symbol string, opened_us long, last_active_us long, detected_us long, opening_alerts long, resolved_us long, status string", ["run_id", "flush_id"]),
    "ops/alerts": ("run_id string, alert_no long, symbol string, rule string, severity string, place int, opens boolean, fired_us long, detected_us long, cleared_us long, active_until long, incident_no long, features string", ["run_id"]),
    "ops/incidents": ("run_id string, incident_no long, symbol string, status string, opened_us long, last_active_us long, detected_us long, resolved_us long, rules array<string>, alert_count long, opening_alerts long, observed string, agent_status string", ["run_id"]),
    "ops/incident_events": ("run_id string, incident_no long, at_us long, event string, alert_no long, detected_us long, rule string", ["run_id"]),
    "ops/rule_runs": ("run_id string, lateness_s double, started_at timestamp, finished_at timestamp, mode string, steps_evaluated long, alerts long, incidents long, rules_text string", ["run_id"]),
    "ops/daily_runs": ("trade_date date, run_id string, status string, finished_at timestamp, detail string, trades long, alerts long, incidents long, minutes_checked long, minutes_matching long, bronze_rows_purged long", []),
    "ops/llm_calls": ("called_at timestamp, trade_date date, model string, status string, error string", []),
    "gold/daily_briefings": ("trade_date date, run_id string, status string, summary string, evidence string, created_at timestamp", []),
    "gold/incident_briefs": ("run_id string, incident_no long, headline string, note string, scope string", ["run_id"]),
    "gold/signal_research": ("version int, section string, signal string, split string, horizon int, n long, value double, control double, ci_lo double, ci_hi double, hit_rate double, first_day date, last_day date, n_days int, split_day date, n_alerts long, cost_pct double", ["version"]),
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self, table: str) -> DataFrame:
        """The table in its declared columns; columns added later are null in older files."""
        if not self.exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table][0])
        return self.spark.read.schema(SCHEMAS[table][0]).parquet(self.path(table))

    def columns(self, table: str) -> list[str]:
        return [c.split()[0] for c in SCHEMAS[table][0].split(", ")]

    def stream(self, table: str, **parts) -> DataFrame:
        """One partition of a table (its first partition columns) as a stream of its files, in the order in which they are
        written, without those columns. The folder may still be empty."""
        path = "/".join([self.path(table), *(f"{k}={v}" for k, v in parts.items())])
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
        columns = [c for c in SCHEMAS[table][0].split(", ") if c.split()[0] not in parts]
        schema = ", ".join(sorted(columns, key=lambda c: c.split()[0] in SCHEMAS[table][1]))  # as files have them: partition columns last
        return self.spark.readStream.schema(schema).parquet(path)

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """By name; missing columns are null, undeclared ones are refused."""
        empty = self.spark.createDataFrame([], SCHEMAS[table][0])
        if unknown := set(rows.columns) - set(empty.columns):
            raise ValueError(f"{table} declares no {', '.join(sorted(unknown))}")
        return empty.unionByName(rows, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])

    def append(self, table: str, rows: DataFrame) -> None:
        self._shaped(table, rows).write.mode("append").partitionBy(*SCHEMAS[table][1]).parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Replaces the partitions that rows fall into, so that rebuilding a run is idempotent. Spark writes all new
        files aside first and moves them in at the end, so a job that dies leaves the old rows. Tables without partitions are
        never overwritten in place: they are logs, appended to and read by latest()."""
        keys = SCHEMAS[table][1]
        if not keys:
            raise ValueError(f"{table} has no partitions to replace: append to it, and read the latest rows of its keys")
        self._shaped(table, rows).write.mode("overwrite").partitionBy(*keys).option("partitionOverwriteMode", "dynamic").parquet(self.path(table))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows of the same keys are replaced, others stay. Only the partitions concerned are rewritten, from a
        staged copy, as a folder can't be read and overwritten at once."""
        parts = SCHEMAS[table][1]
        rows = self._shaped(table, rows)
        old = self.read(table)
        if parts:
            old = old.join(rows.select(*parts).distinct(), parts, "left_semi")
        merged = old.join(rows.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows)
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        merged.write.parquet(staged)
        self.replace(table, self.spark.read.schema(rows.schema).parquet(staged))
        self._delete(staged)

    def purge(self, table: str, column: str, values: list) -> int:
        """Drops partitions by value and returns how many rows went."""
        gone = self.read(table).where(F.col(column).isin(values)).count()
        for value in values:
            self._delete(f"{self.path(table)}/{column}={value}")
        return gone

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an ordering column."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("row"))
    return top.select(*keys, "row.*")
