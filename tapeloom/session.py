"""Session settings for the analytics jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tapeloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution and the state store that keyed streams need; shuffle partitions and memory are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
