"""SparkSession settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "heddle", **conf: str) -> SparkSession:
    """A session with DEFAULTS, overridden by `conf`; `master` is left to spark-submit where None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**DEFAULTS, **conf}).getOrCreate()
