"""Session construction with the settings every meshlake job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "meshlake", master: str | None = None, **conf: str) -> SparkSession:
    """An active session, or a new one with adaptive execution, Arrow and UTC.

    A cluster's own master and settings are kept: only values given here are set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
