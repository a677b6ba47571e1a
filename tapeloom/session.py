"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "tapeloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Return a session; on a cluster, leave ``master`` to spark-submit.

    Adaptive execution stays on: it coalesces small shuffles, splits skewed join
    partitions and turns a sort-merge join into a broadcast join once the real
    size of a side is known.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
