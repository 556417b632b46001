"""Session construction and cluster-safe settings.

Library code never mutates a session it did not build; ``build_session`` is for tests, bench and
the command-line runner. On a cluster the submitter owns the configuration.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Defaults chosen for multi-executor runs: AQE re-plans joins from runtime sizes, coalesces small
# shuffle partitions and splits skewed join partitions; ~128 MB advisory partitions keep tasks
# inside executor memory at large scale.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "featuremart",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(CLUSTER_DEFAULTS)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    })
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
