"""Session settings the jobs rely on.

Nothing here overrides a value the cluster already sets for resources
(executors, memory, shuffle partitions, checkpoint directory).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Semantics the jobs depend on: UTC rendering, last-one-wins duplicate JSON keys.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# Stored records are read whole, or not at all: rules read lifted columns. Taking each VARIANT
# apart for Parquet and putting it together again would cost more than making it.
PLAIN = {"spark.sql.variant.inferShreddingSchema": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that change results, and how VARIANTs are stored; leave sizing to
    the cluster."""
    for key, value in {**REQUIRED, **PLAIN}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "sparkwarden", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())

