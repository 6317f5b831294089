"""Parallelism guard for CPU-heavy per-row stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (regex tokenising, n-gram generation,
    Python batches) enough tasks.

    When the input arrives in fewer partitions than the session's shuffle
    parallelism -- one large unsplittable file, or a small table that a
    stage will blow up -- it is redistributed round-robin.  Input that is
    already split into enough partitions (the normal case on a cluster) is
    returned unchanged, so no shuffle is added at scale.
    """
    spark = df.sparkSession
    target = min_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the plan alone
        return df
    if current >= target:
        return df
    return df.repartition(target)
