"""Reading tables for work that is bound by the processor rather than by the disk."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_scan(scan: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core.

    Files that are too few to keep all cores busy are small, so their rows are
    handed round; a scan that already has enough splits is returned unchanged
    and is not shuffled. Meant for plain scans, whose splits are known without
    running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
