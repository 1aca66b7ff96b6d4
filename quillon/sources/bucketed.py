"""Artifacts bucketed and sorted by an entity, so that joins and windows by it need no exchange.

A table's rows are dealt to a fixed number of buckets by a hash of the entity and sorted within; two tables with the same number of
buckets meet bucket by bucket. A bucket's rows are those of many entities; one entity's rows are in one bucket, so this is for
panels whose entities are short beside a bucket, and ``operators.scans`` is for those that are not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quillon.sources.shared import shared_dir, shuffles_dropped

#: Buckets of an artifact, the same for all, so that any two are co-partitioned. At 100 TB a bucket would hold some 12 GB; deployments set more.
BUCKETS = 8192


def save_bucketed(df: DataFrame, what: str, entity: str = "stock_id", order: tuple[str, ...] = ("period",), buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``entity`` and sorted by it and ``order``.

    Rows are shuffled by the entity once, here, so a bucket is one file. The session is told that a join on more keys than
    the bucketing's may use it; the table is dropped from the catalog with the session, its files stay in the shared folder.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"{what.replace('-', '_')}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        rows = df.repartition(buckets, entity)
        rows.write.format("parquet").bucketBy(buckets, entity).sortBy(entity, *order).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
