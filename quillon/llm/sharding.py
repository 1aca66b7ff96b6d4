"""Sharding by longest processing time.

Groups that must stay together (equal texts) are ordered by their total size, largest first, and each
goes to the least-loaded shard, which a heap yields. What reaches the driver is the histogram of exact group sizes:
D distinct sizes take at least D(D + 1)/2 bytes, so it has fewer rows than the square root of twice the corpus's bytes
(250,000 for 30 GB, 14 million for 100 TB, if no two sizes were alike). Groups of one size are interchangeable;
which of them goes where is settled by a distributed rank (row numbers within slices of the digest, plus
offsets), so no task sees all groups of a size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import materialize, packed

SHARDS = 24
#: The plan is broadcast up to so many rows; beyond, groups meet it by a shuffle on their size.
BROADCAST_SIZES = 200_000


def lpt_counts(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each (size, groups), the shards that get groups of it, and running counts of how many.

    Sizes come largest first. Each group goes to the shard with the least load (of equal ones, the first). A shard that
    stays the least loaded takes several at once, and while all loads are within one group of each other, whole
    rounds are dealt: the outcome is that of one group after the other.
    """
    heap = [(0, k) for k in range(shards)]
    for size, left in sizes:
        got: dict[int, int] = {}
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] < size:
                rounds, left = divmod(left, shards)
                heap = [(load + rounds * size, k) for load, k in heap]
                heapq.heapify(heap)
                for k in range(shards):
                    got[k] = got.get(k, 0) + rounds
                continue
            load, k = heapq.heappop(heap)
            n = min(left, max(1, (heap[0][0] - load) // size)) if heap else left
            heapq.heappush(heap, (load + n * size, k))
            got[k] = got.get(k, 0) + n
            left -= n
        homes, ends, at = sorted(got), [], 0
        for k in homes:
            at += got[k]
            ends.append(at)
        yield size, homes, ends


def _offsets(df: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Rows that come before each slice within ``keys``."""
    order = W.partitionBy(*keys).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    return df.groupBy(*keys, salt).agg(F.count("*").alias("n")).select(*keys, salt, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs``, all their columns, with ``shard`` and ``slot`` as ``lpt_shards`` deals them; columns of these two names are replaced."""
    dealt = lpt_shards(docs, shards, carry=True)
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return dealt.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "shard", "slot")


def lpt_shards(docs: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """Shard and slot of every row of ``docs`` (``doc_id``, ``text``), sizes near equal.

    A row's size is the UTF-8 bytes of its text plus 8; a null text has no bytes and CRC 0. Equal texts form one
    group and share a shard (null texts are a group of their own). Repeated rows each get a slot; null ids are
    kept and come first within their slice of slots. An empty table gives an empty result. Columns of ``docs``
    other than ``doc_id`` and ``text`` play no part. ``grown_shard`` is null: under the law ``bytes`` nothing is
    promised about one more shard. With ``carry`` each result row holds its row of ``docs`` as ``_row``.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text, rest = F.col("text"), ["_row"] if carry else []
    slice_of = lambda c: F.substring(F.hex(c), 1, 3)
    rows = materialize(
        docs.select(
            *([packed(docs)] if carry else []),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("content"),
        ),
        "shard-rows",
        "zstd" if carry else "snappy",
    )
    groups = rows.groupBy("content", "size").agg(F.count("*").alias("n"))
    groups = materialize(groups.select("content", "n", (F.col("size") * F.col("n")).alias("total"), slice_of("content").alias("salt")), "shard-groups")
    histogram = groups.groupBy("total").agg(F.count("*").alias("n")).orderBy(F.desc("total")).toPandas()  # bounded: see above
    dealt = pd.DataFrame(lpt_counts(zip(histogram["total"].tolist(), histogram["n"].tolist(), strict=True), shards), columns=["total", "homes", "ends"])
    plan = spark.createDataFrame(dealt, "total long, homes array<int>, ends array<long>")
    small = (lambda df: F.broadcast(df)) if len(dealt) <= BROADCAST_SIZES else (lambda df: df)
    rank = F.row_number().over(W.partitionBy("total", "salt").orderBy("content")) - 1
    place = F.size(F.filter("ends", lambda end: end <= F.col("rank") + F.col("ahead"))) + 1
    homed = (
        groups.withColumn("rank", rank)
        .join(_offsets(groups, ["total"], "salt"), ["total", "salt"])
        .join(small(plan), "total")
        .select("content", "n", F.element_at("homes", place).alias("shard"))
    )
    homed = materialize(homed, "shard-homes")
    # A text with more than a 2,000th of all rows is told by broadcast (there are 2,000 such at most); all others by a shuffle.
    limit = max(1000, (groups.agg(F.sum("n")).first()[0] or 0) // 2000)
    hot = homed.where(F.col("n") > limit).select("content", "shard")
    cold = homed.where(F.col("n") <= limit).select("content", "shard")
    placed = rows.join(F.broadcast(hot), "content").unionByName(rows.join(F.broadcast(hot.select("content")), "content", "left_anti").join(cold, "content"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lower(F.hex("content"))))
    placed = materialize(placed.withColumn("salt", F.substring(digest, 1, 3)), "shard-placed", "zstd" if carry else "snappy")
    slot = F.row_number().over(W.partitionBy("shard", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "content")) - 1
    return (
        placed.withColumn("rank", slot)
        .join(F.broadcast(_offsets(placed, ["shard"], "salt")), ["shard", "salt"])  # shards x 4,096 rows at most
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("ahead")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *rest)
    )
