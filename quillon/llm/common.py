"""Shared pieces of the training-data operators: text rules, shared storage, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import materialize, shared_dir, shuffles_dropped, work_tables_dropped

__all__ = ["TOKEN", "UPPER", "WORD", "ascii_lower", "bound_batches", "connected_components", "hot_keys", "join_hot", "materialize", "packed", "shared_dir", "unpacked", "work_tables_dropped"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the decontamination rule before A-Z are lower-cased: runs of digits, ASCII letters and anything beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Words of the near-duplicate and size rules: runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Lowers the session's Arrow batches to ``limit`` bytes, so that texts of any length reach Python a few at a time.

    It stays lowered: plans are lazy, and Spark reads the setting when they run.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = spark.conf.get(key, "64m").strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    if int(text.rstrip("kmg")) * unit > limit:
        spark.conf.set(key, str(limit))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does that wherever no other upper-case letter occurs, and is far faster than ``translate``."""
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct ``_row``, so that whatever its columns are called, none clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def hot_keys(df: DataFrame, key: str, least: int = 1000, most: int = 200) -> list:
    """The keys with the most rows, over ``least``: ``most`` of them at most, so that what joins them may be broadcast."""
    top = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), key).limit(most)
    return [r[0] for r in top.collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """An inner join on ``key`` in which no task takes all rows of a hot key: those of ``right`` are broadcast."""
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key).unionByName(left.where(~is_hot).join(right.where(~is_hot), key))


#: A node with more edges than this, and more than a 200th of all, is joined by broadcast: of such hubs there are 400 at most.
HUB = 1000


def _signature(edges: DataFrame) -> tuple[int, int, int]:
    """Edges, their checksum, and the most that one node has."""
    ends = edges.select("a", F.xxhash64("a", "b").cast("decimal(38,0)").alias("h")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).cast("decimal(38,0)").alias("h")))
    row = ends.groupBy("a").agg(F.count("*").alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return row[0] or 0, row[1] or 0, row[2] or 0


def _meet(both: DataFrame, low: DataFrame, limit: int, most: int) -> DataFrame:
    """``both`` with its nodes' ``m``; hubs by broadcast, so that no task takes all edges of one."""
    if most <= limit:
        return both.join(low.select("a", "m"), "a")
    hubs = F.broadcast(low.where(F.col("n") > limit).select("a", "m"))
    return both.join(hubs, "a").unionByName(both.join(hubs.select("a"), "a", "left_anti").join(low.where(F.col("n") <= limit).select("a", "m"), "a"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two columns of one comparable type, ``a`` and ``b``; self-loops and nulls are ignored.
    Returns one row per node with an edge: ``node`` and ``component``, the smallest node it reaches.
    Each round is joins and grouped minima, checkpointed in the shared folder; nothing is collected
    but two counts and one checksum, by which the end and hubs are seen.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    with shuffles_dropped(spark):
        edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = _signature(edges)
    for _ in range(max_rounds):
        limit, most = max(HUB, before[0] // 200), before[2]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = _meet(both, low, limit, most).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = _meet(large, low, limit, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        with shuffles_dropped(spark):
            edges = low.select("a", F.col("m").alias("b")).unionByName(moved).where("a <> b").distinct().checkpoint()
        after = _signature(edges)
        if after[:2] == before[:2]:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
