"""Mixing sources to target weights over a multivariate-hypergeometric splitting tree (DataFrame operations only).

Each source is a stream of words: its documents in a seeded permutation, repeated as often as its target asks. The
stream is cut into blocks of whole documents; a source's quota is its number of blocks. A binary tree over the output
shards splits the vector of quotas: at each node the left half draws its share of blocks from all sources without
replacement. Leaves own disjoint runs of each source's permuted blocks, take their documents, and shuffle them.
Only the vector of sources (id, size, quota) and the tree pass through the driver; rows never do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import TOKEN, materialize, packed, unpacked

WEIGHTS, MAX_EPOCHS, SHARDS, BLOCK, SEED = (5.0, 2.0, 1.0), 3, 16, 4096, "mix-1"
#: Words of an output shard (beyond the least number of shards), shards at most, and words that one task shuffles.
LEAF, LEAVES, SLICE = 1 << 30, 4096, 1 << 26


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def permutation_key(seed: str) -> Column:
    """Where a row stands in its source's permutation: a digest of seed, source, id and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "doc_id")]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts, F.md5(F.coalesce(F.col("text"), F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (``source``, ``source_size``): shares by weight, none above ``max_epochs`` times its size.

    Sharing the excess again and again by weight ends where each source has min(weight x level, cap) for one
    level; sorted by cap per weight, the level follows from running sums. Windows run over sources, not rows.
    """
    index = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index % len(weights)).cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(W.partitionBy()) - before) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    fits = F.when(level <= F.col("cap") / F.col("weight"), level)
    found = rows.withColumn("fits", fits)
    first = F.first("fits", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return found.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * first), F.col("cap")).alias("target"))


def split_quotas(quotas: list[int], shards: int, seed: str = SEED) -> np.ndarray:
    """Blocks of each source for each shard, (shards, sources): the splitting tree, each node seeded by its range."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid, rest = (lo + hi) // 2, int(left.sum())
        rng = np.random.default_rng([*seed.encode(), lo, hi])
        need = rest * (mid - lo) // (hi - lo)
        part = np.zeros_like(left)
        for k, q in enumerate(left.tolist()):  # marginals one after the other give the multivariate draw
            rest -= q
            part[k] = _hypergeometric(rng, q, rest, need)
            need -= int(part[k])
        split(lo, mid, part)
        split(mid, hi, left - part)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if not bad:
        return min(good, draws)
    return int(rng.hypergeometric(good, bad, draws))


def leaves(total: int, least: int = SHARDS) -> int:
    """Output shards for so many words: ``least``, or one for each LEAF words, LEAVES at most."""
    return max(least, min(LEAVES, -(-total // LEAF)))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int | None = None, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``key``, ``size``, ``source_size``, ``target`` and ``pieces`` of every row.

    ``pieces`` has one entry for each pass over the source that takes words of the row: pass, words, the block it
    belongs to (that of its first word in the source's stream), the shard whose draw holds that block, and the
    block's order within the shard. What no shard has drawn is not taken. A null or empty text has size 0
    and no pieces; a null source is a source and sorts last; repeated rows are documents of their own; sources
    without words have target 0. Results depend on the rows and the seed alone. Other columns play no part.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), permutation_key(seed).alias("key"))
    rows = materialize(rows.withColumn("bucket", F.substring("key", 1, 3)), "mix-rows")
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix-buckets")
    goal = materialize(targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs), "mix-targets")
    per = goal.select("source", "source_size", F.ceil(F.round("target") / block).cast("long").alias("quota")).orderBy(F.col("source").asc_nulls_last()).collect()  # one row per source
    n_shards = shards or leaves(sum(r.source_size for r in per))
    dealt = split_quotas([r.quota for r in per], n_shards, seed).cumsum(axis=0) if per else np.zeros((n_shards, 0), dtype=np.int64)
    ends = docs.sparkSession.createDataFrame([(r.source, [int(x) for x in dealt[:, k]]) for k, r in enumerate(per)], "src string, ends array<long>")
    plan = goal.join(ends, F.col("source").eqNullSafe(F.col("src"))).select("src", "source_size", "target", "ends")
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), ahead.alias("ahead"))
    within = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (
        rows.withColumn("within", within)
        .join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .join(F.broadcast(plan) if len(per) <= 10_000 else plan, F.col("source").eqNullSafe(F.col("src")))
        .withColumn("at", F.col("ahead") + F.col("within"))
        .withColumn("asked", F.round("target").cast("long"))
    )
    zero = F.lit(0).cast("long")

    def piece(epoch: Column) -> Column:
        first = epoch * F.col("source_size") + F.col("at")
        own = F.floor(first / block)
        return F.struct(
            epoch.cast("int").alias("epoch"), F.greatest(zero, F.least(F.col("size"), F.col("asked") - first)).cast("long").alias("n"), own.alias("block"),
            F.size(F.filter("ends", lambda end: end <= own)).cast("int").alias("shard"), F.xxhash64(F.lit(seed), F.col("source"), own).alias("order"),
        )

    passes = F.transform(F.array(*[F.lit(e).cast("long") for e in range(max_epochs)]), piece)
    pieces = F.filter(passes, lambda p: (p["n"] > 0) & (p["shard"] < F.size("ends")))
    return placed.withColumn("pieces", pieces).select("doc_id", "source", "key", "size", "source_size", "target", "pieces")


def taken(mixed: DataFrame) -> DataFrame:
    """Words taken of each document, summed over the pieces that the shards drew."""
    words = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return mixed.select("doc_id", "size", "source_size", F.round(F.col("target"), 6).alias("target"), words.alias("taken"))


def draw_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix as its shards hold it: ``shard``, ``order`` (the block's place in it), ``epoch``, ``n``, and ``_row``, the document's row.

    Each shard's blocks are drawn and shuffled locally: rows are partitioned by shard (a large shard by slices of its
    order as well) and sorted by block, then by a digest of their own, within. The one document of a source at which the
    stream ends may be taken in part: its first words, with the white space between them; ``n_chars``, if there, follows
    the text. Of rows that agree in id, source and text, the further columns of one stand for all.
    """
    seed = options.get("seed", SEED)
    mixed = mix(docs, **options).select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.explode("pieces").alias("_p"))
    takes = mixed.select("_key", "_size", F.col("_p.n").alias("_n"), F.col("_p.shard").alias("_shard"), F.col("_p.order").alias("_order"), F.col("_p.epoch").alias("_epoch"))
    takes = materialize(takes, "mix-takes")
    words, top = takes.agg(F.sum("_n"), F.max("_shard")).first()
    slices = max(1, -(-(words or 0) // ((top or 0) + 1) // SLICE))
    rows = docs.select(packed(docs), permutation_key(seed).alias("_key"))
    rows = rows.join(takes.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    text = F.col("_row.text")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + TOKEN), F.lit(0)), 1, F.col("_n").cast("int")), "")
    cut = F.when(F.col("_n") >= F.col("_size"), text).otherwise(part)
    out = rows.join(takes, "_key").withColumn("_row", F.col("_row").withField("text", cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("_row", F.col("_row").withField("n_chars", F.length("_row.text").cast(docs.schema["n_chars"].dataType)))
    slice_ = F.pmod(F.col("_order"), F.lit(slices)).cast("int")
    out = out.repartitionById(((top or 0) + 1) * slices, F.col("_shard") * slices + slice_)
    out = out.sortWithinPartitions("_shard", "_order", F.xxhash64(F.lit(seed), "_epoch", "_key"))
    return out.select(F.col("_shard").alias("shard"), F.col("_order").alias("order"), F.col("_epoch").alias("epoch"), F.col("_n").alias("n"), "_row")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the shards of the mix hold them, in their order: a row for each pass that takes words of a row. Columns are those of ``docs``."""
    return unpacked(draw_shards(docs, **options))
