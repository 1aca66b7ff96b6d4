"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

A benchmark item is a set of windows of ``window`` consecutive words. A document holds a window only if it
holds each of its words, so under containment one word is the necessary prefix: the window's rarest word by the
corpus's own counts. Documents' words are joined on that word alone, without their texts; a match's start and end must lie
within the document (length and positional bounds) and the words on either side must fit. Texts with a candidate are
then fetched once each, and the words in between must equal the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, ascii_lower, materialize, packed, unpacked

WINDOW = 10
#: Broadcast the windows only up to so many of them; beyond, Spark joins by a shuffle on the prefix word.
BROADCAST_WINDOWS = 200_000
#: Broadcast what is found of texts only up to so many texts; beyond, it is joined by a shuffle on their digest.
BROADCAST_TEXTS = 100_000
#: In a shuffle, words and texts that occur more often than this, and more than a 2,000th of all, are dealt over SALTS tasks.
HOT, SALTS = 100_000, 64


def words(text: Column) -> Column:
    """Words of a text as they are written; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item`` (the id as a string; null: empty) and ``win``, an array of words, A-Z lower-cased: every window of every item."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(ascii_lower(F.col("text"))).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return item.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).distinct()


def _content(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each distinct text that holds a window: ``content`` (its digest), ``spans`` (sorted starts and ends) and ``items``.

    Words are joined by ``lower``, which merges more than A-Z; what the join finds is then compared exactly.
    """
    pairs = item_windows(benchmark, window).withColumn("win", F.array_join("win", " ")).withColumn("n", F.size(F.split("win", " ")))
    pairs = pairs.groupBy("win", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    pairs = materialize(pairs, "bench-windows")
    small = pairs.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = pairs.select(F.explode(F.split("win", " ")).alias("word")).select(F.lower("word").alias("word")).distinct()
    listed = docs.select(_content(F.col("text")).alias("content"), words(F.col("text")).alias("w"))
    # How common each benchmark word is in the whole corpus.
    said = listed.select(F.explode("w").alias("word")).select(F.lower("word").alias("word"))
    count = lambda df: df.groupBy("word").agg(F.count("*").alias("freq"))
    seen = count(said.join(F.broadcast(vocabulary), "word")) if small else count(said).join(vocabulary, "word")
    rarity = materialize(vocabulary.join(seen, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq")), "bench-rarity")
    at = lambda k: F.lower(F.try_element_at(F.split("win", " "), (F.col("p.at") + 1 + k).cast("int")))
    prefix = (
        pairs.select("win", "n", F.posexplode(F.split("win", " ")).alias("at", "word")).withColumn("word", F.lower("word")).join(rarity, "word")
        .groupBy("win", "n").agg(F.min(F.struct("freq", "word", "at")).alias("p"))
        .select("win", "n", F.col("p.word").alias("word"), F.col("p.freq").alias("freq"), F.col("p.at").alias("at"), F.when(F.col("p.at") > 0, at(-1)).alias("left"), at(1).alias("right"))
    )
    prefix = materialize(prefix, "bench-prefix")
    # Each word with its place and neighbours; the array of words itself goes no further.
    near = F.transform("w", lambda x, i: F.struct(i.alias("pos"), F.lower(x).alias("word"), F.when(i > 0, F.try_element_at("w", i)).alias("before"), F.try_element_at("w", i + 2).alias("after")))
    placed = listed.select("content", F.size("w").alias("words"), F.explode(near).alias("x")).select("content", "words", "x.*")
    if not small:
        total = rarity.agg(F.sum("freq")).first()[0] or 0
        common = prefix.where(F.col("freq") > max(HOT, total // 2000)).select("word").distinct().withColumn("hot", F.lit(True))  # 2,000 words at most
        salted = placed.join(F.broadcast(common), "word", "left")
        placed = salted.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("content", "pos"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        prefix = prefix.join(F.broadcast(common), "word", "left").withColumn("salt", F.explode(salts)).drop("hot")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("words"))
    for mine, its in (("left", "before"), ("right", "after")):
        fits = fits & (F.col(mine).isNull() | (F.lower(its) == F.col(mine)))
    met = placed.join(hint(prefix), ["word"] if small else ["word", "salt"]).where(fits).select("content", F.struct(start.alias("start"), "n", "win").alias("c")).distinct()
    # A text's candidates are fewer than its words times the windows that share a prefix and its neighbours.
    candidates = materialize(met.groupBy("content").agg(F.collect_list("c").alias("c")), "bench-candidates")
    holders = _attach(docs.select("text", _content(F.col("text")).alias("_content")), candidates, "inner").dropDuplicates(["content"])
    again = holders.select("content", "c", words(F.col("text")).alias("w"))
    same = lambda c: ascii_lower(F.array_join(F.slice("w", c["start"] + 1, c["n"]), " ")) == c["win"]
    found = again.select("content", F.explode(F.filter("c", same)).alias("c")).select("content", "c.*")
    found = found.join(hint(pairs.select("win", "items")), "win")
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    return materialize(found.groupBy("content").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")), "bench-found")


def _attach(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Joins what is known of texts to ``docs`` by their digest ``_content``: by broadcast if it is small, else by a shuffle that deals frequent texts over tasks."""
    if found.count() <= BROADCAST_TEXTS:
        return docs.join(F.broadcast(found), F.col("_content") == F.col("content"), how)
    many = docs.groupBy("_content").agg(F.count("*").alias("n"))
    limit = max(HOT, (many.agg(F.sum("n")).first()[0] or 0) // 2000)
    hot = materialize(many.where(F.col("n") > limit).select(F.col("_content").alias("hot")), "bench-hot")  # 2,000 texts at most
    told = found.join(F.broadcast(hot), F.col("content") == F.col("hot"), "left_semi")
    rest = docs.join(F.broadcast(hot), F.col("_content") == F.col("hot"), "left_anti").join(found, F.col("_content") == F.col("content"), how)
    return rest.unionByName(docs.join(F.broadcast(hot), F.col("_content") == F.col("hot"), "left_semi").join(F.broadcast(told), F.col("_content") == F.col("content"), how))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): its words, those within any occurrence of a benchmark window, and the items met.

    Null and empty texts have no words and are clean; items without words are ignored; an item shorter than
    the window is one window by itself. Repeated rows give repeated results, null ids are kept, other columns
    play no part; an empty benchmark leaves every document clean.
    """
    found = occurrences(docs, benchmark, window)
    none = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("hit"))
    union = F.aggregate("spans", none, lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).cast("long").alias("hit")))
    hits = found.select("content", union["hit"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("joined"))
    text = docs.select("doc_id", _content(F.col("text")).alias("_content"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return _attach(text, hits, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of a benchmark window; all columns stay as they are."""
    bad = occurrences(docs, benchmark, window).select("content")
    return unpacked(_attach(docs.select(packed(docs), _content(F.col("text")).alias("_content")), bad, "left_anti"))
