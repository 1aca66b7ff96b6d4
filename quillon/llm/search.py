"""Ranked lexical search by MaxScore with pair bounds.

Documents keep their terms, as far as queries ask for them, in a forward index; its partitions are the shards of the search.
One pass over it gives each term's largest impact and, for pairs of terms of one query, the length of their
intersection and their largest joint impact, which no document can pass: two terms seldom peak in one document, so
the joint bound is below the sum of the two. The same pass scores the documents with a query's rarest terms, whose
k-th best is a floor for what can still be returned. Against that floor a query's commonest terms together, bounded
pair by pair, are not worth a look by themselves: only documents with one of its other terms are candidates, and of those
only such whose known part plus that bound reaches the floor are scored in full. Scores are integers, so bounds are exact
comparisons and nothing is lost. Partitions return their k best per query; two windows take the k best of all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches, materialize
from quillon.llm.hashing import release

TOP = 20
#: Queries that one pass takes, and the bytes of their texts, on average: what tasks are sent grows with these alone. More queries take more passes.
QUERIES, QUERY_BYTES = 20_000, 4 << 20
#: Documents scored together, meetings of postings and query terms held at once, and the slices in which the best of a query are ranked first.
ROWS, MEETINGS, SALTS = 4096, 1 << 21, 64

_STRIP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and anything beyond ASCII."""
    return (text or b"").translate(_STRIP).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _index(vocabulary: dict[bytes, int]):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, tf = [], [], []
            for k in range(batch.num_rows):
                words = terms_of(batch.column(1)[k].as_py())
                found = Counter(w for w in map(vocabulary.get, words) if w is not None)
                own = sorted(found)
                n.append(len(words))
                at.append(own)
                tf.append([found[t] for t in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "at", "tf"])
        release()

    return index


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total) if total else np.zeros(0, dtype=np.int64)


class Plan:
    """What tasks know of a block of queries: each query's terms with their repeats, terms' weights, and corpus figures."""

    def __init__(self, queries: list[dict[int, int]], df: np.ndarray, docs: int, words: int):
        self.docs, self.words = docs, words
        self.w = np.array([weight(docs, int(x)) for x in df], dtype=np.int64)
        self.df = df
        self.start = np.cumsum([0] + [len(q) for q in queries])
        # A query's terms, commonest first: in the order in which they lose their say.
        order = [sorted(q, key=lambda t: (self.w[t], t)) for q in queries]
        self.term = np.array([t for o in order for t in o], dtype=np.int64)
        self.times = np.array([q[t] for q, o in zip(queries, order, strict=True) for t in o], dtype=np.int64)
        self.query = np.repeat(np.arange(len(queries)), np.diff(self.start))
        pairs = sorted({(min(o[k], o[k + 1]), max(o[k], o[k + 1])) for o in order for k in range(0, len(o) - 1, 2)})
        self.pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)

    def impacts(self, rows: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each posting adds to a score: 64-bit integers, divided downwards."""
        m = 75 + (25 * n * self.docs) // max(self.words, 1)
        return self.w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]))

    def lists(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the chosen query terms by term: bounds per term, and the places in order."""
        places = np.flatnonzero(chosen)
        places = places[np.argsort(self.term[places], kind="stable")]
        return np.searchsorted(self.term[places], np.arange(len(self.w) + 1)), places

    def score(self, rows: np.ndarray, query: np.ndarray, key: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Full scores of (row, query) pairs; ``key`` is row x terms + term of the postings, ascending."""
        counts = np.diff(self.start)[query]
        place = _runs(self.start[query], counts)
        pair = np.repeat(np.arange(len(rows)), counts)
        want = rows[pair] * len(self.w) + self.term[place]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        out = np.zeros(len(rows), dtype=np.int64)
        if len(key):
            np.add.at(out, pair, np.where(key[at] == want, self.times[place] * impact[at], 0))
        return out


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, lengths, and the postings' rows, terms and counts, of some thousand documents at a time."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            yield batch.column(0), batch.column(1).to_numpy(), rows, batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64)


class Best:
    """The k best documents of each query so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.held = k, None

    def add(self, query: np.ndarray, ids: pa.Array, rows: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        null = ids.is_null().to_numpy(zero_copy_only=False)[rows]
        own = ids.fill_null(0).to_numpy()[rows]
        new = (query, null, own, score)
        q, null, own, score = new if self.held is None else tuple(np.concatenate(x) for x in zip(self.held, new, strict=True))
        order = np.lexsort((own, null, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        self.held = q[rank < self.k], null[keep], own[keep], score[keep]

    def table(self) -> pa.RecordBatch:
        q, null, own, score = self.held if self.held is not None else (np.zeros(0, dtype=np.int64),) * 4
        ids = pa.array(own.astype(np.int64), mask=np.asarray(null, dtype=bool))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids, pa.array(score, pa.int64())], ["q", "doc_id", "score"])


SEEN = "kind string, a int, b long, n long, value long"


def _survey(plan: Plan, k: int):
    """Largest impacts of terms and pairs, intersection lengths, and the k best documents among those with a query's rarest terms."""
    first = np.zeros(len(plan.term), dtype=bool)
    for lo, hi in zip(plan.start[:-1], plan.start[1:], strict=True):
        have = 0
        for place in range(hi - 1, lo - 1, -1):  # the rarest first
            first[place] = True
            have += plan.df[plan.term[place]]
            if have >= 5 * k:
                break
    bounds, places = plan.lists(first)
    partner = np.searchsorted(plan.pairs[:, 0], np.arange(len(plan.w) + 1))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, joint, both, best = np.zeros(len(plan.w), dtype=np.int64), np.zeros(len(plan.pairs), dtype=np.int64), np.zeros(len(plan.pairs), dtype=np.int64), Best(k)
        for ids, n, rows, term, tf in _postings(batches):
            impact = plan.impacts(rows, n, term, tf)
            key = rows * len(plan.w) + term
            np.maximum.at(single, term, impact)
            count = np.diff(partner)[term]
            pair = _runs(partner[term], count)
            from_ = np.repeat(np.arange(len(term)), count)
            want = rows[from_] * len(plan.w) + plan.pairs[pair, 1]
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            met = np.flatnonzero(key[at] == want) if len(want) else np.zeros(0, dtype=np.int64)
            np.maximum.at(joint, pair[met], impact[from_[met]] + impact[at[met]])
            np.add.at(both, pair[met], 1)
            row, query = _candidates(plan, bounds, places, rows, term)
            best.add(query, ids, row, plan.score(row, query, key, impact))
        t, p, top = np.flatnonzero(single), np.flatnonzero(both), best.table()
        yield pa.RecordBatch.from_arrays([pa.array(["term"] * len(t), pa.string()), pa.array(t, pa.int32()), pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int64()), pa.array(single[t], pa.int64())], ["kind", "a", "b", "n", "value"])
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(p), pa.string()), pa.array(p, pa.int32()), pa.nulls(len(p), pa.int64()), pa.array(both[p], pa.int64()), pa.array(joint[p], pa.int64())], ["kind", "a", "b", "n", "value"])
        yield pa.RecordBatch.from_arrays([pa.array(["best"] * top.num_rows, pa.string()), top.column(0), top.column(1), pa.nulls(top.num_rows, pa.int64()), top.column(2)], ["kind", "a", "b", "n", "value"])
        release()

    return survey


def _candidates(plan: Plan, bounds: np.ndarray, places: np.ndarray, rows: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, query) pairs in which the row holds a term whose list counts for the query."""
    row, query, _ = _partial(plan, bounds, places, rows, term, np.zeros(len(term), dtype=np.int64))
    return row, query


def _partial(plan: Plan, bounds: np.ndarray, places: np.ndarray, rows: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs, and what the listed terms add to their scores. So many rows at a time as meet MEETINGS query terms, or one."""
    count = np.diff(bounds)[term]
    total, n, lo, out = np.cumsum(count), len(plan.start) - 1, 0, []
    while lo < len(rows):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MEETINGS, side="right"))
        hi = int(np.searchsorted(rows, rows[hi])) if hi < len(rows) else hi  # whole rows only
        hi = hi if hi > lo else int(np.searchsorted(rows, rows[lo], side="right"))
        some = slice(lo, hi)
        place = places[_runs(bounds[term[some]], count[some])]
        met, which = np.unique(np.repeat(rows[some], count[some]) * n + plan.query[place], return_inverse=True)
        part = np.zeros(len(met), dtype=np.int64)
        np.add.at(part, which, plan.times[place] * np.repeat(impact[some], count[some]))
        out.append((met // n, met % n, part))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3


def essential(plan: Plan, single: np.ndarray, joint: np.ndarray, floor: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Which query terms have a say of their own, and the bound of each query's others together.

    The others are the longest run of a query's commonest terms whose bound stays below the query's floor. Neighbours
    (first and second, third and fourth, ...) count as a pair: for no document is their sum above the larger of what they reach in
    one document and what either reaches alone.
    """
    own, rest = np.ones(len(plan.term), dtype=bool), np.zeros(len(plan.start) - 1, dtype=np.int64)
    at = {tuple(p): k for k, p in enumerate(plan.pairs.tolist())}
    for q, (lo, hi) in enumerate(zip(plan.start[:-1].tolist(), plan.start[1:].tolist(), strict=True)):
        done = 0
        for place in range(lo, hi):
            t, c = int(plan.term[place]), int(plan.times[place])
            bound = done + c * int(single[t])
            if pairs and (place - lo) % 2:
                s, d = int(plan.term[place - 1]), int(plan.times[place - 1])
                shared = min(c, d)
                together = shared * int(joint[at[min(s, t), max(s, t)]]) + (c - shared) * int(single[t]) + (d - shared) * int(single[s])
                bound = before + max(min(together, c * int(single[t]) + d * int(single[s])) if joint[at[min(s, t), max(s, t)]] else 0, c * int(single[t]), d * int(single[s]))
            if bound >= floor[q]:
                break
            before = done
            done = bound
            own[place], rest[q] = False, bound
    return own, rest


def _searcher(plan: Plan, own: np.ndarray, rest: np.ndarray, floor: np.ndarray, k: int):
    bounds, places = plan.lists(own)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for ids, n, rows, term, tf in _postings(batches):
            impact = plan.impacts(rows, n, term, tf)
            row, query, part = _partial(plan, bounds, places, rows, term, impact)
            hope = part + rest[query] >= floor[query]
            row, query = row[hope], query[hope]
            score = plan.score(row, query, rows * len(plan.w) + term, impact)
            good = (score >= floor[query]) & (score > 0)
            best.add(query[good], ids, row[good], score[good])
        yield best.table()
        release()

    return search


def _ranked(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k best rows of each ``by`` (columns ``doc_id``, ``score``), ranked within slices first, so that no task sees all rows of one."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    sliced = df.withColumn("_s", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    sliced = sliced.withColumn("_k", F.row_number().over(W.partitionBy(by, "_s").orderBy(*order))).where(F.col("_k") <= k)
    return sliced.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k).drop("_s", "_k")


def pair_lists(index: DataFrame, plan: Plan, k: int) -> tuple[DataFrame, DataFrame]:
    """What one pass over the index sees: largest impacts of terms and pairs with lengths of intersections, and each query's k best documents with its rarest terms."""
    seen = materialize(index.mapInArrow(_survey(plan, k), SEEN), "search-seen")
    bounds = seen.where("kind <> 'best'").groupBy("kind", "a").agg(F.sum("n").alias("n"), F.max("value").alias("value"))
    best = seen.where("kind = 'best'").select(F.col("a").alias("q"), F.col("b").alias("doc_id"), F.col("value").alias("score"))
    return bounds, _ranked(best, "q", k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, pairs: bool = True) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each query's ``k`` best rows of ``docs`` (``doc_id``, ``text``) with a score above 0.

    ``queries`` has ``item_id`` and ``text``; each of its rows is a query of its own, ids that repeat included. Null
    texts have no terms: such documents are found by nothing and count nowhere, such queries find nothing. Equal scores go by ascending
    id, null ids last; repeated rows are documents of their own. Other columns play no part; empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = queries.schema["item_id"].dataType
    asked = queries.select("item_id", F.col("text").cast("string").cast("binary").alias("text"), F.xxhash64("item_id", "text").alias("h"))
    total, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-total // QUERIES), -(-(size or 0) // QUERY_BYTES))
    made = [_block(docs, asked.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else asked, kind, k, pairs) for b in range(blocks)]
    out = made[0]
    for one in made[1:]:
        out = out.unionByName(one)
    return out


def _block(docs: DataFrame, asked: DataFrame, kind, k: int, pairs: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.select("item_id", "text").orderBy("h").collect()  # a block of queries
    counted = [Counter(terms_of(bytes(r.text) if r.text is not None else None)) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in counted for t in c}))}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    index = materialize(text.mapInArrow(_index(vocabulary), "doc_id long, n long, at array<int>, tf array<int>").where("n > 0"), "search-index", "zstd")
    n, words = index.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in index.select(F.explode("at").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # the queries' terms
        df[r.t] = r.df
    plan = Plan([{vocabulary[t]: c for t, c in x.items()} for x in counted], df, n, words or 0)
    bounds, first = pair_lists(index, plan, k)
    single, joint = np.zeros(len(vocabulary), dtype=np.int64), np.zeros(len(plan.pairs), dtype=np.int64)
    for r in bounds.collect():  # terms, and at most half as many pairs as queries have terms
        (single if r.kind == "term" else joint)[r.a] = r.value
    floor = np.zeros(len(rows), dtype=np.int64)
    for r in first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
        floor[r.q] = r.least
    own, rest = essential(plan, single, joint, floor, pairs)
    found = index.mapInArrow(_searcher(plan, own, rest, floor, k), "q int, doc_id long, score long")
    names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], f"q int, item_id {kind.simpleString()}")
    return _ranked(found, "q", k).join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
