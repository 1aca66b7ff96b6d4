"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label, scaled to length 1, are sorted by the grid cells (of width epsilon) of their coordinates on
leading principal axes, and the sequence is cut into intervals. An interval knows the box around its
coordinates; two intervals whose boxes are further apart than epsilon hold no link. Pairs of long intervals are split
into pairs of shorter ones, level by level down to blocks, and blocks in a task again by halves, down to small leaves,
which are compared in double precision. Equal vectors are one representative with a count, so copies never meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches, connected_components, materialize

COSINE = 0.93
#: The axes are fitted on so many vectors at most (those of the smallest hashed ids); they steer pruning alone.
FIT_VECTORS, AXES = 4096, 8
BLOCK, LEAF, FAN = 1024, 128, 32


def _whole() -> Column:
    """A label, and a finite, non-zero vector without nulls."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that may link, their vectors as arrays of doubles; ``grp`` keeps labels and lengths apart."""
    grp = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    return vectors.where(_whole()).select(F.col("vec_id").cast("long").alias("vec_id"), grp.alias("grp"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("v"))


def rest(vectors: DataFrame) -> DataFrame:
    """The rows that ``usable`` leaves out."""
    return vectors.where(~_whole()).select(F.col("vec_id").cast("long").alias("vec_id"))


def fit_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length; other lengths go by their first coordinates."""
    rows = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(FIT_VECTORS).toPandas()
    out: dict[int, np.ndarray] = {}
    for n in rows.v.map(len).unique() if len(rows) else ():
        x = np.stack(rows.v[rows.v.map(len) == n].to_list())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[int(n)] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:AXES].T
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _coordinates(unit: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    base = axes.get(unit.shape[1])
    x = unit @ base if base is not None else unit[:, :AXES]
    return np.hstack([x, np.zeros((len(x), AXES - x.shape[1]))])


def _grid(axes: dict[int, np.ndarray], eps: float):
    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            lengths, at = vectors.value_lengths().to_numpy(), vectors.offsets.to_numpy()
            flat = vectors.values.to_numpy()
            cells = np.zeros((batch.num_rows, AXES), dtype=np.int32)
            for n in np.unique(lengths):  # nearly always one length
                own = np.flatnonzero(lengths == n)
                cells[own] = np.floor(_coordinates(_scaled(flat[at[own][:, None] + np.arange(n)]), axes) / eps)
            order = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * AXES, pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, order], ["grp", "rep", "v", "n", "cell"])

    return grid


BLOCKS = "grp string, part int, blk long, lo array<double>, hi array<double>, reps array<long>, counts array<long>, v array<double>"


def _blocks(axes: dict[int, np.ndarray]):
    """Cuts a sorted partition into blocks of one group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, blk = context.partitionId() if context else 0, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            x = _coordinates(_scaled(np.array([h[2] for h in held])), axes)
            row = {"grp": held[0][0], "part": part, "blk": blk, "lo": x.min(axis=0).tolist(), "hi": x.max(axis=0).tolist(), "reps": [h[1] for h in held], "counts": [h[3] for h in held], "v": np.array([h[2] for h in held]).ravel().tolist()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("grp", pa.string()), ("part", pa.int32()), ("blk", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("reps", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))]))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (row[0] != held[0][0] or len(held) == BLOCK):
                    yield block()
                    blk, held = blk + 1, []
                held.append(row)
        if held:
            yield block()

    return cut


def _near(a: str, b: str, eps: float):
    """Whether two boxes come within epsilon of each other."""
    gap = F.zip_with(F.zip_with(f"{a}_lo", f"{b}_hi", lambda x, y: x - y), F.zip_with(f"{b}_lo", f"{a}_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + 1e-9


def numbered(blocks: DataFrame) -> DataFrame:
    """Numbers the blocks through in the order of the sequence: those of earlier partitions come first."""
    sizes = blocks.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition, 20,000 at most
    ahead = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return blocks.join(F.broadcast(ahead), F.col("part") == F.col("p")).withColumn("blk", F.col("blk") + F.col("ahead")).drop("part", "p", "ahead")


def block_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """Pairs (``a``, ``b``), a <= b, of blocks of one group that may hold links.

    Intervals of FAN blocks, of FAN such intervals and so on have the boxes around theirs. From the longest, of which
    a group has FAN at most, pairs of near intervals are split into the pairs of their parts, level by level,
    so what is provably apart is dropped early and no task meets all pairs of a group.
    """
    axis = lambda f, c, k: f(F.element_at(c, k))
    last = boxes.agg(F.max("blk")).first()[0] or 0
    levels = [boxes.select("grp", F.col("blk").alias("node"), "lo", "hi")]
    while last >= FAN:
        last //= FAN
        up = levels[-1].groupBy("grp", F.floor(F.col("node") / FAN).alias("node")).agg(
            F.array(*[axis(F.min, "lo", k + 1) for k in range(AXES)]).alias("lo"), F.array(*[axis(F.max, "hi", k + 1) for k in range(AXES)]).alias("hi")
        )
        levels.append(materialize(up, "ego-level"))
    side = lambda nodes, s: nodes.select("grp", F.floor(F.col("node") / FAN).alias(f"{s}_up"), F.col("node").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"))
    near = (F.col("a") <= F.col("b")) & _near("a", "b", eps)
    top = levels.pop()
    pairs = side(top, "a").drop("a_up").join(side(top, "b").drop("b_up"), "grp").where(near).select("grp", "a", "b")  # FAN nodes of a group at most
    while levels:
        nodes = levels.pop()
        above = materialize(pairs.select("grp", F.col("a").alias("a_up"), F.col("b").alias("b_up")), "ego-pairs")
        pairs = above.join(side(nodes, "a"), ["grp", "a_up"]).join(side(nodes, "b"), ["grp", "b_up"]).where(near).select("grp", "a", "b")
    return pairs.select("a", "b")


def _leaves(xa: np.ndarray, xb: np.ndarray, a: slice, b: slice, eps: float) -> Iterator[tuple[slice, slice]]:
    """Halves two intervals until both are small, skipping those provably apart."""
    ca, cb = xa[a], xb[b]
    gap = np.maximum(np.maximum(ca.min(axis=0) - cb.max(axis=0), cb.min(axis=0) - ca.max(axis=0)), 0)
    if (gap * gap).sum() > eps * eps + 1e-9:
        return
    na, nb = a.stop - a.start, b.stop - b.start
    if max(na, nb) <= LEAF:
        yield a, b
    elif na >= nb:
        mid = (a.start + a.stop) // 2
        yield from _leaves(xa, xb, slice(a.start, mid), b, eps)
        yield from _leaves(xa, xb, slice(mid, a.stop), b, eps)
    else:
        mid = (b.start + b.stop) // 2
        yield from _leaves(xa, xb, a, slice(b.start, mid), eps)
        yield from _leaves(xa, xb, a, slice(mid, b.stop), eps)


def _leaf_edges(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie every linked vector of a leaf to the first row it reaches there, by repeated minima over rows and columns."""
    rows, cols = np.nonzero(linked)
    label = np.arange(linked.shape[0])
    while True:
        by_col = np.full(linked.shape[1], linked.shape[0])
        np.minimum.at(by_col, cols, label[rows])
        new = label.copy()
        np.minimum.at(new, rows, by_col[cols])
        if (new == label).all():
            break
        label = new
    r, c = np.unique(rows), np.unique(cols)
    return np.concatenate([left[r], right[c]]), np.concatenate([left[label[r]], left[by_col[c]]])


def _span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def _join(axes: dict[int, np.ndarray], cosine: float, eps: float):
    """For a pair of blocks: (vector, number of vectors linked to it, itself), and edges (vector, 0, vector) that span what links within the pair."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [x == y for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for k in range(batch.num_rows):
                (ra, ca, va), (rb, cb, vb) = ([batch.column(c + d)[k].values.to_numpy() for d in range(3)] for c in (2, 5))
                ua, ub = _scaled(va.reshape(len(ra), -1)), _scaled(vb.reshape(len(rb), -1))
                na, nb = np.zeros(len(ra), dtype=np.int64), np.zeros(len(rb), dtype=np.int64)
                edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for x, y in _leaves(_coordinates(ua, axes), _coordinates(ub, axes), slice(0, len(ra)), slice(0, len(rb)), eps):
                    linked = ua[x] @ ub[y].T >= cosine
                    if same[k]:
                        linked &= np.arange(x.start, x.stop)[:, None] != np.arange(y.start, y.stop)[None, :]
                    if linked.any():
                        na[x] += linked @ cb[y]
                        nb[y] += linked.T @ ca[x]
                        edges.append(_leaf_edges(linked, ra[x], rb[y]))
                ids, counts = (ra, na) if same[k] else (np.concatenate([ra, rb]), np.concatenate([na, nb]))
                ids, counts = ids[counts > 0], counts[counts > 0]
                ea, eb = _span(*(np.concatenate(e) for e in zip(*edges, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, ea])), pa.array(np.concatenate([counts, np.zeros(len(ea), np.int64)])), pa.array(np.concatenate([ids, eb]))], ["a", "n", "b"])

    return join


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Only rows of one label and one length are compared. Rows with a null label, or a vector that is null, empty, zero
    or holds null or non-finite components, link with nothing and are their own component. Repeated rows
    count as other vectors; a null id links but names no component unless it is alone. Other columns play no part; an
    empty table gives an empty result.
    """
    eps = math.sqrt(2 - 2 * cosine)
    bound_batches(vectors.sparkSession)
    good = usable(vectors).withColumn("rep", F.xxhash64("grp", "v"))
    good = materialize(good, "ego-rows")
    reps = materialize(good.groupBy("rep", "grp", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")), "ego-reps")
    n = reps.count()
    axes = fit_axes(reps)
    # Written once: sorting by ranges reads its input twice.
    gridded = materialize(reps.select("grp", "rep", "v", "n").mapInArrow(_grid(axes, eps), "grp string, rep long, v array<double>, n long, cell array<int>"), "ego-grid")
    parts = max(1, min(n // (8 * BLOCK), 20_000))
    ordered = gridded.repartitionByRange(parts, "grp", "cell", "rep").sortWithinPartitions("grp", "cell", "rep")
    blocks = numbered(materialize(ordered.select("grp", "rep", "v", "n").mapInArrow(_blocks(axes), BLOCKS), "ego-blocks"))
    pairs = block_pairs(blocks.select("grp", "blk", "lo", "hi"), eps)
    left, right = (blocks.select(F.col("blk").alias(s), F.col("reps").alias(f"{s}_reps"), F.col("counts").alias(f"{s}_counts"), F.col("v").alias(f"{s}_v")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_reps", "a_counts", "a_v", "b_reps", "b_counts", "b_v")
    found = materialize(both.mapInArrow(_join(axes, cosine, eps), "a long, n long, b long"), "ego-links")
    degree = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "rep")
    comps = materialize(connected_components(found.where("n = 0").select("a", "b")), "ego-comps").withColumnRenamed("node", "rep")
    named = reps.select("rep", "n", "low").join(degree, "rep", "left").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(least, "component").select("rep", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "rep").join(named, "rep").select("vec_id", "n_links", "component_id")
    key = F.col("vec_id")
    alone = rest(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), key.alias("component_id"))
    return linked.unionByName(alone).withColumn("component_id", F.coalesce("component_id", "vec_id")).withColumn("kept", key.eqNullSafe(F.col("component_id")))
