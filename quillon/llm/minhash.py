"""Near-duplicate documents by HyperMinHash signatures, banding, and confirmation on full shingle sets.

A signature has one register per hash bucket: the leading-zero count of the bucket's smallest hash and the
mantissa bits that follow it. Bands of registers find candidates; the collision-corrected Jaccard estimate
drops hopeless ones; whatever is left is confirmed on whole shingle sets. Documents with equal sets are one
class, so copies never meet in pairs. Within a band's bucket everyone is compared with the smallest member. Where that
leaves several components, the members of all but the largest meet all members, block by block: by signature first,
then those with a likely partner by whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import TOKEN, bound_batches, connected_components, hot_keys, join_hot, materialize, packed, unpacked, work_tables_dropped
from quillon.llm.hashing import mix64, release, slices, word_hashes

SHINGLE, NUM, DEN = 5, 75, 100
#: 2^7 registers of 6 bits of exponent and 10 of mantissa, in 32 bands of 4: a pair at 0.75 is missed by all bands with probability 5e-6.
BUCKET_BITS, MANTISSA, BAND = 7, 10, 4
BANDS = (1 << BUCKET_BITS) // BAND
#: Candidates estimated this far below the threshold (over four standard errors) are not confirmed.
SLACK = 0.17
#: Members of an open bucket that meet at once; each is sent to as many blocks as the other side has. Smaller blocks spread over more tasks, larger ones send fewer copies, which a stage that drops rows prefers.
BLOCK, STAGE_BLOCK = 512, 1024


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the five-word shingles of texts, sorted within each text, and their bounds by text.

    Of fewer words the whole sequence is one shingle; texts without words have none.
    """
    words, of = word_hashes(texts)
    count = np.bincount(of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    width = np.minimum(count, SHINGLE)
    left = first[of + 1] - np.arange(len(words))  # words of the same text from here on
    start = np.flatnonzero(left >= width[of])
    out = np.zeros(len(start), dtype=np.uint64)
    for j in range(SHINGLE):
        more = j < width[of[start]]
        step = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(start + j, len(words) - 1)])
        out = np.where(more, step, out)
    owner, out = of[start], out + width[of[start]].astype(np.uint64)
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def registers(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (0: empty bucket), a row for each text. A larger register is a smaller minimum."""
    k, n = 1 << BUCKET_BITS, len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    v = mix64(sh ^ np.uint64(0xD6E8FEB86659FD93))
    cell = owner * k + (v >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    smallest = np.full(n * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(smallest, cell, v << np.uint64(BUCKET_BITS))
    full = np.zeros(n * k, dtype=bool)
    full[cell] = True
    zeros = np.clip(64 - np.frexp(np.maximum(smallest, np.uint64(1)).astype(np.float64))[1], 0, 50)
    mantissa = ((smallest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)).astype(np.int64)
    return np.where(full, ((zeros + 1) << MANTISSA) + ((1 << MANTISSA) - 1 - mantissa), 0).astype(np.uint16).reshape(n, k)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of signatures (rows), corrected for registers that agree by chance.

    Two unrelated minima share a register with the probability that they share a leading-zero count and mantissa;
    with n values in a bucket the minimum is near-exponential, which gives the sum below.
    """
    k = a.shape[1]
    used = (a > 0) | (b > 0)
    same = (a == b) & used
    exponent = np.arange(1, 52)
    edge = 2.0**-exponent
    cell = edge / (1 << MANTISSA)
    density = lambda n: (n[:, None] / k) * np.exp(-(n[:, None] / k) * edge)
    chance = ((1 << MANTISSA) * (density(na) * cell) * (density(nb) * cell)).sum(axis=1)
    n = np.maximum(used.sum(axis=1), 1)
    share = same.sum(axis=1) / n
    return np.clip((share - chance) / np.maximum(1 - chance, 1e-9), 0, 1)


SIGNED = "doc_id long, key long, n long, content binary, reg binary, bands array<long>"


def contents(sh: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each text's whole set, in its order; zeros for an empty set."""
    data = memoryview(np.ascontiguousarray(sh)).cast("B") if len(sh) else b""
    at = (8 * bounds).tolist()
    return [hashlib.blake2b(data[lo:hi], digest_size=16).digest() if hi > lo else bytes(16) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for texts in slices([x or b"" for x in batch.column(1).to_pylist()], 1 << 18):
            sh, bounds = shingles(texts)
            reg, n = registers(sh, bounds), np.diff(bounds)
            rows = reg.reshape(len(texts), BANDS, BAND).astype(np.uint64)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(texts), 1))
            for j in range(BAND):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
            some = rows.any(axis=2)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], some.sum(axis=1).cumsum()]), pa.int32()), pa.array(key[some].view(np.int64)))
            ids, keys = batch.column(0).slice(done, len(texts)), batch.column(2).slice(done, len(texts))
            done += len(texts)
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n, pa.int64()), pa.array(contents(sh, bounds), pa.binary()), pa.array([x.tobytes() for x in reg], pa.binary()), bands], ["doc_id", "key", "n", "content", "reg", "bands"])
    release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts; where an id is that of several texts, only those of the class asked for."""
    for batch in batches:
        done = 0
        for texts in slices([x or b"" for x in batch.column(1).to_pylist()], 1 << 18):
            sh, bounds = shingles(texts)
            part = batch.slice(done, len(texts))
            done += len(texts)
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sh.view(np.int64)))
            same = [x == y for x, y in zip(contents(sh, bounds), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["rep", "sh"]).filter(pa.array(same, pa.bool_()))
    release()


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b) whose full sets link."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = [_linked(left[k].values.to_numpy(), right[k].values.to_numpy()) for k in range(batch.num_rows)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    release()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures may belong to linked documents; tiny sets always pass."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
        keep = _hopeful(a, b, batch.column(4).to_numpy(), batch.column(5).to_numpy())
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _hopeful(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows) may belong to linked documents. Correction only lowers an estimate, so it is for those that agree enough without."""
    keep = DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)
    wide = np.flatnonzero(keep & (np.minimum(na, nb) >= 64))
    raw = ((a[wide] == b[wide]) & (a[wide] > 0)).sum(axis=1) / np.maximum(((a[wide] > 0) | (b[wide] > 0)).sum(axis=1), 1)
    near = wide[raw >= NUM / DEN - SLACK]
    keep[wide] = False
    keep[near] = estimate(a[near], b[near], na[near], nb[near]) >= NUM / DEN - SLACK
    return keep


CELL = "band long, i int, j int, rep long, comp long, minor boolean"


def _block_hopes(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of two blocks, as in ``_block_links``, whose signature agrees well enough with one of another component across them."""
    n, minor = table["n"].to_numpy(), table["minor"].to_numpy(zero_copy_only=False)
    reg = np.frombuffer(b"".join(table["reg"].to_pylist()), dtype=np.uint16).reshape(len(n), -1)
    comp, hope = table["comp"].to_numpy(), np.zeros(len(n), dtype=bool)
    for k in np.flatnonzero(minor):
        other = np.flatnonzero((comp != comp[k]) & (DEN * np.minimum(n, n[k]) >= NUM * np.maximum(n, n[k])))
        met = other[_hopeful(reg[other], np.broadcast_to(reg[k], (len(other), reg.shape[1])), n[other], np.full(len(other), n[k]))]
        hope[met] = True
        hope[k] |= len(met) > 0
    return table.select(["band", "i", "j", "rep", "comp", "minor"]).filter(pa.array(hope, pa.bool_()))


def _block_links(key: tuple, table: pa.Table) -> pa.Table:
    """Links between a block of a bucket's minority and a block of all its members, of components that are not one yet; a spanning set of them."""
    reps, comp, minor = table["rep"].to_numpy(), table["comp"].to_numpy(), table["minor"].to_numpy(zero_copy_only=False)
    sets = [x.values.to_numpy() for x in table["sh"].combine_chunks()]
    parent = {c: c for c in set(comp.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    size, at, found = np.array([len(x) for x in sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), []
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(inverse, kind="stable")
    posting, starts = owner[order], np.searchsorted(inverse[order], np.arange(len(values) + 1))
    for k in np.flatnonzero(minor):
        ids = inverse[at[k] : at[k + 1]]
        both = np.bincount(np.concatenate([posting[starts[i] : starts[i + 1]] for i in ids]), minlength=len(sets))
        for j in np.flatnonzero((DEN * both >= NUM * (size + size[k] - both)) & (comp != comp[k])):
            if (x := root(comp[k])) != (y := root(comp[j])):
                parent[max(x, y)] = min(x, y)
                found.append((int(reps[k]), int(reps[j])))
    del sets, values, inverse, owner, order, posting
    release()
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _key() -> Column:
    """What tells texts under one id apart."""
    return F.xxhash64(F.col("text").cast("binary"))


def _whole_sets(text: DataFrame, signed: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rep`` and the whole set ``sh`` of each class in ``chosen``, from one document that holds it."""
    holders = signed.join(chosen.select("content", "n", "rep"), ["content", "n"]).groupBy("rep", "content").agg(F.min("doc_id").alias("doc_id"))
    texts = text.join(holders, text.doc_id.eqNullSafe(holders.doc_id)).select("rep", "text", "content")
    return materialize(texts.mapInArrow(_sets, "rep long, sh array<long>").dropDuplicates(["rep"]), "near-sets")


def _components(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Each row's ``doc_id``, ``key``, ``n`` and ``content``, and the component of each class: its name and smallest id."""
    bound_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialize(text.withColumn("key", _key()).mapInArrow(_sign, SIGNED), "near-signed")
    classes = signed.where("n > 0").groupBy("content", "n").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.xxhash64("content"), "reg", "bands")).alias("x"))
    # Classes are named by a hash of their content: ids may repeat, or be null.
    classes = materialize(classes.select(F.xxhash64("content", "n").alias("rep"), "content", "n", "low", "x.reg", "x.bands"), "near-classes")

    rows = classes.select(F.explode("bands").alias("band"), "rep")
    # Buckets with the same members need one look: their count, sum and smallest member tell them apart.
    buckets = rows.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("lead"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    buckets = materialize(buckets.where("m > 1").groupBy("m", "lead", "who").agg(F.min("band").alias("band")).select("band", "lead", "m"), "near-buckets")
    top = [r.band for r in buckets.where("m > 1000").orderBy(F.desc("m"), "band").limit(200).collect()]
    members = materialize(join_hot(rows, buckets, "band", top), "near-members")

    pairs = materialize(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    hubs = hot_keys(pairs, "a")
    regs = classes.select("rep", "reg", "n")
    signed_pairs = join_hot(pairs, regs.toDF("a", "reg_a", "n_a"), "a", hubs).join(regs.toDF("b", "reg_b", "n_b"), "b").select("a", "b", "reg_a", "reg_b", "n_a", "n_b")
    likely = materialize(signed_pairs.mapInArrow(_likely, "a long, b long"), "near-likely")

    # Full sets, of the classes that some comparison asks for only: one document of each.
    asked = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
    sets = _whole_sets(text, signed, classes.join(asked, "rep"))
    linked = join_hot(likely, sets.toDF("a", "sh_a"), "a", hubs).join(sets.toDF("b", "sh_b"), "b").select("a", "b", "sh_a", "sh_b")
    links = materialize(linked.mapInArrow(_confirm, "a long, b long"), "near-links")
    comps = materialize(connected_components(links), "near-star")

    # Buckets of three and more whose members the comparisons with the smallest left apart.
    state = members.where("m > 2").join(comps, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    split = lambda df: df.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    state = materialize(state.join(split(state), "band"), "near-open")
    # Each bucket's largest component needs no look at itself: the others, its minority, meet all members, block by block.
    main = state.groupBy("band", "comp").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("m"))
    state = state.join(main, "band").withColumn("minor", F.col("comp") != F.col("main"))
    down, across = (F.ceil(x / block).cast("int") for x in (F.col("m") - F.col("most"), F.col("m")))
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    side = state.where(~F.col("minor") | (F.col("m") > block))  # in a bucket of one block the minority is there already
    cells = state.where("minor").withColumn("i", own(down)).withColumn("j", all_of(across)).unionByName(side.withColumn("minor", F.lit(False)).withColumn("j", own(across)).withColumn("i", all_of(down)))
    # Signatures meet first: whole sets are fetched for, and sent to, the cells of those that agree well enough there.
    hopes = cells.select("band", "i", "j", "rep", "comp", "minor").join(regs, "rep").groupBy("band", "i", "j").applyInArrow(_block_hopes, CELL)
    hopes = materialize(hopes, "near-hopes")
    late = _whole_sets(text, signed, classes.join(hopes.select("rep").distinct(), "rep").join(asked, "rep", "left_anti"))
    more = hopes.join(sets.unionByName(late), "rep").groupBy("band", "i", "j").applyInArrow(_block_links, "a long, b long")
    links = links.unionByName(materialize(more, "near-more"))
    comps = materialize(connected_components(links), "near-comps")

    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select("content", "n", "low", F.coalesce("component", "rep").alias("comp"))
    least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    return signed.select("doc_id", "key", "n", "content"), named.join(least, "comp").select("content", "n", "comp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs`` (``doc_id``, ``text``).

    Rows with equal shingle sets are one class, linked whole; texts without words (null, empty, white space) have
    empty sets and link with nothing. Repeated rows give repeated results; a null id links like any other
    but never names a component unless all ids in it are null, and is kept only then; other columns play no
    part; an empty table gives an empty result.
    """
    signed, named = _components(docs, BLOCK)
    out = signed.select("doc_id", "content", "n").join(named.drop("comp"), ["content", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, null ids last.

    Groups are the components of texts, whatever their ids: unrelated texts under one id, or under none, all stay.
    Texts without words link with nothing; of those only rows that repeat an id and a text are one group.
    """
    with work_tables_dropped(docs.sparkSession):
        signed, named = _components(docs, STAGE_BLOCK)
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")
        linked = signed.where("n > 0").join(named.select("content", "n", "comp"), ["content", "n"]).groupBy("comp").agg(best).select("x.doc_id", "x.key")
        blank = signed.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "key")
        kept = materialize(linked.unionByName(blank).distinct(), "near-kept", keep=True).toDF("_kept_id", "_kept_key")

    loose = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(TOKEN), F.lit(False))
    rows = docs.where(~loose).select(packed(docs), F.col("doc_id").cast("long").alias("_id"), _key().alias("_key"))
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    # Rows that repeat an id and a text differ in other columns at most.
    first = W.partitionBy("_id", "_key").orderBy(F.xxhash64("_row"))
    rows = rows.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    return unpacked(rows).unionByName(docs.where(loose))
