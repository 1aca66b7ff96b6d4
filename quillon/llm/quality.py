"""Quality classifier by hierarchical empirical Bayes.

A document has two kinds of evidence. Its text gives logits of being low in quality and of being toxic, from logistic
regressions over surface measures and a learnt lexicon. Its site's other documents give posteriors of the same two
rates: those of the path (source and language) shrink toward those of the host (source), which shrink toward the
global rate, each by a prior strength that the spread between hosts or paths sets. The two are added as logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import TOKEN, bound_batches, materialize, packed, unpacked

#: The text classifier is fitted on so many labelled rows at most, those of the smallest hashed ids.
FIT_ROWS = 20_000
#: Words of the lexicon, and the least documents that show one: this share of the labelled rows, three at least.
LEXICON, LEAST, SHARE = 2000, 3, 1 / 2500
TRAITS = ("low", "toxic")
#: Site tables of up to so many paths are broadcast; larger ones are joined by a shuffle.
BROADCAST_PATHS = 50_000
#: Labels are broadcast up to so many ids.
BROADCAST_LABELS = 200_000
REJECT = 0.5

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*+=^~@|\\/_<>{}[]", b".,;:", b"\n", b" \t\r")
_STRIP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def _words(data: bytes) -> list[bytes]:
    return data.translate(_STRIP).split()


def features(data: bytes, lexicon: dict[bytes, tuple[float, float]]) -> list[float]:
    """Surface measures of a text, and its lexicon words' weights for either trait."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = max(len(data), 1)
    shares = [float(counts[list(c)].sum()) / n for c in _CLASSES]
    tokens = data.split()
    words = _words(data)
    lines = [x for x in data.split(b"\n") if x]
    distinct = set(words)
    hits = [lexicon[w] for w in distinct if w in lexicon]
    low, toxic = (np.array(hits).T if hits else np.zeros((2, 1)))
    return [
        np.log1p(len(tokens)), *shares, np.sqrt(shares[3]), np.sqrt(shares[2]),
        len(distinct) / max(len(words), 1), len(set(lines)) / max(len(lines), 1), sum(map(len, tokens)) / max(len(tokens), 1),
        float(np.clip(low, 0, None).sum()), float(np.clip(toxic, 0, None).sum()), float(toxic.max()), float(low.max()),
    ]


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _labels(labels: DataFrame) -> DataFrame:
    """One row per labelled id; of several labels the mean counts."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.avg(1 - F.col("quality")).alias("y_low"), F.avg("toxic").cast("double").alias("y_toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The text classifier, from at most FIT_ROWS labelled documents. Without labels every logit is 0."""
    bound_batches(docs.sparkSession)
    known = _labels(labels)
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "quality-sample")
    total = sample.agg(F.count("*"), F.sum("y_low"), F.sum("y_toxic")).first()
    if not total[0]:
        return {"lexicon": {}, "mean": None, "std": None, "coef": None}
    plain = F.lower(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)))
    seen = sample.select(F.explode(words).alias("word"), "y_low", "y_toxic").groupBy("word").agg(F.count("*").alias("n"), F.sum("y_low").alias("low"), F.sum("y_toxic").alias("toxic")).where(F.col("n") >= max(LEAST, total[0] * SHARE))
    for trait, all_ in zip(TRAITS, total[1:], strict=True):
        rate = F.lit(max(all_, 0.5) / total[0])
        seen = seen.withColumn("z_" + trait, (F.col(trait) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1e-9))
        seen = seen.withColumn("w_" + trait, F.when(F.col("z_" + trait) > 4, F.log((F.col(trait) + rate) / (F.col("n") - F.col(trait) + 1 - rate)) - F.log(rate / (1 - rate))).otherwise(0.0))
    top = seen.where("z_low > 4 or z_toxic > 4").orderBy(F.desc(F.greatest("z_low", "z_toxic")), "word").limit(LEXICON).collect()
    lexicon = {r.word.encode(): (float(r.w_low), float(r.w_toxic)) for r in top}
    rows = sample.select(_measure(lexicon)(F.col("text")).alias("x"), "y_low", "y_toxic").toPandas()  # FIT_ROWS at most
    x = np.stack(rows.x)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    return {"lexicon": lexicon, "mean": mean, "std": std, "coef": np.stack([_regress(x, rows["y_" + t].to_numpy()) for t in TRAITS])}


def _measure(lexicon: dict):
    @F.pandas_udf("array<double>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([features((t or "").encode(), lexicon) for t in part])

    return measure


def scorer(model: dict):
    """A function of a text column: its logits of low quality and of toxicity. A text without words has logits (30, -30)."""

    @F.pandas_udf("low double, toxic double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            out = np.zeros((len(part), 2))
            if model["coef"] is not None and len(part):
                x = (np.array([features((t or "").encode(), model["lexicon"]) for t in part]) - model["mean"]) / model["std"]
                out = model["coef"][:, 0] + x @ model["coef"][:, 1:].T
            out[[not (t or "").encode().split() for t in part]] = 30.0, -30.0
            yield pd.DataFrame(np.clip(out, -30, 30), columns=["low", "toxic"])

    return score


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(mean: Column, spread: Column, noise: Column) -> Column:
    """Prior rows of a beta whose variance is what the spread exceeds sampling noise by (method of moments)."""
    between = F.greatest(spread - noise, F.lit(1e-6))
    return F.greatest(F.least(mean * (1 - mean) / between - 1, F.lit(1e6)), F.lit(20.0))


def sites(scored: DataFrame) -> DataFrame:
    """What is known of sites: sums of each trait by ``source`` and ``lang``, by source, and of all, with the prior strengths.

    ``scored`` has a rate of 0 to 1 for each trait in every row: its label if it has one, else its probability by text. Sums
    by path roll up to hosts and to all, so rows are grouped once, with partial sums before the shuffle.
    """
    paths = materialize(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TRAITS]), "quality-paths")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("host_n"), *[F.sum(t).alias("host_" + t) for t in TRAITS])
    all_ = paths.agg(F.sum("n").alias("all_n"), *[F.sum(t).alias("all_" + t) for t in TRAITS])
    hosts = hosts.crossJoin(F.broadcast(all_))  # one row
    out = paths.join(hosts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
    spread = []
    for t in TRAITS:
        mean = F.col("all_" + t) / F.col("all_n")
        deviation = lambda a, n, mean=mean: F.sum(F.col(n) * (F.col(a) / F.col(n) - mean) ** 2) / F.greatest(F.sum(n), F.lit(1))
        noise = F.count("*") * F.first(mean * (1 - mean)) / F.greatest(F.first("all_n"), F.lit(1))
        spread.append(hosts.agg(_strength(F.first(mean), deviation("host_" + t, "host_n"), noise).alias("k_host_" + t)))
        spread.append(out.agg(_strength(F.first(mean), deviation(t, "n"), noise).alias("k_path_" + t)))
    for one in spread:
        out = out.crossJoin(F.broadcast(one))  # one row
    sums = [x + t for t in TRAITS for x in ("", "host_", "all_", "k_host_", "k_path_")]
    return materialize(out.select(F.col("source").alias("_host"), F.col("lang").alias("_path"), *[F.col(c).alias("_" + c) for c in ("n", "host_n", "all_n", *sums)]), "quality-sites")


def _others(sum_: Column, n: Column, own: Column, prior: Column, strength: Column) -> Column:
    """Posterior rate of a group of ``n`` rows without the row whose rate is ``own``."""
    return (F.greatest(sum_ - own, F.lit(0.0)) + strength * prior) / (n - 1 + strength)


def adjustment(trait: str, own: Column) -> Column:
    """What a row's site says of it, in logits: the path's posterior, shrunk toward the host's and that toward the rate of all, each without the row itself."""
    col = lambda c: F.col("_" + c)
    mean = F.when(col("all_n") > 1, (col("all_" + trait) - own) / (col("all_n") - 1)).otherwise(0.5)
    host = _others(col("host_" + trait), col("host_n"), own, mean, col("k_host_" + trait))
    path = _others(col(trait), col("n"), own, host, col("k_path_" + trait))
    return F.coalesce(_logit(path) - _logit(mean), F.lit(0.0))


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _with_sites(rows: DataFrame, table: DataFrame) -> DataFrame:
    table = F.broadcast(table) if table.count() <= BROADCAST_PATHS else table
    return rows.join(table, F.col("source").eqNullSafe(F.col("_host")) & F.col("lang").eqNullSafe(F.col("_path")), "left")


def _scored(docs: DataFrame, labels: DataFrame, keep_rows: bool) -> DataFrame:
    """Each row's logits by text and posteriors, with the row itself (``_row``) if asked for; texts are scored once."""
    model = fit(docs, labels)
    key = F.col("doc_id").cast("long")
    first = docs.select(*([packed(docs)] if keep_rows else []), key.alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), scorer(model)(F.col("text").cast("string")).alias("_s"))
    rest = ["_row"] if keep_rows else []
    scored = materialize(first.select(*rest, "doc_id", "source", "lang", "_s.low", "_s.toxic"), "quality-scored", "zstd")
    known = _labels(labels).withColumnRenamed("doc_id", "_id")
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    rated = scored.join(known, F.col("doc_id") == F.col("_id"), "left").withColumns({"r_" + t: F.coalesce("y_" + t, _probability(F.col(t))) for t in TRAITS})
    table = sites(rated.select("source", "lang", *[F.col("r_" + t).alias(t) for t in TRAITS]))
    sited = _with_sites(rated, table)
    # Without labels nothing is known of sites either: blank texts alone would speak for them.
    said = lambda t: adjustment(t, F.col("r_" + t)) if model["coef"] is not None else F.lit(0.0)
    return sited.select(*rest, "doc_id", *[F.col(t).alias(t + "_logit") for t in TRAITS], *[_probability(F.col(t) + said(t)).alias("p_" + t) for t in TRAITS])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``low_logit``, ``toxic_logit`` (of the text), ``p_low``, ``p_toxic`` (with its site) and ``kept`` of every row of ``docs``.

    The host is ``source`` and the path within it ``lang``: the table has no other column that divides a site. A row's
    own label or score plays no part in what its site says of it. A row is rejected at a posterior over one half
    (to six places) of either trait. Null, empty and blank texts are rejected; null sources
    and languages are sites like any other; labels with a null, or of unknown ids, play no part; without labels
    all but blank texts are kept. Repeated rows give repeated results. Other columns play no part.
    """
    return _scored(docs, labels, False).withColumn("kept", _keeps(F.col("p_low"), F.col("p_toxic")))


def _keeps(p_low: Column, p_toxic: Column) -> Column:
    return (F.round(p_low, 6) <= REJECT) & (F.round(p_toxic, 6) <= REJECT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects. Rows are written once beside their scores, so no text is scored twice."""
    return unpacked(_scored(docs, labels, True).where(_keeps(F.col("p_low"), F.col("p_toxic"))))
