"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans, which stay. Nodes of the field are those, every other number of seven digits and more,
every further mention of a found address's local part, and long tokens of letters and digits that may be secrets (one that
follows a name such as "password", or begins as an issuer's keys do, is evidence by pattern as well, and its span the pattern's finding, not the field's).
Nodes within NEAR code points of one another form chains; those that repeat, or end in the same digits, are tied by skip edges however far
apart: each to the next, and each to the first that is evidence. Loopy belief propagation over both kinds of edge,
with base spans and known secrets as evidence, labels the rest; a label that wins adds a span. Secrets are a fifth kind, which only the
field finds.

Potentials come from the base spans of the whole corpus; tokens that no pattern labels count for nothing in them and
start at even odds of being nothing. So what looks like a number but is tied to no evidence stays unlabelled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
SECRET = len(LABELS) - 1
NEAR = 80
ROUNDS, DAMPING, SURE = 12, 0.5, 0.7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_])[0-9]++(?:[ ().-]{1,2}+[0-9]++)*+(?![A-Za-z0-9_])")
_NAME = re.compile(r"[A-Za-z0-9._%+-]{5,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{12,}")
_NAMED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer)[\"']?\s{0,3}[=: ]\s{0,3}[\"']?$", re.IGNORECASE)
# How well-known issuers begin their keys.
_ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}$|sk-[A-Za-z0-9]{16,}$|xox[abprs]-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _only_digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the fixed patterns find, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_only_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def nodes(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(start, end, label or -1, shape, key) of the tokens to label, in order. Equal keys are tied. One pass for each pattern."""
    out = []
    for kind, a, b in base:
        s = text[a:b]
        digits = _only_digits(s)
        key = s.partition("@")[0].lower() if kind == "email" else s if kind == "ip" else digits[-9:]
        out.append((a, b, LABELS.index(kind), _shape(s, digits), key))
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or reach[k - 1] <= a

    if not _DIGIT.search(text):
        numbers = tokens = ()
    else:
        numbers, tokens = _NUMBER.finditer(text), _TOKEN.finditer(text)
    for m in numbers:
        digits = _only_digits(m[0])
        if len(digits) >= 7 and free(m.start(), m.end()):
            out.append((m.start(), m.end(), -1, _shape(m[0], digits), m[0] if m[0].count(".") == 3 and len(digits) <= 12 else digits[-9:]))  # four short parts may be an address of the net; longer ones are a number in groups
    for m in tokens:
        s = m[0]
        if _DIGIT.search(s) and re.search(r"[A-Za-z]", s) and free(m.start(), m.end()):
            known = _ISSUED.match(s) or _NAMED.search(text, max(0, m.start() - 24), m.start())
            out.append((m.start(), m.end(), SECRET if known else -1, "secret", s))
    locals_ = {x[4] for x in out if x[2] == 1 and len(x[4]) >= 5 and not x[4].isdigit()}
    for m in _NAME.finditer(text) if locals_ else ():
        name = m[0].strip(".-%+").lower()
        at = m.start() + len(m[0]) - len(m[0].lstrip(".-%+"))
        if name in locals_ and free(at, at + len(name)):
            out.append((at, at + len(name), -1, "name", name))
    return sorted(out)


def _shape(s: str, digits: str) -> str:
    """Length and punctuation; the plus sign is left out, for it tells base phones from all else."""
    if "@" in s:
        return "address"
    marks = "".join(sorted({c for c in s if c in " ().-"}))
    return f"{min(len(digits), 20)}|{marks}|{int(len(digits) >= 16 and luhn(digits))}"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the base spans of a partition say: labels by shape, labels by the label before, and whether tied ones agree."""
    seen: dict[tuple[str, str], int] = defaultdict(int)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            base = base_spans(text or "")
            if not base:
                continue
            before, last = None, {}
            for a, _, label, shape, key in nodes(text, base):
                if not 0 < label <= len(KINDS):
                    continue
                seen["shape:" + shape, LABELS[label]] += 1
                if before and a - before[0] < NEAR:
                    seen["after:" + before[1], LABELS[label]] += 1
                if key in last:
                    seen["tied:" + str(last[key] == label), ""] += 1
                before, last[key] = (a, LABELS[label]), label
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["what", "label", "n"])


def fit(docs: DataFrame) -> dict:
    """Potentials from the base spans of all documents: smoothed log ratios of counts, which are added up per task first."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_count, "what string, label string, n long").groupBy("what", "label").agg(F.sum("n").alias("n"))
    return potentials([(r.what, r.label, r.n) for r in rows.collect()])  # shapes are lengths to 20 with a handful of marks: a few thousand rows at most


def potentials(counts: list[tuple[str, str, int]]) -> dict:
    k = len(LABELS)
    shape: dict[str, np.ndarray] = {}
    chain, tied = np.zeros((k, k)), {"True": 20.0, "False": 1.0}  # before the corpus speaks, mentions agree
    for what, name, n in counts:
        kind, _, of = what.partition(":")
        if kind == "shape":
            shape.setdefault(of, np.zeros(k))[LABELS.index(name)] += n
        elif kind == "after":
            chain[LABELS.index(of), LABELS.index(name)] += n
        else:
            tied[of] += n
    personal = slice(1, 1 + len(KINDS))
    prior = np.zeros(k)
    prior[personal] = sum(shape.values(), np.zeros(k))[personal] + 1
    prior /= prior.sum()
    even = lambda share: np.log(np.maximum(0.5 * share + 0.5 * (np.arange(k) == 0), 1e-6))
    unary = {s: even((v + 2 * prior) / (v.sum() + 2)) for s, v in shape.items()}
    unary["name"] = even(np.arange(k) == 1)  # a local part is an address or nothing
    # A label after another, against its share; what patterns do not label is neutral.
    follow = np.zeros((k, k))
    square = chain[personal, personal] + prior[personal]
    follow[personal, personal] = np.log(square / square.sum(axis=1, keepdims=True) / prior[personal])
    skip = float(np.clip(np.log(tied["True"] / tied["False"] * (k - 1)), 1.0, 8.0))
    return {"unary": unary, "rest": even(prior), "chain": 0.3 * follow, "skip": skip}


def unary(shape: str, model: dict) -> np.ndarray:
    """Log potentials of the labels of a token that nothing has told."""
    if shape != "secret":
        return model["unary"].get(shape, model["rest"])
    out = np.full(len(LABELS), -14.0)
    out[0], out[SECRET] = np.log(0.6), np.log(0.4)
    return out


def graph(tokens: list[tuple[int, int, int, str, str]], model: dict) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Log potentials of the tokens, and the edges with theirs: two skip edges and one of the chain for each token at most."""
    k = len(LABELS)
    potential = np.array([unary(t[3], model) for t in tokens])
    for i, t in enumerate(tokens):
        if t[2] >= 0:
            potential[i] = -50.0
            potential[i, t[2]] = 0.0
    edges, last, hub = [], {}, {}
    for i, t in enumerate(tokens):
        if t[2] >= 0:
            hub.setdefault(t[4], i)
    tie = model["skip"] * np.eye(k)
    for i, t in enumerate(tokens):
        if i and t[0] - tokens[i - 1][0] < NEAR:
            edges.append((i - 1, i, model["chain"]))
        if t[4] in last:
            edges.append((last[t[4]], i, tie))
        if t[2] < 0 and t[4] in hub and hub[t[4]] != last.get(t[4]):
            edges.append((hub[t[4]], i, tie))
        last[t[4]] = i
    return potential, edges


def label(tokens: list[tuple[int, int, int, str, str]], model: dict) -> np.ndarray:
    """Beliefs over LABELS for every token, by loopy belief propagation over chain and skip edges."""
    k = len(LABELS)
    potential, edges = graph(tokens, model)
    if edges:
        src = np.array([e[0] for e in edges] + [e[1] for e in edges])
        dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
        pair = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(src), k))
        for _ in range(ROUNDS):
            belief = potential.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + pair
            new = np.logaddexp.reduce(out, axis=1)
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        np.add.at(potential, dst, message)
    potential -= np.logaddexp.reduce(potential, axis=1)[:, None]
    return np.exp(potential)


def all_spans(text: str, model: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those with what the field adds; by kind, secrets last, then by start."""
    base = base_spans(text)
    tokens = nodes(text, base)
    if all(0 < t[2] < SECRET for t in tokens):
        return base, base
    added = []
    for t, belief in zip(tokens, label(tokens, model), strict=True):
        best = int(belief.argmax())
        if not 0 < t[2] < SECRET and best and belief[best] >= SURE:
            added.append((LABELS[best], t[0], t[1]))
    return base, sorted(base + added, key=lambda s: (LABELS.index(s[0]), s[1], s[2]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): counts and digest of the base spans, and all spans.

    Kinds are those of KINDS and, where the field finds one, "secret". A null text is empty and holds nothing; repeated rows give repeated results; null ids are kept; other columns
    play no part; an empty table gives an empty result. Spans count code points, ends exclusive.
    """
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for text in batch.column(1).to_pylist():
                base, full = all_spans(text or "", model)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(full))
            columns = [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, SCHEMA)
