"""The pipeline's stages, each against a plain version on its own input."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_toxic_documents_go_and_clean_ones_stay(spark):
    large = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{large}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.classify(spark, spark.read.parquet(f"{large}/documents.parquet"), large).select("doc_id").collect()}
    rows = labels.collect()
    toxic, clean = [r.doc_id for r in rows if r.toxic], [r.doc_id for r in rows if r.quality and not r.toxic]
    assert sum(k in kept for k in toxic) <= 0.2 * len(toxic)
    assert sum(k in kept for k in clean) >= 0.98 * len(clean)


def test_stages_in_order_and_their_effects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r.doc_id: r.text for r in docs.collect()})
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, r in labels.items() if r.quality and not r.toxic]
    assert sum(k in seen[1] for k in good) >= 0.95 * len(good)
    sets = {}
    for k, t in seen[1].items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    linked = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    kept = sorted(seen[2])
    assert not any(linked(a, b) for a in kept for b in kept if b < a)
    assert all(any(linked(a, b) for b in sets if b != a) for a in set(seen[1]) - set(seen[2]))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")
    low = lambda t: words("".join(c.lower() if c < "\x80" else c for c in t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(low, bench) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}
    dirty = {k for k, t in seen[2].items() if any(tuple(low(t)[i : i + n]) in windows for n in sizes for i in range(len(low(t)) - n + 1))}
    assert set(seen[3]) == set(seen[2]) - dirty
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows) == Counter(map(tuple, docs.collect()))
    assert {r.shard for r in rows} == set(range(24))
    for shard in range(24):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    homes = {}
    assert all(homes.setdefault(r.text, r.shard) == r.shard for r in rows)


def test_odd_rows_and_columns_pass_all_stages(spark, tmp_path):
    odd = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n", None, "a"), (None, "of no id, with words of its own", "en", None), (4, "word " * 30_000, "en", "b"), (4, "word " * 30_000, "en", "b")]
    plain = [(k, f"document {k} says " + " ".join(f"w{k * 7 + j}" for j in range(40)), "en", "abc"[k % 3]) for k in range(10, 60)]
    docs = spark.createDataFrame(odd + plain, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in ("n", "size", "shard", "key", "content", "_row", "rank")})
    empty = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, empty), "test-stage")
        assert [c for c in docs.columns if c not in ("shard", "slot")] == [c for c in before.columns if c not in ("shard", "slot")], name
        if name == "benchmark decontamination":  # the mix then takes as many words of each source as it asks for
            assert Counter(r.doc_id for r in docs.collect()) == Counter([None, 4, *range(10, 60)])
    assert docs.count() > 20 and docs.where("n <> 'n' or _row <> '_row'").count() == 0
    none = before.where("false").drop("shard")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, empty)
    assert none.count() == 0 and none.columns[-2:] == ["shard", "slot"]
