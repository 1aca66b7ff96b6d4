"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, decontaminate, ego, infill, minhash, mixing, pii, quality, search, sharding, suffixes, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.lpt_shards(_table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    formatted = chat.format_conversations(turns.unionByName(extra)).withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.read_learnt(F.col("formatted"), F.col("mask")))
    lines = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(_table(spark, sf_dir, "documents")).drop("removed")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restored(infill.fill_in_middle(_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_personal_data, op3_decontamination, op4_chat, op5_mixing, op6_warc, op7_embeddings, op8_suffix_dedup, op9_quality, op10_near_duplicates,
        op11_fill_in_middle, op12_toxicity, op13_search,
    )
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
i AS (SELECT coalesce(cast(item_id AS varchar), '') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
         FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
          FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT r, s, g.n, item FROM grams g JOIN wins USING (win, n)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM occ) GROUP BY r),
met AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN met USING (r)
"""

OP4_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, row_number() OVER o AS k, lag(role) OVER o AS before, lead(role) OVER o AS after,
               regexp_replace(replace(text, '\', '\\'), '(<\||\[INST|\[/INST|<s>|</s>|<<SYS|<</SYS)', '\1', 'g') AS plain,
               len(regexp_extract_all(replace(text, '\', '\\'), '<\||\[/?INST|</?s>|<</?SYS')) AS marks,
               len(regexp_extract_all(replace(role, '\', '\\'), '<\||\[/?INST|</?s>|<</?SYS')) AS role_marks
        FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(sum(length(plain) + marks + CASE WHEN before = role THEN 8 ELSE 16 + length(replace(role, '\', '\\')) + role_marks END
                + CASE WHEN after = role THEN 0 ELSE 7 END) AS bigint) AS formatted_chars
FROM esc GROUP BY conv_id
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size,
       md5(concat('mix-1:', coalesce(source, ''), ':', coalesce(cast(doc_id AS varchar), ''), ':', md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size, (ARRAY[5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::double AS weight FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, source, source_size, weight, cast(NULL AS double) AS fixed FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         CASE WHEN fixed IS NULL AND weight * ((sum(source_size) OVER ()) - coalesce(sum(fixed) OVER (), 0)) / (sum(CASE WHEN fixed IS NULL THEN weight END) OVER ()) > 3.0 * source_size
              THEN 3.0 * source_size ELSE fixed END
  FROM fill WHERE step < 60),
t AS (SELECT source, source_size, coalesce(fixed, weight * ((sum(source_size) OVER ()) - coalesce(sum(fixed) OVER (), 0)) / (sum(CASE WHEN fixed IS NULL THEN weight END) OVER ())) AS target
      FROM fill WHERE step = 60),
c AS (SELECT d.*, source_size, target, cast(round(target) AS bigint) AS asked,
             cast(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       greatest(0, least(size, asked - ahead)) + greatest(0, least(size, asked - ahead - source_size)) + greatest(0, least(size, asked - ahead - 2 * source_size)) AS taken
FROM c
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(('0b' || substr(bits, {5 * k + 1}, 5)) AS integer), 1)" for k in range(32))

OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS latest FROM p),
c AS (SELECT *, {" || ".join(f"right(bin(cast(('0x' || substr(h, {k + 1}, 1)) AS integer) + 16), 4)" for k in range(40))} AS bits FROM b)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to
FROM c
"""

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT n, y FROM reach JOIN links ON x = c),
low AS (SELECT n, min(c) AS c FROM reach GROUP BY n), degree AS (SELECT x, count(*) AS k FROM links GROUP BY x)
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN low ON n = vec_id LEFT JOIN degree ON x = vec_id
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT a, y FROM reach JOIN links ON x = c),
low AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d JOIN low ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', cast(doc_id AS varchar))) AS x FROM documents),
h AS (SELECT *, cast(len(u) AS bigint) AS n, cast(('0x' || substr(x, 1, 8)) AS bigint) AS h1, cast(('0x' || substr(x, 9, 8)) AS bigint) AS h2, cast(('0x' || substr(x, 25, 8)) AS bigint) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN cast(length(prefix) AS bigint) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(middle) AS bigint) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
a AS (SELECT count(*) AS n_docs, cast(sum(len(w)) AS bigint) AS n_words FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
t AS (SELECT term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) AS bigint) AS weight FROM p, a GROUP BY term, n_docs),
s AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY 1, 2, 3),
m AS (SELECT q, item_id, p.r, cast(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(d.w) * n_docs) // n_words)))) AS bigint) AS score
      FROM s JOIN t USING (term) JOIN p USING (term) JOIN d ON d.r = p.r CROSS JOIN a GROUP BY 1, 2, 3)
SELECT item_id, cast(row_number() OVER o AS integer) AS rank, doc_id, score FROM m JOIN d ON d.r = m.r WHERE score > 0
WINDOW o AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 20
"""

ORACLES = {
    "op7_embeddings": OP7_SQL, "op10_near_duplicates": OP10_SQL, "op6_warc": OP6_SQL, "op3_decontamination": OP3_SQL, "op4_chat": OP4_SQL, "op5_mixing": OP5_SQL,
    "op11_fill_in_middle": OP11_SQL, "op13_search": OP13_SQL,
}
