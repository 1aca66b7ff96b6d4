"""A deterministic, sharded WARC writer and its reader.

Records are dealt to shards by ranges of (page id, digest, url) that hold about as many bytes each, sorted within, and
written as one gzip member per record; a file is closed when its compressed size reaches the limit. Headers,
block digests and payload digests are made anew. Tasks write under temporary names of their own, so retried and
speculative attempts never meet; a manifest of the attempts that count is written, their files are renamed, and
the manifest's second part marks the archive as whole. File names, contents and order depend on the rows alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches, materialize, shared_dir, work_tables_dropped

#: Target of uncompressed bytes in a shard, and of compressed bytes in a file.
SHARD_BYTES, FILE_BYTES = 64 << 20, 16 << 20
#: Payloads that repeat are broadcast up to so many digests (some 5 MB); beyond, records are joined by a shuffle.
BROADCAST_REPEATS = 50_000
#: Tasks that read archives, at most; each takes whole shards.
READERS = 20_000
#: Shards at most: beyond, they grow. Their bounds, a row each, are what the driver sees and tasks are sent.
MOST_SHARDS = 1 << 16


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null for revisits), ``size``, ``sha1``, ``type`` and ``refers_to`` of every page.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page id is the response
    and the others revisit it; of rows that repeat that id and payload each is a response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # The largest id of each payload that repeats, gathered without the payloads.
    seen = rows.groupBy("sha1").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    seen = materialize(seen.select(F.col("sha1").alias("of"), "latest", "n"), "warc-repeats")
    repeats, total = seen.agg(F.count("*"), F.sum("n")).first()
    if repeats <= BROADCAST_REPEATS:
        paired = rows.join(F.broadcast(seen), F.col("sha1") == F.col("of"), "left")
    else:  # payloads with over a 2,000th of the repeats by broadcast, all others by a shuffle
        hot = F.broadcast(seen.where(F.col("n") > max(1000, total // 2000)))
        cold = seen.where(F.col("n") <= max(1000, total // 2000))
        same = F.col("sha1") == F.col("of")
        paired = rows.join(hot, same).unionByName(rows.join(hot.select("of"), same, "left_anti").join(cold, same, "left"))
    again = (F.col("size") >= min_bytes) & F.coalesce(F.col("page_id") < F.col("latest"), F.col("latest").isNotNull())  # no id comes before any
    return paired.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "sha1",
        F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("latest")).alias("refers_to"),
    )


def shard_bounds(records: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (page id, digest, url) of every shard, ascending: shards are cut where the running bytes of the whole order pass a multiple of ``shard_bytes``.

    The order is that of the rows alone: keys are range-sorted without their payloads, running sums are added up within ranges and
    carried over from range to range, so neither the ids' spread nor Spark's choice of ranges plays a part. A shard ends at a key, so
    only rows that agree in id, payload and url can make one larger than asked.
    """
    spark = records.sparkSession
    weight = F.coalesce(F.octet_length("payload"), F.lit(0)) + 512
    order = ["page_id", "sha1", "url"]
    keys = records.groupBy(*order).agg(F.sum(weight).alias("w"))
    parts = max(1, min(READERS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    with work_tables_dropped(spark):
        ranged = materialize(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "warc-keys", "zstd")
        sums = ranged.groupBy("part").agg(F.sum("w").alias("w"))  # READERS rows at most
        ahead = sums.select("part", (F.sum("w").over(W.orderBy("part")) - F.col("w")).alias("ahead"))
        total = sums.agg(F.sum("w")).first()[0] or 0
        size = max(shard_bytes, total // MOST_SHARDS + 1)
        within = F.sum("w").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("w")
        placed = ranged.withColumn("within", within).join(F.broadcast(ahead), "part")
        at = F.floor((F.col("ahead") + F.col("within")) / F.lit(size))
        firsts = placed.groupBy(at.alias("at")).agg(F.min(F.struct(*order)).alias("k")).orderBy("at").collect()
    return [_sortable(r.k.page_id, r.k.sha1, r.k.url) for r in firsts]


def _sortable(page_id: int | None, sha1: str, url: str | None) -> tuple:
    return (page_id is not None, page_id or 0, sha1, url is not None, url or "")


def shards_by_range(records: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``shard``, by ``shard_bounds``; and the number of shards."""
    bounds = shard_bounds(records, shard_bytes)

    @F.pandas_udf("int")
    def shard(ids: pd.Series, sums: pd.Series, urls: pd.Series) -> pd.Series:
        rows = zip(ids, sums, urls, strict=True)
        return pd.Series([bisect_right(bounds, _sortable(None if i is None else int(i), s, u)) - 1 for i, s, u in rows], dtype="int32")

    # Ids go as strings: a column of longs with nulls would pass through doubles.
    return records.withColumn("shard", shard(F.col("page_id").cast("string"), F.col("sha1"), F.col("url"))), max(1, len(bounds))


def _record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, kind: str, refers_to: int | None) -> bytes:
    sum_ = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    name = "" if page_id is None else str(page_id)
    uri = "".join(c if c.isprintable() else "%{:02X}".format(ord(c) & 255) for c in (url or "about:blank"))
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{sha1}')}>", "WARC-Target-URI": uri,
        "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{sum_}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Page-Id": name, "X-Payload-Length": str(size),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(refers_to), "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}:{sha1}')}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


MANIFEST = "shard int, seq int, temp string, name string, records long, bytes long, sha1 string"


def _writer(base: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        shard = seq = out = entry = None
        done: list[dict] = []

        def close() -> None:
            if out is not None:
                out.close()
                done.append(entry | {"sha1": entry["sha1"].hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard or entry["bytes"] >= file_bytes:
                    close()
                    seq = seq + 1 if r["shard"] == shard else 0
                    shard = r["shard"]
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    entry = {"shard": shard, "seq": seq, "temp": f"_temporary/{name}.{uuid.uuid4().hex}", "name": name, "records": 0, "bytes": 0, "sha1": hashlib.sha1(usedforsecurity=False)}
                    out = fs.open_output_stream(f"{root}/{entry['temp']}", compression=None)
                member = gzip.compress(_record(*(r[c] for c in ("page_id", "url", "payload", "size", "sha1", "type", "refers_to"))), 6, mtime=0)
                out.write(member)
                entry["sha1"].update(member)
                entry["records"] += 1
                entry["bytes"] += len(member)
        close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    return write


def _renamer(base: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{root}/{r['name']}").type == pafs.FileType.NotFound:  # else an earlier attempt has done it
                    fs.move(f"{root}/{r['temp']}", f"{root}/{r['name']}")
            yield batch

    return rename


def write_archives(pages: DataFrame, base: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) as archives under ``base`` (a URI all executors reach); returns the manifest.

    Null pages have empty payloads, null urls the target ``about:blank``, null ids an empty id header; equal ids are ordered
    by digest and url. Other columns play no part. An empty table gives an empty manifest. The folder holds
    ``_manifest`` once all files have their final names; without it an archive is not whole.
    """
    bound_batches(pages.sparkSession)
    fs, root = pafs.FileSystem.from_uri(base)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    records = materialize(plan_records(pages, min_bytes), "warc-records", "zstd")
    sharded, n = shards_by_range(records, shard_bytes)
    # One partition for each shard: shards are ranges of ids already.
    sorted_ = sharded.repartitionById(n, "shard").sortWithinPartitions("shard", "page_id", "sha1", "url")
    manifest = materialize(sorted_.select("shard", "page_id", "url", "payload", "size", "sha1", "type", "refers_to").mapInArrow(_writer(base, file_bytes), MANIFEST), "warc-attempts")
    final = manifest.repartitionById(min(n, 200), F.pmod("shard", F.lit(min(n, 200)))).mapInArrow(_renamer(base), MANIFEST)
    final.write.parquet(f"{base}/_manifest")
    return records.sparkSession.read.schema(manifest.schema).parquet(f"{base}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data, inflate, out = b"", zlib.decompressobj(31), []
    while chunk := data or stream.read(1 << 20):
        out.append(inflate.decompress(chunk))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("an archive ends within a record")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(base: str):
    number = lambda s: int(s) if s else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        head, _, block = member.partition(b"\r\n\r\n")
                        h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        block = block[: int(h["Content-Length"])]
                        if "sha1:" + digest(block) != h["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block differs from its digest")
                        sum_, payload = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if digest(payload) != sum_ or len(payload) != int(h["X-Payload-Length"]):
                                raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append({"page_id": number(h["X-Page-Id"]), "url": h["WARC-Target-URI"], "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": sum_, "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page-Id", "")), "payload": payload})
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(spark: SparkSession, base: str) -> DataFrame:
    """The records of whole archives under ``base``; every block and payload is checked against its digest. Revisits have no payload."""
    manifest = spark.read.parquet(f"{base}/_manifest")
    readers = min((manifest.agg(F.max("shard")).first()[0] or 0) + 1, READERS)
    return manifest.repartitionById(readers, F.pmod("shard", F.lit(readers))).select("name").mapInArrow(_reader(base), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and reads them back."""
    base = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, base)
    return read_archives(pages.sparkSession, base)
