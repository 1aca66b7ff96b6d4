"""Artifacts partitioned by a column, published whole: readers see one version or the next, never half of a rebuild.

A publication writes the partitions it has under a version of its own, beside those that are there. A numbered pointer file then
lists, for every partition value, the version that counts. Pointers are written under a temporary name and renamed, which
fails if their number is taken; so of two publications at once one loses, and what a failed one has written nobody sees.
Readers take the pointer with the highest number and open its partitions alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

VERSION, POINTER = "_version", "_pointer-"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, pattern: str) -> list[str]:
    target, fs = _fs(spark, pattern)
    return [s.getPath().toString() for s in (fs.globStatus(target) or [])]


def _pointers(spark: SparkSession, base: str) -> list[str]:
    return sorted(_names(spark, f"{base}/{POINTER}*.json"))


def _read_text(spark: SparkSession, path: str) -> str:
    target, fs = _fs(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # one pointer: an entry for each partition
    finally:
        stream.close()


def _write_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that must not be there yet: under another name first, then renamed."""
    temp, fs = _fs(spark, f"{path.rsplit('/', 1)[0]}/_tmp-{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    final, _ = _fs(spark, path)
    if fs.exists(final) or not fs.rename(temp, final):
        fs.delete(temp, False)
        raise RuntimeError(f"{path} was published by someone else meanwhile")


def publish(df: DataFrame, base: str, by: str, replace: bool = True) -> int:
    """Writes ``df`` partitioned by ``by`` and makes it current; returns the publication's number.

    With ``replace`` the artifact is what ``df`` holds; else partitions that ``df`` has rows of take the place of the old ones and all
    others stay (dynamic overwrite). Names of the artifact's columns must not be ``_version``. A null partition value is a partition. The pointer read before the write is the one that
    the new one follows: if another came between, this publication fails and leaves what is current alone.
    """
    spark = df.sparkSession
    known = _pointers(spark, base)
    old = json.loads(_read_text(spark, known[-1])) if known else {"number": 0, "parts": {}}
    if old["parts"] and old["by"] != by:
        raise ValueError(f"the artifact is partitioned by {old['by']}")
    version = uuid.uuid4().hex
    # A partition's rows are dealt over as many tasks as the session shuffles to; a date is no hot key of one task.
    df.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(by, VERSION).parquet(base)
    written = [p.split(f"/{by}=", 1)[1].split("/", 1)[0] for p in _names(spark, f"{base}/{by}=*/{VERSION}={version}")]
    parts = ({} if replace else dict(old["parts"])) | {value: version for value in written}
    number = old["number"] + 1
    _write_once(spark, f"{base}/{POINTER}{number:08d}.json", json.dumps({"number": number, "by": by, "schema": df.schema.jsonValue(), "parts": parts}))
    return number


def current(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The artifact as last published, or as of a publication that is still there. A filter on the partition column prunes partitions."""
    known = _pointers(spark, base)
    chosen = known[-1:] if number is None else [p for p in known if p.endswith(f"{number:08d}.json")]
    if not chosen:
        raise FileNotFoundError(f"{base} has no such publication")
    said = json.loads(_read_text(spark, chosen[0]))
    schema = StructType.fromJson(said["schema"])
    paths = [f"{base}/{said['by']}={value}/{VERSION}={version}" for value, version in sorted(said["parts"].items())]
    if not paths:
        return spark.createDataFrame([], schema)
    whole = StructType([*schema.fields, StructField(VERSION, StringType())])
    return spark.read.schema(whole).option("basePath", base).parquet(*paths).select(*[f"`{f.name}`" for f in schema.fields])


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Deletes pointers but the last ``keep``, and partitions that none of those names; returns how many went. Not for use while something publishes."""
    known = _pointers(spark, base)
    live, by, gone = set(), None, 0
    for p in known[-keep:]:
        said = json.loads(_read_text(spark, p))
        by = said["by"]
        live |= {f"{by}={value}/{VERSION}={version}" for value, version in said["parts"].items()}
    for p in known[:-keep]:
        target, fs = _fs(spark, p)
        fs.delete(target, False)
    for p in _names(spark, f"{base}/{by}=*/{VERSION}=*") if by else []:
        if "/".join(p.rsplit("/", 2)[1:]) not in live:
            target, fs = _fs(spark, p)
            gone += bool(fs.delete(target, True))
    return gone
