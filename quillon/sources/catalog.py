"""Named Parquet tables and artifacts: loading, casting, writing and manifests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ID_COLUMNS = ("stock_id", "country_code", "currency_code", "region_code", "gics_sector_name", "gics_industry_group_name", "gics_industry_name")


def load_table(spark: SparkSession, name: str, catalog: Mapping[str, str]) -> DataFrame:
    """The table that ``catalog`` maps ``name`` to."""
    if name not in catalog:
        raise KeyError(f"no table is called {name!r}; known: {', '.join(sorted(catalog))}")
    return spark.read.parquet(catalog[name])


def load_all(spark: SparkSession, catalog: Mapping[str, str], views: bool = False) -> dict[str, DataFrame]:
    """All tables by name, as temporary views too if asked."""
    tables = {name: load_table(spark, name, catalog) for name in catalog}
    for name, df in tables.items() if views else ():
        df.createOrReplaceTempView(name)
    return tables


def cast_ids(df: DataFrame, columns: Iterable[str] = ID_COLUMNS) -> DataFrame:
    """Ids and codes as strings, as far as they are there; other columns stay."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def load_artifacts(spark: SparkSession, folder: str, names: Iterable[str], step: str) -> dict[str, DataFrame]:
    """Artifacts of an earlier step; an absent one is an error that names that step."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:
            raise FileNotFoundError(f"{folder}/{name} cannot be read: run {step} first") from e
    return out


def write_artifact(df: DataFrame, folder: str, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes an artifact by Spark's commit protocol and reads it back, so later plans start from the file."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def write_with_manifest(frames: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Writes artifacts, counting rows in the same pass, then the manifest, whose presence says that all are there."""
    counts = []
    spark = None
    for name, df in frames.items():
        seen = Observation(name)
        write_artifact(df.observe(seen, F.count(F.lit(1)).alias("rows")), folder, name)
        counts.append((name, seen.get["rows"]))
        spark = df.sparkSession
    if spark is None:
        raise ValueError("there is nothing to write")
    return write_artifact(spark.createDataFrame(counts, "artifact string, rows long"), folder, "manifest")


def did_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of difference-in-differences coefficients."""
    return spark.read.parquet(path).select("cohort", "currency", "outcome", "coef")
