"""Reading and writing tables. Identifiers are always read as text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewise.functions.columns import clean_names


def read_csv_ids(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType | None = None,
    casts: Mapping[str, str] | None = None,
    sep: str = ",",
    clean: bool = False,
) -> DataFrame:
    """Delimited text with a header; gzip and other codecs are read as they are.

    Without ``schema`` every column stays text (nothing is guessed, no pass is
    spent guessing); ``casts`` then types chosen columns, bad values giving NULL.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    if clean:
        df = clean_names(df)
    if not casts:
        return df
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in casts.items()})


def read_delim(spark: SparkSession, path: str | list[str], casts: Mapping[str, str] | None = None) -> DataFrame:
    """Tab-delimited text with cleaned column names."""
    return read_csv_ids(spark, path, casts=casts, sep="\t", clean=True)


def read_dataset(
    spark: SparkSession, path: str, where: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet folder; a predicate on partition columns skips whole folders."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*columns)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, missing values empty."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def materialize_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` unless a finished copy exists, and read it back.

    Only a copy with its success marker counts as finished; a broken one is redone.
    """
    spark = df.sparkSession
    fs, folder = _file_system(spark, path)
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not fs.exists(done):
        write_parquet(df, path, partition_by)
    return spark.read.parquet(path)


def read_csv_collection(
    spark: SparkSession,
    folder: str,
    exclude: str | None = None,
    casts: Mapping[str, Mapping[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """CSV files one level below ``folder``, by their path in it (``a/x.csv``), so equal names do not hide each other.

    Paths in which the ``exclude`` pattern is found are left out. ``casts`` go by path or by file name.
    """
    fs, _ = _file_system(spark, folder)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*/*.csv"))
    paths: Iterable[str] = sorted(s.getPath().toString() for s in (found or []))
    named = {"/".join(p.split("/")[-2:]): p for p in paths if not (exclude and re.search(exclude, p))}
    known = casts or {}
    return {
        name: read_csv_ids(spark, path, casts=known.get(name, known.get(name.rsplit("/", 1)[-1])))
        for name, path in named.items()
    }
