"""Readers that bear with missing and broken files, and sinks: JSON Lines, partitions, upserts."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.operators.joins import latest

CORRUPT = "_corrupt"


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False, keep_corrupt: bool = False) -> DataFrame:
    """JSON Lines, or one document a file; a missing path is an empty frame. Unreadable records are left out, or with
    ``keep_corrupt`` kept as text in ``_corrupt``."""
    out = _parsed(spark, path, schema, multiline)
    return out.drop("_file") if keep_corrupt else out.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")


def _parsed(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    """The columns of the schema, ``_corrupt`` and ``_file`` of every line (or file) that isn't blank."""
    full = StructType.fromDDL(f"{schema}, {CORRUPT} string")
    if not _there(spark, path):
        return spark.createDataFrame([], StructType.fromDDL(f"{schema}, {CORRUPT} string, _file string"))
    text = spark.read.option("wholetext", whole).text(path).where("trim(value) != ''").select("value", F.col("_metadata.file_path").alias("_file"))
    return text.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "_file").select("r.*", "_file")


def read_json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every *.json of a folder, one document each, with ``stem``: the file's name without ending."""
    rows = _parsed(spark, f"{folder}/*.json", schema, True)
    stem = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.json$", "")
    return rows.where(F.col(CORRUPT).isNull()).withColumn("stem", stem).drop(CORRUPT, "_file")


def read_csv(spark: SparkSession, path: str, schema: str, keep: dict[str, list[str]] | None = None, required: list[str] | None = None) -> DataFrame:
    """The columns of ``schema`` of a CSV with a header, in any order and among any others; one that lacks is null, as is a
    value of another type. ``keep``: allowed values of columns; rows that lack a required value are left out."""
    wanted = StructType.fromDDL(schema)
    there = spark.read.option("header", True).option("inferSchema", False).csv(path)  # columns by the names of the header
    names = {c.lower(): c for c in there.columns}
    rows = there.select(*[(F.col(f"`{names[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])
    for c, values in (keep or {}).items():
        rows = rows.where(F.col(c).isin(values))
    return rows.dropna(subset=required) if required else rows


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Training triplets in JSON Lines; rows in the form of chats (``messages``) are refused."""
    rows = read_json(spark, path, "query string, positive string, negative string, strategy string, messages string")
    if not rows.where("messages is not null").isEmpty():
        raise ValueError(f"{path} has chat rows, not triplets")
    return rows.drop("messages")


def first_folder(candidates: list[str]) -> str | None:
    """The first folder that exists and isn't empty."""
    return next((c for c in candidates if os.path.isdir(c) and glob.glob(os.path.join(c, "*"))), None)


def write_json_lines(df: DataFrame, path: str, force: bool = True) -> None:
    """``force=False`` leaves what is there, as a cache does."""
    df.write.mode("overwrite" if force else "ignore").json(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each value of the key; rows are brought together first, so a value has few files."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


class Table:
    """A table in versions: each write makes a new folder, and a pointer file names the current one.

    Readers see the old version or the new one, never a mixture; a job that dies leaves the old one current.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str]) -> None:
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order

    def _versions(self) -> list[int]:
        if not _there(self.spark, f"{self.path}/v*/_SUCCESS"):
            return []
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v[-1]:09d}") if v else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        v = self._versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{(v[-1] if v else 0) + 1:09d}")

    def replace(self, df: DataFrame) -> None:
        """Purge and load."""
        self._write(df)

    def upsert(self, df: DataFrame) -> None:
        """Rows of df added; of equal keys the row latest in ``order`` stays."""
        self._write(latest(self.read().unionByName(df), self.key, self.order))

    def retain(self, keys: DataFrame) -> None:
        """Rows whose key isn't among ``keys`` are removed."""
        self._write(self.read().join(keys.select(*self.key).distinct(), self.key, "left_semi"))

    def update(self, changes: DataFrame, columns: list[str]) -> None:
        """Columns set by key; null changes leave the old value."""
        c = changes.select(*self.key, *[F.col(x).alias(f"_{x}") for x in columns])
        old = self.read().join(c, self.key, "left")
        self._write(old.withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).drop(*[f"_{x}" for x in columns]))


def markdown(df: DataFrame, most: int = 50) -> str:
    """A small frame as a Markdown table, columns padded."""
    rows = [df.columns, *[["" if x is None else str(x) for x in r] for r in df.limit(most).collect()]]
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows[1:])])
