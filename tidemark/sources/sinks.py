"""Writing results: labelled JSON, tab-separated text, snapshots with a stamp, review outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_tsv(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text column: fields in the given order, tabs and line ends in them as spaces, nulls empty."""
    fields = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n\r", "   ") for c in columns]
    return rows.select(F.concat_ws("\t", *fields).alias("line"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def write_snapshot(table: DataFrame, folder: str, stamp: str) -> str:
    """A consistent copy as Parquet under a stamped name."""
    path = f"{folder}/snapshot-{stamp}"
    table.write.parquet(path)
    return path


def as_labelled(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, block): ``field : value`` lines of each row, field names right-aligned; nulls have no line."""
    width = max(map(len, columns))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.rjust(width)} : "), F.translate(F.col(c).cast("string"), "\t\n\r", "   "))) for c in columns]
    return rows.select(key, F.concat_ws("\n", *lines).alias("block"))


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """The snapshot folders in a folder, the newest first, wherever Spark can read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    names = [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]
    return [f"{folder}/{n}" for n in sorted(names, reverse=True) if n.startswith("snapshot-")]


def restore(spark: SparkSession, folder: str, path: str, stamp: str) -> DataFrame:
    """Put the newest snapshot in place of the table at ``path``; what is there stays beside it as ``path``-before-``stamp``."""
    found = snapshots(spark, folder)
    if not found:
        raise FileNotFoundError(f"no snapshot in {folder}")
    table = spark.read.parquet(found[0])
    jvm = spark._jvm.org.apache.hadoop.fs
    where, beside = jvm.Path(path), jvm.Path(f"{path}-before-{stamp}")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(where):
        system.rename(where, beside)
    table.write.parquet(path)
    return spark.read.parquet(path)


def backup_warning(backup_turns: int, store_turns: int, slack: int = 100) -> str | None:
    """A line when a backup holds more than the store by over ``slack`` turns, which indexing again can't bring back."""
    if backup_turns <= store_turns + slack:
        return None
    return f"the backup holds {backup_turns:,} turns, this store {store_turns:,}; restore it instead of indexing again"


def write_outbox(reviews: DataFrame, path: str) -> None:
    reviews.write.mode("overwrite").json(path)
