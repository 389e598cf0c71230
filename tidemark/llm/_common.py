"""What the operators of this subpackage share: table reading, lineage cuts, text batches and word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session

#: Words are runs of anything but these six characters; ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\v\f\r"
#: A Python call handles at most about this much text at once, however large the Arrow batch is.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 2048
#: Rows of an Arrow batch between the JVM and Python. Spark's 10,000 would be tens of MB of texts a task on either side.
ARROW_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Hand the package to Python workers, and bound the batches of text that go to them."""
    session.ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine that names none (tests) it is a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder, and a folder of this machine would not reach the executors")
    named = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What operators have written or persisted in this process and nobody has released yet.
_tables: list[str] = []
_persisted: list[DataFrame] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    The shuffle files of df go once it is written; the table goes when the session ends, or before, with ``released``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _tables.append(path)
    where, system = _located(spark, path)
    system.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def hold(df: DataFrame) -> DataFrame:
    """Keep df on executors' disks for plans that read it more than once. Lineage stays: what a lost executor held is made again."""
    df = df.persist(StorageLevel.DISK_ONLY)
    _persisted.append(df)
    return df


@contextlib.contextmanager
def released(spark: SparkSession, *last: str) -> Iterator[None]:
    """What is written and persisted inside goes at the end, but for the tables of ``last`` (names given to ``cut``)."""
    tables, persisted = len(_tables), len(_persisted)
    try:
        yield
    finally:
        for df in _persisted[persisted:]:
            df.unpersist()
        del _persisted[persisted:]
        for path in _tables[tables:]:
            if not any(path.rpartition("/")[2].startswith(f"{name}-") for name in last):
                where, system = _located(spark, path)
                system.delete(where, True)
                _tables.remove(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece but a single long row holds over ``most`` bytes of text or SLICE_ROWS rows."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < n:
        done = total[at - 1] if at else 0
        end = int(np.searchsorted(total, done + most, side="right"))
        end = min(max(end, at + 1), at + SLICE_ROWS, n)
        yield batch.slice(at, end - at)
        at = end


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    make: Callable[[], Callable[[list], dict]],
    added: str,
    text: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Keep columns ``keep`` and add what ``make()`` computes for lists of texts (None where null), in the order of ``added``."""
    fields = T._parse_datatype_string(added)
    ship_package(df.sparkSession)
    frame = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([frame.schema[k] for k in keep] + list(fields))
    names = schema.names
    kinds = _arrow_types(fields)
    position = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, position, slice_bytes):
                made = compute(part.column(position).to_pylist())
                columns = [part.column(i) for i in range(position)]
                columns += [made[f] if isinstance(made[f], pa.Array) else pa.array(made[f], type=t) for f, t in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.mapInArrow(run, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of df, all columns, for whose texts the function that ``make()`` returns says true."""
    ship_package(df.sparkSession)
    position = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays = make()
        for batch in batches:
            for part in slices(batch, position):
                yield part.filter(pa.array(stays(part.column(position).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_types(fields: T.StructType) -> list[tuple[str, pa.DataType]]:
    kinds = {
        T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
    }
    out = []
    for f in fields:
        kind = f.dataType
        out.append((f.name, pa.list_(kinds[type(kind.elementType)]) if isinstance(kind, T.ArrayType) else kinds[type(kind)]))
    return out


def has_word(line: str) -> bool:
    return bool(line.strip(_BLANKS))


def blanks(text: str) -> int:
    return sum(map(text.count, _BLANKS))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that no model may learn from: crc32 of doc_id as text leaves 1 when divided by 3 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
