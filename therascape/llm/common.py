"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only on a local master, where that may be unset (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Parquet options for rows of megabytes: without them a page takes 100 rows before its size is looked at, and codecs hold whole pages outside the heap.
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 8 << 20}


def materialize(df: DataFrame, tag: str, **options: object) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/therascape/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_memory() -> None:
    """Give back what Arrow and the C library keep of memory that is free, where they can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def join_spread(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``found`` by ``key``, however many rows one key has; an inner join.

    ``found`` has one row for each key, and in ``n`` how many of the ``total`` rows it has.  Keys of more than a share of
    1 / (4 * shuffle partitions) of the rows are fewer than four times the shuffle partitions: these are broadcast and joined in place.
    All others meet by a shuffle, in which no key fills a partition.
    """
    most = total // (4 * shuffle_width(rows.sparkSession))
    hot, cold = found.where(F.col("n") > most).drop("n"), found.where(F.col("n") <= most).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` (written once, since ranges are drawn from samples) with ``idx``, their place from 0 within ``key``, and ``n``, the key's rows.

    No window spans a key: rows are numbered inside ranges of (key, order), and moved by the rows of the ranges before.
    """
    ranged = materialize(rows.repartitionByRange(key, *order).withColumn("range", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(key, "range").agg(F.count("*").alias("here"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy(key)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "range").orderBy(*order))
    return ranged.withColumn("place", place).join(parts, [key, "range"]).withColumn("idx", F.col("before") + F.col("place") - 1).drop("range", "place", "before")


def as_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text): the input row as one struct, so that no column an operator adds can clash with an input column."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BLOCK_SCHEMA = "block long, n_bytes long, data binary"


def pack(text_col: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows (row) packed in blocks of ``most`` bytes of text or little more, each one Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal seq, held, size
            whole = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole.combine_chunks())
            made = pa.record_batch({"block": pa.array([seq], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            seq, held, size = seq + 1, [], 0
            return made

        for batch in batches:
            rows = batch.column("row")
            lens = np.asarray(pa.compute.binary_length(rows.field(text_col).fill_null("")).to_numpy(zero_copy_only=False), np.int64)
            a = 0
            for k, x in enumerate(lens):
                size += int(x)
                if size >= most:
                    held.append(batch.slice(a, k + 1 - a))
                    yield out()
                    a = k + 1
            if a < len(lens):
                held.append(batch.slice(a))
        if held:
            yield out()

    return run


def unpacked(data: bytes) -> pa.StructArray:
    """The rows of a block."""
    with pa.ipc.open_stream(data) as r:
        whole = r.read_all()
    return whole["row"].combine_chunks() if whole.num_rows else pa.array([], whole.schema.field("row").type)


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


#: DuckDB: the 256 steps of CRC-32 as a list, made from its polynomial; for a CTE ``crc_steps(t)``.
CRC_STEPS_SQL = """SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS t
          FROM range(256) r(i)"""


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text's UTF-8 bytes, where ``crc_steps`` is joined."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda s: CAST('0x' || s AS INT))"
    return f"xor(list_reduce({data}, lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
