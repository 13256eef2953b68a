"""Substring dedup by content-defined chunking with a gear rolling hash (operator 3).

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes, h = (h << 1) + G[byte], has ``MASK_BITS`` zero
bits, at least ``LEAST`` and at most ``MOST`` bytes after the last cut, so an insertion moves only the cuts near it.
Chunks are compared by BLAKE2b digest (128 bits): the first one, by (doc_id, place), stays and every other one is a
repetition.  Repetitions that follow one another make a run; runs of ``LEAST_RUN`` bytes or more go, and so does a text
that is one run whatever its length.  Shorter runs are turns of phrase that texts share by chance.
The rows that meet are digests, not text, counted before they are shuffled; texts never move.  Digests of more than a fixed
share of all chunks are broadcast (``join_spread``), so a hot chunk fills no task.

Defined results: null text is empty and has no chunks; a text's last chunk may be shorter than ``LEAST`` and is
compared like any other, so short texts and short ends that occur before go too; repeated rows are
copies of one another, so one of them keeps its text; null ids come after all others; an empty table gives an empty
table; the result carries the id alone, so input columns cannot clash, and ``remove_repeats`` gives all columns back.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import join_spread, materialize, table
from therascape.llm.suffix_dedup import whole_characters

LEAST, MOST, MASK_BITS = 32, 512, 5
LEAST_RUN = 96
GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last one is its length."""
    n = len(text)
    if not n:
        return []
    h = GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, last = [], 0
    for m in marks.tolist():
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, digests, sizes = [], [], []
        for x in batch.column("text"):
            text = x.as_py() or b""
            at = cuts(text)
            sizes.append(len(at))
            ends += at
            digests += [blake2b(text[a:b], digest_size=16).digest() for a, b in zip([0, *at], at, strict=False)]
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        chunk = pa.StructArray.from_arrays([pa.array(ends, pa.int32()), pa.array(digests, pa.binary())], ["end", "digest"])
        yield pa.record_batch({"carry": batch.column("carry"), "chunks": pa.ListArray.from_arrays(offsets, chunk)})


def chunks(docs: DataFrame, carry: Column, text_col: str = "text") -> DataFrame:
    """(carry, chunks): for every row the ends and digests of its chunks, beside a column of the caller's choice."""
    src = docs.select(carry.alias("carry"), docs[text_col].cast("binary").alias("text"))
    kind = T.ArrayType(T.StructType().add("end", "integer").add("digest", "binary"))
    return src.mapInArrow(_chunked, T.StructType([src.schema["carry"], T.StructField("chunks", kind)]))


def _with_spans(rows: DataFrame, id_of: str) -> DataFrame:
    """(carry, n_bytes, n_chunks, spans) of rows (carry, chunks, mark): the byte ranges of repetitions in long runs."""
    every = rows.select(F.col(id_of).alias("id"), "mark", F.posexplode("chunks").alias("k", "c"), "chunks").select(
        "id", "mark", "k", F.coalesce(F.get("chunks.end", F.col("k") - 1), F.lit(0)).alias("start"), F.col("c.end").alias("end"), F.col("c.digest").alias("digest")
    )
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "k")
    firsts = every.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = materialize(firsts.select("digest", "n", F.col("first.mark").alias("mark0"), F.col("first.k").alias("k0")), "chunk-firsts")
    total = rows.agg(F.sum(F.size("chunks"))).first()[0] or 0
    gone = join_spread(every, firsts, "digest", total).where("mark <> mark0 or k <> k0")
    gone = gone.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    size = F.coalesce(F.array_max("chunks.end"), F.lit(0)).cast("long")
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = rows.join(gone, "mark", "left").select("carry", size.alias("n_bytes"), F.size("chunks").cast("long").alias("n_chunks"), F.coalesce("spans", none).alias("spans"))
    return out.mapInArrow(_runs, out.schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the spans of long runs alone."""
    for batch in batches:
        spans = batch.column("spans")
        size = np.asarray(pa.compute.list_value_length(spans))
        flat = spans.flatten()
        start, end = (np.asarray(flat.field(c), np.int64) for c in ("start", "end"))
        row = np.repeat(np.arange(len(size)), size)
        fresh = np.ones(len(start), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != end[:-1])
        run = np.cumsum(fresh) - 1
        long = np.bincount(run, end - start) if len(run) else np.zeros(0)
        keep = (long[run] >= LEAST_RUN) | (long[run] == np.asarray(batch.column("n_bytes"))[row])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(size)))))
        kept = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(keep)))
        yield batch.set_column(batch.schema.get_field_index("spans"), pa.field("spans", kept.type), kept)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_chunks, n_removed_chunks, n_removed, spans) for every row; spans are byte ranges to cut out."""
    rows = materialize(chunks(docs, docs[id_col], text_col).withColumn("mark", F.monotonically_increasing_id()), "chunks")
    out = _with_spans(rows, "carry")
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(F.col("carry").alias("id"), "n_bytes", "n_chunks", F.size("spans").cast("long").alias("n_removed_chunks"), n_removed.alias("n_removed"), "spans")


def _kept(text: bytes, spans: list[dict]) -> str:
    """A text without its spans; a character of which a byte goes is cut as a whole."""
    gone = np.zeros(len(text), bool)
    for s in spans:
        gone[s["start"] : s["end"]] = True
    data = np.frombuffer(text, np.uint8)
    return data[~whole_characters(gone, data, np.zeros(1, np.int64))].tobytes().decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with repeated chunks cut out of the text.  Every row stays."""
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = materialize(chunks(docs, row, text_col).withColumn("mark", F.monotonically_increasing_id()), "chunk-rows")
    out = _with_spans(rows, f"carry.`{id_col}`").select("carry", "spans", F.col(f"carry.`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_kept(x.as_py(), s.as_py()) if len(s) else None for x, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.record_batch({"carry": batch.column("carry"), "kept": pa.array(kept, pa.string())})

    out = out.mapInArrow(run, T.StructType([out.schema["carry"]]).add("kept", "string"))
    return out.select(*[(F.coalesce("kept", F.col(f"carry.`{c}`")) if c == text_col else F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])


def op3_chunk_dedup(spark, sf_dir):
    """Every document of ``documents``: what the removal of repeated chunks takes."""
    out = duplicate_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "spans")
