"""Exact removal of repeated byte strings with a difference-cover suffix structure (operator 2).

Every byte covered by a ``width``-byte string that starts at two or more places of the corpus is removed.
The suffixes of the corpus are never sorted as a whole.  The work is laid out blockwise:

1. Documents are packed into blocks of about ``BLOCK_BYTES`` and stored once, bucketed by block, in the
   shared folder; every later pass reads the blocks where they are, without shuffling text again.
2. A difference cover D modulo v picks sample suffixes: for any two positions some shift below v puts both
   on sample positions.  Sample suffixes get *names*: two samples share a name if and only if they agree on
   their first characters.  Names are compared one bucket of the name space at a time.
3. A suffix can repeat to depth ``width`` only if a sample within v of it repeats to depth width - v + 1.
   A long tie (a sample that repeats to depth width + v - 1) settles all suffixes of the v before it at once,
   from the precomputed sample names; no text is compared there.
4. The few suffixes left open, at the ends of runs, are sorted one suffix bucket at a time by their
   depth-``width`` names; equal neighbours repeat.  A settled suffix may be the only partner of an open one, so
   settled suffixes that share a sample name with any open one join the bucket.

Only equality to a fixed depth is asked for, so suffixes are ordered by fingerprints of their first characters
(64-bit, seeded; the expected number of false matches among n compared suffixes is n * n / 2**65) instead of
lexicographically.  Memory of a task: one block or one bucket, whatever the size of the corpus.

Defined results: null text is empty; texts shorter than ``width`` lose nothing; repeated rows are different
places, so both lose the bytes they share; an empty table gives an empty table; other columns, whatever
their names, come back inside ``row``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import BLOCK_SCHEMA, LARGE_ROWS, materialize, pack, records, shared_dir, shuffle_width, table, unpacked

WIDTH = 200
#: Perfect difference set of order 11: every nonzero difference modulo 133 occurs once.
COVER_MOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
BLOCK_BYTES = 1 << 19
#: Bytes of names that one bucket holds at most, on average.
BUCKET_BYTES = 24 << 20

_NAME_SCHEMA = "block long, bucket int, names binary"
_cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _cache.get("powers")
    if have is None or len(have[0]) < n:
        n, base = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2)), 0x9E3779B97F4A7C15
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _cache["powers"] = (out[0], out[1])
    return have


class Block:
    """Concatenated texts of a block with prefix sums, from which any substring gets its name in O(1)."""

    def __init__(self, rows: pa.Array, text_col: str):
        texts = rows.field(text_col).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        self.rows, first = rows, int(ends[0])
        self.text = np.frombuffer(raw, np.uint8)[first : int(ends[-1])] if raw is not None and ends[-1] > first else np.zeros(0, np.uint8)
        self.off = ends - first
        n = len(self.text)
        codes = np.random.default_rng(133).integers(0, 1 << 64, 256, np.uint64)
        self.pow, self.inv = _powers(n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[self.text] * self.pow[:n], out=self.sum[1:])
        lens = np.diff(self.off)
        self.end = np.repeat(self.off[1:].astype(np.int32), lens)  # of the document that holds the position
        self.sample = np.flatnonzero(np.isin(np.arange(COVER_MOD), COVER)[(np.arange(n, dtype=np.int32) - np.repeat(self.off[:-1].astype(np.int32), lens)) % np.int32(COVER_MOD)])

    def names(self, at: np.ndarray, depth: int) -> np.ndarray:
        x = (self.sum[at + depth] - self.sum[at]) * self.inv[at]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x

    def fits(self, at: np.ndarray, depth: int) -> np.ndarray:
        return at[at + depth <= self.end[at]]


class Named:
    """Distinct names of some positions; ``split`` deals them to buckets, ``repeats`` reads the verdicts."""

    def __init__(self, names: np.ndarray, n_buckets: int, width: int = 8):
        if width < 8:
            names = names & np.uint64((1 << 64) - (1 << 8 * (8 - width)))
        self.unique, self.inverse, self.counts = np.unique(names, return_inverse=True, return_counts=True)
        self.width, bucket = width, ((self.unique >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        self.cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))

    def split(self, marks: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """The buckets' names; with ``marks`` (a flag for each position) a byte that is 1 if a position with this name has it."""
        raw = self.unique.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        if marks is not None:
            raw = np.column_stack([raw, (np.bincount(self.inverse, marks, len(self.unique)) > 0).astype(np.uint8)])
        for k in np.flatnonzero(np.diff(self.cuts)):
            yield int(k), raw[self.cuts[k] : self.cuts[k + 1]].tobytes()

    def repeats(self, verdicts: list[dict] | None, alone: bool = True) -> np.ndarray:
        """For each position whether its name was found; ``alone``: a name that the block holds twice needs no other block."""
        hit = self.counts > 1 if alone else np.zeros(len(self.counts), bool)
        for x in verdicts or []:
            a, b = self.cuts[x["bucket"]], self.cuts[x["bucket"] + 1]
            hit[a:b] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
        return hit[self.inverse]


def _verdict(group: pa.Table, width: int, marked: bool) -> pa.Table:
    """For one bucket of names: which names of each block occur in another block, or (marked) have a mark in any."""
    blobs = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width + marked) for x in group["names"]]
    sizes = [len(x) for x in blobs]
    full = np.zeros((sum(sizes), 8), np.uint8)
    blob = np.concatenate(blobs)
    full[:, :width] = blob[:, :width]
    names = full.view(">u8").ravel().astype(np.uint64)
    marks = blob[:, width] if marked else None
    del blobs, blob, full
    order = np.argsort(names)
    names = names[order]
    same = names[1:] == names[:-1]
    hit = np.zeros(len(names), bool)
    if marked:
        group_of = np.concatenate(([0], np.cumsum(~same)))
        hit[order] = (np.bincount(group_of, marks[order]) > 0)[group_of]
    else:
        hit[order[1:]] = same
        hit[order[:-1]] |= same
    bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])]
    return pa.table({"block": group["block"].cast(pa.int64()), "bucket": group["bucket"].cast(pa.int32()), "bits": pa.array(bits, pa.binary())})


def _verdicts(names: DataFrame, width: int, label: str) -> DataFrame:
    """(block, <label>): the verdicts of all buckets, brought back to the blocks."""
    found = names.groupBy("bucket").applyInArrow(lambda t: _verdict(t, width, label == "near"), "block long, bucket int, bits binary")
    return materialize(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(label)), f"suffix-{label}")


class Work:
    """One block in one pass: the stages up to where the verdicts so far allow."""

    def __init__(self, row: dict, text_col: str, n_buckets: int, width: int):
        self.block = b = Block(unpacked(row["data"]), text_col)
        short, long = width - COVER_MOD + 1, width + COVER_MOD - 1
        self.at = b.fits(b.sample, short)
        self.short = Named(b.names(self.at, short), n_buckets, 5)
        if "short" not in row:
            return
        self.tied = self.at[self.short.repeats(row["short"])]
        self.deep = b.fits(self.tied, long)
        self.long = Named(b.names(self.deep, long), n_buckets)
        if "long" not in row:
            return
        n = len(b.text)
        edge = np.zeros(n + 1, np.int32)
        settled = self.deep[self.long.repeats(row["long"])]
        np.add.at(edge, settled, 1)
        np.add.at(edge, settled + COVER_MOD, -1)
        self.start = np.cumsum(edge[:-1], dtype=np.int32) > 0  # of windows known to repeat
        seen = np.zeros(n + COVER_MOD + 1, np.int32)
        seen[self.tied + 1] = 1
        np.cumsum(seen, out=seen)
        self.open = b.fits(np.flatnonzero((seen[COVER_MOD : n + COVER_MOD] > seen[:n]) & ~self.start), width)
        held = np.zeros(n + 1, np.int32)
        held[self.open + 1] = 1
        np.cumsum(held, out=held)
        self.marks = held[self.tied + 1] > held[np.maximum(self.tied - COVER_MOD + 1, 0)]
        self.near = Named(b.names(self.tied, short), n_buckets, 5)
        if "near" not in row:
            return
        asked = np.zeros(n + 1, np.int32)
        q = self.tied[self.near.repeats(row["near"], alone=False)]
        np.add.at(asked, np.maximum(q - COVER_MOD + 1, 0), 1)
        np.add.at(asked, q + 1, -1)
        also = b.fits(np.flatnonzero((np.cumsum(asked[:-1], dtype=np.int32) > 0) & self.start), width)
        self.full = Named(b.names(np.concatenate([self.open, also]), width), n_buckets)
        if "full" not in row:
            return
        self.start[self.open[self.full.repeats(row["full"])[: len(self.open)]]] = True


def _emit(which: str, text_col: str, n_buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in records(batches):
            work = Work(row, text_col, n_buckets, width)
            parts = list(getattr(work, which).split(work.marks if which == "near" else None))
            if parts:
                k, blobs = zip(*parts, strict=True)
                yield pa.record_batch({"block": pa.array([row["block"]] * len(k), pa.int64()), "bucket": pa.array(k, pa.int32()), "names": pa.array(blobs, pa.binary())})

    return run


def whole_characters(gone: np.ndarray, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``gone`` widened to characters: a UTF-8 character of which a byte goes, goes; ``starts`` of texts begin characters, too."""
    begins = (text & 0xC0) != 0x80
    begins[starts] = True
    at = np.flatnonzero(begins)
    return np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.append(at, len(text)))) if len(at) else gone


def _cut(text_col: str, n_buckets: int, width: int, characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in records(batches):
            work = Work(row, text_col, n_buckets, width)
            b, n = work.block, len(work.block.text)
            edge = np.zeros(n + width + 1, np.int32)
            edge[np.flatnonzero(work.start)] += 1
            edge[np.flatnonzero(work.start) + width] -= 1
            gone = np.cumsum(edge, dtype=np.int32)[:n] > 0
            starts = b.off[:-1][b.off[:-1] < n]
            if characters:
                gone = whole_characters(gone, b.text, starts)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            first[starts] = gone[starts]
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[b.off])
            removed, spans = total(gone), total(first)
            at = np.flatnonzero(first)
            last = gone.copy()
            last[:-1] &= ~gone[1:]
            last[b.off[1:][b.off[1:] > 0] - 1] = gone[b.off[1:][b.off[1:] > 0] - 1]
            base = np.repeat(b.off[:-1], spans)
            pairs = pa.StructArray.from_arrays([pa.array(at - base, pa.int64()), pa.array(np.flatnonzero(last) + 1 - base, pa.int64())], ["start", "end"])
            out = {"row": b.rows, "n_bytes": pa.array(np.diff(b.off), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
            out["spans"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(spans))), pa.int32()), pairs)
            cuts = np.concatenate(([0], np.cumsum(np.diff(b.off) - removed))).astype(np.int32)
            out["kept"] = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(b.text[~gone].tobytes())])
            yield pa.record_batch(out)

    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", width: int = WIDTH, characters: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, spans, kept) for every input row.

    ``spans`` are the maximal removed runs as byte offsets, ``kept`` the bytes left, ``row`` the input row.  With
    ``characters`` a character of which a byte goes is removed as a whole, so that ``kept`` is text as far as the input was.
    """
    if width <= COVER_MOD:
        raise ValueError(f"width must be over {COVER_MOD}")
    spark = docs.sparkSession
    src = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    packed = src.mapInArrow(pack(text_col, BLOCK_BYTES), BLOCK_SCHEMA)
    buckets, name = shuffle_width(spark), f"therascape_suffix_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/therascape/suffix-blocks-{uuid.uuid4().hex}"
    packed.repartition(buckets, "block").write.bucketBy(buckets, "block").format("parquet").options(**LARGE_ROWS).option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(buckets, -(-size * 8 * len(COVER) // (COVER_MOD * BUCKET_BYTES)))
    known = blocks.select("block", "data")
    for which, bytes_each in (("short", 5), ("long", 8), ("near", 5), ("full", 8)):
        names = known.mapInArrow(_emit(which, text_col, n_buckets, width), _NAME_SCHEMA)
        known = known.join(_verdicts(names, bytes_each, which), "block", "left")
    schema = T.StructType([src.schema["row"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    return known.mapInArrow(_cut(text_col, n_buckets, width, characters), schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The input's rows and columns with repeated bytes cut out of the text.  Every row stays.

    A character of which a byte goes is cut as a whole; no other character is touched or made.
    """
    out = repeated_spans(docs, text_col, width, characters=True)
    clean = F.when(F.col("n_spans") == 0, F.col(f"row.`{text_col}`")).otherwise(F.col("kept").cast("string"))
    return out.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_suffix_dedup(spark, sf_dir):
    """Every document of ``documents``: what the removal of 200-byte repeats leaves."""
    out = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
