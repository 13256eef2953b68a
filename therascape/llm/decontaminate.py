"""Benchmark decontamination with an FM-index for each shard of training text (operator 6).

Words are maximal runs of digits, lower-case letters (A-Z folded) and non-ASCII characters.  A window is ``WINDOW``
consecutive words of a benchmark item, or a whole item that has fewer.  Every document word inside any
occurrence of a window is hit.

A shard is a block of documents of about ``SHARD_BYTES``.  Its index covers all its words, numbered by the shard's own
vocabulary: a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix whose ranks drive the
backward search of all windows at once, and suffix positions sampled every ``SAMPLE`` symbols, from which occurrences
are located.  Shards and indexes are written once to the shared folder (``indexed``) and serve any number of benchmarks
(``search``).  Hits are merged to removal spans.

The benchmark is broadcast in parts of at most ``PART_BYTES`` of text; a larger one takes several passes over the
indexes, whose hits are written and merged.

Defined results: null has no words; items without words have no windows; items that share an id count once; a
null item id reads "null"; repeated documents are treated alike; empty tables give no hits; the input's columns, whatever
their names, come back inside ``row``.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import BLOCK_SCHEMA, LARGE_ROWS, materialize, pack, records, table, unpacked

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 2 << 20
#: Windows that are searched at a time.
SEARCHED = 1 << 16
#: Bytes of benchmark text broadcast at once; its windows take about 20 times as many in the driver and in each worker.
PART_BYTES = 4 << 20
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Bits:
    """A bit vector with ranks: bits packed in words, and the ones before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int32)))

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(bits, bitorder="little")
        return cls(np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), "<u8"))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low).astype(np.int64)

    def at(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level after another; queries are arrays."""

    def __init__(self, levels: list[Bits], zeros: list[int]):
        """Bits and their zeros from the highest bit of the symbols to the lowest."""
        self.levels = [(len(levels) - 1 - k, b, int(n)) for k, (b, n) in enumerate(zip(levels, zeros, strict=True))]

    @classmethod
    def of(cls, seq: np.ndarray, n_bits: int) -> WaveletMatrix:
        levels, zeros = [], []
        for bit in range(n_bits - 1, -1, -1):
            one = (seq >> bit) & 1 > 0
            levels.append(Bits.of(one))
            zeros.append(int(len(seq) - one.sum()))
            seq = np.concatenate([seq[~one], seq[one]])
        return cls(levels, zeros)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        first = np.zeros_like(at)
        for bit, bits, n in self.levels:
            one = (symbol >> bit) & 1 > 0
            x, y = bits.ones(at), bits.ones(first)
            at, first = np.where(one, n + x, at - x), np.where(one, n + y, first - y)
        return at - first

    def symbols(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol, first = np.zeros_like(at), np.zeros_like(at)
        for bit, bits, n in self.levels:
            one, x, y = bits.at(at), bits.ones(at), bits.ones(first)
            symbol |= one.astype(np.int64) << bit
            at, first = np.where(one, n + x, at - x), np.where(one, n + y, first - y)
        return symbol, at - first


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Places of the suffixes in sorted order, by prefix doubling; the last symbol must be the least and occur once.

    A suffix's rank is where its group of equal beginnings starts; only groups of two and more are sorted on.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    fresh = np.concatenate(([True], seq[order[1:]] != seq[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    shared = ~(fresh & np.append(fresh[1:], True))
    act, step = np.flatnonzero(shared), 1
    while len(act):
        at = order[act]
        key = rank[at] * (n + 1) + rank[at + step]
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[act] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh, act, 0))
        act = act[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Over a sequence of symbols of at least 1; 0 is added as its end."""

    def __init__(self, n: int, first: np.ndarray, ranks: WaveletMatrix, sampled: Bits, places: np.ndarray):
        self.n, self.top, self.first, self.ranks, self.sampled, self.places = n, len(first) - 2, first, ranks, sampled, places

    @classmethod
    def of(cls, seq: np.ndarray) -> FMIndex:
        seq = np.append(seq, 0).astype(np.int64)
        order, top = suffix_array(seq), int(seq.max())
        first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        taken = order % SAMPLE == 0
        return cls(len(seq), first, WaveletMatrix.of(seq[order - 1], max(1, top.bit_length())), Bits.of(taken), order[taken].astype(np.int32))

    def arrays(self) -> dict[str, np.ndarray]:
        """What is kept of the index; ``restored`` makes it again."""
        out = {f"level{k}": b.words for k, (_, b, _) in enumerate(self.ranks.levels)}
        return out | {"zeros": np.array([n for *_, n in self.ranks.levels]), "n": np.array(self.n), "first": self.first, "sampled": self.sampled.words, "places": self.places}

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> FMIndex:
        ranks = WaveletMatrix([Bits(a[f"level{k}"]) for k in range(len(a["zeros"]))], a["zeros"].tolist())
        return cls(int(a["n"]), a["first"], ranks, Bits(a["sampled"]), a["places"])

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of a matrix: where each one's suffixes start and end."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        live = np.flatnonzero((windows <= self.top).all(1))
        hi[np.setdiff1d(np.arange(len(windows)), live)] = 0
        for k in range(windows.shape[1] - 1, -1, -1):
            c = windows[live, k]
            lo[live], hi[live] = self.first[c] + self.ranks.rank(c, lo[live]), self.first[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi[lo >= hi] = lo[lo >= hi]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps to the left until a sampled position."""
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            at = rows[todo]
            found = self.sampled.at(at)
            out[todo[found]] = self.places[self.sampled.ones(at[found])] + steps
            todo, at = todo[~found], at[~found]
            symbol, before = self.ranks.symbols(at)
            rows[todo] = self.first[symbol] + before
            steps += 1
        return out


class Windows:
    """The benchmark's distinct windows as word numbers (2 and up), by length, with the items that hold them.

    ``by_length``: windows as rows of a matrix, and of each the items from ``first[k]`` to ``first[k + 1]`` in ``items``.  A window takes
    4 * WINDOW + 12 bytes or so.
    """

    def __init__(self, texts: list[tuple[str, bytes | None]]):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in texts})
        name_of = {item: k for k, item in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in texts:
            ids = np.array([self.number.setdefault(w, len(self.number) + 2) for w in words_of(text)], np.int32)
            if len(ids):
                size = min(len(ids), WINDOW)
                rows[size].append(np.lib.stride_tricks.sliding_window_view(ids, size))
                owners[size].append(np.full(len(ids) - size + 1, name_of[item], np.int32))
        self.by_length = {}
        for n in sorted(rows):
            windows, which = np.unique(np.concatenate(rows.pop(n)), axis=0, return_inverse=True)
            pair = np.unique(which.ravel().astype(np.int64) * len(self.names) + np.concatenate(owners.pop(n)))
            first = np.searchsorted(pair, np.arange(len(windows) + 1) * len(self.names))
            self.by_length[n] = (windows, first, (pair % len(self.names)).astype(np.int32))


def index_of(texts: list[bytes | None]) -> bytes:
    """The index of a shard's texts: words numbered from 2 in the order they first come, 1 after each text."""
    number: dict[bytes, int] = {}
    parts, sizes = [], []
    for text in texts:
        found = words_of(text)
        sizes.append(len(found))
        parts += [np.fromiter((number.setdefault(w, len(number) + 2) for w in found), np.int32, len(found)), np.ones(1, np.int32)]
    index = FMIndex.of(np.concatenate(parts) if parts else np.zeros(0, np.int32))
    words = np.frombuffer(b" ".join(number), np.uint8)
    sink = io.BytesIO()
    np.savez(sink, words=words, sizes=np.array(sizes, np.int64), **index.arrays())
    return sink.getvalue()


def find(index: bytes, bench: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Of a shard's documents: their words, the merged hit spans, as [first word, last word + 1), and the items found."""
    with np.load(io.BytesIO(index)) as f:
        kept = dict(f)
    del index
    sizes, shard = kept["sizes"], FMIndex.restored(kept)
    n, starts = len(sizes), np.cumsum(sizes + 1) - sizes - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    known = np.fromiter(map(bench.number.get, kept["words"].tobytes().split(), repeat(0)), np.int64)
    symbol = np.zeros(len(bench.number) + 2, np.int32)  # of each benchmark word in this shard
    symbol[known[known > 0]] = np.flatnonzero(known) + 2
    cover = np.zeros(shard.n + WINDOW + 1, np.int32)
    for size, (windows, first, holders) in bench.by_length.items():
        may, lo, count = [], [], []
        for k in range(0, len(windows), SEARCHED):
            here = symbol[windows[k : k + SEARCHED]]
            some = np.flatnonzero((here > 0).all(1))
            a, b = shard.search(here[some])
            may.append((some + k)[b > a])
            lo.append(a[b > a])
            count.append((b - a)[b > a])
        may, lo, count = np.concatenate(may), np.concatenate(lo), np.concatenate(count)
        which = np.repeat(may, count)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = shard.locate(rows)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        pair = np.unique(np.searchsorted(starts, at, side="right") - 1 + which * n)
        for w, d in zip(pair // n, pair % n, strict=True):
            items[d].update(bench.names[k] for k in holders[first[w] : first[w + 1]])
    hit = np.cumsum(cover) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    owner = np.searchsorted(starts, edge[::2], side="right") - 1
    for d, x, y in zip(owner, edge[::2] - starts[owner], edge[1::2] - starts[owner], strict=True):
        spans[d].append((int(x), int(y)))
    return sizes, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def indexed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(block, n_bytes, data, index): the documents in shards with their FM-indexes, written to the shared folder."""
    src = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out, packed = T.StructType.fromDDL(BLOCK_SCHEMA).add("index", "binary"), pack(text_col, SHARD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in records(packed(batches)):
            texts = unpacked(row["data"]).field(text_col).cast(pa.binary()).to_pylist()
            yield pa.record_batch({k: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for k, v in (row | {"index": index_of(texts)}).items()})

    return materialize(src.mapInArrow(run, out), "fm-shards", **LARGE_ROWS)


_FOUND = "block long, spans array<array<struct<first:long,end:long>>>, items array<array<string>>"
_FOUND_SPANS = pa.list_(pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))


def _found(shards: DataFrame, sent) -> DataFrame:
    """For each shard what one part of the benchmark finds in it; texts are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in records(batches):
            _, spans, items = find(row.pop("index"), sent.value)
            yield pa.record_batch(
                {
                    "block": pa.array([row["block"]], pa.int64()),
                    "spans": pa.array([[[{"first": a, "end": b} for a, b in x] for x in spans]], _FOUND_SPANS),
                    "items": pa.array([[sorted(x) for x in items]], pa.list_(pa.list_(pa.string()))),
                }
            )

    return shards.select("block", "index").mapInArrow(run, _FOUND)


def _each_shard(shards: DataFrame, benchmark: DataFrame, schema: T.StructType, put: Callable[..., dict[str, pa.Array]], part_bytes: int) -> DataFrame:
    """``put(rows, n_words, spans, items)`` of every shard, once all parts of the benchmark are searched."""
    spark = shards.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    parts = max(1, -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    found = None
    for part in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else bench
        sent = spark.sparkContext.broadcast(Windows([tuple(x) for x in rows.collect()]))  # about part_bytes of text
        if part < parts - 1:
            now = materialize(_found(shards, sent), f"fm-found-{part}")
            sent.unpersist()  # so that executors hold one part at a time
            found = now if found is None else found.union(now)
    # the last part, of most benchmarks the only one, is searched while the rows are put out, so texts meet no join without others
    wanted = shards.select("block", "data", "index")
    if found is not None:
        wanted = wanted.join(found.groupBy("block").agg(F.collect_list(F.struct("spans", "items")).alias("parts")), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in records(batches):
            sizes, spans, items = find(x.pop("index"), sent.value)  # the index is let go of before the rows are unpacked
            for other in x.get("parts") or []:
                spans = [_merged(a + [(s["first"], s["end"]) for s in b]) for a, b in zip(spans, other["spans"], strict=True)]
                items = [a | set(b) for a, b in zip(items, other["items"], strict=True)]
            yield pa.record_batch(put(unpacked(x.pop("data")), sizes, spans, items))

    return wanted.mapInArrow(run, schema)


def search(shards: DataFrame, benchmark: DataFrame, row: T.StructField, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row, n_words, spans, items) for every document of indexed shards: spans of hit words, items sorted as strings.

    ``row`` is the field that the documents' rows have, as in ``hits``.
    """

    def put(rows: pa.StructArray, sizes: np.ndarray, spans: list[list[tuple[int, int]]], items: list[set[str]]) -> dict[str, pa.Array]:
        pairs = pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], _FOUND_SPANS.value_type)
        return {"row": rows, "n_words": pa.array(sizes, pa.int64()), "spans": pairs, "items": pa.array([sorted(s) for s in items], pa.list_(pa.string()))}

    span = T.ArrayType(T.StructType().add("first", "long").add("end", "long"))
    out = T.StructType([row]).add("n_words", "long").add("spans", span).add("items", T.ArrayType(T.StringType()))
    return _each_shard(shards, benchmark, out, put, part_bytes)


def _row_field(docs: DataFrame) -> T.StructField:
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).schema["row"]


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(row, n_words, spans, items) for every input row; spans of hit words, items sorted as strings."""
    return search(indexed(docs, text_col), benchmark, _row_field(docs), part_bytes)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without hit words and what stands between them."""
    folded, at, kept, n, k = text.translate(_FOLD), 0, [], 0, 0
    pos = 0
    for word in folded.split():
        pos = folded.index(word, pos)
        if k < len(spans) and n == spans[k][0]:
            kept.append(text[at:pos])
        pos += len(word)
        n += 1
        if k < len(spans) and n == spans[k][1]:
            at, k = pos, k + 1
    return b"".join([*kept, text[at:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The input's rows and columns, with every hit span cut out of the text.  Every row stays.

    Spans are cut in the task that finds them, so texts pass to Python and back once.
    """

    def put(rows: pa.StructArray, sizes: np.ndarray, spans: list[list[tuple[int, int]]], items: list[set[str]]) -> dict[str, pa.Array]:
        fields, at = rows.flatten(), rows.type.get_field_index(text_col)
        if any(spans):
            texts, kind = fields[at].cast(pa.binary()), fields[at].type
            fields[at] = pa.array([_without(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, spans, strict=True)], pa.binary()).cast(kind, safe=False)  # bytes that are no text stay
        return {"row": pa.StructArray.from_arrays(fields, fields=list(rows.type))}

    out = _each_shard(indexed(docs, text_col), benchmark, T.StructType([_row_field(docs)]), put, part_bytes)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_decontaminate(spark, sf_dir):
    """Every document of ``documents`` against all windows of ``benchmark``."""
    out = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    out = out.select(F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


OP6_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws, row_number() OVER () AS rn FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, len(g) AS n, array_to_string(g, ' ') AS g FROM
        (SELECT item, ws[k : k + {WINDOW - 1}] AS g FROM i, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - {WINDOW} + 2))) AS k) t WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT rn, k, n, array_to_string(ws[k : k + n - 1], ' ') AS g FROM w, sizes, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS k) t WHERE len(ws) >= n),
m AS (SELECT rn, k, occ.n, item FROM occ JOIN win USING (n, g)),
h AS (SELECT rn, count(DISTINCT p) AS n_hit FROM m, LATERAL (SELECT unnest(range(k, k + n)) AS p) t GROUP BY rn),
it AS (SELECT rn, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rn, item FROM m) GROUP BY rn)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (rn) LEFT JOIN it USING (rn)
"""
