"""SimHash near-duplicate groups through BK-trees (operator 8).

A document's fingerprint holds one bit for each of 64 positions: 1 if over half the XXH64 values (seed 42) of
its 3-word shingles have it.  Fingerprints link at ``RADIUS`` or fewer differing bits.

Distinct fingerprints alone are compared, so copies cost nothing.  They are dealt to shards by the pigeonhole
rule: cut 64 bits into four blocks; two fingerprints that differ in two bits or fewer agree on two blocks, so
they meet in the shard of one of the six block pairs.  A shard that holds over ``SPLIT_OVER`` fingerprints is
dealt again by pairs of byte blocks of its other 32 bits.  In each shard a BK-tree is built - children keyed by their
integer Hamming distance to the parent - and a search follows only edges within the radius.  The trees are
not broadcast: they grow with the corpus, so they stay where their shard is and the fingerprints come to
them by the shuffle.  A shard returns links that join its fingerprints into the same groups as all links
would (at most one for each fingerprint), and components are found by large-star/small-star rounds.

No fingerprint, shard or component fills a task, whatever its share of the rows: joins on them go through
``join_spread``, and a shard that was dealt again agrees on 48 bits, so it holds 65,536 fingerprints at most.

Defined results: null or blank text has fingerprint zero and links like any other; repeated rows share a
component; a null id never names a component unless all its ids are null; an empty table gives an empty table;
other columns, whatever their names, never meet those of the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import join_spread, materialize, shuffle_width, table

RADIUS = 2
SPLIT_OVER = 2000


def fingerprint(text: bytes | None) -> int:
    """SimHash over 3-word shingles, repeats included; fewer words: the whole sequence; none: zero."""
    words = (text or b"").lower().split()  # bytes: A-Z alone fold, six blanks alone split
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        h = np.array([digest(b" ".join(words), 42)], np.uint64)
    else:
        h = np.fromiter((digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        counts += np.unpackbits(h[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: Column, text_col: str = "text") -> DataFrame:
    """(carry, fp): the fingerprint, as a signed 64-bit integer, of every row, beside a column of the caller's choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.record_batch({"carry": batch.column("carry"), "fp": pa.array(fp.view(np.int64), pa.int64())})

    src = docs.select(carry.alias("carry"), docs[text_col].cast("binary").alias("text"))
    return src.mapInArrow(run, T.StructType([src.schema["carry"]]).add("fp", "long"))


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        at = self.root
        self.children[x] = {}
        if at is None:
            self.root = x
            return
        while True:
            below, d = self.children[at], (at ^ x).bit_count()
            if d not in below:
                below[d] = x
                return
            at = below[d]

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                found.append(at)
            below = self.children[at]
            todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found


def _forest(shard: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join the shard's distinct fingerprints like all links within the radius do."""
    tree, up = BKTree(), {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x in shard:
        up[x] = x
        for y in tree.within(x, radius):
            a, b = top(x), top(y)
            if a != b:
                up[a] = b
                yield x, y
        tree.add(x)


def _links(sharded: DataFrame, radius: int) -> DataFrame:
    """(a, b), a > b: links found in shards, whose rows stand together and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch({"a": pa.array([max(x) for x in pairs], pa.int64()), "b": pa.array([min(x) for x in pairs], pa.int64())})

        mask, sign = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
        links = lambda: [(sign(x), sign(y)) for x, y in _forest(held, radius)] if len(held) > 1 else []
        for batch in batches:
            pairs = []
            for shard, fp in zip(batch.column("shard").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if shard != key:
                    pairs += links()
                    held, key = [], shard
                held.append(fp & mask)
            yield out(pairs)
        yield out(links())

    return sharded.select("shard", "fp").mapInArrow(run, "a long, b long")


def _pairs_of_blocks(fp: str, low: int, bits: int) -> list:
    """Keys for the six pairs of four blocks of ``bits`` bits from bit ``low``: pair number, then the pair's bits."""
    block = [F.shiftrightunsigned(F.col(fp), low + bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(4)]
    both = [(i, j) for i in range(4) for j in range(i)]
    return [F.shiftleft(F.lit(n).cast("long"), 2 * bits) + F.shiftleft(block[i], bits) + block[j] for n, (i, j) in enumerate(both)]


def shard_links(distinct: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp``, enough to join every group."""
    if radius > 2:
        raise ValueError("the pigeonhole rule here holds for a radius of 2 at most")
    n = shuffle_width(distinct.sparkSession)
    keyed = materialize(distinct.select("fp", F.explode(F.array(*_pairs_of_blocks("fp", 0, 16))).alias("shard")), "simhash-keys")
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1").withColumn("n", F.col("size"))
    keyed = materialize(join_spread(keyed, sizes, "shard", keyed.count()), "simhash-shards")
    links = _links(keyed.where(F.col("size") <= split_over).repartition(n, "shard").sortWithinPartitions("shard", "fp"), radius)
    large = keyed.where(F.col("size") > split_over)
    # the other two blocks of a large shard, as 32 bits together, are dealt again; ranks by pair number as in _pairs_of_blocks
    other = {0: (3, 2), 1: (3, 1), 2: (2, 1), 3: (3, 0), 4: (2, 0), 5: (1, 0)}
    part = lambda k: F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF))
    pair = F.shiftrightunsigned(F.col("shard"), 32)
    rest = F.lit(None).cast("long")
    for number, (i, j) in other.items():
        rest = F.when(pair == number, F.shiftleft(part(i), 16) + part(j)).otherwise(rest)
    again = large.withColumn("rest", rest).select("fp", "shard", F.explode(F.array(*_pairs_of_blocks("rest", 0, 8))).alias("sub"))
    again = again.select("fp", F.concat_ws(":", "shard", "sub").alias("shard"))
    return links.union(_links(again.repartition(n, "shard").sortWithinPartitions("shard", "fp"), radius)).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has a link (a, b), by star rounds.

    A round hangs each node's larger neighbours on its smallest one, then its smaller ones; the number of links
    never grows, and O(log n squared) rounds leave stars.  Each round is written, so none is computed twice.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = state(links)
    while now[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = join_spread(both, least, "a", 2 * now[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "links-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, least, "a", 2 * now[0])
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        links = materialize(small.where("a <> b").distinct(), "links")
        was, now = now, state(links)
        if was == now:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _groups(fps: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, least, n, root) of each distinct fingerprint: the smallest ``least`` of its rows, their number and its group."""
    distinct = materialize(fps.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(shard_links(distinct.select("fp"), radius))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the smallest id reachable over links."""
    fps = materialize(fingerprints(docs, docs[id_col], text_col).withColumnRenamed("carry", "id"), "simhash")
    group = materialize(_groups(fps, F.col("id"), radius), "simhash-groups")
    least = group.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    members = join_spread(group.select("fp", F.col("n").alias("rows"), "root"), least, "root", group.count())
    members = materialize(members.select("fp", "component", F.col("rows").alias("n")), "simhash-members")
    return join_spread(fps, members, "fp", fps.count()).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The input's rows without near copies: exactly one row of each group stays, that with the smallest id.

    Null ids come last; of rows that share the smallest id any one stays.  The choice goes by a mark of the row, written once beside
    it, so equal ids and equal rows do no harm.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = materialize(fingerprints(docs, row, text_col).withColumn("mark", F.monotonically_increasing_id()), "simhash-rows")
    place = F.struct(F.col(f"carry.`{id_col}`").isNull().alias("no_id"), F.col(f"carry.`{id_col}`").alias("id"), "mark")
    kept = _groups(rows, place, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.mark")
    return rows.join(kept, "mark", "left_semi").select(*[F.col(f"carry.`{c}`").alias(c) for c in docs.columns])


def op8_simhash_bktree(spark, sf_dir):
    """Every document of ``documents``: its SimHash fingerprint and near-duplicate component."""
    out = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
