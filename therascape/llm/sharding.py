"""Shards of near equal bytes by histogram sort (operator 13).

Rows are ordered by a key of 40 hex digits: 16 of the text's MD5, 16 of the id's, 8 that tell whole repeats apart.  The boundaries
between shards are found by counting: bytes and rows below the candidate boundaries of 4 digits are counted over all partitions, exactly; where the
nearest candidate to a shard's ideal end is off by more than one part in ``WITHIN`` of a shard, only the cell that holds the ideal end is
counted again by two more digits, until all are near enough or a cell is one row.  As candidates of up to 16 digits never lie within
equal texts, copies stay together wherever such a boundary is near enough; a group of copies larger than that is split by its ids.  The
counts also give ranges of about equal rows (hot groups included) with the slot that each begins at, so rows are then exchanged once, to their range,
and numbered there.

The driver gets counts of cells alone: 65,536 at first, then 256 for each of at most ``shards`` + 2 * shuffle partitions cells.

Defined results: null text counts as empty, of size 1; a null id is one value; repeated rows get slots of their own, in no fixed order among
themselves, and can be split between shards; a text larger than a shard stays whole, and with fewer rows than shards some shards are
empty; texts of any length count whole; an empty table gives an empty result; the carried columns come back inside ``row``, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from therascape.llm.common import CRC_STEPS_SQL, crc_sql, materialize, shuffle_width, table

SHARDS = 16
#: A boundary may be off by one part in so many of a shard's bytes.
WITHIN = 200
DIGITS = 40
#: Digits of the first candidates, and how many each refinement adds.
FIRST, MORE = 4, 2


class Cell(NamedTuple):
    """All keys of one beginning: their bytes and rows, the smallest and the largest of them."""

    prefix: str
    size: int
    rows: int
    least: str
    most: str


class Plan(NamedTuple):
    """``starts``: the least key of each range, in order; ``shard`` and ``slot``: where its first row goes."""

    starts: list[str]
    shard: list[int]
    slot: list[int]


def keyed(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, key, size, crc) for every input row; ``row`` holds the columns to carry (all of them by default)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    half = lambda c: F.left(F.md5(c.cast("binary")), F.lit(16))
    key = F.concat(half(text), half(F.coalesce(docs[id_col].cast("string"), F.lit(""))), F.left(F.md5(F.monotonically_increasing_id().cast("string")), F.lit(8)))
    row = F.struct(*[docs[c] for c in (docs.columns if carry is None else carry)])
    return docs.select(row.alias("row"), key.alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"))


def _counted(keys: DataFrame, digits: int) -> list[Cell]:
    found = keys.groupBy(F.left("key", F.lit(digits)).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most"))
    return sorted(Cell(*r) for r in found.collect())


def _shared(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


class _Ends:
    """The shards' boundaries as they are found: for each ideal end the beginning of the cell next to it."""

    def __init__(self, total: int, shards: int, within: int):
        self.total, self.shards, self.within = total, shards, within
        self.found: dict[int, str] = {}

    def look(self, cells: list[Cell]) -> set[str]:
        """Settle what can be settled; the prefixes of the cells that must be counted again."""
        below = np.concatenate(([0], np.cumsum([c.size for c in cells]))).tolist()
        again = set()
        for i in range(1, self.shards) if cells else ():
            if i in self.found:
                continue
            ideal = i * self.total
            # the last cell that begins at or before the ideal end
            k = int(np.searchsorted(np.array(below, np.float64) * self.shards, ideal, "right")) - 1
            k = min(max(k, 0), len(cells) - 1)
            while k and below[k] * self.shards > ideal:
                k -= 1
            while k + 1 < len(cells) and below[k + 1] * self.shards <= ideal:
                k += 1
            off = [abs(self.shards * below[j] - ideal) for j in (k, k + 1)]
            at = k if off[0] <= off[1] else k + 1
            if min(off) * self.within <= self.total or cells[k].least == cells[k].most:
                self.found[i] = cells[at].prefix if at < len(cells) else "g"  # after all hex digits
            else:
                again.add(cells[k].prefix)
        return again


def plan(keys: DataFrame, shards: int = SHARDS, within: int = WITHIN, ranges: int | None = None) -> Plan:
    """Count and refine until the boundaries are near enough; keys: (key, size), written, as it is read once a refinement."""
    ranges = ranges or 2 * shuffle_width(keys.sparkSession)
    digits = FIRST
    cells = _counted(keys, digits)
    rows = sum(c.rows for c in cells)
    ends = _Ends(sum(c.size for c in cells), shards, within)
    while True:
        again = ends.look(cells) | {c.prefix for c in cells if c.rows * ranges > 2 * rows and c.least != c.most}
        if not again:
            break
        # cells that go on come from the last count, so all their prefixes are of one length; at most shards + ranges / 2
        inside = keys.where(F.left("key", F.lit(digits)).isin(sorted(again)))
        steps = max(0, min(_shared(c.least, c.most) for c in cells if c.prefix in again) - digits) // MORE
        digits += MORE * (steps + 1)
        cells = sorted([c for c in cells if c.prefix not in again] + _counted(inside, digits), key=lambda c: c.least)
    bounds = sorted(ends.found.values())
    out, shard, slot, here = Plan([], [], []), -1, 0, 0
    for c in cells:
        of = sum(b <= c.prefix for b in bounds)
        if of != shard or here * ranges >= rows:
            slot, here, shard = (0, 0, of) if of != shard else (slot, 0, shard)
            out.starts.append(c.prefix), out.shard.append(of), out.slot.append(slot)
        slot, here = slot + c.rows, here + c.rows
    return out


def _dealt(p: Plan):
    starts, shard, slot = np.array(p.starts, f"S{DIGITS}"), np.array(p.shard, np.int32), np.array(p.slot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(starts, np.array(batch.column("key").to_pylist(), f"S{DIGITS}"), "right") - 1
            made = {"range": pa.array(at.astype(np.int32)), "shard": pa.array(shard[at]), "first": pa.array(slot[at])}
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    return run


def shard(docs: DataFrame, shards: int = SHARDS, within: int = WITHIN, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, size, crc, shard, slot) for every input row: ``shard`` from 0, ``slot`` its place there, in the order of keys, without gaps."""
    rows = materialize(keyed(docs, carry, id_col, text_col), "shard-keys")
    found = plan(rows.select("key", "size"), shards, within)
    dealt = rows.mapInArrow(_dealt(found), T.StructType([*rows.schema.fields]).add("range", "integer").add("shard", "integer").add("first", "long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return dealt.withColumn("slot", F.col("first") + place - 1).select("row", "size", "crc", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The rows of ``docs`` in one folder a shard (``shard=0`` and so on), with ``slot`` and sorted by it in every file; docs has no such columns."""
    out = shard(docs, shards)
    out.select("row.*", "slot", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_shard_histogram(spark, sf_dir):
    """Every document of ``documents``: its size, shard and slot; the shards' bytes are near equal."""
    out = shard(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = f"""
WITH crc_steps AS MATERIALIZED ({CRC_STEPS_SQL}),
d AS (SELECT doc_id, coalesce(text, '') AS x, strlen(x) + 1 AS size, left(md5(x), 16) || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 16) AS k FROM documents),
c AS (SELECT doc_id, size, {crc_sql('x')} AS text_crc32, k, CAST(coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM d, crc_steps),
total AS (SELECT CAST(sum(size) AS BIGINT) AS t FROM c),
edge AS (SELECT n AS digits, min(below) AS pos FROM c, range({FIRST}, {DIGITS - 8 + 1}, {MORE}) r(n) GROUP BY n, left(k, n)
         UNION ALL SELECT n, t FROM total, range({FIRST}, {DIGITS - 8 + 1}, {MORE}) r(n)),
near AS (SELECT i, digits, pos, abs({SHARDS} * pos - i * t) AS off, t FROM edge, total, range(1, {SHARDS}) r(i)
         QUALIFY row_number() OVER (PARTITION BY i, digits ORDER BY off, pos) = 1),
bound AS (SELECT i, pos FROM near QUALIFY row_number() OVER (PARTITION BY i ORDER BY off * {WITHIN} > t, CASE WHEN off * {WITHIN} > t THEN -digits ELSE digits END) = 1),
placed AS (SELECT c.*, CAST((SELECT count(*) FROM bound WHERE pos <= below) AS INTEGER) AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""
