"""Mixing sources to target weights by Pfair scheduling (operator 1, DataFrame functions only).

A source of weight q (of Q = sum of all q) gets its k-th block of documents between the release time
floor((k - 1) * Q / q) and the deadline ceil(k * Q / q); earliest deadline first then fills slot after slot from the
released blocks.  With whole weights one processor meets all deadlines, so before any slot each source has been
given less than one block more or less than its share, and the schedule repeats after Q slots.  One
period is therefore computed from the weights alone, and every block's slot follows by arithmetic; no task walks over the blocks of a source.

The fold over a period's slots looks at one candidate for each different weight, not for each source: sources of equal weight have the same times, so
among them the next one by name is the earliest.  There are at most sqrt(2 * Q) different weights.  ``SEGMENT`` slots at a time are
folded and written, so a period of any length takes bounded memory and time in proportion to it.

Within a source documents stand in the order of (md5 of the id, id).  Positions are counted for 256 or more ranges of
that digest apart and put together by a sum over counts, so a source with a third of all rows is spread as well.

No row is dropped or repeated.  A source that runs out leaves its slots empty, from then on shares are of what is left:
``full_mix`` says whether a block's slot lies before the first empty one.  Defined results: null is a source of
its own; null ids come last in their source, by a digest of their whole row, and are spread like others by it (rows alike in everything take places
of their own, in one task); repeated rows take places of their own; sources without a given
weight get weight 1; texts of any length travel whole; an empty table gives an empty table; other columns come back inside ``row``, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.llm.common import materialize, numbered, shuffle_width, table

BLOCK_ROWS = 16
#: Slots over which the default weights are spread, or ``SLOTS_EACH`` for every source where these are more.
SLOTS = 1000
SLOTS_EACH = 4
#: Slots of the longest period for given weights; default weights have no such bound.
MOST_SLOTS = 1 << 24
#: Slots that one inner fold fills, and that are folded before they are written.
LEAP = 128
SEGMENT = 1 << 15


def default_weights(counts: DataFrame) -> DataFrame:
    """(key, rows, q): weights by the square root of a source's rows, whole numbers of at least 1 that sum to about the slots."""
    whole = counts.agg(F.sum(F.sqrt("rows")).alias("roots"), F.greatest(F.lit(SLOTS), SLOTS_EACH * F.count("*")).alias("slots"))
    share = F.sqrt("rows") / F.col("roots")
    return counts.join(F.broadcast(whole)).withColumn("q", F.greatest(F.lit(1), F.floor(F.col("slots") * share + 0.5)).cast("long")).drop("roots", "slots")


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _common_divisor(w: Column) -> Column:
    """The greatest common divisor of all q by Euclid's steps (92 suffice for 64 bits)."""
    euclid = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.coalesce(s["a"] % F.nullif(s["b"], F.lit(0)), F.lit(0).cast("long")).alias("b")))
    both = lambda a, x: F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), x["q"].alias("b")), euclid, lambda s: s["a"])
    return F.aggregate(w, F.lit(0).cast("long"), both)


def _div(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers that are not negative."""
    return F.call_function("div", a, b)


def one_period(weights: DataFrame, most: int | None = MOST_SLOTS) -> DataFrame:
    """(key, q, k, slot, period): the slots of each source's first q blocks; weights: (key, q), a row for each source.

    The q that come back are divided by their greatest common divisor, so that the period is as short as can be.  A period of over ``most`` slots is
    an error (None: no bound).
    """
    ranked = numbered(weights.select("key", "q").withColumn("all", F.lit(0)), "all", "key").select("key", "q", F.col("idx").alias("rank"))
    classes = ranked.groupBy("q").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    one = classes.agg(F.array_sort(F.collect_list(F.struct("q", "ranks"))).alias("w")).where(F.size("w") > 0)
    one = materialize(one.withColumn("g", _common_divisor(F.col("w"))), "divisor")  # one row; else the divisor would be computed for each weight
    one = one.select("g", F.transform("w", lambda x: F.struct(_div(x["q"], F.col("g")).alias("q"), F.size(x["ranks"]).cast("long").alias("m"), x["ranks"].alias("ranks"))).alias("w"))
    one = one.withColumn("period", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["q"] * x["m"]))
    one = one.withColumn("nxt", F.transform("w", lambda x: F.struct(F.lit(1).cast("long").alias("k"), F.lit(0).cast("long").alias("i"))))
    one = materialize(one, "weights")
    known = one.select("period").first()
    period = known[0] if known else 0
    if most is not None and period > most:
        raise ValueError(f"the period of the weights is {period} slots, over {most}: use rounder weights")
    state, made = one, []
    for begin in range(0, period, SEGMENT):
        done = materialize(state.select("g", "w", "period", _segment(F.lit(begin).cast("long"), F.lit(min(period, begin + SEGMENT) - 1).cast("long")).alias("f")), "segment")
        made.append(done.select("g", "w", "period", F.explode("f.out").alias("s")))
        state = done.select("g", "w", "period", F.col("f.nxt").alias("nxt"))
    if not made:
        return weights.limit(0).select("key", "q", *[F.lit(0).cast("long").alias(c) for c in ("k", "slot", "period")])
    slots = made[0]
    for more in made[1:]:
        slots = slots.unionByName(more)
    of = F.element_at("w", F.col("s.j") + 1)
    slots = slots.select(of["q"].alias("q"), F.element_at(of["ranks"], (F.col("s.i") + 1).cast("int")).alias("rank"), F.col("s.k").alias("k"), F.col("s.slot").alias("slot"), "period")
    return slots.join(ranked.select("key", "rank"), "rank").select("key", "q", "k", "slot", "period")


def _segment(begin: Column, end: Column) -> Column:
    """struct(nxt, out): the slots from begin to end filled, and what comes next of each weight."""
    period = F.col("period")

    def due(w: Column, nxt: Column, t: Column) -> Column:
        """The released block of the earliest deadline, then the first source by name."""

        def candidate(x: Column, j: Column) -> Column:
            deadline = _div(x["k"] * period + x["w"]["q"] - 1, x["w"]["q"])
            rank = F.element_at(x["w"]["ranks"], (x["i"] + 1).cast("int"))
            return F.struct(deadline.alias("deadline"), rank.alias("rank"), j.cast("int").alias("j"), x["k"].alias("k"), x["i"].alias("i"), x["w"]["m"].alias("m"), _div((x["k"] - 1) * period, x["w"]["q"]).alias("release"))

        both = F.zip_with(nxt, w, lambda n, x: F.struct(n["k"].alias("k"), n["i"].alias("i"), x.alias("w")))
        return F.array_min(F.filter(F.transform(both, candidate), lambda x: x["release"] <= t))

    def step(w: Column, acc: Column, t: Column) -> Column:
        def taken(d: Column) -> Column:
            after = F.when(d["i"] + 1 < d["m"], F.struct(d["k"].alias("k"), (d["i"] + 1).alias("i"))).otherwise(F.struct((d["k"] + 1).alias("k"), F.lit(0).cast("long").alias("i")))
            given = F.struct(d["j"].alias("j"), d["i"].alias("i"), d["k"].alias("k"), t.alias("slot"))
            return F.struct(F.transform(acc["nxt"], lambda n, j: F.when(j == d["j"], after).otherwise(n)).alias("nxt"), F.concat(acc["out"], F.array(given)).alias("out"))

        return _let(due(w, acc["nxt"], t), taken)

    empty = F.array().cast("array<struct<j:int,i:bigint,k:bigint,slot:bigint>>")

    def leap(w: Column, acc: Column, first: Column) -> Column:
        """``LEAP`` slots: their list grows by itself, so the long one is copied once for all of them."""
        slots = F.sequence(first, F.least(first + (LEAP - 1), end))
        part = F.aggregate(slots, F.struct(acc["nxt"].alias("nxt"), empty.alias("out")), lambda a, t: step(w, a, t))
        return _let(part, lambda p: F.struct(p["nxt"].alias("nxt"), F.concat(acc["out"], p["out"]).alias("out")))

    # the weights are copied out of the row's bytes once, which makes each of the many looks at them cheap
    copied = F.transform("w", lambda x: F.struct(x["q"].alias("q"), x["m"].alias("m"), x["ranks"].alias("ranks")))
    firsts = F.sequence(begin, end, F.lit(LEAP).cast("long"))
    return _let(copied, lambda w: F.aggregate(firsts, F.struct(F.col("nxt").alias("nxt"), empty.alias("out")), lambda a, b: leap(w, a, b)))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, block, release, deadline, slot, position, full_mix) for every input row.

    ``position`` orders the mix: slot * block_rows + the row's place in its block.  All times count blocks.
    """
    src = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.coalesce(F.concat(F.lit("s:"), docs[source_col].cast("string")), F.lit("null")).alias("key"))
    # digests are cut to ranges: 256 of them on a small cluster, 16 times the shuffle partitions or more on a large one
    digits = max(2, len(f"{shuffle_width(docs.sparkSession):x}") + 1)
    lone = F.concat(F.lit("~"), F.md5(F.to_json("row")))
    src = src.withColumn("digest", F.coalesce(F.md5(F.col("id").cast("string")), lone)).withColumn("part", F.left("digest", F.when(F.col("id").isNull(), digits + 1).otherwise(digits)))
    parts = src.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = src.groupBy("key").agg(F.count("*").alias("rows"))
    if weights is None:
        weighted = default_weights(counts)
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (f"s:{k}", int(v))]) if weights else None
        q = F.greatest(F.lit(1), F.coalesce(given[F.col("key")], F.lit(1)) if given is not None else F.lit(1))
        weighted = counts.withColumn("q", q.cast("long"))
    period = materialize(one_period(weighted.select("key", "q"), None if weights is None else MOST_SLOTS), "period")
    # the first empty slot: each source's block after its last
    blocks = F.ceil(F.col("rows") / block_rows).cast("long")
    after = counts.select("key", blocks.alias("b")).join(period, "key").where(F.col("k") == F.col("b") % F.col("q") + 1)
    empty = after.agg(F.min(F.floor(F.col("b") / F.col("q")) * F.col("period") + F.col("slot")).alias("empty"))
    parts = parts.select("key", "part", F.coalesce(before, F.lit(0)).alias("before")).join(period.where("k = 1").select("key", "q"), "key")
    order = Window.partitionBy("key", "part").orderBy("digest", F.asc_nulls_last("id"))
    placed = src.withColumn("n", F.row_number().over(order)).join(parts, ["key", "part"])
    placed = placed.withColumn("n", F.col("before") + F.col("n") - 1).withColumn("block", F.floor(F.col("n") / block_rows).cast("long") + 1)
    placed = placed.withColumn("k", (F.col("block") - 1) % F.col("q") + 1).drop("q")
    placed = placed.join(period, ["key", "k"]).join(F.broadcast(empty))  # one row
    slot = F.floor((F.col("block") - 1) / F.col("q")) * F.col("period") + F.col("slot")
    return placed.select(
        "row",
        "block",
        F.floor((F.col("block") - 1) * F.col("period") / F.col("q")).cast("long").alias("release"),
        F.ceil(F.col("block") * F.col("period") / F.col("q")).cast("long").alias("deadline"),
        slot.cast("long").alias("slot"),
        (slot * block_rows + F.col("n") % block_rows).cast("long").alias("position"),
        (slot < F.col("empty")).alias("full_mix"),
    )


def op1_mix_sources(spark, sf_dir):
    """Every document of ``documents``: its block, release time, deadline, slot and position in the mix."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("row.doc_id", "row.source", "block", "release", "deadline", "slot", "position", "full_mix")


OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS key, md5(CAST(doc_id AS VARCHAR)) AS digest FROM documents),
c AS (SELECT key, count(*) AS n_rows FROM d GROUP BY key),
w AS (SELECT key, n_rows, CAST(greatest(1, floor(greatest({SLOTS}, {SLOTS_EACH} * count(*) OVER ()) * (sqrt(n_rows) / sum(sqrt(n_rows)) OVER ()) + 0.5)) AS BIGINT) AS q FROM c),
p AS (SELECT CAST(sum(q) AS BIGINT) AS period FROM w),
job AS (SELECT key, q, k, period, ((k - 1) * period) // q AS r, (k * period + q - 1) // q AS dl,
               row_number() OVER (ORDER BY (k * period + q - 1) // q, key) - 1 AS id
        FROM w, p, LATERAL (SELECT unnest(range(1, q + 1)) AS k) t),
jobs AS (SELECT list(r ORDER BY id) AS rs FROM job),
fill AS (SELECT CAST(0 AS BIGINT) AS t, CAST([] AS BIGINT[]) AS done, range(0, len(rs)) AS todo, rs FROM jobs
         UNION ALL
         SELECT t + 1, list_append(done, pick), list_filter(todo, lambda x: x <> pick), rs
         FROM (SELECT t, done, todo, rs, list_filter(todo, lambda x: rs[x + 1] <= t)[1] AS pick FROM fill WHERE len(todo) > 0)),
slots AS (SELECT unnest(done) AS id, generate_subscripts(done, 1) - 1 AS slot FROM fill WHERE len(todo) = 0),
per AS (SELECT key, q, k, period, slot FROM job JOIN slots USING (id)),
e AS (SELECT min((b // per.q) * period + slot) AS empty
      FROM (SELECT key, (n_rows + {BLOCK_ROWS} - 1) // {BLOCK_ROWS} AS b FROM c) x JOIN per ON x.key = per.key AND per.k = x.b % per.q + 1),
n AS (SELECT d.doc_id, d.source, d.key, row_number() OVER (PARTITION BY d.key ORDER BY digest, doc_id) - 1 AS i FROM d),
b AS (SELECT n.*, i // {BLOCK_ROWS} + 1 AS block, w.q AS wq FROM n JOIN w USING (key))
SELECT doc_id, source, CAST(block AS BIGINT) AS block,
       CAST(((block - 1) * period) // q AS BIGINT) AS release, CAST((block * period + q - 1) // q AS BIGINT) AS deadline,
       CAST(((block - 1) // q) * period + slot AS BIGINT) AS slot,
       CAST((((block - 1) // q) * period + slot) * {BLOCK_ROWS} + i % {BLOCK_ROWS} AS BIGINT) AS "position",
       ((block - 1) // q) * period + slot < empty AS full_mix
FROM b JOIN per ON b.key = per.key AND per.k = (block - 1) % wq + 1, e
"""
