"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of text (operator 4, DataFrame functions only).

A text is cut, without losing a character, into sections (ended by a blank line), paragraphs (lines) and pieces
of up to ``PIECE_WORDS`` words.  A node's digest is the SHA-256 of its children's digests, a leaf's the MD5 of its
piece, so roots test whole texts for equality and differing branches locate edits.  A fingerprint string is
``root|sections``: sections joined by ``/``, their paragraphs by ``;``, a paragraph's leaves (6 hex digits) by ``.``.
Likeness is 1 for equal roots, else the Dice coefficient of the two sets of leaves.

Defined results: null text is empty; two empty texts are alike (1); repeated rows keep one row each and follow one
another in the order of (doc_id, text), or by a hash of the text where very many share an id; null ids come last; a lone
document's next document is itself; an empty table gives an empty table; the operators put the input's columns
inside ``row`` or leave them behind, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.llm.common import shuffle_width, table

PIECE_WORDS = 4
LEAF_DIGITS = 6
_SECTION = r"(?s).+?(?:\n[ \t\r]*\n\s*|\z)"
_PARAGRAPH = r"[^\n]*\n|[^\n]+"
_PIECE = rf"\s*(?:\S+\s*){{1,{PIECE_WORDS}}}|\s+"


def _cut(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tree(text: Column) -> Column:
    """array<array<array<string>>>: digests of the leaves by section and paragraph."""
    leaves = lambda p: F.transform(_cut(p, _PIECE), lambda x: F.md5(x))
    return F.transform(_cut(text, _SECTION), lambda s: F.transform(_cut(s, _PARAGRAPH), leaves))


def fingerprint_of(nodes: Column) -> Column:
    """The fingerprint string of a tree."""
    digest = lambda xs: F.sha2(F.array_join(xs, ""), 256)
    root = digest(F.transform(nodes, lambda s: digest(F.transform(s, digest))))
    short = lambda p: F.array_join(F.transform(p, lambda x: F.left(x, F.lit(LEAF_DIGITS))), ".")
    shown = F.array_join(F.transform(nodes, lambda s: F.array_join(F.transform(s, short), ";")), "/")
    return F.concat(root, F.lit("|"), shown)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprint strings, 0 to 1."""
    leaves = lambda x: F.array_distinct(F.filter(F.split(F.substring_index(x, "|", -1), "[./;]"), lambda y: y != ""))
    x, y = leaves(a), leaves(b)
    shared = F.size(F.array_intersect(x, y)).cast("double")
    dice = F.when(F.size(x) + F.size(y) == 0, F.lit(0.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y)))
    same = F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1)
    return F.when(same, F.lit(1.0)).otherwise(F.least(dice, F.lit(1.0)))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> of ``a`` whose branch is not at the same place in ``b`` (both count from 0)."""
    parts = lambda x: F.transform(F.split(F.substring_index(x, "|", -1), "/"), lambda s: F.split(s, ";"))
    other = parts(b)
    spread = F.transform(
        parts(a), lambda s, i: F.filter(F.transform(s, lambda p, j: F.when(~p.eqNullSafe(F.get(F.get(other, i), j)), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())
    )
    return F.flatten(spread)


def fingerprinted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, fingerprint) for every input row; null text counts as empty."""
    src = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return src.withColumn("nodes", tree(F.col("text"))).select("row", "text", fingerprint_of(F.col("nodes")).alias("fingerprint"))


def _range_of(x: Column, edges: list) -> Column:
    """How many of the sorted edges are at most x, looked up in two steps of about the root of their number."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= x))
    part = below(F.array(*map(F.lit, edges[::step])))
    fine = F.array(*[F.array(*map(F.lit, edges[k : k + step])) for k in range(0, len(edges), step)])
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * step + below(F.element_at(fine, F.greatest(part, F.lit(1)))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = 100_000) -> DataFrame:
    """(id, text, fingerprint, next_text, next_fingerprint): next by descending id, after the last comes the first.

    Documents are dealt by ranges of ids, so no task sees the whole order; ranges are cut at approximate percentiles.  An id (or
    null) of over ``often`` rows and more than a range's worth is a group of its own, dealt again by hashes of the texts, in whose
    order its rows then stand.  The first document of each group goes to the group before it as well, where it follows the last one.
    """
    n = 4 * shuffle_width(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("id"))
    seen = ids.groupBy("id").agg(F.count("*").alias("c"))
    rows, cuts = ids.agg(F.count("*"), F.percentile_approx("id", [k / n for k in range(1, n)], 20 * n)).first()
    # each has more than 1 / n of all rows, so these are fewer than n
    hot = seen.where(F.col("c") > max(often, rows // n)).collect()
    edges = sorted({*(cuts or []), *[r["id"] for r in hot if r["id"] is not None]})
    parts = F.coalesce(*[F.when(F.col("id").eqNullSafe(r["id"]), -(-r["c"] * n // rows)) for r in hot], F.lit(0))
    # in the order of documents: ranges from above, null ids last; an often repeated id is the least of its range
    range_of = F.when(F.col("id").isNull(), F.lit(1)).otherwise(-_range_of(F.col("id"), edges))
    group = F.struct(range_of.alias("range"), (parts > 0).alias("repeated"), F.when(parts > 0, F.pmod(F.col("tie"), parts)).otherwise(0).alias("part"))
    dealt = lambda df: df.withColumn("tie", F.when(parts > 0, F.xxhash64("text")) if hot else F.lit(None).cast("long")).withColumn("g", group)
    ids = docs.select(F.col(id_col).alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # a row for each group, some n at most: its first document's id and hash, and the group before it, for the first one the last
    heads = dealt(ids).groupBy("g").agg(F.max("id").alias("head"), F.min("tie").alias("head_tie"))
    whole = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("g", "head", "head_tie", F.coalesce(F.lag("g").over(Window.orderBy("g")), F.last("g").over(whole)).alias("up"))
    full = dealt(fingerprinted(docs, text_col).select(F.col(f"row.`{id_col}`").alias("id"), "text", "fingerprint"))
    both = full.join(F.broadcast(heads), "g")
    early, late = (F.struct(F.col(g).alias("g"), F.lit(k).alias("late")) for g, k in (("g", 0), ("up", 1)))
    first = F.col("id").eqNullSafe(F.col("head")) & F.col("tie").eqNullSafe(F.col("head_tie"))
    dealt_rows = both.select("id", "text", "fingerprint", "tie", F.explode(F.when(first, F.array(early, late)).otherwise(F.array(early))).alias("at"))
    order = Window.partitionBy("at.g").orderBy("at.late", F.desc_nulls_last("id"), "tie", "text")
    out = dealt_rows.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).where("at.late = 0")
    return out.select("id", "text", "fingerprint", F.col("next.text").alias("next_text"), F.col("next.fingerprint").alias("next_fingerprint"))


def op4_merkle_fingerprints(spark, sf_dir):
    """Every document of ``documents``: its fingerprint and likeness to its edited text and to the next document."""
    out = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    out = out.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - third), F.left("next_text", third)))
    out = out.withColumn("nodes", tree(F.col("edited"))).withColumn("edited_fingerprint", fingerprint_of(F.col("nodes")))
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
