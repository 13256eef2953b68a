"""A Merkle manifest of a dataset, built level by level with DataFrames (operator 12).

Rows are leaves: SHA-256 over the fields, each with its length.  The leaves of a source stand by id; runs of ``FANOUT`` consecutive nodes become
their digest, level after level, until the source's subroot remains, and the subroots of all sources go on likewise to the root.  A level is one
grouping by (source, floor(index / FANOUT)) of rows a third as many as the one before, written to the shared folder with its
children; going down, each level joins its nodes with their proofs and hands each child its siblings, so a proof travels once to a third of the
rows it is for, and the leaves themselves meet in no join.

Indices are counted without a window over a whole source: the leaves, without texts, are ranged by (source, id, leaf) and
written, numbered inside each range and source, and moved by the sum of the ranges before.  A source with a third of all rows lies in as many
ranges as its share.

Defined results: a null field is the leaf's ``-``, so null and empty text differ; a null source is one of its own and the first; null ids
come first in their source and are not tampered with; rows of one id stand by their leaves, and rows alike in all fields
take places of their own (such rows lie in one range, a few hundred bytes each); a lone leaf is its subroot, a lone subroot the root, and a proof without siblings
the digest of nothing; texts of any length are hashed whole; an empty table gives an empty result; the fields are picked by name, and other
columns do not come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from therascape.llm.common import CRC_STEPS_SQL, crc_sql, materialize, numbered, table

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields in their order."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def _levels(most: int, fanout: int) -> int:
    """How often ``most`` nodes are put together until one is left."""
    k = 0
    while most > 1:
        most, k = -(-most // fanout), k + 1
    return k


def grow(nodes: DataFrame, key: str, tag: str, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above ``nodes`` (key, idx, n, digest and whatever else a leaf has to carry), lowest first.

    A level has (key, idx, n, below, digest, kids): n counts the nodes of the key there, ``below`` those of the level below, kids are the rows below
    in their order, each with ``pos``.  A key of one node passes unchanged, as many levels as the largest key needs.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    for k in range(_levels(most, fanout)):
        kid = F.struct((F.col("idx") % fanout).cast("int").alias("pos"), *[c for c in nodes.columns if c not in (key, "idx", "n", "below", "kids")])
        up = nodes.groupBy(key, F.floor(F.col("idx") / fanout).alias("idx")).agg(F.max("n").alias("below"), F.array_sort(F.collect_list(kid)).alias("kids"))
        digests = F.array_join(F.transform("kids", lambda x: x["digest"]), "")
        digest = F.when(F.col("below") > 1, F.sha2(digests, 256)).otherwise(digests)
        out.append(materialize(up.select(key, "idx", F.ceil(F.col("below") / fanout).cast("long").alias("n"), "below", digest.alias("digest"), "kids"), f"{tag}-{k}"))
        nodes = out[-1].select(key, "idx", "n", "digest")
    return out


#: A step up: what stands left and right of a node among its siblings.
STEPS = "array<struct<l:string,r:string>>"


def descend(levels: list[DataFrame], tops: DataFrame, key: str, fanout: int = FANOUT) -> DataFrame:
    """(key, kid, steps, and what tops has beside): every node below the lowest level with its steps to the root; tops: (key, steps, ...) of the keys' last nodes."""
    other = [c for c in tops.columns if c not in (key, "steps")]
    above = tops.withColumn("idx", F.lit(0).cast("long"))
    beside = lambda keep: F.array_join(F.transform(F.filter("kids", keep), lambda x: x["digest"]), "")
    for level in reversed(levels):
        nodes = level.join(above, [key, "idx"]).withColumn("kid", F.explode("kids"))
        step = F.struct(beside(lambda x: x["pos"] < F.col("kid.pos")).alias("l"), beside(lambda x: x["pos"] > F.col("kid.pos")).alias("r"))
        steps = F.when(F.col("below") > 1, F.concat(F.array(step), "steps")).otherwise(F.col("steps"))
        nodes = nodes.select(key, (F.col("idx") * fanout + F.col("kid.pos")).alias("idx"), "kid", steps.alias("steps"), *other)
        above = nodes.drop("kid")
    return nodes.drop("idx")


def siblings_digest(steps: Column) -> Column:
    """The digest of all siblings from below to above, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to; a step without siblings hashes the node alone."""
    return F.aggregate(steps, leaf, lambda a, s: F.sha2(F.concat(s["l"], a, s["r"]), 256))


def manifest(leaves: DataFrame) -> DataFrame:
    """(leaf, subroot, root, steps, and what leaves has beside) for every row of leaves: (key, doc_id, leaf, ...).

    Keys are never null; they order the subroots.
    """
    other = [c for c in leaves.columns if c not in ("key", "leaf")]
    leaves = materialize(leaves, "leaves")  # its texts are hashed once
    nodes = materialize(numbered(leaves, "key", "doc_id", "leaf").withColumnRenamed("leaf", "digest"), "nodes")
    levels = grow(nodes.select("key", "idx", "n", "digest", *other), "key", "source")
    subroots = (levels[-1] if levels else nodes).select("key", "digest").withColumn("all", F.lit(0))
    tops = materialize(numbered(subroots, "all", "key"), "subroots")
    over = grow(tops, "all", "root")
    root = (over[-1] if over else tops).select("all", F.col("digest").alias("root"), F.array().cast(STEPS).alias("steps"))  # one row
    if over:
        down = descend(over, root, "all").select(F.col("kid.key").alias("key"), F.col("kid.digest").alias("subroot"), "root", "steps")
    else:
        down = tops.join(root, "all").select("key", F.col("digest").alias("subroot"), "root", "steps")
    if not levels:  # every source is a lone leaf
        return nodes.join(down, "key").select(F.col("digest").alias("leaf"), *other, "subroot", "root", "steps")
    return descend(levels, down, "key").select(F.col("kid.digest").alias("leaf"), *[F.col("kid")[c].alias(c) for c in other], "subroot", "root", "steps")


def op12_dataset_manifest(spark, sf_dir):
    """Every row of ``documents``: its leaf, subroot, root and proof, and whether the row, tampered with or not, still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    fields = [F.col(c) for c in FIELDS]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(*fields).alias("leaf"),
        F.when(touched, leaf_of(*fields[:-1], F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"),
    )
    out = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(part, (*FIELDS[:-1], text)))})"


def _up_sql(start: str) -> str:
    """The nodes of all levels by key, from (key, idx, n, h)."""
    return f"""SELECT 0 AS level, key, idx, n, h FROM {start} UNION ALL
           SELECT level + 1, key, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM {start[:-1]}_up
           WHERE n > 1 GROUP BY level, key, idx // {FANOUT}, n"""


def _steps_sql(nodes: str, leaf: str, first: int) -> str:
    """A row's steps: what stands left and right of it at each level."""
    side = lambda op: f"coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx {op} x.idx // CAST({FANOUT} ** u.level AS BIGINT)), '')"
    return f"""SELECT x.{leaf} AS who, u.level + {first} AS level, {side('<')} AS l, {side('>')} AS r
           FROM {nodes} x JOIN {nodes[:-1]}_up u ON u.key = x.key AND u.n > 1 AND u.idx // {FANOUT} = x.idx // CAST({FANOUT} ** (u.level + 1) AS BIGINT)
           GROUP BY x.{leaf}, x.idx, u.level"""


OP12_SQL = f"""
WITH RECURSIVE crc_steps AS MATERIALIZED ({CRC_STEPS_SQL}),
d AS (SELECT doc_id, coalesce('s:' || source, '') AS key, {_leaf_sql('text')} AS h,
             CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered
      FROM documents, crc_steps),
nodes AS MATERIALIZED (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM d),
node_up AS ({_up_sql('nodes')}),
subs AS MATERIALIZED (SELECT 0 AS key, key AS source, h, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM node_up WHERE n = 1),
sub_up AS ({_up_sql('subs')}),
low AS ({_steps_sql('nodes', 'row', 0)}),
high AS ({_steps_sql('subs', 'source', 1000)}),
path AS (SELECT row, list({{'l': l, 'r': r}} ORDER BY level) AS steps
         FROM (SELECT who AS row, level, l, r FROM low UNION ALL SELECT nodes.row, level, l, r FROM nodes JOIN high ON high.who = nodes.key) GROUP BY row)
SELECT doc_id, nodes.h AS leaf, subs.h AS subroot, root.h AS root, sha256(coalesce(list_reduce(steps, lambda a, s: a || s.l || s.r, ''), '')) AS proof_sha256,
       coalesce(list_reduce(steps, lambda a, s: sha256(s.l || a || s.r), coalesce(tampered, nodes.h)), tampered, nodes.h) AS folded_root,
       folded_root = root.h AS verified
FROM nodes LEFT JOIN path USING (row) JOIN subs ON subs.source = nodes.key, (SELECT h FROM sub_up WHERE n = 1) root
"""
