"""How the sources of a language differ in their words: a sort-based streaming audit (operator 11).

A task folds stretches of about ``STRETCH_BYTES`` of text into one row a (lang, term, source), with its documents and occurrences;
these rows, far fewer than the words, are repartitioned by (lang, term) and sorted by the term's number (a hash of 64 bits), and a run-length
scan, which tells terms of one number apart by their names, gives each term's document frequency and its count in each source.  So a word of every document brings one row a stretch
and source, no task holds more than the counts of one term by source, and no text is shuffled.  A second scan, over the kept terms in the
same order, adds up what each term's run says of pairs of sources and keeps each group's best terms.

p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) is the smoothed share of a term in a group, V the kept terms of the language, N the
group's occurrences of them; p0 is that of a count of 0.  Two groups differ at a term by f(p, q) = floor((p - q)**2 / (p + q)).  Of a pair the
sum over all V terms is made of: the terms that both have (from the runs), those of each (by how often each count occurs) and
V times f(p0, q0), so pairs of (term, source) that do not occur are never written out.  All of it is whole numbers (decimals of 38 digits for p).

Defined results: null text, language and source are empty strings; each row is a document, repeated ids too; a group without terms has
count 0 everywhere and takes part in the pairs; a language without kept terms has pairs of value 0; a lone source has no pairs; ties
go by the item's bytes (all names are compared as bytes, valid UTF-8 or not); texts of any length are read whole, one text at a time; an empty table gives an empty result; the columns are
picked by name, so others cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.llm.common import materialize, table

STRETCH_BYTES = 16 << 20
#: A term is kept if at least so many documents of its language have it.
LEAST_DOCS = 10
#: Terms of a group that are reported.
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Pairs of sources held by a scan before they are added up, and added-up ones before they are handed on.
MOST_PAIRS = 1 << 20

#: Term bytes: letters of ASCII (A-Z folded) and all bytes of other characters.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, term, source, docs, n): one row a term and source of each stretch of texts."""
    docs: dict[tuple, Counter] = defaultdict(Counter)
    seen: dict[tuple, Counter] = defaultdict(Counter)
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in seen.items():
            terms.pop(b"", None)
            k = len(terms)
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * k, pa.binary()),
                    "term": pa.array(list(terms), pa.binary()),
                    "source": pa.array([source] * k, pa.binary()),
                    "docs": pa.array(list(map(docs[lang, source].__getitem__, terms)), pa.int64()),
                    "n": pa.array(list(terms.values()), pa.int64()),
                }
            )

    for batch in batches:
        langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
        for k in range(batch.num_rows):
            text = texts[k].as_py()
            words = text.translate(_FOLD).split(b" ")
            group = langs[k].as_py(), sources[k].as_py()
            seen[group].update(words)
            docs[group].update(set(words))
            size += len(text)
            if size >= STRETCH_BYTES:
                yield from out()
                docs.clear(), seen.clear()
                size = 0
    yield from out()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(number, lang, term, source, docs, n), sorted by number, the rows of equal names within a batch added up."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["number", "lang", "term", "source"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
        t = t.take(pa.array(np.argsort(t["number"].to_numpy(), kind="stable")))  # groups come in no order
        yield from zip(*(t[c].to_pylist() for c in ("number", "lang", "term", "source", "docs_sum", "n_sum")))


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.record_batch(list(zip(*held)), schema=schema)
            held = []
    if held:
        yield pa.record_batch(list(zip(*held)), schema=schema)


_RUNS = pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("source", pa.binary()), ("n", pa.int64()), ("in_lang", pa.int64()), ("opens", pa.bool_())])


def _run_lengths(least: int):
    """(number, lang, term, source, docs, n), sorted by number, to the kept runs: (lang, term, source, n, in_lang, opens), one row a source of each term."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[tuple]:
            for _, run in groupby(_collapsed(batches), lambda r: r[0]):
                frequency: Counter = Counter()
                counts: dict[tuple, Counter] = defaultdict(Counter)
                for _, lang, term, source, docs, n in run:
                    frequency[lang, term] += docs
                    counts[lang, term][source] += n
                # one term, or the few of one number
                for (lang, term), mine in counts.items():
                    if frequency[lang, term] >= least:
                        whole = sum(mine.values())
                        for k, (source, n) in enumerate(mine.items()):
                            yield lang, term, source, n, whole, k == 0

        yield from _emit(kept(), _RUNS)

    return scan


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f(p, q); both are at most SCALE + 1, so the square fits 64 bits."""
    return (p - q) ** 2 // (p + q)


def gap(p: Column, q: Column) -> Column:
    """f(p, q) of two long columns."""
    p, q = p.cast("decimal(19,0)"), q.cast("decimal(19,0)")
    return _whole((p - q) * (p - q), p + q)


def _whole(a: Column, b: Column) -> Column:
    """floor(a / b) of decimals that are not negative, exactly."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p: null where the language has no kept term."""
    return _whole((count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(total.cast("decimal(20,0)") + terms * 2, F.lit(0))) + 1


_PARTS = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def _pairs_and_terms(top: int, most: int):
    """Sorted (lang, term, source, p, p0, q) to partial rows: what the terms that both of a pair have add to it, and each group's best terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_lang(rows: Iterator[tuple], lang: bytes) -> Iterator[tuple]:
            number: dict[bytes, int] = {}
            names: list[bytes] = []
            best: dict[bytes, list] = defaultdict(list)
            keys, values, held = [], [], 0

            def added() -> tuple[np.ndarray, np.ndarray]:
                if not keys:
                    return np.zeros(0, np.int64), np.zeros(0, np.int64)
                both, back = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, back, np.concatenate(values))
                return both, total

            def put(both: np.ndarray, total: np.ndarray) -> Iterator[tuple]:
                for k, v in zip(both.tolist(), total.tolist()):
                    a, b = sorted((names[k >> 32], names[k & 0xFFFFFFFF]))
                    yield lang, a, "pair", b, v

            for term, run in groupby(rows, lambda r: r[1]):
                run = list(run)
                for _, _, source, p, _, q in run:
                    if source not in number:
                        number[source] = len(names)
                        names.append(source)
                    if p > q:
                        mine = best[source]
                        mine.append((-((p - q) ** 2 // (p + q)), term))
                        if len(mine) >= 64 * top:
                            mine.sort()
                            del mine[top:]
                if len(run) < 2:
                    continue
                run.sort(key=lambda r: number[r[2]])
                ids = np.array([number[r[2]] for r in run], np.int64)
                p, p0 = (np.array([r[k] for r in run], np.int64) for k in (3, 4))
                block = max(1, most // len(run))
                for i in range(0, len(run) - 1, block):
                    at = slice(i, min(i + block, len(run)))
                    a, b = p[at, None], p0[at, None]
                    more = _gap(a, p) - _gap(a, p0) - _gap(b, p) + _gap(b, p0)
                    upper = ids[at, None] < ids
                    keys.append((ids[at, None] << 32 | ids)[upper])
                    values.append(more[upper])
                    held += len(keys[-1])
                    if held >= 2 * most:
                        both, total = added()
                        if len(both) >= most:
                            yield from put(both, total)
                            keys, values, held = [], [], 0
                        else:
                            keys, values, held = [both], [total], len(both)
            yield from put(*added())
            for source, mine in best.items():
                for value, term in sorted(mine)[:top]:
                    yield lang, source, "term", term, -value

        def both() -> Iterator[tuple]:
            for lang, rows in groupby(_rows(batches), lambda r: r[0]):
                yield from of_lang(rows, lang)

        yield from _emit(both(), _PARTS)

    return scan


def term_runs(docs: DataFrame, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, source, n, in_lang, opens): the count of each kept term in each source that has it and in its language; ``opens`` marks a term's first row."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary")
    src = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    folded = src.mapInArrow(_folded, "lang binary, term binary, source binary, docs long, n long")
    # sorted by a term's number alone, which takes no comparison of rows; terms of one number are told apart by name in the scan
    number = F.xxhash64("lang", "term")
    dealt = folded.repartition("lang", "term").sortWithinPartitions(number)
    return dealt.select(number.alias("number"), "lang", "term", "source", "docs", "n").mapInArrow(_run_lengths(least_docs), "lang binary, term binary, source binary, n long, in_lang long, opens boolean")


def groups_of(docs: DataFrame, runs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, total, has, v, lang_total, p0): a row for each group that occurs; ``has`` counts its kept terms, v those of the language."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary")
    occurring = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    counted = runs.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"), F.sum(F.col("opens").cast("long")).alias("opened"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = occurring.join(counted, ["lang", "source"], "left").select("lang", "source", zero("total"), zero("has"), zero("opened"))
    langs = groups.groupBy("lang").agg(F.sum("opened").alias("v"), F.sum("total").alias("lang_total"))
    return groups.drop("opened").join(langs, "lang").withColumn("p0", share(F.lit(0), F.col("total"), F.col("v")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by how far they are, ``term`` the group's own terms."""
    runs = materialize(term_runs(docs, least_docs, text_col, lang_col, source_col), "runs")
    groups = materialize(groups_of(docs, runs, lang_col, source_col), "groups")
    shares = runs.join(groups.select("lang", "source", "total", "v", "lang_total", "p0"), ["lang", "source"])
    shares = shares.select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", share(F.col("in_lang"), F.col("lang_total"), F.col("v")).alias("q"))
    scanned = shares.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    scanned = materialize(scanned.mapInArrow(_pairs_and_terms(top_terms, MOST_PAIRS), "lang binary, source binary, part string, item binary, value long"), "parts")
    # each group's own terms against the other's share of absent ones, by how often each share occurs
    levels = runs.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups.select("lang", "source", "total", "v"), ["lang", "source"])
    levels = levels.select("lang", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("has").alias("item_has"), F.col("p0").alias("q0"))
    alone = levels.join(other, "lang").where("source != item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("q0"))).alias("value"))
    rest = (F.col("v") - F.col("has") - F.col("item_has")) * gap(F.col("p0"), F.col("q0"))
    nowhere = groups.join(other, "lang").where("source != item").select("lang", "source", "item", F.coalesce(rest, F.lit(0)).alias("value"))
    both = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    shared = scanned.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = both(shared).unionByName(both(alone)).unionByName(nowhere).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    parts = pairs.withColumn("part", F.lit("pair")).unionByName(scanned.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = parts.select("lang", "source", "part", "item", "value", rank.alias("rank")).where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
    return out.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")], "value", "rank")


def op11_source_divergence(spark, sf_dir):
    """Each (lang, source) group of ``documents``: all other sources of its language by distance and its ten most telling terms."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT lang, source, g.source AS s, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ltot AS (SELECT lang, sum(total) AS total FROM tot GROUP BY lang),
p AS (SELECT kept.lang, tot.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + 2)) // (tot.total + 2 * v.v) AS p
      FROM kept JOIN tot USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = kept.lang AND c.source = tot.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + ({SCALE} * (sum(c.n) + 2)) // (any_value(ltot.total) + 2 * any_value(v.v)) AS q
      FROM c JOIN ltot USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
out AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
        FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
        UNION ALL
        SELECT p.lang, p.source, 'term', p.term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM out)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
