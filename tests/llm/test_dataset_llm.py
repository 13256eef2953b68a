"""Divergence audit, dataset manifest and sharding against brute force, over awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from therascape.llm import divergence, manifest, sharding

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, n int, key string, idx long, row string, value long"


def _rows():
    rng = random.Random(5)
    vocab = [f"w{c}{d}" for c in "abcdefghij" for d in "äklmnop"]
    out = []
    for k in range(260):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "b", "é", "", None, f"s{k}"])
        text = " ".join(rng.choice(vocab[: 10 + 3 * (k % 7)]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", "\nB9z\n", " ÄÖ-x_Y "])
        out.append((k, source, rng.choice(["en", "en", "de", None]), len(text), text))
    copy = "the same words Again " * 30 + "\n"
    out += [(1000 + k, "hot", "en", len(copy), copy) for k in range(130)]
    out += [(None, "a", "en", None, "no id\n"), (None, "a", "en", None, "no id\n"), (None, None, None, None, None), (7, "hot", "en", 1, "other text of id 7"), (9, "hot", "en", None, None)]
    out += [out[20], out[20], (5000, "long", "en", None, "Long wordß\n" * 300_000), (5001, "blank", "xx", 2, " \n"), (5002, "lone", "yy", 0, "")]
    return [(*r, 1, "k", 2, "r", 3) for r in out]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


def terms(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if "a" <= c <= "z" or c >= "\x80" else " " for c in text or "")
    return Counter(fold.split(" ")) - Counter({"": 10**9})


def test_audit_equals_brute_force(docs):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in ROWS:
        lang, source, found = r[2] or "", r[1] or "", terms(r[4])
        groups.add((lang, source))
        n[lang, source].update(found)
        df[lang].update(found.keys())
    kept = {lang: sorted(t for t, k in df[lang].items() if k >= 10) for lang, _ in groups}
    total = {g: sum(n[g][t] for t in kept[g[0]]) for g in groups}
    want = []
    for lang, source in groups:
        v, ts = len(kept[lang]), kept[lang]
        p = lambda count, whole: 1 + 10**9 * (count + 2) // (whole + 2 * v)  # noqa: B023,E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = {t: p(n[lang, source][t], total[lang, source]) for t in ts}
        pairs = [(sum(f(mine[t], p(n[lang, o][t], total[lang, o])) for t in ts), o) for x, o in groups if x == lang and o != source]
        in_lang = {t: p(sum(n[g][t] for g in groups if g[0] == lang), sum(total[g] for g in groups if g[0] == lang)) for t in ts}
        own = [(f(mine[t], in_lang[t]), t) for t in ts if n[lang, source][t] and mine[t] > in_lang[t]]
        for part, items, most in (("pair", pairs, None), ("term", own, 10)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            want += [(lang, source, part, o, value, k + 1) for k, (value, o) in enumerate(items[:most])]
    got = [tuple(r) for r in divergence.audit(docs).collect()]
    assert len(groups) > 40 and sorted(got) == sorted(want)


def test_pairs_handed_on_in_parts_add_up(docs, monkeypatch):
    whole = sorted(map(tuple, divergence.audit(docs, least_docs=2).collect()))
    monkeypatch.setattr(divergence, "MOST_PAIRS", 7)
    monkeypatch.setattr(divergence, "STRETCH_BYTES", 500)
    assert sorted(map(tuple, divergence.audit(docs, least_docs=2).collect())) == whole


def test_terms_of_invalid_bytes_do_not_break_the_audit(spark):
    rows = spark.range(12).selectExpr("id AS doc_id", "CAST(X'FF41' AS STRING) AS source", "'en' AS lang", "CAST(concat(X'FE41', CAST(' b' AS BINARY)) AS STRING) AS text")
    assert divergence.audit(rows).count() == 0  # a lone source


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[1], r[2], r[3], text)))


def tree(nodes):
    """The top of a list of digests, and each one's steps (left, right)."""
    steps, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + 3, len(nodes))) for k in range(0, len(nodes), 3)]
        for run in runs:
            for j in run:
                for leaf_no in at[j]:
                    steps[leaf_no].append(("".join(nodes[i] for i in run if i < j), "".join(nodes[i] for i in run if i > j)))
        nodes, at = [sha("".join(nodes[j] for j in run)) for run in runs], [sum((at[j] for j in run), []) for run in runs]
    return nodes[0], steps


def manifest_by_hand(rows):
    by = defaultdict(list)
    for r in rows:
        by[(r[1] is not None, (r[1] or "").encode())].append(r)
    tops, parts = [], []
    for source in sorted(by):
        mine = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        top, steps = tree([leaf(r, r[4]) for r in mine])
        tops.append(top)
        parts.append((mine, steps))
    root, above = tree(tops)
    out = []
    for top, more, (mine, steps) in zip(tops, above, parts):
        for r, low in zip(mine, steps):
            path = low + more
            touched = r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            x = leaf(r, r[4].replace("\n", "") if touched else r[4])
            for left, right in path:
                x = sha(left + x + right)
            out.append((r[0], leaf(r, r[4]), top, root, sha("".join(a + b for a, b in path)), x, x == root))
    return out


@pytest.mark.parametrize("some", [slice(None), slice(0, 1), slice(0, 2), slice(3, 31), slice(-1, None)])
def test_manifest_equals_brute_force(spark, tmp_path, some):
    rows = ROWS[some]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in manifest.op12_dataset_manifest(spark, str(tmp_path)).collect()]
    want = manifest_by_hand(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(rows) < 30 or {v for *_, v in want} == {True, False}


def test_manifest_of_sources_of_one_leaf_each(spark, tmp_path):
    rows = [(k, f"s{k}", "en", 1, "x", 1, "k", 2, "r", 3) for k in range(11)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, manifest.op12_dataset_manifest(spark, str(tmp_path)).collect())) == sorted(manifest_by_hand(rows))


def check_shards(rows, got, shards, within=200):
    size = lambda r: len((r[4] or "").encode()) + 1
    assert Counter((r[0], size(r), crc32((r[4] or "").encode())) for r in rows) == Counter((g.row.doc_id, g["size"], g.crc) for g in got)
    total, largest = sum(map(size, rows)), max(map(size, rows))
    slots, by = defaultdict(list), Counter()
    for g in got:
        slots[g.shard].append(g.slot)
        by[g.shard] += g["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    below = 0
    for i in range(1, shards):
        below += by[i - 1]
        assert abs(below - i * total / shards) <= max(total / shards / within, largest / 2) + 1e-6


def test_shards_are_near_equal_and_slots_without_gaps(docs):
    some = [r for r in ROWS if len(r[4] or "") < 10_000]
    got = sharding.shard(docs.where("coalesce(length(text), 0) < 10000"), shards=5).collect()
    check_shards(some, got, 5)
    # copies lie next to each other: a group smaller than a shard is in two of them at most
    where = defaultdict(set)
    for g in got:
        where[g.row.text].add(g.shard)
    assert sum(len(x) > 1 for x in where.values()) <= 4
    check_shards(ROWS, sharding.shard(docs).collect(), 16)


def test_groups_of_copies_and_whole_repeats_are_split(spark):
    copies = [(k, None, None, None, "copy " * 20, 1, "k", 2, "r", 3) for k in range(900)]
    repeats = [(None, None, None, None, "repeat " * 20, 1, "k", 2, "r", 3)] * 900
    few = [(k, None, None, None, None if k % 2 else "x" * k, 1, "k", 2, "r", 3) for k in range(900, 930)]
    rows = copies + repeats + few
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check_shards(rows, sharding.shard(frame).collect(), 16)
    keys = sharding.materialize(sharding.keyed(frame, ["doc_id"]), "t").select("key", "size")
    found = sharding.plan(keys, ranges=32)
    assert found.starts == sorted(found.starts) and len(found.starts) >= 24  # hot groups lie in ranges of their own
    assert sharding.plan(keys, ranges=1).starts[1:] and len({*sharding.plan(keys, ranges=1).shard}) == 16


def test_more_shards_than_rows_and_written_shards(spark, docs, tmp_path):
    got = sharding.shard(docs.limit(3), shards=16).collect()
    assert len({g.shard for g in got}) == len(got) == 3 and {g.slot for g in got} == {0}
    some = docs.where("doc_id < 50").drop("row")
    sharding.write_shards(some, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(r.text) for r in some.collect())
    for k in range(4):
        slots = [r.slot for r in spark.read.parquet(f"{tmp_path}/out/shard={k}").collect()]
        assert sorted(slots) == list(range(len(slots)))


def test_ordinal_fit_has_no_gradient_left_and_stays_with_more_steps():
    import numpy as np

    from therascape.llm import toxicity

    rng = np.random.default_rng(9)
    n, m = 3000, 40
    row, col = np.repeat(np.arange(n), 6), rng.integers(0, m, 6 * n)
    val = 1 + np.abs(rng.normal(size=6 * n))
    score = np.bincount(row, rng.normal(size=m)[col] * val, n) + rng.normal(size=n)
    for grade in (np.digitize(score, [0, 2, 4]), np.where(score > 1, 3, 0), np.where(score > 3, 2, 0)):
        few, more = (toxicity.Model.__new__(toxicity.Model) for _ in range(2))
        few._descend(row, col, val, grade, m)
        more._descend(row, col, val, grade, m, steps=400)
        assert (few.w == more.w).all() and (few.theta == more.theta).all() and (np.diff(few.theta) >= -1e-6).all()
        e = (1 / (1 + np.exp(few.theta - np.bincount(row, few.w[col] * val, n)[:, None])) - (grade[:, None] > np.arange(3))) / n
        assert np.abs(np.bincount(col, e.sum(1)[row] * val, m) + 1e-5 * few.w).max() < 1e-8 and np.abs(e.sum(0)).max() < 1e-6


def test_mixing_of_thousands_of_sources_is_earliest_deadline_first(spark):
    import heapq

    from therascape.llm import mixing

    rng = random.Random(2)
    weights = {f"s{k}": rng.choice([1, 1, 1, 2, 3, 5, 40]) for k in range(3000)} | {"big": 9000}
    got = {(r.key, r.k): r.slot for r in mixing.one_period(spark.createDataFrame(list(weights.items()), "key string, q long")).collect()}
    total = sum(weights.values())
    ready, later = [], sorted((((k - 1) * total // q, -(-k * total // q), key, k) for key, q in weights.items() for k in range(1, q + 1)), reverse=True)
    for slot in range(total):
        while later and later[-1][0] <= slot:
            heapq.heappush(ready, later.pop()[1:])
        deadline, key, k = heapq.heappop(ready)
        assert got[key, k] == slot < deadline
    assert len(got) == total


def test_mixing_spreads_rows_without_an_id(spark):
    from therascape.llm import mixing

    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a' AS source", "concat('text ', id % 1900) AS text")
    out = mixing.mix(docs).selectExpr("row.text", "position")
    first, second = ({r.position: r.text for r in out.collect()} for _ in range(2))
    assert first == second and sorted(first) == list(range(2000))
    assert mixing.mix(docs.repartition(7)).selectExpr("row.text", "position").exceptAll(out).count() == 0
