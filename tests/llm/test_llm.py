"""Small cases with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from therascape.llm import chunk_dedup, decontaminate, licenses, merkle, mixing, quality, simhash_dedup, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, source string, row string, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base, part = words(rng, 120), words(rng, 60)
    out = [(k, words(rng, rng.randint(1, 90)), f"s{k % 3}", "x", "y") for k in range(30)]
    out += [(100, base, "s0", None, None), (101, base, "s0", "r", None), (102, base[:300] + "ö" + base[300:], None, "r", "k"), (103, part + " " + words(rng, 50), "s1", "r", "k"), (104, "é " + words(rng, 33) + " " + part, "s1", "r", "k")]
    out += [(105, None, "s2", None, None), (106, "", "s2", None, None), (None, "lone text without id", "s2", None, None), (107, words(rng, 9000), "s0", "r", "k"), (107, "twice the same id", "s0", "r", "k"), (108, "aaaa" * 120, "s1", "", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_difference_cover_holds_every_shift():
    d = suffix_dedup.COVER
    assert sorted({(a - b) % suffix_dedup.COVER_MOD for a in d for b in d}) == list(range(suffix_dedup.COVER_MOD))


def test_suffix_dedup_equals_brute_force(docs, rows):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = []
    for k, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((k, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept))
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated_spans(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 1000
    clean = suffix_dedup.remove_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)


def test_simhash_components_equal_brute_force(spark, docs, rows):
    fp = [simhash_dedup.fingerprint(None if r[1] is None else r[1].encode()) for r in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        want.append((r[0], fp[i] - (1 << 64) if fp[i] >> 63 else fp[i], min(ids, default=None)))
    got = [(r.id, r.fp, r.component) for r in simhash_dedup.near_groups(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({top(i) for i in range(len(rows))})


@pytest.mark.parametrize("split_over", [1, 5, 2000])
def test_shard_links_join_the_same_groups(spark, split_over):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(5):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash_dedup.components(simhash_dedup.shard_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), split_over=split_over)).collect()
    root = {r.node: r.root for r in found}
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 2:
                assert root.get(signed(x), signed(x)) == root.get(signed(y), signed(y))


def test_mixing_stays_within_a_block(spark, docs, rows):
    got = mixing.mix(docs, {"s0": 5, "s1": 3, "s2": 1}, block_rows=2).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    period = mixing.one_period(spark.createDataFrame([("a", 5), ("b", 3), ("c", 9)], "key string, q long")).collect()
    for t in range(18):
        for key, q in (("a", 5), ("b", 3), ("c", 9)):
            assert abs(sum(r.key == key and r.slot < t for r in period) - t * q / 17) < 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_merkle_next_and_likeness(docs, rows):
    got = merkle.with_next(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = [(r[0], r[1] or "", order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order)]
    assert sorted([(r.id, r.text, r.next_text) for r in got], key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_decontamination_equals_brute_force(spark, docs, rows):
    item = " ".join(rows[0][1].split()[:14])
    bench = spark.createDataFrame([(1, item), (2, "LONE text"), (3, None), (4, ""), (None, rows[38][1])], "item_id long, text string")
    got = {(r.row.doc_id, r.row.text): r for r in decontaminate.hits(docs, bench).collect()}
    items = [(str(k) if k is not None else "null", decontaminate.words_of(None if t is None else t.encode())) for k, t in [(1, item), (2, "LONE text"), (3, None), (4, ""), (None, rows[38][1])]]
    wins = [(k, tuple(w[i : i + 10])) for k, w in items if w for i in range(max(1, len(w) - 9))]
    for k, text, *_ in rows:
        w = decontaminate.words_of(None if text is None else text.encode())
        hit, seen = set(), set()
        at = {n: {tuple(w[i : i + n]): [] for i in range(len(w) - n + 1)} for n in {len(x) for _, x in wins}}
        for n, where in at.items():
            for i in range(len(w) - n + 1):
                where[tuple(w[i : i + n])].append(i)
        for name, win in wins:
            for i in at[len(win)].get(win, []):
                hit.update(range(i, i + len(win)))
                seen.add(name)
        r = got[k, text]
        assert (r.n_words, sum(s.end - s.first for s in r.spans), list(r["items"])) == (len(w), len(hit), sorted(seen))
    clean = decontaminate.remove_hits(docs, bench)
    assert clean.columns == docs.columns and decontaminate.hits(clean, bench).where("size(items) > 0").count() == 0


def test_chunks_cover_texts_and_one_copy_stays(docs, rows):
    for _, text, *_ in rows:
        ends = chunk_dedup.cuts((text or "").encode())
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len((text or "").encode())
    got = {r.id: r for r in chunk_dedup.duplicate_spans(docs).collect()}
    assert got[100].n_removed == 0 and got[101].n_removed > 0.9 * got[101].n_bytes and got[104].n_removed > 150
    assert all(got[k].n_removed == 0 for k in range(30))


def test_chunks_of_every_length_are_compared(spark):
    rng = random.Random(5)
    stump = next(t for t in (words(rng, 60) for _ in range(1000)) if 0 < len(t) - ([0, *chunk_dedup.cuts(t.encode())])[-2] < 16)
    texts = [(1, "ten  bytes"), (2, "ten  bytes"), (None, "ten  bytes"), (4, stump), (5, stump), (6, "z"), (7, None), (8, ""), (9, words(rng, 200)), (9, words(rng, 3))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(((r.id, r.n_bytes, r.n_chunks, r.n_removed_chunks, r.n_removed, [tuple(s) for s in r.spans]) for r in chunk_dedup.duplicate_spans(docs).collect()), key=str)
    seen, want = set(), []
    for k, text in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        t = (text or "").encode()
        ends = chunk_dedup.cuts(t)
        spans = [(a, b) for a, b in zip([0, *ends], ends) if t[a:b] in seen or seen.add(t[a:b])]
        want.append((k, len(t), len(ends), len(spans), sum(b - a for a, b in spans), spans))
    assert got == sorted(want, key=str)
    assert {r[0]: r[1] - r[4] for r in got if r[0] in (1, 2, None, 5)} == {1: 10, 2: 0, None: 0, 5: 0}


def test_license_lines(spark):
    texts = ["x\nReleased under the MIT license.\ny", "Licensed under the Apache License,\nVersion 2.0.", None, "", "a license to speak", "Licensed under CC BY-NC 4.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: [(m.license, m.line) for m in r.matches] for r in licenses.scanned(df).collect()}
    assert got == {0: [("MIT", 1)], 1: [("Apache-2.0", 0)], 2: [], 3: [], 4: [], 5: [("CC-BY-NC-4.0", 0)]}


def test_licenses_inside_lines_over_many_lines_and_whole():
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    names = lambda text: [(m["license"], m["line"], m["lines"]) for m in known.scan(text.encode())]
    assert names("This project is released under the MIT License. See LICENSE for details.") == [("MIT", 0, 1)]
    assert names("Copyright 2020 Acme. Licensed under the Apache License, Version 2.0 (see LICENSE)") == [("Apache-2.0", 0, 1)]
    assert names("The MIT License (MIT)") == [("MIT-title", 0, 1)]
    assert names("x\n\n# This\n# work is\n# licensed\n# under the\n# GNU General\n# Public License,\n# version 3.\nend") == [("GPL-3.0", 2, 7)]
    assert names("a b. Released under the MIT License. Licensed under CC BY-SA 4.0, too") == [("MIT", 0, 1), ("CC-BY-SA-4.0", 0, 1)]
    for name in ("Apache-2.0-text", "BSD-3-Clause-text", "GPL-2.0-text", "MIT-text"):
        assert name in [m["license"] for m in known.scan(("Before it.\n" + licenses.TEMPLATES[name] + "\nAnd after.").encode())]
    assert [m["license"] for m in licenses.Templates({"short": "CC BY 4.0"}, 0.8).scan(b"free, CC BY 4.0 it is")] == ["short"]
    assert licenses.Templates({}, 0.8).scan(b"a b") == [] and licenses.Templates({"one": "word"}, 0.8).scan(b"one word") == []


def test_license_windows_equal_brute_force():
    rng = random.Random(6)
    templates = {"p": "a b a b c", "q": "b c d", "r": "c c c c d a a b"}
    grams = {k: licenses.bigrams(v.encode()) for k, v in templates.items()}
    known = licenses.Templates(templates, 0.8)
    for _ in range(150):
        text = [rng.choice("aabbccdx") for _ in range(rng.randint(0, 25))]
        lines = "".join(w + rng.choice(" \n") for w in text)
        row = [lines[: 2 * k].count("\n") for k in range(len(text))]
        wins = []
        for a in range(len(text)):
            for b in range(a + 2, len(text) + 1):
                have = licenses.bigrams(" ".join(text[a:b]).encode())
                for name, of in grams.items():
                    dice = 2 * (have & of).total() / (b - a - 1 + of.total())
                    if dice >= 0.8:
                        wins.append((-dice, -of.total(), a, name, b))
        want, used = [], set()
        for dice, _, a, name, b in sorted(wins):
            if used.isdisjoint(range(a, b)):
                used.update(range(a, b))
                want.append((a, {"line": row[a], "lines": row[b - 1] - row[a] + 1, "license": name, "dice": -dice}))
        assert known.scan(lines.encode()) == [m for _, m in sorted(want, key=lambda x: x[0])]


@pytest.mark.parametrize("seed", range(6))
def test_license_runs_find_what_single_begins_find(monkeypatch, seed):
    """Whole, cut and altered licences in a row, some twice: runs of begins against every begin by itself."""
    rand = random.Random(seed)
    words = []
    for name in rand.choices(list(licenses.TEMPLATES), k=3) + ["GPL-1.0-text"] * 2:
        w = licenses.TEMPLATES[name].split()
        i, j = sorted((rand.randrange(len(w)), len(w))) if rand.random() < 0.4 else (0, len(w))
        words += [x if rand.random() > 0.05 else rand.choice(["foo", "the", "of", "work"]) for x in w[i:j]] + ["other"] * rand.randrange(3)
    text = " ".join(words).encode()
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    found = known.scan(text)
    monkeypatch.setattr(licenses, "RUNS", 10**9)
    assert found == known.scan(text) and len(found) >= 2


def test_licenses_in_a_text_of_some_megabytes():
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    assert [m["license"] for m in known.scan(licenses.TEMPLATES["GPL-3.0-text"].encode() * 90)] == ["GPL-3.0-text"] * 90


def test_token_counts_sum_to_whole_documents(docs, rows):
    for rule in ("first", "most"):
        got = token_counts.counted(docs, rule=rule).collect()
        assert len(got) == len(rows) and all(sum(r.sections) == r.n_tokens for r in got)
    assert token_counts.attribute(np.array([3, 6]), np.array([2, 4]), "first").tolist() == [2, 0]
    assert token_counts.attribute(np.array([3, 6]), np.array([2, 4]), "most").tolist() == [1, 1]


def _labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(400):
        bad, rude = k % 2, k % 5 == 0
        text = words(rng, 40) + (" ### @@@" if bad else "") + (" grrbad" + " grrugly" * rng.randint(0, 3) if rude else "")
        docs.append((k, text))
        labels.append((k, 1 - bad, int(rude)))
    docs += [(1000, None), (1001, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_the_held_out_fold(spark):
    docs, labels = _labelled(spark)
    scores = {r.row.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    assert len(scores) == 402 and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[k] >= 0.5) == (k % 2 == 0) for k in range(400)]) > 0.95
    graded = {r.row.doc_id: r for r in toxicity.graded(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([(graded[k].p_toxic >= 0.5) == (k % 5 == 0) for k in range(400)]) > 0.95
    none = toxicity.graded(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("p_toxic > 0").count() == 0
    assert quality.scored(docs, quality.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert simhash_dedup.near_groups(none).count() == 0
    assert merkle.with_next(none).count() == 0
    assert chunk_dedup.duplicate_spans(none).count() == 0
    assert decontaminate.hits(docs, spark.createDataFrame([], "item_id long, text string")).where("size(items) > 0").count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d", "x", 1, 2, 3), (2, "a b c d", "y", 1, 2, 3), (1, "a b c d", "x", 1, 2, 3), (3, "quite other words in this text", "z", 0, 0, 0), (4, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, N int, n_ int, component int")
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
