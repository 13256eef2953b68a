import json

from pyspark.sql import functions as F

from therascape.functions import answers as W


def by_hand(raw):
    """Python's parser, and the text closed at its end where that fails."""
    raw = (raw or "").strip()
    try:
        return json.loads(raw), False
    except ValueError:
        pass
    inside = escaped = False
    close = ""
    for c in raw:
        if inside:
            escaped, inside = (c == "\\" and not escaped), inside if escaped or c != '"' else False
        elif c == '"':
            inside = True
        elif c in "[{":
            close = {"[": "]", "{": "}"}[c] + close
        elif c in "]}":
            close = close[1:]
    text = (raw + '"' * inside).rstrip()
    text = (text + "null" * text.endswith(":")).rstrip().rstrip(",") + close
    try:
        return json.loads(text), True
    except ValueError:
        return None, True


WHOLE = r'{"modality_list": ["ADC", "a \"b]\" {c", "ADC"], "target_list": [], "biomarkers": [["x", {"y": [1, 2.5]}], "K\\"], "summary_ko": "요약 , : 끝", "confidence": 0.75, "more": {"z": [true, null]}}'


def test_every_cut_of_a_nested_answer(spark):
    raws = [WHOLE[:k] for k in range(len(WHOLE) + 1)] + ["  " + WHOLE + "\n", None, "", "]", "}{", '[1,,,', '{"a":  ', "no json", WHOLE + "}", '{"a": [1, 2,  ']
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string").select("k", W.repaired(F.col("raw")).alias("a")).select("k", F.to_json("a.data").alias("data"), "a.truncated")
    got = {r.k: (None if r.data is None else json.loads(r.data), r.truncated) for r in df.collect()}
    wrong = [(raws[k], got[k], by_hand(x)) for k, x in enumerate(raws) if got[k] != by_hand(x)]
    assert not wrong and sum(v[0] is not None and v[1] for v in got.values()) > 80


def test_fields_of_the_wrong_type_read_empty(spark):
    rows = [
        WHOLE,
        '{"modality_list": "ADC", "target_list": [1, " HER2 ", "", "HER2", null], "biomarkers": null, "summary_ko": 5, "confidence": "0.9"}',
        '{"biomarkers": [' + ", ".join(f'"g{k}"' for k in range(40)) + ', "g',
        "nothing",
        '{"confidence": 1, "summary_ko": "  x "}',
    ]
    got = [r.a for r in spark.createDataFrame(list(enumerate(rows)), "k int, raw string").orderBy("k").select(W.abstract_answer(F.col("raw")).alias("a")).collect()]
    assert got[0].modality_list == ["ADC", 'a "b]" {c'] and got[0].summary == "요약 , : 끝" and got[0].confidence == 0.75 and not got[0].truncated
    assert (got[1].modality_list, got[1].target_list, got[1].biomarkers, got[1].summary, got[1].confidence) == ([], ["1", "HER2"], [], "", 0.0)
    assert got[2].truncated and got[2].biomarkers == [f"g{k}" for k in range(20)]
    assert got[3].unparsed and got[3].target_list == [] and got[3].confidence == 0.0
    assert (got[4].confidence, got[4].summary, got[4].unparsed) == (1.0, "x", False)


def test_postings_of_a_trial_that_half_of_all_records_name(spark):
    from therascape.operators.links import trial_postings

    lit = spark.range(400).selectExpr("concat('u', id) AS uid", "CASE WHEN id % 2 = 0 THEN array('HOT', 'HOT', concat('N', id % 7)) WHEN id = 1 THEN NULL ELSE array(concat('N', id % 7), '') END AS nct_ids")
    rows = trial_postings(lit, most=20).collect()
    hot = [r for r in rows if r.nct_id == "HOT"]
    assert len(hot) > 5 and max(len(r.uids) for r in hot) < 60 and {r.n for r in hot} == {200} and all(r.uids == sorted(r.uids) for r in rows)
    assert sorted(u for r in hot for u in r.uids) == sorted(f"u{k}" for k in range(0, 400, 2)) and {r.nct_id for r in rows} == {"HOT", *(f"N{k}" for k in range(7))}


def test_drug_targets_and_canonical_names(spark):
    from therascape.operators import offline as O

    programs = spark.createDataFrame([("PD1",), ("PD-1",), ("PD-1",), (None,), ("",)], "target string")
    answers = spark.createDataFrame([("a", "PD1", "A", "mAb"), ("a", "PD1", "A", "mAb"), ("a", "EGFR", "B", "mAb"), ("b", "egf-r", None, None), ("c", None, "C", "x"), ("b", "EGF-R", None, "")], "drug string, target string, drug_name string, modality string")
    abstracts = spark.createDataFrame([(["PD 1", "EGFR"],), (["EGFR", None],), (None,)], "target_list array<string>")
    canon = {r.raw: r.canonical for r in O.target_canon(programs, answers, abstracts).collect()}
    assert canon["PD1"] == canon["PD-1"] == canon["PD 1"] and set(canon) == {"PD1", "PD-1", "PD 1", "EGFR"}
    got = {r.drug: tuple(r)[1:] for r in O.drug_targets(programs, answers, abstracts).collect()}
    assert got["a"] == (canon["PD1"], "A", "mAb") and got["b"][1:] == ("b", "Unknown") and set(got) == {"a", "b"}


def test_caches_get_new_keys_or_stay_as_they_are(spark):
    import pytest

    from therascape.operators import links as K

    rows = spark.createDataFrame([("u1", "a"), ("u2", "b"), (None, "c"), ("n4", "d")], "id string, name string")
    keys = K.new_keys(rows, "id", F.concat(F.lit("n"), F.ascii("name").cast("string")))
    cache = spark.createDataFrame([("u1", 1), ("n98", 2), ("u2", 3), ("other", 4)], "id string, v int")
    once = K.rekeyed(cache, "id", keys)
    want = [("n97", 1), ("n98", 2), ("other", 4)]  # u2's entry gives way to the one that has the key
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, K.rekeyed(once, "id", keys).collect())) == want
    assert tuple(K.key_coverage(once, "id", keys).first()) == (3, 2, 3)
    with pytest.raises(ValueError, match="share"):
        K.new_keys(rows, "id", F.lit("same"))
