from pyspark.sql import functions as F

from therascape.operators import merges as M


def test_target_equality(spark):
    pairs = [("HER-2", "her2"), ("PD-1", "PD-L1"), ("VEGF", "VEGF/VEGFR"), (None, ""), ("", "EGFR")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    assert [r[0] for r in df.orderBy("k").select(M.same_target(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, False]


def test_literature_merge_is_idempotent(spark):
    rec = spark.createDataFrame([("a", ["X"], ["T"], ["B"]), ("b", ["X"], ["T"], ["B"]), ("c", ["X"], None, ["B"])], "uid string, modality_list array<string>, target_list array<string>, biomarker_list array<string>")
    ans = spark.createDataFrame([("a", ["ADC"], [], ["M"], 0.6, "s"), ("b", ["ADC"], ["Z"], [], 0.59, "t")], "uid string, modality_list array<string>, target_list array<string>, biomarkers array<string>, confidence double, summary string")
    once = M.merge_literature(rec, ans)
    rows = {r["uid"]: r for r in once.collect()}
    assert (rows["a"]["modality_list"], rows["a"]["target_list"], rows["a"]["biomarker_list"], rows["a"]["summary"]) == (["ADC"], ["Unknown"], ["M"], "s")
    assert (rows["b"]["modality_list"], rows["b"]["summary"], rows["b"]["enrich_src"]) == (["X"], "t", "rule")
    assert (rows["c"]["target_list"], rows["c"]["summary"], rows["c"]["llm_confidence"]) == (None, None, None)
    twice = M.merge_literature(once, ans)
    assert sorted(map(str, twice.select(*once.columns).collect())) == sorted(map(str, once.collect()))


def test_cross_source_merge_and_report(spark):
    prog = spark.createDataFrame([("a", "Unknown", "T", None), ("b", "ADC", "T", ["x"]), ("c", "ADC", "HER-2", []), ("d", "ADC", "T", [])], "drug_id string, modality string, target string, biomarker_list array<string>")
    ans = spark.createDataFrame(
        [("a", "Peptide", "Z", ["m", ""], 0.7, False, ["u"], "n"), ("b", "CAR-T", "Unknown", ["x", "y"], 0.85, True, ["v"], None), ("c", "ADC", "HER2", [], 0.99, True, [], None), ("d", "mRNA", "Q", [], 0.84, True, [], None)],
        "drug_id string, modality string, target string, biomarkers array<string>, confidence double, conflict boolean, evidence array<string>, note string",
    )
    out = M.merge_cross_source(prog, ans)
    rows = {r["drug_id"]: r for r in out.collect()}
    assert [(rows[k]["modality"], rows[k]["target"], rows[k]["action"], rows[k]["biomarker_list"]) for k in "abcd"] == [
        ("Peptide", "T", "filled", ["m"]),
        ("CAR-T", "T", "corrected", ["x", "y"]),
        ("ADC", "HER-2", None, []),
        ("ADC", "T", None, []),
    ]
    assert rows["b"]["modality_pre_xref"] == "ADC" and rows["b"]["data_flags"] == ["xref_corrected"] and rows["a"]["modality_pre_xref"] is None
    assert {(r["drug_id"], r["before"]["modality"], r["after"]["modality"]) for r in M.changes(prog, out).collect()} == {("a", "Unknown", "Peptide"), ("b", "ADC", "CAR-T")}


def test_evidence_keeps_the_best(spark):
    lit = spark.createDataFrame([(f"u{k:02}", ["ADC"] if k % 5 else ["Unknown"], None, k / 50) for k in range(40)], "uid string, modality_list array<string>, target_list array<string>, llm_confidence double")
    links = spark.createDataFrame([("d", f"u{k:02}", k in (1, 5)) for k in range(40)] * 2, "drug_id string, uid string, by_trial boolean")
    rows = M.evidence(links, lit, 4).orderBy("rank").collect()
    assert [r["uid"] for r in rows] == ["u01", "u39", "u38", "u37"]


def test_modality_gap_fix(spark):
    data = [("BCG vaccine + drug", "Unknown"), ("COVID vaccine", "Unknown"), ("interferon alfa", None), ("anti-IL-6 mAb", "Unknown"), ("aflibercept", "CAR-T"), (None, "ADC"), ("drug + interferon", "Peptide")]
    df = spark.createDataFrame([(k, a, b, "T") for k, (a, b) in enumerate(data)], "k int, drug_name string, modality string, target string")
    out = M.fix_modality(df).orderBy("k").collect()
    assert [r["modality"] for r in out] == ["Vaccine", "Unknown", "Recombinant Protein", "Unknown", "CAR-T", "ADC", "Peptide"]
    assert out[0]["modality_pre_gapfix"] == "Unknown" and out[0]["moa"] == "Vaccine targeting T" and out[4]["modality_src"] is None


def test_cdx_score(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, '2024-03-31', true, CAST(NULL AS STRING), 'Gastric Cancer', CAST(array() AS ARRAY<STRING>), 'Unknown'), (2, '2024', false, 'confirmed', 'Lung', array('x'), 'T'), (3, 'soon', NULL, 'exploratory', NULL, NULL, NULL)"
        " t(k, done, bm, strategy, cond, coll, tgt)"
    )
    s = M.cdx_score(F.lit("2024-01-01").cast("date"), *map(F.col, ("done", "bm", "strategy", "cond", "coll", "tgt")))
    rows = df.select("k", s.alias("s")).orderBy("k").collect()
    assert [tuple(r["s"]) for r in rows] == [
        (9, "high", ["phase2_entry_imminent", "biomarker_relevant", "cdx_strategy_undefined", "priority_indication", "no_partner", "needs_review"]),
        (3, "low", ["phase2_entry_imminent"]),
        (3, "low", ["cdx_strategy_open", "no_partner"]),
    ]


def test_cdx_strategy_and_renormalize(spark):
    df = spark.createDataFrame([(0, "HER2 must have been documented"), (1, "exploratory analysis of KRAS"), (2, "adults"), (3, None)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(M.cdx_strategy(F.col("t"))).collect()] == ["confirmed", "exploratory", "none", "none"]
    prog = spark.createDataFrame([("abc-1", ["xyz"], "XYZ", ["genomic"], "ADC"), ("abc-1", None, "erbb2", ["MSI", "msi"], "ADC")], "drug_name string, combo_drugs array<string>, target string, biomarker_list array<string>, modality string")
    assert [(r["target"], r["biomarker_list"], r["biomarker_mentioned"], r["moa"]) for r in M.renormalize(prog).collect()] == [("Unknown", [], False, "ADC"), ("HER2", ["MSI-H"], True, "ADC targeting HER2")]


def test_latest_and_summaries(spark):
    ans = spark.createDataFrame([("a", "old", 0.1, 1), ("a", "new", 0.2, 2), ("b", "", 0.9, 1), (None, "x", 0.1, 1)], "drug_id string, summary string, confidence double, at int")
    prog = spark.createDataFrame([("a",), ("b",), ("c",)], "drug_id string")
    rows = M.merge_summaries(prog, M.latest(ans, "drug_id", "at")).orderBy("drug_id").collect()
    assert [(r["summary"], r["summary_confidence"]) for r in rows] == [("new", 0.2), (None, None), (None, None)]
