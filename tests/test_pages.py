"""Known cases of filters, links, merges, labels and the offline study."""

import pytest
from pyspark.sql import functions as F

from therascape.functions import labels as L
from therascape.functions import mentions as T
from therascape.functions import normalize as N
from therascape.operators import links as K
from therascape.operators import merges as M
from therascape.operators import offline as O
from therascape.operators import pages as P
from therascape.operators.aggregates import all_ranked, top_n_other
from therascape.operators.filters import LiteratureFilter, ProgramFilter


def values(spark, f, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in rows.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_endings_are_stripped_however_many(spark):
    many = "KRAS" + " mutation" * 12
    assert values(spark, N.biomarker, many, "KRAS G12C", None, "") == ["KRAS", "KRAS", None, None]
    assert values(spark, N.without_state, many, "mutation", "") == ["KRAS", "", ""]
    assert values(spark, N.company, "Acme Therapeutics" + " Inc." * 9)[0] == "Acme Therapeutics"


def test_no_limit_keeps_all_groups(spark):
    df = spark.createDataFrame([(f"n{k:03}", k % 7) for k in range(100)], "name string, count long")
    got = [(r["name"], r["count"]) for r in top_n_other(df, 0).orderBy("rank").collect()]
    assert got == sorted([(f"n{k:03}", k % 7) for k in range(100)], key=lambda x: (-x[1], x[0]))
    assert [r["rank"] for r in all_ranked(df).orderBy("rank").collect()] == list(range(1, 101))
    assert top_n_other(df.limit(0), 0).count() == 0


def test_code_names(spark):
    assert values(spark, lambda t: F.array_join(K.code_tokens(t), ","), "BI 907828 and ONO-4578", "PD-1, CD19 and Lu-177", "AZD4547 AZD-4547", None) == ["bi907828,ono4578", "", "azd4547", ""]
    assert values(spark, lambda t: F.array_join(K.name_tokens(t), ","), "BI 907828", "pembrolizumab", "Debio 0123 in two words", "") == ["bi907828", "", "debio0123intwowords", ""]


def test_kinds_labels_and_cells(spark):
    rows = [("Poster", "LBA1", "x"), (None, "LBA1", "x"), ("e-abstract", "12", "x"), (None, "E5", "ASCO"), (None, "E5", "x"), (None, "TPS3", "x"), (None, "LB01", None), ("", "12", None), (None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string, c string")
    kinds = [r.v for r in df.orderBy("k").select("k", L.presentation_kind(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()]
    assert kinds == ["Poster", "Late-Breaking", "Online only", "Online only", None, "Trials in Progress", "Late-Breaking", "Presented", None]
    assert values(spark, L.phase_label, "PHASE1/PHASE2", "", None, "X") == ["Ph1/Ph2", "Unknown", "Unknown", "X"]
    one = spark.range(1)
    assert one.select(L.phase_cell(F.lit(2), F.lit(0), F.lit(1))).first()[0] == "진행2 / 중단1"
    assert one.select(L.heat_colour(F.lit(0), F.lit(9)), L.heat_colour(F.lit(9), F.lit(9)), L.heat_colour(F.lit(0), F.lit(0))).first() == ("#ffffff", "#2563eb", "#ffffff")
    assert one.select(L.log_length(F.lit(9), F.lit(99)), L.bubble_radius(F.lit(25), F.lit(100)), L.cutoff(F.lit("2026-03-09").cast("date"))).first() == (50.0, 12.5, "2026-03-01")


def test_texts_name_drugs_and_authors(spark):
    text = "Osimertinib with ABC-123, osimertinib, PFS-12 and pembrolizumab"
    assert values(spark, lambda t: F.array_join(T.drugs(t), ","), text, None) == ["Osimertinib,pembrolizumab,ABC-123", ""]
    assert values(spark, lambda t: F.array_join(T.cancers(F.lit("LUNG CANCER"), t), ","), "All patients", "ALL in children", "NSCLC") == ["Lung", "Hematologic", "Lung"]
    assert values(spark, lambda t: T.author_key(t, F.lit("École Normale, Paris")), "José  Ångström-Łuk") == ["jose_angstrom_uk|_cole_normale"]
    assert values(spark, T.sponsor, " Pfizer Inc. .", "None.", "", None) == ["Pfizer Inc.", None, None, None]


def test_whole_merge(spark):
    rows = [("A", "Unknown", "HER2", ["X"]), ("b ", "ADC", "HER2", None), ("c", "ADC", "EGFR", []), ("d", "ADC", "EGFR", []), ("e", "Unknown", "Unknown", [])]
    answers = [("a", "ADC", "HER-2", [" Y ", "X", ""], 0.99), ("b", "CAR-T", "EGFR", None, 0.82), ("c", "CAR-T", "MET", None, 0.85), ("d", "Unknown", "Unknown", None, 0.99), ("e", "ADC", "MET", ["Z"], 0.59)]
    p = spark.createDataFrame(rows, "drug_name string, modality string, target string, biomarker_list array<string>")
    a = spark.createDataFrame(answers, "name_key string, modality string, target string, biomarkers array<string>, confidence double")
    once = M.merge_models(p, a)
    got = {r.drug_name.strip(): (r.modality, r.target, r.biomarker_list, r.data_flags, r.biomarker_src, r.moa) for r in once.collect()}
    assert got == {
        "A": ("ADC", "HER2", ["X", "Y"], [], "llm+rule", "ADC targeting HER2"),
        "b": ("ADC", "HER2", [], ["modality_conflict", "target_conflict"], "rule", "ADC targeting HER2"),
        "c": ("CAR-T", "MET", [], ["modality_conflict_resolved", "target_conflict_resolved"], "rule", "CAR-T targeting MET"),
        "d": ("ADC", "EGFR", [], [], "rule", "ADC targeting EGFR"),
        "e": ("Unknown", "Unknown", [], [], "rule", "Unknown"),
    }
    assert sorted(M.merge_models(once, a).select(*once.columns).collect(), key=str) == sorted(once.collect(), key=str)
    assert M.merge_statistics(once).first().asDict()["modality_filled"] == 1


def test_scored_maturity(spark):
    rows = [("HER2", "PHASE3"), ("HER2", "PHASE1/PHASE2"), ("HER2", "UNKNOWN"), ("Unknown", "PHASE2"), ("EGFR", "EARLY_PHASE1")]
    p = spark.createDataFrame(rows, "target string, phase string")
    pre = spark.createDataFrame([("HER2", "x")], "target string, drug string")
    none = spark.createDataFrame([], "target string, mentions long")
    got = {r.target: (r.preclinical, r.clinical_total, r.total_activity, r.max_phase, r.maturity_score, r.emerging_ratio, r.place) for r in O.scored_maturity(p, pre, none).collect()}
    assert got == {"HER2": (1, 3, 4, "P3", 4.8, 0.25, 1), "Unknown": (0, 1, 1, "P2", 2.0, 0.0, 2), "EGFR": (0, 1, 1, "P1", 1.0, 0.0, 3)}


def test_fixes_titles_and_papers(spark):
    p = spark.createDataFrame([("Red pill + x", "A", "ADC", "m"), ("red", "B", "Unknown", "m"), ("blue", "A", "ADC", "m")], "drug_name string, target string, modality string, moa string")
    got = sorted((r.drug_name, r.target, r.target_pre_manualfix, r.moa) for r in K.prefix_fixes(p, [("red", {"A": "Z"}), ("re", {"B": "Y"})]).collect())
    assert got == [("Red pill + x", "Z", "A", "ADC targeting Z"), ("blue", "A", None, "m"), ("red", "B", None, "m")]
    assert values(spark, K.bad_title, "1ca1234567 grant", "A fine long title", "short", None, "SYMPOSIUM of x and y") == [True, False, True, True, True]
    papers = spark.createDataFrame([("N1", f"p{k}", "On DRUG one", "Review" if k == 0 else "Article", k) for k in range(9)] + [("N1", "q", "other", "Article", 99)], "nct_id string, pmid string, title string, kind string, cited int")
    found = K.papers_of_trials(spark.createDataFrame([("N1", "Drug"), ("N1", "on")], "nct_id string, drug_name string"), papers).orderBy("rank").collect()
    assert [(r.drug_name, r.pmid) for r in found] == [("Drug", f"p{k}") for k in (8, 7, 6, 5, 4)]


def test_filters_of_lists(spark):
    p = spark.createDataFrame(
        [(1, ["Lung"], "Skin", ["UNKNOWN"], ["N1"], "A", ["B"], "solo"), (2, [], "Lung", ["PHASE1"], ["N2"], "B", None, "partnered"), (3, None, "Skin", None, None, "C", ["B"], None)],
        "k int, cancer_categories array<string>, cancer_category string, phases array<string>, nct_ids array<string>, company string, collaborators array<string>, partnership_status string",
    )
    ids = lambda f: sorted(r.k for r in p.where(f.column(p.columns)).collect())
    assert ids(ProgramFilter(cancers=["Lung"])) == [1, 2] and ids(ProgramFilter(cancers=["Skin"])) == [3]
    assert ids(ProgramFilter(phases=["NA"])) == [1, 3] and ids(ProgramFilter(any_company="B")) == [1, 2, 3]
    assert ids(ProgramFilter(trial="N2", cancers=["x"])) == [2] and ids(ProgramFilter(partnership="solo")) == [1]
    lit = spark.createDataFrame([(1, "Éa Univ", "embargoed", []), (2, None, None, ["PHASE1"])], "k int, affiliation string, status string, phases array<string>")
    found = lambda f: sorted(r.k for r in lit.where(f.column(lit.columns)).collect())
    assert found(LiteratureFilter()) == [2] and found(LiteratureFilter(show_embargoed=True, affiliation="éA")) == [1] and found(LiteratureFilter(show_embargoed=True, phases=["NA"])) == [1]


@pytest.mark.parametrize("number", [0, 1, 2, 3])
def test_pages_of_a_table(spark, number):
    df = spark.createDataFrame([(k,) for k in range(25)], "k int")
    got = P.page(df, [F.desc("k")], number, 10).orderBy("place").collect()
    assert [(r.k, r.place) for r in got] == [(24 - k, k + 1) for k in range(25)][10 * number : 10 * number + 10]
