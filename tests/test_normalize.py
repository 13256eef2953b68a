import pytest
from pyspark.sql import functions as F

from therascape.functions import normalize as N


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


CASES = {
    "target": (N.target, {"ErbB-2": "HER2", "WTErbB-2": "HER2", "ErbB2c": "HER2", "K-RAS G12D": "KRAS", "DNA": "Unknown", "": None, " ": None, "NRAS": "NRAS", "K-RAS": "K-RAS", "pd1": "PD-1", "PI3Kα": "PIK3CA", None: None}),
    "model_target": (
        N.model_target,
        {
            "bortezomib": "Proteasome",
            "TP53": "p53",
            "Vascular Endothelial Growth Factor Receptor (VEGFR)": "VEGF/VEGFR",
            None: "Unknown",
            "n/a": "Unknown",
            "KRAS G12C": "KRAS",
            "It is a drug that binds the proteasome; not one target": "Proteasome",
            "some very long name without any abbreviation": "Unknown",
        },
    ),
    "plain_biomarker": (N.plain_biomarker, {"MSI": "MSI-H", "genomic": None, "PD-L1": "PD-L1", "": None, "BRCA": "BRCA"}),
    "biomarker": (
        N.biomarker,
        {
            "KRAS G12C": "KRAS", "Her2-low": "HER2", "VEGFR2": "VEGFR2", "KRASG12C": "KRAS", "EGFRm": "EGFR", "BRAF V600": "BRAF", "KRAS p.G12C": "KRAS", "MET exon 14 skipping mutation": "MET",
            "microsatellite instability": "MSI", "mutation": "mutation", "gene signature": "gene signature", "": None, None: None, "PD-1": "PD-1", "CD20": "CD20",
        },
    ),
    "biomarker_state": (N.biomarker_state, {"HER2 Amplification": "amplification", "HER2": None, "KRAS G12C": "mutation", "HER2-low": "low", None: None}),
    "institution": (
        N.institution,
        {
            "Yonsei University Health System": "Yonsei University",
            "The University of Tokyo Hospital": "The University of Tokyo",
            "Department of Medicine, University of California, San Francisco, CA": "University of California, San Francisco",
            "Acme Therapeutics, Inc., Boston": "Acme Therapeutics, Inc.",
            "The University of Texas MD Anderson Cancer Center, Houston": "MD Anderson Cancer Center",
            "": "",
            None: None,
        },
    ),
    "country": (N.country, {"China.": "China", "CA.": "USA", "PR": "Puerto Rico", "Republic of Korea": "South Korea", "": "", None: None}),
    "country_of_code": (N.country_of_code, {"us": "USA", "ZZ": "ZZ", None: None}),
    "known_modality": (N.known_modality, {"adc": "ADC", " Small molecule ": "Small Molecule", "x": "Unknown", None: "Unknown"}),
    "companies": (
        N.companies,
        {
            "AstraZeneca UK Limited": ["AstraZeneca"],
            "AstraZeneca; Merck": ["AstraZeneca", "Merck (MSD)"],
            "Merck KGaA, Darmstadt": ["Merck KGaA"],
            "ABL Bio, Inc. / Seoul National University Hospital": ["ABL Bio"],
            "Pfizer | pfizer": ["Pfizer"],
            "": [],
            None: [],
        },
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_names(spark, name):
    f, cases = CASES[name]
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_lists_keep_order_and_drop_repeats(spark):
    lists = [["HER-2", "EGFR", "ERBB2", ""], [], None]
    assert apply(spark, N.targets, lists, "array<string>") == [["HER2", "EGFR"], [], []]
    assert apply(spark, N.model_targets, lists, "array<string>") == [["HER2", "EGFR", "Unknown"], ["Unknown"], ["Unknown"]]
    blocked, canon = F.array(F.lit("genomic")), F.create_map(F.lit("msi"), F.lit("MSI-H"), F.lit("microsatellite instability"), F.lit("MSI-H"), F.lit("egfr mutation"), F.lit("EGFR"))
    found = apply(spark, lambda c: N.clean_biomarkers(c, blocked, canon), [["genomic", "MSI", "microsatellite instability", "EGFR mutation", "egfr", None], None], "array<string>")
    assert found == [["MSI-H", "EGFR"], []]


def test_more_rounds_change_nothing(spark):
    names = ["KRAS G12C mutation positive high", "EGFR exon 20 ins mutant status", "HER2 ihc 3+ overexpression positive", "a", ""]
    assert apply(spark, N.without_state, names) == apply(spark, lambda c: N.without_state(c, 9), names)
