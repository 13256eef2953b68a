"""The functions of names and texts read every row of the tables: the literal cases of the registry, planted in a fixture folder."""

import hashlib
import re

import pytest

from therascape import registry

LITERAL = sorted(k.removesuffix("_tables") for k in registry.QUERIES if k.endswith("_tables"))


#: Known answers of the rules.
CASES = {
    "nrm_01_target": {"ErbB-2": "HER2", "WTErbB-2": "HER2", "K-RAS G12D": "KRAS", "DNA": "Unknown", "": None, "NRAS": "NRAS", "K-RAS": "K-RAS", "pd1": "PD-1"},
    "nrm_07_biomarker_state": {"HER2 Amplification": "amplification", "HER2": None, "KRAS G12C": "mutation", "HER2-low": "low"},
    "nrm_05_plain_biomarker": {"MSI": "MSI-H", "genomic": None, "PD-L1": "PD-L1", "BRCA": "BRCA"},
    "nrm_10_country": {"China.": "China", "CA.": "USA", "PR": "Puerto Rico", "Republic of Korea": "South Korea"},
    "nrm_12_modality": {"adc": "ADC", " Small molecule ": "Small Molecule", "x": "Unknown"},
    "nrm_15_country_of_code": {"us": "USA", "ZZ": "ZZ"},
    "scl_phases": {"A phase II and Phase 3 trial, phase 2": "PHASE2|PHASE3", "none": ""},
    "nrm_03_target_list": {"HER-2;EGFR;ERBB2;": "HER2;EGFR", "": "", "VEGFA;KDR;x": "VEGF/VEGFR;x"},
    "nrm_04_model_target": {"bortezomib": "Proteasome", "TP53": "p53", "Vascular Endothelial Growth Factor Receptor (VEGFR)": "VEGF/VEGFR", "n/a": "Unknown"},
    "nrm_06_biomarker": {"KRAS G12C": "KRAS", "Her2-low": "HER2", "VEGFR2": "VEGFR2", "KRASG12C": "KRAS", "EGFRm": "EGFR", "BRAF V600": "BRAF", "KRAS p.G12C": "KRAS"},
    "nrm_09_institution": {"Yonsei University Health System": "Yonsei University", "The University of Tokyo Hospital": "The University of Tokyo", "Acme Therapeutics, Inc., Boston": "Acme Therapeutics, Inc."},
    "nrm_11_companies": {"AstraZeneca UK Limited": "AstraZeneca", "AstraZeneca; Merck": "AstraZeneca|Merck (MSD)", "Merck KGaA, Darmstadt": "Merck KGaA"},
    "scl_lead_drug": {"Placebo;Carboplatin;ABC-1;abc-1 10 mg": "ABC-1|Placebo|Carboplatin", "": "Unknown"},
    "mrg_07_gap_fix": {"BCG vaccine + drug": "Vaccine", "COVID vaccine": None, "interferon alfa": "Recombinant Protein", "anti-IL-6 mAb": None, "x": None},
    "mrg_09_cdx_strategy": {"HER2 must have been documented": "confirmed", "exploratory analysis of KRAS": "exploratory", "adults": "none"},
}
TAGS = [
    ("ADC", "HER2", "HER2", "Breast", "NCT01234567"),
    ("Monoclonal Antibody", "PD-1", "", "Liver", "NCT00000001"),
    ("CAR-T", "CD19", "tumor mutational burden,biomarker,TMB", "Hematologic", ""),
    ("Cell Therapy", "MET", "MET", "Hematologic", ""),
    ("Unknown", "Unknown", "", "Other", ""),
]


def known(name):
    return list(CASES[name].items())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("names"))
    raws = sorted({r[0] for name in LITERAL if name != "scl_s03_text_tags" for r in known(name)})
    texts = [(k, t) for k, t in enumerate([*raws, *registry._TEXTS, "long words " * 20000 + "NCT00000007"])] + [(-1, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("HER-2", "b", "adc")], "p_name string, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([("AstraZeneca UK Limited",)], "s_name string").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([("PR",)], "n_name string").write.parquet(f"{d}/nation.parquet")
    return d, texts


@pytest.mark.parametrize("name", [x for x in LITERAL if x != "scl_s03_text_tags"])
def test_every_value_of_the_tables_is_named_once(spark, folder, name):
    d, texts = folder
    rows = registry.QUERIES[f"{name}_tables"](spark, d).collect()
    count = {}
    for t in [x for _, t in texts if t is not None for x in (t, *t.split("\n"), *[w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w])] + ["HER-2", "b", "adc", "AstraZeneca UK Limited", "PR"]:
        count[t] = count.get(t, 0) + 1
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert sorted((r.digest, r.n) for r in rows) == sorted((digest(t), n) for t, n in count.items())
    found = {r.digest: r.name for r in rows}
    assert {raw: found[digest(raw)] for raw, _ in known(name)} == dict(known(name))


def test_whole_texts_are_tagged(spark, folder):
    d, texts = folder
    rows = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["scl_s03_text_tags_tables"](spark, d).collect()}
    assert sorted(rows) == sorted(k for k, _ in texts)
    where = {t: k for k, t in texts}
    for i, tags in enumerate(TAGS):
        assert rows[where[registry._TEXTS[i]]] == tuple(tags)
    assert rows[max(rows)][-1] == "NCT00000007"
