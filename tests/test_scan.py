import pytest

from therascape.operators.filters import LiteratureFilter
from therascape.sources import scan as C

SCHEMA = "uid string, conference string, year int, status string, cancer_list array<string>, cancer_category string, biomarker_list array<string>"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    rows = [(f"{c}{y}{k}", c, y, "embargoed" if k == 2 else "available", ["Lung"] if k else None, "Skin", ["KRAS", " kras", "bad", "", None, "EGFRm"] if k else None) for c, y in (("A", 2024), ("A", 2025), ("B", 2023), ("B", 2024)) for k in range(3)]
    p = str(tmp_path_factory.mktemp("lit"))
    C.write_literature(spark.createDataFrame(rows, SCHEMA), p)
    return p


def uids(df):
    return sorted(r.uid for r in df.collect())


def partition_filters(df):
    df.collect()
    (scan,) = [x for x in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).splitlines() if "FileScan parquet" in x and "biomarker_list" in x][:1]
    return scan[scan.index("PartitionFilters:") : scan.index("PushedFilters:")]


def test_partitions_follow_the_filter(spark, path):
    newest = C.read_literature(spark, path)
    assert uids(newest) == ["A20250", "A20251"] and "subquery" in partition_filters(newest).lower()
    assert uids(C.read_literature(spark, path, LiteratureFilter(conferences=["B"]))) == ["B20240", "B20241"]
    chosen = C.read_literature(spark, path, LiteratureFilter(conferences=["A", "B"], years=[2023, 2024]))
    assert uids(chosen) == ["A20240", "A20241", "B20230", "B20231", "B20240", "B20241"]
    assert "year#" in partition_filters(chosen) and "conference#" in partition_filters(chosen)
    looked = C.read_literature(spark, path, LiteratureFilter(cancers=["Skin"]))  # something is looked for: all years
    assert uids(looked) == ["A20240", "A20250", "B20230", "B20240"]
    assert not C.any_filter(LiteratureFilter()) and C.any_filter(LiteratureFilter(years=[1])) and not C.search_active(LiteratureFilter(years=[1], show_embargoed=True))
    assert C.search_active(LiteratureFilter(keyword="x")) and C.search_active(LiteratureFilter(nct_id="N"))


def test_every_scan_is_cleaned_by_the_dictionary(spark, path):
    known = spark.createDataFrame([("bad", None, True), ("egfrm", "EGFR", False), ("kras", None, None)], "name string, canon string, blocked boolean")
    got = {r.uid: r.biomarker_list for r in C.read_literature(spark, path, dictionary=known).collect()}
    assert got == {"A20250": [], "A20251": ["KRAS", "EGFR"]}


def test_clean_lists_keep_order_and_first_spelling(spark):
    df = spark.createDataFrame([(1, ["b", "A", "a", "x ", "B"]), (2, []), (3, None), (4, ["No", "no"])], "k int, names array<string>")
    known = spark.createDataFrame([("x", "a", False), ("no", "No", True)], "name string, canon string, blocked boolean")
    assert {r.k: r.names for r in C.clean_lists(df, ["k"], "names", known).collect()} == {1: ["b", "A"], 2: [], 3: [], 4: []}
