"""Known cases of whole pages."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from therascape.operators import dashboards as B

COLUMNS = (
    "uid string, conference string, year int, modality_list array<string>, target_list array<string>, biomarker_list array<string>, cancer_list array<string>, companies_normalized array<string>,"
    " affiliation string, country_raw string, phases array<string>, journal string, presentation_type string"
)


def record(uid, year, modalities=(), targets=(), biomarkers=(), cancers=(), companies=(), conference="ASCO", affiliation=None, country=None, phases=(), journal=None, kind=None):
    some = lambda xs: None if xs is None else list(xs)
    return (uid, conference, year, some(modalities), some(targets), some(biomarkers), some(cancers), some(companies), affiliation, country, some(phases), journal, kind)


def chart(rows, name):
    return sorted((r.place, r["name"], r.series, r["count"], r.is_other) for r in rows if r.chart == name)


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        record("a", 2020, ["M1", "M1"], ["T1", "Unknown"], cancers=["Lung"], companies=["C1", "C2"], phases=["PHASE2", "PHASE1"]),
        record("b", 2021, ["M2"], ["T2"], cancers=["Lung", "Skin"], conference="AACR", phases=["UNKNOWN"]),
        record("c", 2023, ["M3", None, ""], None, cancers=None, companies=None, phases=None, conference=None),
        record("d", None, ["M1"], ["T1"], cancers=["Lung"]),
    ]
    return B.conference_page(spark.createDataFrame(data, COLUMNS), 2, 1).collect()


def test_distributions_with_the_rest(rows):
    assert chart(rows, "modality") == [(1, "M1", None, 3, False), (2, "M2", None, 1, False), (3, "Other (1)", None, 1, True)]
    assert chart(rows, "target") == [(1, "T1", None, 2, False), (2, "T2", None, 1, False)]
    assert chart(rows, "phase") == [(2, "PHASE1", None, 1, False), (3, "PHASE2", None, 1, False), (6, "NA", None, 3, False)]
    assert chart(rows, "biomarker") == [] and chart(rows, "country") == []


def test_trends_count_a_name_once_a_record_and_fill_zeros(rows):
    assert chart(rows, "modality_by_year") == [(1, "M1", "2020", 1, False), (1, "M1", "2021", 0, False), (1, "M1", "2023", 0, False)]
    assert chart(rows, "cancer_by_year") == [(1, "Lung", "2020", 1, False), (1, "Lung", "2021", 1, False), (1, "Lung", "2023", 0, False)]
    assert chart(rows, "year") == [(1, "2020", None, 1, False), (2, "2021", None, 1, False), (3, "2023", None, 1, False)]
    assert chart(rows, "conference_by_year") == [(1, "AACR", "2021", 1, False), (2, "ASCO", "2020", 1, False)]


def test_cards(rows):
    assert {r["name"]: r["count"] for r in rows if r.chart == "summary"} == {"cancers": 2, "companies": 2, "datasets": 3, "therapeutic_pct": 100}
    assert chart(rows, "total") == [(1, "records", None, 4, False)]


def test_a_page_of_no_rows_is_empty(spark):
    assert B.conference_page(spark.createDataFrame([], COLUMNS)).count() == 0
    assert B.publication_page(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("top", [1, 3, 50])
def test_many_names_in_salted_parts(spark, top):
    """More names than salts and tops, with ties and one name that a third of all rows have, against a count by hand."""
    rand = random.Random(top)
    names = [["hot"] if k % 3 == 0 else [f"n{rand.randrange(400):03}" for _ in range(2)] for k in range(900)]
    df = spark.createDataFrame([record(str(k), 2020, xs) for k, xs in enumerate(names)], COLUMNS)
    got = chart(B.conference_page(df, top, 6).collect(), "modality")
    order = sorted(Counter(x for xs in names for x in xs).items(), key=lambda x: (-x[1], x[0]))
    want = [(i, x, None, n, False) for i, (x, n) in enumerate(order[:top], 1)]
    assert got == want + [(top + 1, f"Other ({len(order) - top})", None, sum(n for _, n in order[top:]), True)]


def test_trends_may_show_more_names_than_the_chart(spark):
    df = spark.createDataFrame([record("a", 2020, ["x", "x", "y", "z"])], COLUMNS)
    got = B.conference_page(df, 1, 2).collect()
    assert chart(got, "modality") == [(1, "x", None, 2, False), (2, "Other (2)", None, 2, True)]
    assert chart(got, "modality_by_year") == [(1, "x", "2020", 1, False), (2, "y", "2020", 1, False)]


PROGRAM = "drug_name string, company string, company_normalized string, cancer_category string, modality string, target string, biomarkers array<string>, phases array<string>, overall_status string"


def test_program_page_shows_statuses_that_occur(spark):
    data = [
        ("d1", "c1", "C1", "Lung", "ADC", "T1", ["B1"], ["PHASE1", "PHASE2"], "RECRUITING"),
        ("d1", "c2", None, "", None, None, [], [], "odd"),
        (None, "", "C1", None, "ADC", "T1", None, None, None),
    ]
    rows = B.program_page(spark.createDataFrame(data, PROGRAM), 5).collect()
    assert chart(rows, "company") == [(1, "C1", None, 2, False)]
    assert chart(rows, "drug") == [(1, "d1", None, 2, False), (2, "Unknown", None, 1, False)]
    assert chart(rows, "status") == [(2, "RECRUITING", None, 1, False), (9, "UNKNOWN", None, 1, False)]
    of = lambda place, name, a, b: [(place, name, "RECRUITING", a, False), (place, name, "UNKNOWN", b, False)]
    assert chart(rows, "phase_by_status") == of(2, "PHASE1", 1, 0) + of(3, "PHASE2", 1, 0) + of(6, "NA", 0, 1)
    assert chart(rows, "phase") == [(2, "PHASE1", None, 1, False), (3, "PHASE2", None, 1, False), (6, "NA", None, 2, False)]
    assert {r["name"]: r["count"] for r in rows if r.chart == "summary"} == {"companies": 2, "cancers": 1, "biomarker_pct": 33}
    assert chart(rows, "total_by_biomarker") == [(1, "programs", "mentioned", 1, False), (1, "programs", "not mentioned", 2, False)]


def test_a_page_reads_its_table_once(spark, tmp_path):
    spark.createDataFrame([record("a", 2020, ["M1"])], COLUMNS).write.parquet(str(tmp_path / "t"))
    plan = B.conference_page(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Join" not in plan


def test_landing_page(spark):
    day = lambda n: (dt.date(2024, 1, 1) + dt.timedelta(n)).isoformat()
    posted = PROGRAM + ", cancer_categories array<string>, nct_ids array<string>, phase string, first_post string, last_update string"
    programs = [(f"d{k}", "c", "C", "Lung", "ADC", "Unknown" if k == 3 else "HER-2", [], [], "RECRUITING", [], [f"N{k}"], "PHASE1/PHASE2", day(k) if k else None, day(20 + k)) for k in range(6)]
    lit = [record("p1", 2024, targets=["RARE"], journal="J"), record("p2", 2024, targets=["HER2"], journal="J"), record("a1", 2024, targets=["HER2"])]
    both = spark.createDataFrame(lit, COLUMNS).withColumns({"is_pub": F.col("uid").startswith("p"), "title": F.when(F.col("uid") == "p2", "Paper")})
    known = spark.createDataFrame([("p2",)], "uid string")
    got = B.landing_page(spark.createDataFrame(programs, posted), both, known, day(4), {"targets": 1, "biomarkers": 1, "companies": 1}, listed=1).collect()
    part = lambda name: sorted(((r.place, r["name"], r.detail, r["count"]) for r in got if r.part == name), key=str)
    assert part("stats") == [(None, "abstracts", None, 1), (None, "companies", None, 1), (None, "drugs", None, 6), (None, "publications", None, 2), (None, "targets", None, 2)]
    assert part("facet_targets") == [(1, "HER2", None, 7)]
    assert part("news") == [(None, "new_publications", None, 1), (None, "new_trials", None, 2), (None, "updated_trials", None, 4)]
    assert part("new_trials") == [(1, "N5", "d5 · HER2 · Ph1/Ph2 · C", None)]
    assert part("new_publications") == [(1, "p1", "J", None)]
    assert part("emerging_targets") == [(1, "RARE", "1", 1), (2, "HER2", "5", 7)]
