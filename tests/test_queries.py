import duckdb
import pytest

from therascape import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels benchmark".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canon(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert canon([r[c] for c in cols] for r in df.collect()) == canon([r[names.index(c)] for c in cols] for r in found.fetchall())


def test_other_row_keeps_the_total(spark):
    from therascape.operators.aggregates import top_n_other

    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1), ("d", 1)], "name string, count long")
    rows = top_n_other(df, 2).orderBy("rank").collect()
    assert [(r["name"], r["count"], r["is_other"]) for r in rows] == [("a", 3, False), ("b", 3, False), ("Other (2)", 2, True)]
    assert top_n_other(df, 9).count() == 4
    assert top_n_other(df.limit(0), 2).count() == 0


def test_format_canon_prefers_frequent_then_hyphen(spark):
    from therascape.operators.aggregates import format_canon

    df = spark.createDataFrame([("PD-1", 5), ("PD1", 5), ("pd 1", 2), ("HER2", 1)], "name string, count long")
    assert {r["name"]: r["canonical"] for r in format_canon(df).collect()} == {"PD-1": "PD-1", "PD1": "PD-1", "pd 1": "PD-1", "HER2": "HER2"}


def test_dedup_by_regimen_keeps_cancers_and_combinations_apart(spark):
    from therascape.operators.aggregates import dedup_by_regimen

    rows = [
        ("Drug  A", "ACME ", "P1", "Lung", False, "2001", "N1", ["N1"], ["KR", "US"]),
        ("drug a", "acme", "P1", "Lung", False, "2003", "N3", ["N3"], ["US", "JP"]),
        ("drug a", "acme", "P1", "Lung", True, "2002", "N2", ["N2"], None),
        ("drug a", "acme", "P1", "Skin", False, None, "N1", ["N1"], []),
    ]
    df = spark.createDataFrame(rows, "drug_name string, company string, phase string, cancer_category string, combo boolean, done string, nct_id string, nct_ids array<string>, countries array<string>")
    got = {(r.cancer_category, r.combo): (r.name_key, r.company_key, r.done, r.nct_id, r.nct_ids, r.countries, r.n) for r in dedup_by_regimen(df, ["combo"], "done", ["nct_id"], ["nct_ids", "countries"]).collect()}
    assert got == {
        ("Lung", False): ("drug a", "acme", "2003", "N3", ["N3", "N1"], ["US", "JP", "KR"], 2),
        ("Lung", True): ("drug a", "acme", "2002", "N2", ["N2"], [], 1),
        ("Skin", False): ("drug a", "acme", None, "N1", ["N1"], [], 1),
    }


def test_biomarker_maturity_counts_preclinical_drugs(spark):
    rows = registry.QUERIES["agg_28_biomarker_maturity_preclinical"](spark, DATA).collect()
    assert sum(r.preclinical for r in rows) > 0 and all(r.total_activity == r.clinical_total + r.preclinical for r in rows)
