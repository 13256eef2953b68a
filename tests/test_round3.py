"""Cases of the third round's findings."""

import duckdb
from pyspark.sql import functions as F

from therascape import registry, registry_pages
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.llm import divergence
from therascape.operators import aggregates as A
from therascape.operators import dashboards as B
from therascape.operators import links as K
from therascape.operators import merges as M
from therascape.operators import pages as P


def equals_sql(spark, name, folder, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, folder)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_dictionary_names_with_sharp_s_equal_their_sql(spark, tmp_path):
    spark.createDataFrame([(1, "süßigkeit ein maß")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "Süßigkeit SÜSSI süßi ß maß"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert equals_sql(spark, "nrm_08_clean_lists", str(tmp_path), ["benchmark", "documents"])


def test_a_paper_counts_once_for_a_trial(spark):
    papers = spark.createDataFrame([("N1", k, "a drug", "Article", 9 - int(k)) for k in "112"], "nct_id string, pmid string, title string, kind string, cited int")
    programs = spark.createDataFrame([("N1", "Drug")], "nct_id string, drug_name string")
    assert [(r.rank, r.pmid) for r in K.papers_of_trials(programs, papers).orderBy("rank").collect()] == [(1, "1"), (2, "2")]


def test_evidence_joins_only_the_best_records_of_a_trial_and_a_target(spark):
    records = spark.createDataFrame([(f"u{k}", ["M"], ["T", "S"] if k else ["T"], f"N{k % 2}", k % 5 / 10) for k in range(40)], "uid string, modality_list array<string>, target_list array<string>, nct_id string, llm_confidence double")
    programs = spark.createDataFrame([("a", "N0", "T"), ("a", "N9", "S"), ("b", "N9", "T")], "drug_id string, nct_id string, target string")
    links = programs.join(records, "nct_id").select("drug_id", "uid", F.lit(True).alias("by_trial"))
    links = links.union(programs.join(records.select("uid", F.explode("target_list").alias("target")), "target").select("drug_id", "uid", F.lit(False)))
    rows = lambda df: sorted(map(tuple, df.select("drug_id", "uid", "rank").collect()))
    found = M.evidence_of(programs, records, 3)
    assert rows(found) == rows(M.evidence(links, records, 3)) and len(rows(found)) == 6
    assert "evidence_of" in registry._evidence.__code__.co_names


def test_long_texts_take_no_round_a_letter(spark):
    ends = ("KRAS mutation", "mutation +", "EGFR exon 19", "end", "KRASm", "KRAS exon 1234567", "del 5 / ", "p.G12C", "X-amp.", "3+")
    df = spark.createDataFrame([("word " * 400 + e,) for e in ends], "raw string")
    assert [r.a == r.b for r in df.select(N.without_state(F.col("raw")).alias("a"), N.without_state(F.col("raw"), 20).alias("b")).collect()] == [True] * len(ends)
    named = df.limit(1).select(N.institution(F.lit("Inc, " + "a, " * 3000 + "Inc, ltd, X University of Y Hospital, Ltd")).alias("i"), N.institution(F.lit("Inc")).alias("j"), N.institution(F.lit(" , ")).alias("k"))
    assert tuple(named.first()) == ("X University of Y Hospital, Ltd", "Inc", ",")
    plan = df.select(N.institution(F.col("raw")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_append" not in plan  # parts were put together one by one, each time with a copy of those before


def test_letters_that_only_unicode_takes_for_ascii(spark):
    texts = ["KRAS KK", "İDH1", "low", "ſkipping", "deıetion", "MSH2 loſs", "no 5١ A55B"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.biomarkers(F.col("t")).alias("b"), N.biomarker_state(F.col("t")).alias("s")).collect()
    assert [r.b for r in got] == [[], [], [], [], [], [], []]
    assert [r.s for r in got] == [None, None, "low", "skipping", None, "loss", "mutation"]


def test_the_first_drug_of_a_name(spark):
    texts = [" , and neo-PV-01", "interferon alfa with x", "x and interferon", "a" * 50000 + " plus vaccine", "vaccine", " with ", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.fixed_modality(F.col("t"), F.lit("Unknown"))).collect()
    assert [r[0] for r in got] == ["Vaccine", "Recombinant Protein", None, None, "Vaccine", None, None]


def test_lists_are_counted_before_they_are_taken_apart(spark):
    plan = registry_pages._spelled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") : plan.index("Join")]


def test_terms_are_sorted_by_number_before_name(spark):
    docs = spark.createDataFrame([("en", "a", "x y x"), ("en", "b", "y Z")], "lang string, source string, text string")
    runs = divergence.term_runs(docs, 1)
    assert "Sort [xxhash64(lang" in runs._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((bytes(r.term), bytes(r.source), r.n, r.in_lang) for r in runs.collect())
    assert got == [(b"x", b"a", 2, 2), (b"y", b"a", 1, 2), (b"y", b"b", 1, 2), (b"z", b"b", 1, 1)]


def test_rows_are_counted_by_their_own_columns_before_names_are_made(spark):
    rows = [("a", ["BM1", "bm1"], "a"), ("a", ["BM1", "bm1"], None), (None, None, "a"), ("b", [], "a")]
    df = spark.createDataFrame(rows, "x string, xs array<string>, y string")
    got = sorted((r.of, str(r.x_0), str(r.xs_0), str(r.xs_1), r.n) for r in P.by_own_columns(df, {"x": [F.col("x")], "xs": [F.col("xs"), F.col("y")]}).collect())
    assert got == sorted([("x", "a", "None", "None", 2), ("x", "b", "None", "None", 1), ("x", "None", "None", "None", 1)] + [("xs", "None", str(xs), str(y), 1) for _, xs, y in rows])
    options = P._options(df, {"xs": (F.col("xs"), lambda xs: F.array_distinct(F.transform(xs, F.lower))), "y": (F.col("y"), F.array)})
    assert sorted(map(tuple, options.collect())) == [("xs", "bm1", 2), ("y", "a", 3)]
    plan = options._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan[plan.index("Generate") :]  # names are taken apart above the count


def test_charts_count_equal_rows_at_once(spark):
    df = spark.createDataFrame([(["a", "a", "b"], "s"), (["a", "a", "b"], "s"), (["a"], None)], "xs array<string>, s string")
    rows = B.counted(df, {"c": B.Chart(F.col("xs"), series=F.col("s"), once=True)})
    assert sorted((r.name, r["count"], sorted((str(p.series), p.n, p.rows) for p in r.parts)) for r in rows.collect()) == [("a", 5, [("None", 1, 1), ("s", 4, 2)]), ("b", 2, [("s", 2, 2)])]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan[plan.index("Generate") :]
    counts = spark.createDataFrame([("T", 3, 5), ("S", 1, 7), ("T", 0, 1), ("Unknown", 9, 9), ("R", 0, 1)], "target string, this_week long, corpus_total long")
    assert [tuple(r) for r in K.emerging_of_counts(counts, 2).collect()] == [("T", 3, 6), ("S", 1, 7)]


def test_a_regimen_shuffles_each_value_once(spark):
    data = [("d", "c", "P", "L", True, None, "N1", ["u"]), ("d", "c", "P", "L", True, "2020", "N1", ["v", None]), ("d", "c", "P", "L", True, "2020", "N2", None)]
    df = spark.createDataFrame(data, "drug_name string, company string, phase string, cancer_category string, combo boolean, done string, nct_id string, ids array<string>")
    out = A.dedup_by_regimen(df, ["combo"], "done", ["nct_id"], ["ids"])
    assert [(r.done, r.nct_id, r.ids, r.n) for r in out.collect()] == [("2020", "N2", ["v", None, "u"], 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "RepartitionByExpression" in plan


def test_tags_of_long_texts_equal_the_rules(spark):
    texts = [*registry._TEXTS, "aMET met", "İRET", "ret", "x-alk.", "bcl-2", "éalké", "breast  K", "HNSCC_", "vaccine mRNA", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select(F.struct(*X.text_tags(t).values()).alias("a"), F.struct(X.modality(t), X.target(t), X.biomarkers(t), X.cancer_category(t)).alias("b")).collect():
        assert tuple(r.a) == tuple(r.b)


ODD = ["ſa pharma", "x Ltd, \t", "İnc. genomİcs", "Kite Kite Pharma", "MERCK KGaA", "Acme Bio, Université", "Acme Bio UNIVERSITÉ", "Acme co" + " " * 90, "co_ab", "éco", "", " ; | ", "Roche;Acme Holdings Ltd", "bıo", "KRAS  mutation", "EGFR exon ١٩", "MET  fuſion .",
       "KRAS  wild-type , ", "A12B ;", "EGFRm", "egfrm", "x 3+. ", "copy\t number", "IHC", "a\n\n b", "HER-2 / neu", "BCG Vaccİne", "Vaccine code VB10.NEO", "K-RAS GAIN", "3+", "fiſh", None]


def test_searches_before_the_rules_change_nothing(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, *("word " * 90 + t for t in ODD if t is not None)]], "t string")
    t = F.col("t")
    pairs = [(N.companies, N.companies_of_text), (N.biomarker, N.biomarker_of_text), (N.biomarker_state, lambda c: N.biomarker_state(c, N.tidy_text))]
    pairs.append((lambda c: M.fixed_modality(c, F.lit("Unknown")), lambda c: M.fixed_modality_of_text(c, F.lit("Unknown"))))
    for slow, fast in pairs:
        for r in df.select("t", slow(t).alias("a"), fast(t).alias("b")).collect():
            assert r.a == r.b, r
    # a legal form is sought at a name's end first
    assert df.limit(1).select(N.companies(F.lit("Acme Bio" + " Holdings, Ltd" * 9))).first()[0] == ["Acme Bio"]


def test_rules_of_long_texts_search_whole_columns(spark, tmp_path):
    for name, c in (("documents", "text"), ("supplier", "s_name"), ("nation", "n_name")):
        spark.createDataFrame([("Roche\n a  b",)], f"{c} string").withColumn("doc_id", F.lit(1)).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([("a", "b", "c")], "p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    plan = lambda q: registry.QUERIES[q](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    for q in ("nrm_11_companies_tables", "nrm_11_companies", "nrm_06_biomarker", "mrg_07_gap_fix_tables", "scl_s03_text_tags_tables"):
        assert "ArrowEvalPython" in plan(q), q
    assert plan("nrm_11_companies").count("Aggregate [") == 1  # names were counted twice


def test_terms_of_one_number_are_told_apart(spark):
    import pyarrow as pa

    rows = [(1, b"en", b"x", b"a", 1, 2), (1, b"en", b"y", b"a", 1, 1), (1, b"en", b"x", b"a", 1, 3), (1, b"en", b"x", b"b", 1, 1), (2, b"en", b"z", b"a", 1, 1)]
    batches = [pa.table(list(zip(*part)), names=["number", "lang", "term", "source", "docs", "n"]).to_batches()[0] for part in (rows[:3], rows[3:])]
    got = [tuple(r.values()) for b in divergence._run_lengths(1)(iter(batches)) for r in b.to_pylist()]
    assert got == [(b"en", b"x", b"a", 5, 6, True), (b"en", b"x", b"b", 1, 6, False), (b"en", b"y", b"a", 1, 1, True), (b"en", b"z", b"a", 1, 1, True)]
    docs = spark.createDataFrame([("en", "a", "x y")], "lang string, source string, text string")
    # one whole number is the only key, so rows are sorted without comparing them
    assert len(divergence.term_runs(docs, 1)._jdf.queryExecution().optimizedPlan().toString().split("Sort [")[1].split("]")[0].split("NULLS")) == 2
