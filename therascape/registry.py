"""All queries of the library, by name, with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.functions import dictionaries as D
from therascape.functions import drugs
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.functions import vocabulary as V
from therascape.operators import aggregates as A
from therascape.operators import links as K
from therascape.operators import merges as M
from therascape.operators.filters import LiteratureFilter, ProgramFilter
from therascape.plans.bridge import LITERATURE_SQL, PROGRAMS_SQL, literature, programs
from therascape.sources import literature as R
from therascape.sources import store as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register a query; its SQL may use the views p (programs) and l (literature) unless it is raw."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            uses = [v for v, word in ((PROGRAMS_SQL, " p"), (LITERATURE_SQL, " l")) if f"FROM{word}" in sql or f"JOIN{word}" in sql]
            ORACLE_SQL[name] = sql if raw else "WITH " + ",\n".join(uses) + ("," if sql.lstrip().startswith(",") else "\n") + sql.lstrip().removeprefix(",")
        return f

    return put


def top_n_sql(counted: str, n: int) -> str:
    return f""", c AS ({counted}), r AS (SELECT name, "count", row_number() OVER (ORDER BY "count" DESC, name) rn FROM c)
SELECT CAST(rn AS INTEGER) AS rank, name, CAST("count" AS BIGINT) AS "count", false AS is_other FROM r WHERE rn <= {n}
UNION ALL SELECT {n} + 1, 'Other (' || count(*) || ')', CAST(sum("count") AS BIGINT), true FROM r WHERE rn > {n} HAVING sum("count") > 0"""


def _scalar_top(column: str):
    return lambda spark, d: A.top_n_other(A.counts(programs(spark, d), F.col(column)), 10)


query("agg_01_top_n_other_drug", top_n_sql('SELECT drug_name AS name, count(*) AS "count" FROM p GROUP BY 1', 10))(_scalar_top("drug_name"))
query("qry_01_company_top_n", top_n_sql('SELECT company_normalized AS name, count(*) AS "count" FROM p WHERE company_normalized IS NOT NULL GROUP BY 1', 10))(
    lambda spark, d: A.top_n_other(A.counts(programs(spark, d).where("company_normalized is not null"), F.col("company_normalized")), 10)
)
query("agg_02_company_with_unknown", top_n_sql("SELECT coalesce(nullif(company_normalized, ''), 'Unknown') AS name, count(*) AS \"count\" FROM p GROUP BY 1", 10))(_scalar_top("company_normalized"))
query("qry_02_target_top_n", top_n_sql('SELECT target AS name, count(*) AS "count" FROM p GROUP BY 1', 10))(_scalar_top("target"))
query("agg_18_modality_counts", 'SELECT modality AS name, count(*) AS "count" FROM p GROUP BY 1')(lambda spark, d: A.counts(programs(spark, d), F.col("modality")))
query("agg_17_status_counts", 'SELECT overall_status AS name, count(*) AS "count" FROM p GROUP BY 1')(lambda spark, d: A.counts(programs(spark, d), F.col("overall_status")))
query("agg_19_biomarker_counts", 'SELECT name, count(*) AS "count" FROM (SELECT unnest(biomarkers) AS name FROM p) GROUP BY 1')(lambda spark, d: A.element_counts(programs(spark, d), F.col("biomarkers")))
query("agg_22_distinct_by_frequency", 'SELECT drug_name AS name, count(*) AS "count", row_number() OVER (ORDER BY count(*) DESC, drug_name) AS rank FROM p GROUP BY 1')(
    lambda spark, d: A.all_ranked(A.counts(programs(spark, d), F.col("drug_name")))
)

STATUSES = ["RECRUITING", "COMPLETED", "TERMINATED", "UNKNOWN"]
query(
    "agg_05_phase_by_status",
    ", e AS (SELECT unnest(string_split(phase, '/')) AS phase, overall_status s FROM p) SELECT phase, count(*) AS total, " + ", ".join(f"count(*) FILTER (s = '{s}') AS \"{s}\"" for s in STATUSES) + " FROM e GROUP BY 1",
)(lambda spark, d: A.phase_by_status(programs(spark, d), STATUSES))
query("agg_20_program_summary", "SELECT count(*) AS total, count(DISTINCT company) AS companies, count(DISTINCT cancer_category) AS cancers, CAST(floor(count(*) FILTER (len(biomarkers) > 0) * 100.0 / count(*) + 0.5) AS BIGINT) AS biomarker_pct FROM p")(
    lambda spark, d: A.program_summary(programs(spark, d))
)
SOURCES = ["src0", "src1", "src2"]
query("agg_06_year_by_conference", 'SELECT "year", ' + ", ".join(f"count(*) FILTER (conference = '{s}') AS {s}" for s in SOURCES) + ', count(*) AS total FROM l GROUP BY 1')(lambda spark, d: A.year_by_key(literature(spark, d), "conference", SOURCES))
query("agg_11_by_year", 'SELECT "year", count(*) AS n FROM l GROUP BY 1')(lambda spark, d: literature(spark, d).groupBy("year").agg(F.count("*").alias("n")))
query("agg_33_manifest", 'SELECT conference, "year", count(*) AS n FROM l GROUP BY 1, 2')(lambda spark, d: S.manifest(literature(spark, d), ["conference", "year"]).withColumnRenamed("count", "n"))
query("agg_09_modality_elements", top_n_sql('SELECT name, count(*) AS "count" FROM (SELECT unnest(modality_list) AS name FROM l) GROUP BY 1', 3))(lambda spark, d: A.top_n_other(A.element_counts(literature(spark, d), F.col("modality_list")), 3))
query("agg_13_country_elements", top_n_sql('SELECT name, count(*) AS "count" FROM (SELECT unnest(countries) AS name FROM l) GROUP BY 1', 8))(lambda spark, d: A.top_n_other(A.element_counts(literature(spark, d), F.col("countries")), 8))
query(
    "agg_12_trend",
    """, e AS (SELECT uid, "year", unnest(modality_list) AS name FROM l), k AS (SELECT name FROM e GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 4),
g AS (SELECT * FROM (SELECT DISTINCT "year" FROM l) y, k), s AS (SELECT "year", name, count(DISTINCT uid) n FROM e GROUP BY 1, 2)
SELECT g."year", g.name, coalesce(n, 0) AS "count" FROM g LEFT JOIN s ON g."year" = s."year" AND g.name = s.name""",
)(lambda spark, d: A.trend(literature(spark, d), "modality_list", 4))
query("agg_37_author_counts", "SELECT author, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 2")(lambda spark, d: K.author_counts(literature(spark, d)))
query("agg_34_trial_index", 'SELECT nct_id, count(*) AS n, min("year") AS first_year, max("year") AS last_year FROM l GROUP BY 1')(lambda spark, d: K.trial_index(literature(spark, d)))


def _preclinical(spark: SparkSession, d: str) -> DataFrame:
    """A target's drugs as mentioned by supply: a part's brand and name."""
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.where("p_size > 10").select(F.col("p_brand").alias("target"), F.col("p_name").alias("drug"))


_PB = "CASE phase WHEN 'EARLY_PHASE1' THEN 'P1' WHEN 'PHASE1' THEN 'P1' WHEN 'PHASE1/PHASE2' THEN 'P1/2' WHEN 'PHASE2' THEN 'P2' WHEN 'PHASE2/PHASE3' THEN 'P2/3' WHEN 'PHASE3' THEN 'P3' WHEN 'PHASE4' THEN 'P4' ELSE 'NA' END"
_SB = "CASE overall_status WHEN 'RECRUITING' THEN 'ongoing' WHEN 'COMPLETED' THEN 'completed' WHEN 'TERMINATED' THEN 'stopped' ELSE 'unknown' END"
_IDX = "CASE pb WHEN 'P1' THEN 1 WHEN 'P1/2' THEN 2 WHEN 'P2' THEN 3 WHEN 'P2/3' THEN 4 WHEN 'P3' THEN 5 WHEN 'P4' THEN 6 ELSE 0 END"


def _maturity_sql(rows: str, before: str) -> str:
    cell = lambda p, s: f"{p.replace('/', '_').lower()}_{s}"
    cells = [f"count(*) FILTER (pb = '{p}' AND sb = '{s}') AS {cell(p, s)}" for p in A.CLINICAL for s in ("ongoing", "completed", "stopped")]
    cells += [f"count(*) FILTER (pb = '{p}') AS {cell(p, 'total')}" for p in A.CLINICAL]
    names = [c.split(" AS ")[1] for c in cells]
    out = ", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in names)
    return f""", e AS ({rows}), b AS (SELECT target, {_PB} AS pb, {_SB} AS sb FROM e WHERE target <> 'Unknown'),
c AS (SELECT target, {", ".join(cells)}, count(*) AS ct, max({_IDX}) AS ix FROM b WHERE pb <> 'NA' GROUP BY 1), z AS ({before})
SELECT coalesce(c.target, z.target) AS target, {out}, CAST(coalesce(ct, 0) AS BIGINT) AS clinical_total, CAST(coalesce(pre, 0) AS BIGINT) AS preclinical,
CAST(coalesce(ct, 0) + coalesce(pre, 0) AS BIGINT) AS total_activity,
CASE WHEN ix > 0 THEN ['P1', 'P1/2', 'P2', 'P2/3', 'P3', 'P4'][ix] WHEN pre > 0 THEN 'Preclinical' ELSE 'NA' END AS max_phase
FROM c FULL JOIN z ON c.target = z.target"""


_PRE = "SELECT p_brand AS target, count(DISTINCT lower(p_name)) AS pre FROM part WHERE p_size > 10 GROUP BY 1"
query("qry_12_target_maturity", _maturity_sql("SELECT target, phase, overall_status FROM p", _PRE))(lambda spark, d: A.maturity_matrix(programs(spark, d), _preclinical(spark, d), F.col("target")))
query("agg_28_biomarker_maturity", _maturity_sql("SELECT unnest(biomarkers) AS target, phase, overall_status FROM p", "SELECT '' AS target, 0 AS pre WHERE false"))(
    lambda spark, d: A.maturity_matrix(programs(spark, d).withColumn("bm", F.explode("biomarkers")), _preclinical(spark, d).where("false"), F.col("bm"))
)


def _preclinical_biomarkers(spark: SparkSession, d: str) -> DataFrame:
    """A biomarker's drugs as mentioned by supply: the biomarkers of a part, as in ``programs``, and its name."""
    bm = lambda k: F.concat(F.lit("BM"), (F.col("p_size") % k).cast("string"))
    part = spark.read.parquet(f"{d}/part.parquet").where("p_size > 10")
    return part.select(F.explode(F.array_distinct(F.array(bm(7), bm(5)))).alias("target"), F.col("p_name").alias("drug"))


_PRE_BM = "SELECT bm AS target, count(DISTINCT lower(p_name)) AS pre FROM (SELECT p_name, unnest(['BM' || (p_size % 7), 'BM' || (p_size % 5)]) AS bm FROM part WHERE p_size > 10) GROUP BY 1"
query("agg_28_biomarker_maturity_preclinical", _maturity_sql("SELECT unnest(biomarkers) AS target, phase, overall_status FROM p", _PRE_BM))(
    lambda spark, d: A.maturity_matrix(programs(spark, d).withColumn("bm", F.explode("biomarkers")), _preclinical_biomarkers(spark, d), F.col("bm"))
)
query(
    "qry_14_target_opportunity",
    f""", b AS (SELECT target, CAST(left(start_date, 4) AS INTEGER) AS y, 1 AS clin, {_PB} AS pb, {_SB} AS sb FROM p),
ev AS (SELECT target, y, clin, CASE pb WHEN 'P1' THEN 10 WHEN 'P1/2' THEN 15 WHEN 'P2' THEN 20 WHEN 'P2/3' THEN 25 WHEN 'P3' THEN 30 WHEN 'P4' THEN 40 END *
  CASE sb WHEN 'ongoing' THEN 100 WHEN 'completed' THEN 115 WHEN 'stopped' THEN 50 ELSE 90 END AS w, {_IDX} AS ix FROM b
  UNION ALL SELECT unnest(target_list), "year", 0, NULL, 0 FROM l),
f AS (SELECT * FROM ev WHERE target NOT IN ('Unknown', 'DNA', 'RNA', 'N/A', 'NONE', '-', '')), m AS (SELECT max(y) AS my FROM f),
a AS (SELECT target, count(*) AS size_total, CAST(sum(clin) AS BIGINT) AS clinical_total, count(*) FILTER (y IN (my, my - 1)) AS recent, count(*) FILTER (y IN (my - 4, my - 3)) AS early,
  any_value(my) - max(y) AS years_stale, sum(w) AS w, max(ix) AS ix, sum(pow(0.5e0, (my - y) / 2e0)) AS dec, count(y) AS dated FROM f, m GROUP BY 1),
o AS (SELECT target, size_total, clinical_total, recent, early, floor((recent + 1e0) / (early + 1e0) * 100e0 + 0.5e0) / 100e0 AS growth_ratio, CAST(coalesce(years_stale, 999) AS INTEGER) AS years_stale,
  CASE WHEN w IS NOT NULL THEN floor(w / 100e0 + 0.5e0) / 10e0 WHEN size_total > clinical_total THEN 0.3e0 ELSE 0e0 END AS clin_maturity,
  CASE WHEN ix > 0 THEN ['P1', 'P1/2', 'P2', 'P2/3', 'P3', 'P4'][ix] WHEN size_total > clinical_total THEN 'Preclinical' ELSE 'NA' END AS max_phase,
  floor(dec / (dated + 5e0) * 1000e0 + 0.5e0) / 1000e0 AS recency FROM a)
SELECT *, recent >= 4 AND growth_ratio >= 1.3e0 AND clin_maturity <= 5e0 AS emerging FROM o""",
)(lambda spark, d: A.opportunity_rows(programs(spark, d), literature(spark, d)))


def _filtered(f: ProgramFilter):
    return lambda spark, d: programs(spark, d).where(f.column()).groupBy("cancer_category").agg(F.count("*").alias("n"), F.count_distinct("drug_name").alias("drugs"))


def _flt(name: str, where: str, f: ProgramFilter) -> None:
    query(name, f"SELECT cancer_category, count(*) AS n, count(DISTINCT drug_name) AS drugs FROM p WHERE {where} GROUP BY 1")(_filtered(f))


_flt("flt_01_company", "company_normalized IN ('Supplier#000000001', 'Supplier#000000003')", ProgramFilter(companies=["Supplier#000000001", "Supplier#000000003"]))
_flt("flt_02_drug", "drug_name IN ('small ring')", ProgramFilter(drugs=["small ring"]))
_flt("flt_03_cancer", "cancer_category IN ('HOUSEHOLD', 'MACHINERY')", ProgramFilter(cancers=["HOUSEHOLD", "MACHINERY"]))
_flt("flt_04_modality", "modality = 'ECONOMY'", ProgramFilter(modalities=["ECONOMY"]))
_flt("flt_05_target", "target IN ('Brand#2', 'Brand#7')", ProgramFilter(targets=["Brand#2", "Brand#7"]))
_flt("flt_06_biomarker", "list_has_any(biomarkers, ['BM2', 'BM6'])", ProgramFilter(biomarkers=["BM2", "BM6"]))
_flt("flt_07_status", "overall_status = 'RECRUITING'", ProgramFilter(statuses=["RECRUITING"]))
_flt("flt_08_phase", "list_has_any(string_split(phase, '/'), ['PHASE2'])", ProgramFilter(phases=["PHASE2"]))
_flt("flt_10_regimen", "is_combination", ProgramFilter(regimen="combo"))
_flt("flt_11_needs_review", "target = 'Unknown'", ProgramFilter(needs_review=True))
_flt("flt_12_oncology_only", "coalesce(is_oncology, true)", ProgramFilter(oncology_only=True))
_flt("flt_13_start_years", "CAST(left(start_date, 4) AS INTEGER) BETWEEN 1997 AND 1999", ProgramFilter(start_years=(1997, 1999)))
_flt("flt_14_completion_years", "CAST(left(completion_date, 4) AS INTEGER) >= 2000", ProgramFilter(completion_years=(2000, None)))
_flt("flt_15_keyword", "lower(concat_ws(' ', drug_name, company, cancer_category, modality, target, overall_status, phase, nct_id, array_to_string(biomarkers, ' '))) LIKE '%ring supp%'", ProgramFilter(keyword="Ring Supp"))


def _lit(name: str, where: str, f: LiteratureFilter) -> None:
    query(name, f"SELECT conference, count(*) AS n FROM l WHERE {where} GROUP BY 1")(lambda spark, d: literature(spark, d).where(f.column()).groupBy("conference").agg(F.count("*").alias("n")))


_lit("flt_20_hide_embargoed", "status <> 'embargoed'", LiteratureFilter())
_lit("flt_21_conference", "status <> 'embargoed' AND conference IN ('src1', 'src4')", LiteratureFilter(conferences=["src1", "src4"]))
_lit("flt_22_year", '"year" IN (2019, 2021)', LiteratureFilter(years=[2019, 2021], show_embargoed=True))
_lit("flt_24_modality", "list_contains(modality_list, 'M4')", LiteratureFilter(modalities=["M4"], show_embargoed=True))
_lit("flt_26_country", "list_has_any(countries, ['NATION_4', 'NATION_5'])", LiteratureFilter(countries=["NATION_4", "NATION_5"], show_embargoed=True))
_lit("flt_28_target", "list_contains(target_list, 'Brand#3')", LiteratureFilter(targets=["Brand#3"], show_embargoed=True))
_lit("flt_33_author", "author = 'Author 7'", LiteratureFilter(author="Author 7", show_embargoed=True))
_lit("flt_34_trial", "nct_id = 'NCT00000042'", LiteratureFilter(nct_id="NCT00000042", show_embargoed=True))

query("j_09_shared_trials", "SELECT DISTINCT drug_name, uid FROM p JOIN l ON p.nct_id = l.nct_id")(lambda spark, d: K.shared_trials(programs(spark, d), literature(spark, d)))
query(
    "agg_38_drug_links",
    """, k AS (SELECT DISTINCT drug_name, uid, "year" FROM p JOIN l ON p.nct_id = l.nct_id), r AS (SELECT drug_name, uid, row_number() OVER (PARTITION BY drug_name ORDER BY "year" DESC, uid) AS rank, count(*) OVER (PARTITION BY drug_name) AS total FROM k)
SELECT drug_name, CAST(rank AS INTEGER) AS rank, uid, total FROM r WHERE rank <= 15""",
)(lambda spark, d: K.top_links(K.shared_trials(programs(spark, d), literature(spark, d)), literature(spark, d)))
query("j_13_new_trials", "SELECT DISTINCT nct_id FROM p WHERE nct_id NOT IN (SELECT nct_id FROM l)")(lambda spark, d: K.missing_from(programs(spark, d).select("nct_id").distinct(), literature(spark, d), "nct_id"))
query(
    "agg_40_dedup_representative",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY drug_name, company, phase ORDER BY completion_date DESC, nct_id DESC, overall_status DESC) AS rn FROM p),
g AS (SELECT drug_name, company, phase, list_sort(list(DISTINCT nct_id)) AS ids, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT r.drug_name, r.company, r.phase, completion_date, nct_id, overall_status, array_to_string(ids, ',') AS nct_ids, n FROM r JOIN g ON r.drug_name = g.drug_name AND r.company = g.company AND r.phase = g.phase WHERE rn = 1""",
)(lambda spark, d: A.representatives(programs(spark, d), ["drug_name", "company", "phase"], "completion_date", ["nct_id", "overall_status"]).withColumn("nct_ids", F.array_join("nct_ids", ",")))


def _dedup_by_regimen(spark: SparkSession, d: str) -> DataFrame:
    lit = literature(spark, d).groupBy("nct_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("countries")))).alias("countries"), F.array_sort(F.collect_set("uid")).alias("links"))
    rows = programs(spark, d).join(lit, "nct_id", "left").withColumn("nct_ids", F.array("nct_id"))
    unions = ["nct_ids", "countries", "links"]
    out = A.dedup_by_regimen(rows, ["is_combination"], "completion_date", ["nct_id", "overall_status"], unions)
    return out.withColumns({c: F.array_join(c, ",") for c in unions})


_KEY = "name_key, company_key, phase, cancer_category, is_combination"
query(
    "agg_40_dedup_by_regimen",
    rf""", k AS (SELECT *, trim(regexp_replace(lower(drug_name), '\s+', ' ', 'g')) AS name_key, lower(trim(company)) AS company_key FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY completion_date DESC, nct_id DESC, overall_status DESC) AS rn FROM k),
e AS (SELECT {_KEY}, 'i' AS kind, nct_id AS x, rn FROM r UNION ALL SELECT {_KEY}, 'u', x, rn FROM r JOIN (SELECT nct_id AS id, uid AS x FROM l) ON r.nct_id = id
  UNION ALL SELECT {_KEY}, 'c', x, rn FROM r JOIN (SELECT nct_id AS id, unnest(countries) AS x FROM l) ON r.nct_id = id),
f AS (SELECT {_KEY}, kind, x, min(rn) AS m FROM e GROUP BY ALL),
g AS (SELECT {_KEY}, string_agg(x, ',' ORDER BY m, x) FILTER (kind = 'i') AS nct_ids, coalesce(string_agg(x, ',' ORDER BY m, x) FILTER (kind = 'c'), '') AS countries, coalesce(string_agg(x, ',' ORDER BY m, x) FILTER (kind = 'u'), '') AS links FROM f GROUP BY ALL),
h AS (SELECT {_KEY}, count(*) AS n FROM r GROUP BY ALL)
SELECT {_KEY}, completion_date, nct_id, overall_status, nct_ids, countries, links, n FROM r JOIN g USING ({_KEY}) JOIN h USING ({_KEY}) WHERE rn = 1""",
)(_dedup_by_regimen)
query(
    "agg_36_new_and_updated",
    "SELECT count(DISTINCT nct_id) FILTER (start_date >= '2001-06-01') AS new_trials, count(DISTINCT nct_id) FILTER (completion_date >= '2001-06-01' AND start_date < '2001-06-01') AS updated_trials FROM p",
)(lambda spark, d: programs(spark, d).agg(F.count_distinct(F.when(F.col("start_date") >= "2001-06-01", F.col("nct_id"))).alias("new_trials"), F.count_distinct(F.when((F.col("completion_date") >= "2001-06-01") & (F.col("start_date") < "2001-06-01"), F.col("nct_id"))).alias("updated_trials")))


def _merge(spark: SparkSession, d: str) -> DataFrame:
    value, action = K.gated_merge(F.col("target"), F.concat(F.lit("Brand#"), (F.length("drug_name") % 9).cast("string")), (F.length("company") + F.length("drug_name")) % 40 / 39.0, same=M.same_target)
    return programs(spark, d).select(value.alias("merged"), action.alias("action")).groupBy("merged", "action").agg(F.count("*").alias("n"))


query(
    "mrg_01_gated_merge",
    """, m AS (SELECT target, 'Brand#' || (length(drug_name) % 9) AS model, ((length(company) + length(drug_name)) % 40) / 39e0 AS c FROM p), o AS (SELECT *, target <> 'Unknown' AND NOT (contains(target, model) OR contains(model, target)) AS other FROM m)
SELECT CASE WHEN (target = 'Unknown' AND c >= 0.6) OR (other AND c >= 0.85) THEN model ELSE target END AS merged,
CASE WHEN target = 'Unknown' AND c >= 0.6 THEN 'filled' WHEN other AND c >= 0.85 THEN 'adopted' WHEN other AND c >= 0.8 THEN 'flagged' ELSE 'kept' END AS action,
count(*) AS n FROM o GROUP BY 1, 2""",
)(_merge)
query(
    "scl_s18_strip_markup",
    r"""SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<jats:title>.*?</jats:title>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)""",
    raw=True,
)(lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.strip_markup(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest")))
query("scl_s27_token_key", "SELECT regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]', '', 'g') AS k, count(*) AS n FROM part GROUP BY 1", raw=True)(
    lambda spark, d: spark.read.parquet(f"{d}/part.parquet").groupBy(X.token_key(F.concat_ws(" ", "p_brand", "p_name")).alias("k")).agg(F.count("*").alias("n"))
)
query("scl_h01_digest_id", "SELECT p_partkey, left(sha1(p_name || '::' || p_brand), 16) AS id FROM part", raw=True)(lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.left(F.sha1(F.concat_ws("::", "p_name", "p_brand")), F.lit(16)).alias("id")))
query("scl_j01_json_props", "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1", raw=True)(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))
)
query("str_02_daily_window", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", raw=True)(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
)

_TEXTS = [
    "A phase 2 trial of trastuzumab deruxtecan (DXd) in HER2-positive breast cancer NCT01234567",
    "Pembrolizumab plus lenvatinib for hepatocellular carcinoma, NCT00000001 and NCT00000001",
    "CAR-T targeting CD19 in B-cell lymphoma; tumor mutational burden (TMB) as biomarker",
    "Until we met, all was well",
    "",
]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, their lines and words, with how often each is there, equal ones of a batch once."""
    for batch in batches:
        texts = batch.column("text").drop_null()
        words = pc.ascii_split_whitespace(texts).flatten()
        counts = pa.chunked_array([texts, pc.split_pattern(texts, "\n").flatten(), words.filter(pc.not_equal(words, ""))]).value_counts()
        yield pa.record_batch({"raw": counts.field("values"), "n": counts.field("counts")})


def _names(spark: SparkSession, d: str, more: list[str] | None = None) -> DataFrame:
    """(raw, n): every text of documents, its lines and words, the names of parts, suppliers and nations and ``more``, with how often each is there."""
    names = spark.read.parquet(f"{d}/documents.parquet").select("text").mapInArrow(_pieces, "raw string, n long")
    for name, column in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("supplier", "s_name"), ("nation", "n_name")):
        names = names.union(spark.read.parquet(f"{d}/{name}.parquet").select(column, F.lit(1).cast("long")))
    if more:
        names = names.union(spark.createDataFrame([(x,) for x in more], "raw string").select("raw", F.lit(1).cast("long")))
    return names.groupBy("raw").agg(F.sum("n").alias("n"))


NAMES_SQL = r"""WITH t AS (SELECT unnest(list_concat([text], string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))) AS raw FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation),
v AS (SELECT raw, count(*) AS n FROM t GROUP BY 1) """


def _by_rule(name: str, f, sql: str | None, more: list[str]) -> None:
    """A query of a function over all names of the tables and some that the rule is made for; its SQL, where it has one, is an expression of ``raw``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = NAMES_SQL.replace("v AS (SELECT raw, count(*) AS n FROM t GROUP BY 1)", f"v AS (SELECT raw, count(*) AS n FROM (SELECT raw FROM t UNION ALL SELECT unnest([{', '.join(map(quote, more))}])) GROUP BY 1)")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _names(spark, d, more).select(F.md5("raw").alias("digest"), f(F.col("raw")).alias("name"), "n")

    query(name, sql and f"{rows} SELECT md5(raw) AS digest, {sql} AS name, n FROM v", raw=True)(run)
    if sql and f"{name}_tables" in QUERIES:  # the same rule over the tables' names alone
        ORACLE_SQL[f"{name}_tables"] = f"{NAMES_SQL}SELECT md5(raw) AS digest, {sql} AS name, n FROM v"


def _over_names(name: str, f, sql: str | None = None) -> None:
    """A query of a function over all names of the tables; its SQL, where it has one, is an expression of ``raw``."""
    query(f"{name}_tables", sql and f"{NAMES_SQL}SELECT md5(raw) AS digest, {sql} AS name, n FROM v", raw=True)(lambda spark, d: _names(spark, d).select(F.md5("raw").alias("digest"), f(F.col("raw")).alias("name"), "n"))


def _case_sql(key: str, table: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " END"


_WHITE = r"[\s\x{0B}\x{85}\p{Z}]+"
_STRIPPED = f"regexp_replace(raw, '^{_WHITE}|{_WHITE}$', '', 'g')"
_DOTLESS = f"regexp_replace(regexp_replace(raw, '[.\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+$', ''), '^{_WHITE}', '')"
_over_names("nrm_01_target", N.target)
_over_names("nrm_03_target_list", lambda c: F.array_join(N.targets(F.split(c, ";")), ";"))
_over_names("nrm_04_model_target", N.model_target)
_PLAIN = f"CASE WHEN {_STRIPPED} <> '' AND lower({_STRIPPED}) NOT IN ({', '.join(repr(x) for x in V.BIOMARKER_JUNK)}) THEN coalesce({_case_sql(f"regexp_replace(lower({_STRIPPED}), '[^a-z0-9]', '', 'g')", V.BIOMARKER_CANON)}, {_STRIPPED}) END"
_over_names("nrm_05_plain_biomarker", N.plain_biomarker, _PLAIN)
_by_rule("nrm_05_plain_biomarker", N.plain_biomarker, _PLAIN, ["MSI", "genomic", "PD-L1", "BRCA", "", *V.BIOMARKER_CANON, *V.BIOMARKER_JUNK])
_over_names("nrm_06_biomarker", N.biomarker_of_text)
_over_names("nrm_07_biomarker_state", lambda c: N.biomarker_state(c, N.tidy_text))
_over_names("nrm_09_institution", N.institution)
_COUNTRY = f"CASE WHEN {_DOTLESS} = '' THEN raw WHEN upper({_DOTLESS}) IN ({', '.join(repr(x) for x in V.US_STATES)}) THEN 'USA' ELSE coalesce({_case_sql(f'upper({_DOTLESS})', V.US_TERRITORIES)}, {_case_sql(_DOTLESS, V.COUNTRIES)}, {_DOTLESS}) END"
_over_names("nrm_10_country", N.country, _COUNTRY)
_by_rule("nrm_10_country", N.country, _COUNTRY, ["China.", "CA.", "", ".", *V.US_STATES, *V.US_TERRITORIES, *V.COUNTRIES])
_over_names("nrm_11_companies", lambda c: F.array_join(N.companies_of_text(c), "|"))
_KIND = f"coalesce({_case_sql(f'lower({_STRIPPED})', {k.lower(): k for k in D.MODALITY})}, 'Unknown')"
_over_names("nrm_12_modality", N.known_modality, _KIND)
_by_rule("nrm_12_modality", N.known_modality, _KIND, ["adc", " Small molecule ", "x", *D.MODALITY])
_over_names("nrm_15_country_of_code", N.country_of_code)
_over_names("scl_lead_drug", lambda c: F.array_join(drugs.lead_first(F.split(c, ";")), "|"))
_SAID_PHASES = f"list_transform(regexp_extract_all(raw, '{R.PHASE_WORD.replace(chr(92) + 's', '[' + chr(92) + 's' + chr(92) + 'x{0B}]')}', 1), lambda w: {_case_sql('upper(w)', R.PHASES)})"
_PHASES = f"array_to_string(list_transform([{_SAID_PHASES}], lambda xs: array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), '|')), '')"
_over_names("scl_phases", lambda c: F.array_join(R.phases(c), "|"), _PHASES)
_by_rule("scl_phases", lambda c: F.array_join(R.phases(c), "|"), _PHASES, ["A phase II and Phase 3 trial, phase 2", "phase 1/phase iv", "PHASE III, phase IIV", "phase2 phases 3 phase\n4", "none"])
_over_names("mrg_09_cdx_strategy", M.cdx_strategy)
_over_names("mrg_07_gap_fix", lambda c: M.fixed_modality_of_text(c, F.lit("Unknown")))


def _tagged(t: Column) -> list[Column]:
    tags = X.text_tags(t)
    return [(F.array_join(v, ",") if k == "biomarkers" else v).alias(k) for k, v in tags.items()]


def _text_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tagging of every document's whole text."""
    t = F.col("text")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    trials = F.when(F.contains(t, F.lit("NCT")), X.trial_ids(t)).otherwise(F.when(t.isNotNull(), F.array().cast("array<string>")))
    return docs.select("doc_id", *_tagged(t), F.array_join(trials, ",").alias("trials"))


query("scl_s03_text_tags_tables")(_text_tags)


def _target_sql(x: str) -> str:
    """NRM-01 in SQL."""
    upper = {k.upper(): v for k, v in V.TARGET_SYNONYMS.items()}
    erbb = f"CASE regexp_extract({x}, '(?i)^(?:wt)?erbb[\\s\\-]?([123])[a-z]?$', 1) WHEN '1' THEN 'EGFR' WHEN '2' THEN 'HER2' WHEN '3' THEN 'HER3' END"
    kras = f"CASE WHEN regexp_matches({x}, '{V.KRAS_MUTATION}') THEN 'KRAS' END"
    junk = ", ".join(f"'{j}'" for j in V.TARGET_JUNK)
    return f"CASE WHEN upper({x}) IN ({junk}) THEN 'Unknown' ELSE coalesce({_case_sql(x, V.TARGET_SYNONYMS)}, {kras}, {erbb}, {_case_sql(f'upper({x})', upper)}, {x}) END"


_ODD = ["ErbB-2", "WTErbB-2", "erbb 3b", "K-RAS G12D", "kras-q61h", "DNA", "n/a", "", "  ", "NRAS", "K-RAS", "pd1", " HER-2 ", *V.TARGET_SYNONYMS, *[k.lower() for k in V.TARGET_SYNONYMS]]
_by_rule("nrm_01_target", N.target, f"CASE WHEN {_STRIPPED} <> '' THEN {_target_sql(_STRIPPED)} END", _ODD)
_EACH = _STRIPPED.replace("raw", "e")
_LIST = f"list_filter(list_transform(string_split(raw, ';'), lambda e: CASE WHEN {_EACH} <> '' THEN {_target_sql(_EACH)} END), lambda x: x IS NOT NULL)"
_LISTED = f"array_to_string(list_transform([{_LIST}], lambda xs: array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), ';')), '')"
_by_rule("nrm_03_target_list", lambda c: F.array_join(N.targets(F.split(c, ";")), ";"), _LISTED, ["HER-2;EGFR;ERBB2;", "", ";", "VEGFA;KDR;x", "a;A;a; a ;n/a;DNA"])
_EDGE = re.compile(r"\\b(\w+)\\b")
_STATE = "CASE " + " ".join(f"WHEN regexp_matches(raw, '(?i){_EDGE.sub(lambda m: f"(?:^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_]){m[1]}(?:$|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])", p)}') THEN '{k}'" for k, p in V.BIOMARKER_STATES.items()) + " END"
_by_rule("nrm_07_biomarker_state", lambda c: N.biomarker_state(c, N.tidy_text), _STATE, ["HER2 Amplification", "HER2", "KRAS G12C", "HER2-low", "EGFR exon 20", "PD-L1 IHC 3+", "ALK fusion", "MSH2 loss", "wild type RAS", "TMB-high", "ER negative", "pos"])
_UPPER = "upper(replace(raw, 'ß', 'SS'))"
_by_rule("nrm_15_country_of_code", N.country_of_code, f"coalesce({_case_sql(_UPPER, V.COUNTRY_CODES)}, {_UPPER})", ["us", "ZZ", *V.COUNTRY_CODES])


def _has_sql(text: str, words: list[str], whole: bool = False) -> str:
    """Any of the words in a lower-cased text; whole ones do not touch other letters or digits."""
    quote = lambda w: w.lower().replace("'", "''")
    if whole:
        return f"regexp_matches({text}, '(^|[^a-z0-9])(?:{'|'.join(quote(re.escape(w)) for w in words)})([^a-z0-9]|$)')"
    return "(" + " OR ".join(f"contains({text}, '{quote(w)}')" for w in words) + ")"


_CDX_NAMED = f"{_has_sql('lower(raw)', D.BIOMARKER + D.BIOMARKER_WORDS)}"
_by_rule("mrg_09_cdx_strategy", M.cdx_strategy, f"CASE WHEN NOT {_CDX_NAMED} THEN 'none' WHEN {_has_sql('lower(raw)', V.CDX_CONFIRMED)} THEN 'confirmed' ELSE 'exploratory' END", ["HER2 must have been documented", "exploratory analysis of KRAS", "adults"])


_RE2 = lambda pattern: pattern.replace("(?iU)", "(?i)").replace(r"\s", r"[\s\x{0B}\x{85}\p{Z}]")
_FIRST_DRUG = f"coalesce(list_filter(regexp_split_to_array(raw, '{_RE2(V.DRUG_BREAK)}'), lambda e: {_EACH} <> '')[1], raw)"
_GAP = f"""list_transform([{_FIRST_DRUG}], lambda d: CASE WHEN regexp_matches(d, '{_RE2(V.PREVENTIVE)}') THEN NULL WHEN {_has_sql('lower(d)', V.VACCINE_CODES + D.MODALITY['Vaccine'])} THEN 'Vaccine'
 WHEN regexp_matches(d, '{_RE2(V.ANTI_CYTOKINE)}') THEN NULL {' '.join(f"WHEN {_has_sql('lower(d)', D.MODALITY[m])} THEN '{m}'" for m in ('Fusion Protein', 'Recombinant Protein'))} END)[1]"""
_GAP_CASES = ["BCG vaccine + drug", "COVID vaccine", "interferon alfa", "anti-IL-6 mAb", "x", "anti-interferon fusion protein", "etanercept plus flu vaccine", " , and neo-PV-01", "VB10.NEO/x"]
_by_rule("mrg_07_gap_fix", lambda c: M.fixed_modality_of_text(c, F.lit("Unknown")), _GAP, _GAP_CASES)

_LET = "list_transform([{}], lambda {}: {})[1]".format
_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')".format
_BRACKETS = r"\(([A-Za-z0-9/\-]{2,14})\)"


def _rescued_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{k}') THEN '{v}'" for k, v in V.TARGET_RESCUE.items()) + " END"


_INSIDE = f"nullif(regexp_extract(s, '{_BRACKETS}', 1), '')"
_OF_SENTENCE = f"coalesce({_rescued_sql('s')}, {_case_sql(_KEY(_INSIDE), V.TARGET_CANON)}, {_INSIDE}, 'Unknown')"
_SHORT_BODY = f"coalesce({_case_sql(_KEY('n'), V.TARGET_CANON)}, CASE WHEN length(n) > 28 AND contains(n, ' ') THEN coalesce({_rescued_sql('n')}, 'Unknown') END, n)"
_SHORT = _LET(f"coalesce(nullif(regexp_extract(s, '{_BRACKETS}[\\s\\x{{0B}}]*$', 1), ''), s)", "n", _SHORT_BODY)
_SENTENCE = f"length(s) > 40 AND {_has_sql('lower(s)', V.SENTENCE_MARKS)}"
_MEANT = f"coalesce({_case_sql(_KEY('s'), V.DRUG_AS_TARGET)}, CASE WHEN {_SENTENCE} THEN {_OF_SENTENCE} ELSE {_SHORT} END)"
_BARE = _STRIPPED.replace("raw", "m")
_MODEL = _LET(f"trim({_STRIPPED}, '.')", "s", f"CASE WHEN lower(s) IN ('unknown', '', 'n/a', 'none') THEN 'Unknown' ELSE {_LET(_MEANT, 'm', f"coalesce(CASE WHEN {_BARE} <> '' THEN {_target_sql(_BARE)} END, m)")} END")
_by_rule(
    "nrm_04_model_target",
    N.model_target,
    _MODEL,
    ["bortezomib", "TP53", "Vascular Endothelial Growth Factor Receptor (VEGFR)", "n/a", "KRAS G12C", "It is a drug that binds the proteasome; not one target", "some very long name without any abbreviation", "It is not a single target, see (XYZ-1) or (ABC)", " HER-2. ", *V.TARGET_CANON, *V.DRUG_AS_TARGET],
)
_DOSED = lambda p: p.replace("(?iU)", "(?i)").replace(r"\s", r"[\s\x{0B}\x{85}\p{Z}]").replace(r"\d", r"\p{Nd}")
_UNDOSED = f"regexp_replace(regexp_replace({_EACH}, '{_DOSED(drugs.DOSE)}', '', 'g'), '{_DOSED(drugs.SCHEDULE)}', '', 'g')"
_CLEANED = f"list_filter(list_transform(string_split(raw, ';'), lambda e: {_STRIPPED.replace('raw', _UNDOSED)}), lambda e: e <> '')"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_WEIGHT = f"CASE WHEN lower(x) IN {_IN(drugs.SUPPORTIVE)} THEN 0 WHEN lower(x) IN {_IN(drugs.BACKBONE)} THEN 1 WHEN regexp_matches(lower(x), '{drugs.TARGETED_END}') OR (regexp_matches(x, '{drugs.CODE_NAME}') AND NOT regexp_matches(lower(x), '{drugs.CHEMO_END}')) THEN 3 ELSE 2 END"
_LED = _LET(f"list_transform(d, lambda x: {_WEIGHT})", "w", _LET("list_position(w, list_max(w))", "p", "array_to_string(list_concat([d[p]], list_filter(d, lambda x, i: i <> p)), '|')"))
_ONCE = _LET("list_transform(c, lambda x: lower(x))", "l", "list_filter(c, lambda x, i: list_position(l, lower(x)) = i)")
_by_rule(
    "scl_lead_drug",
    lambda c: F.array_join(drugs.lead_first(F.split(c, ";")), "|"),
    _LET(_CLEANED, "c", f"CASE WHEN len(c) = 0 THEN 'Unknown' ELSE {_LET(_ONCE, 'd', _LED)} END"),
    ["Placebo;Carboplatin;ABC-1;abc-1 10 mg", "", ";", "Cisplatin 5 mg/m2 q3w;Pembrolizumab 200 mg iv;Aspirin", "Docetaxel;x qd;Y po ;y", *drugs.SUPPORTIVE, *drugs.BACKBONE],
)
_by_rule("nrm_06_biomarker", N.biomarker_of_text, None, ["KRAS G12C", "Her2-low", "VEGFR2", "KRASG12C", "EGFRm", "BRAF V600", "KRAS p.G12C", "MET exon 14 skipping mutation", "mutation", "gene signature", "BRCA1 del 17", *V.BIOMARKER_ALIAS])
_AFFILIATIONS = ["Yonsei University Health System", "The University of Tokyo Hospital", "Acme Therapeutics, Inc., Boston", "Department of Medicine, University of California, San Francisco, CA", "The University of Texas MD Anderson Cancer Center, Houston", "Department of Physics; Unit 7", ", ;", "Boston University School of Medicine, Boston"]
_by_rule("nrm_09_institution", N.institution, None, _AFFILIATIONS)
_by_rule("nrm_11_companies", lambda c: F.array_join(N.companies_of_text(c), "|"), None, ["AstraZeneca UK Limited", "AstraZeneca; Merck", "Merck KGaA, Darmstadt", "ABL Bio, Inc. / Seoul National University Hospital", "Pfizer | pfizer", "Acme Bio Holdings Co., Ltd.", *[w for _, ws in V.COMPANIES for w in ws]])


def _tag_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document, and behind it one of some sentences that the dictionaries are made for."""
    tail = F.get(F.array(*map(F.lit, _TEXTS)), (F.col("doc_id") % len(_TEXTS)).cast("int"))
    t = F.col("t")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), tail).alias("t"))
    return docs.select("doc_id", *_tagged(t))


def _first_sql(tests: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests) + f" ELSE '{default}' END"


_TAG_TARGETS = [(k, _has_sql("u", v)) for k, v in D.TARGET.items()] + [(k, _has_sql("u", v, True)) for k, v in D.TARGET_WORDS.items()]
_TAG_MARKERS = [(k, _has_sql("u", [k])) for k in D.BIOMARKER] + [(k, _has_sql("u", [k], True)) for k in D.BIOMARKER_WORDS]
_TAGS = f"""SELECT doc_id, {_first_sql([(k, _has_sql("u", v)) for k, v in D.MODALITY.items()], "Unknown")} AS modality, {_first_sql(_TAG_TARGETS, "Unknown")} AS target,
array_to_string(list_filter([{', '.join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _TAG_MARKERS)}], lambda x: x IS NOT NULL), ',') AS biomarkers, {_first_sql([(k, _has_sql("u", v, True)) for k, v in D.CANCER.items()], "Other")} AS cancer"""
query(
    "scl_s03_text_tags",
    f"""WITH d AS (SELECT doc_id, lower(concat_ws(' ', coalesce(text, ''), [{', '.join("'" + x + "'" for x in _TEXTS)}][doc_id % {len(_TEXTS)} + 1])) AS u FROM documents) {_TAGS} FROM d""",
    raw=True,
)(_tag_texts)
_TRIALS = r"regexp_extract_all(text, '\bNCT\d{8}\b')"
ORACLE_SQL["scl_s03_text_tags_tables"] = f"""WITH d AS (SELECT doc_id, text, lower(text) AS u FROM documents)
{_TAGS}, array_to_string(list_filter({_TRIALS}, lambda x, i: list_position({_TRIALS}, x) = i), ',') AS trials FROM d"""

query("snk_03_metadata", "SELECT count(*) AS total, count(DISTINCT company) AS companies FROM p")(lambda spark, d: S.metadata(programs(spark, d)))


def _cdx(spark: SparkSession, d: str) -> DataFrame:
    partners = F.when(F.col("is_combination"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    s = M.cdx_score(F.lit("2001-01-01").cast("date"), F.col("completion_date"), F.size("biomarkers") > 0, F.lit(None).cast("string"), F.col("drug_name"), partners, F.col("target"))
    rows = programs(spark, d).select(s.alias("s")).select("s.score", "s.level", F.array_contains("s.flags", "needs_review").alias("review"))
    return rows.groupBy("score", "level", "review").agg(F.count("*").alias("n"))


query(
    "mrg_08_cdx_score",
    """, s AS (SELECT 1 + CASE WHEN date_diff('day', DATE '2001-01-01', CAST(completion_date AS DATE)) BETWEEN 0 AND 180 THEN 3 ELSE 0 END + CASE WHEN len(biomarkers) > 0 THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(lower(drug_name), 'colorectal|gastric|stomach|colon|rectal|gastrointestinal|gi|crc|gc') THEN 2 ELSE 0 END + CASE WHEN is_combination THEN 0 ELSE 1 END AS score, target = 'Unknown' AS review FROM p)
SELECT CAST(score AS INTEGER) AS score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS level, review, count(*) AS n FROM s GROUP BY 1, 2, 3""",
)(_cdx)


def _literature_merge(spark: SparkSession, d: str) -> DataFrame:
    records = literature(spark, d).withColumn("biomarker_list", F.array(F.lit("B")))
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    answers = labels.select(
        F.concat(F.lit("uid-"), F.col("doc_id").cast("string")).alias("uid"),
        F.when(F.col("t") == 1, F.array(F.lit("ADC"))).otherwise(F.array().cast("array<string>")).alias("modality_list"),
        F.array(F.lit("T")).alias("target_list"),
        F.array(F.lit("M")).alias("biomarkers"),
        F.when(F.col("q") == 1, 0.8).otherwise(0.3).alias("confidence"),
        F.when(F.col("doc_id") % 4 == 0, "short").alias("summary"),
    )
    out = M.merge_literature(records, answers)
    return out.groupBy(F.array_join("modality_list", ",").alias("modalities"), F.array_join("target_list", ",").alias("targets"), "enrich_src", "summary").agg(F.count("*").alias("n"))


query(
    "mrg_03_literature_merge",
    """, a AS (SELECT 'uid-' || doc_id AS uid, max(quality) AS q, max(toxic) AS t, max(CASE WHEN doc_id % 4 = 0 THEN 'short' END) AS s FROM labels GROUP BY 1)
SELECT CASE WHEN q = 1 THEN CASE WHEN t = 1 THEN 'ADC' ELSE 'Unknown' END ELSE array_to_string(modality_list, ',') END AS modalities, CASE WHEN q = 1 THEN 'T' ELSE array_to_string(target_list, ',') END AS targets,
CASE WHEN q = 1 THEN 'llm' ELSE 'rule' END AS enrich_src, s AS summary, count(*) AS n FROM l LEFT JOIN a ON l.uid = a.uid GROUP BY 1, 2, 3, 4""",
)(_literature_merge)


def _cross_source(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_name").alias("drug_id"))
    none = F.lit(None)
    answers = part.agg(F.min("p_type").alias("modality"), F.max("p_brand").alias("target"), (F.max("p_size") / 50.0).alias("confidence"), (F.min("p_size") % 2 == 0).alias("conflict"))
    answers = answers.withColumns({"biomarkers": none.cast("array<string>"), "evidence": none.cast("array<string>"), "note": none.cast("string")})
    rows = programs(spark, d).withColumnRenamed("drug_name", "drug_id").withColumnRenamed("biomarkers", "biomarker_list")
    return M.merge_cross_source(rows, answers).groupBy("modality", "target", "action").agg(F.count("*").alias("n"))


query(
    "mrg_05_cross_source",
    """, a AS (SELECT p_name AS k, min(p_type) AS am, max(p_brand) AS tg, max(p_size) / 50e0 AS c, min(p_size) % 2 = 0 AS cf FROM part GROUP BY 1),
j AS (SELECT *, target = 'Unknown' AND c >= 0.7e0 AS gap, regexp_replace(lower(target), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(tg), '[^a-z0-9]', '', 'g') AS y FROM p JOIN a ON drug_name = k),
t AS (SELECT *, NOT gap AND cf AND c >= 0.85e0 AND am <> modality AS tm, gap OR (cf AND c >= 0.85e0 AND NOT (contains(x, y) OR contains(y, x))) AS tt FROM j)
SELECT CASE WHEN tm THEN am ELSE modality END AS modality, CASE WHEN tt THEN tg ELSE target END AS target, CASE WHEN tm OR tt THEN CASE WHEN gap THEN 'filled' ELSE 'corrected' END END AS action, count(*) AS n FROM t GROUP BY 1, 2, 3""",
)(_cross_source)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    records = literature(spark, d).withColumn("llm_confidence", F.length("title") % 10 / 10.0)
    return M.evidence_of(programs(spark, d).withColumnRenamed("drug_name", "drug_id"), records).select("drug_id", "uid", "rank")


query(
    "mrg_06_evidence",
    """, t AS (SELECT DISTINCT drug_name, uid, 1 AS bt FROM p JOIN l ON p.nct_id = l.nct_id), e AS (SELECT uid, unnest(target_list) AS tt FROM l),
g AS (SELECT DISTINCT drug_name, uid, 0 AS bt FROM (SELECT DISTINCT drug_name, target FROM p) x JOIN e ON target = tt), u AS (SELECT drug_name, uid, max(bt) AS bt FROM (SELECT * FROM t UNION ALL SELECT * FROM g) GROUP BY 1, 2),
r AS (SELECT drug_name AS drug_id, u.uid, row_number() OVER (PARTITION BY drug_name ORDER BY bt DESC, length(title) % 10 DESC, u.uid) AS rank FROM u JOIN l ON u.uid = l.uid)
SELECT drug_id, uid, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)(_evidence)
query(
    "agg_36_emerging_targets",
    """, w AS (SELECT target, count(*) AS this_week FROM p WHERE target <> 'Unknown' AND start_date >= '2001-06-01' GROUP BY 1),
c AS (SELECT target, count(*) AS corpus_total FROM (SELECT target FROM p UNION ALL SELECT unnest(target_list) FROM l) GROUP BY 1)
SELECT target, this_week, coalesce(corpus_total, 0) AS corpus_total FROM w LEFT JOIN c USING (target) ORDER BY corpus_total, this_week DESC, target LIMIT 10""",
)(lambda spark, d: K.emerging_targets(programs(spark, d).where("start_date >= '2001-06-01'").select("target"), programs(spark, d).select("target").union(literature(spark, d).select(F.explode("target_list"))), 10))

from therascape import registry_pages  # noqa: E402, F401  (registers the queries of the wide views)
from therascape import registry_stores  # noqa: E402, F401  (registers the queries of sources, stores and streams)
from therascape import registry_dashboards  # noqa: E402, F401  (registers the queries of whole pages)
