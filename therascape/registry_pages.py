"""Queries of filters, pages, links, merges and the offline study over the wide views, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.functions import dictionaries as D
from therascape.functions import labels as L
from therascape.functions import mentions as T
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.operators import aggregates as A
from therascape.operators import links as K
from therascape.operators import merges as M
from therascape.operators import offline as O
from therascape.operators import pages as P
from therascape.operators.filters import LiteratureFilter, ProgramFilter
from therascape.plans.bridge import LITERATURE_SQL, PROGRAMS_SQL
from therascape.plans.wide import WIDE_LITERATURE_SQL, WIDE_PROGRAMS_SQL, wide_literature, wide_programs
from therascape.registry import _IDX, _PB, query, top_n_sql
from therascape.sources import store as S


def _wide(name: str, sql: str):
    """Register a query; its SQL may use pw (programs), lw (literature) and lc (literature with country and kind)."""
    parts = [PROGRAMS_SQL, WIDE_PROGRAMS_SQL] if " pw" in sql else []
    parts += [LITERATURE_SQL, WIDE_LITERATURE_SQL] if " lw" in sql or " lc" in sql else []
    more = "," if sql.lstrip().startswith(",") else ""
    return query(name, "WITH " + ",\n".join(parts) + more + "\n" + sql.lstrip().removeprefix(","), raw=True)


def _p(spark: SparkSession, d: str) -> DataFrame:
    return wide_programs(spark, d)


def _l(spark: SparkSession, d: str) -> DataFrame:
    return wide_literature(spark, d)


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.manifest(_l(spark, d), ["conference", "year"]).withColumnRenamed("count", "n")


# Filters: rows by id, so that equal counts of wrong rows do not pass.


def _program_filter(name: str, where: str, f: ProgramFilter) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = _p(spark, d)
        return p.where(f.column(p.columns)).groupBy("drug_id", "nct_id", "completion_date").agg(F.count("*").alias("n"))

    _wide(name, f"SELECT drug_id, nct_id, completion_date, count(*) AS n FROM pw WHERE {where} GROUP BY 1, 2, 3")(run)


_program_filter("flt_03_any_cancer", "CASE WHEN len(cancer_categories) > 0 THEN list_has_any(cancer_categories, ['Basket', 'MACHINERY']) ELSE cancer_category IN ('Basket', 'MACHINERY') END", ProgramFilter(cancers=["Basket", "MACHINERY"]))
_program_filter("flt_08_phase_na", "len(list_filter(phases, lambda x: x <> 'UNKNOWN')) = 0 OR list_contains(phases, 'PHASE3')", ProgramFilter(phases=["NA", "PHASE3"]))
_program_filter("flt_09_partnership", "partnership_status = 'solo'", ProgramFilter(partnership="solo"))
_program_filter("flt_16_trial_focus", "list_contains(nct_ids, 'NCT00000011')", ProgramFilter(trial="NCT00000011", companies=["nobody"]))
_program_filter("flt_17_any_company", "company = 'Supplier#000000002' OR list_contains(collaborators, 'Supplier#000000002')", ProgramFilter(any_company="Supplier#000000002"))
_BLOB = "lower(concat_ws(' ', drug_name, company, company_normalized, target, modality, condition, cancer_category, official_title, moa, overall_status, nullif(array_to_string(combo_drugs, ' '), ''), nullif(array_to_string(cancer_categories, ' '), ''), nullif(array_to_string(biomarkers, ' '), ''), nullif(array_to_string(collaborators, ' '), ''), array_to_string(nct_ids, ' ')))"
_program_filter("flt_15_keyword_all_fields", f"{_BLOB} LIKE '%tumour household trial of re%'", ProgramFilter(keyword="Tumour HOUSEHOLD Trial of re"))
_program_filter("flt_13_14_years", "CAST(left(start_date, 4) AS INTEGER) >= 1998 AND CAST(left(completion_date, 4) AS INTEGER) <= 1999 AND partnership_status = 'partnered'", ProgramFilter(start_years=(1998, None), completion_years=(None, 1999), partnership="partnered"))


def _literature_filter(name: str, where: str, f: LiteratureFilter, chart: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        lit = _l(spark, d)
        return lit.where(f.chart_column(lit.columns) if chart else f.column(lit.columns)).select("uid")

    _wide(name, f"SELECT uid FROM lc WHERE {where}")(run)


_SHOW = {"show_embargoed": True}
_literature_filter("flt_23_phase_na", "len(phases) = 0 OR list_contains(phases, 'PHASE3')", LiteratureFilter(phases=["NA", "PHASE3"], **_SHOW))
_literature_filter("flt_25_any_cancer", "list_contains(cancer_list, 'Other')", LiteratureFilter(cancers=["Other"], **_SHOW))
_literature_filter("flt_26_country_normalized", "country IN ('China', 'Puerto Rico')", LiteratureFilter(countries=["China", "Puerto Rico"], **_SHOW))
_literature_filter("flt_27_company", "list_has_any(companies_normalized, ['Supplier#000000003'])", LiteratureFilter(companies=["Supplier#000000003"], **_SHOW))
_literature_filter("flt_29_biomarker", "list_has_any(biomarker_list, ['BM2', 'BM6'])", LiteratureFilter(biomarkers=["BM2", "BM6"], **_SHOW))
_literature_filter("flt_30_institution", "affiliation IN ('University of N3', 'University of N4')", LiteratureFilter(institutions=["University of N3", "University of N4"], **_SHOW))
_literature_filter("flt_31_kind", "kind IN ('Late-Breaking', 'Presented')", LiteratureFilter(kinds=["Late-Breaking", "Presented"], **_SHOW))
_literature_filter("flt_32_affiliation", "lower(coalesce(affiliation, '')) LIKE '%of n1%'", LiteratureFilter(affiliation=" OF N1", **_SHOW))
_literature_filter("flt_33_homonym", "author = 'Author 7' AND coalesce(affiliation, '') = 'University of N7'", LiteratureFilter(author="Author 7", author_affiliation="University of N7", **_SHOW))
_literature_filter("flt_34_any_trial", "list_contains(nct_ids, 'NCT00000009')", LiteratureFilter(nct_id="NCT00000009", **_SHOW))
_LIST = "nullif(array_to_string({}, ' '), '')".format
_LBLOB = f"lower(concat_ws(' ', nullif(title, ''), author, abstract_id, country_raw, affiliation, {', '.join(map(_LIST, ['target_list', 'biomarker_list', 'nct_ids', 'drugs_mentioned', 'companies_normalized', 'cancer_list']))}))"
_literature_filter("flt_35_keyword_all_fields", f"{_LBLOB} LIKE '%china. university of n1 %'", LiteratureFilter(keyword="CHINA. University of N1 ", **_SHOW))
_CBLOB = f"lower(concat_ws(' ', nullif(title, ''), author, abstract_id, {', '.join(map(_LIST, ['target_list', 'biomarker_list', 'nct_ids', 'drugs_mentioned', 'companies_normalized', 'cancer_list']))}))"
_literature_filter("flt_36_chart", f"list_has_any(phases, ['PHASE1', 'NA']) AND {_CBLOB} LIKE '%brand#1%'", LiteratureFilter(phases=["PHASE1", "NA"], keyword=" Brand#1 "), chart=True)

# Option lists, sidebars and facets.


def _axes_sql(axes: dict[str, str], table: str) -> str:
    return "\nUNION ALL ".join(f"SELECT '{a}' AS axis, name, count(*) AS n FROM (SELECT unnest({v}) AS name FROM {table}) WHERE name <> '' GROUP BY 2" for a, v in axes.items())


def _at_sql(names: list[str]) -> str:
    return "coalesce(list_position([" + ", ".join(f"'{n}'" for n in names) + f"], name), {len(names) + 1})"


_CANCERS = "CASE WHEN len(cancer_categories) > 0 THEN cancer_categories ELSE [cancer_category] END"
_YEAR = "[CASE WHEN CAST(left({0}, 4) AS INTEGER) BETWEEN 2001 AND 2039 THEN left({0}, 4) END]".format
_NAMED = "list_filter(phases, lambda x: x <> 'UNKNOWN')"
_PHASES = f"CASE WHEN len({_NAMED}) = 0 THEN ['NA'] ELSE {_NAMED} END"
_PROGRAM_AXES = {
    "companies": "[company_normalized]",
    "drugs": "[drug_name]",
    "cancers": _CANCERS,
    "phases": _PHASES,
    "modalities": "[modality]",
    "targets": "[nullif(target, 'Unknown')]",
    "biomarkers": "biomarkers",
    "statuses": "[overall_status]",
    "startYears": _YEAR("start_date"),
    "completionYears": _YEAR("completion_date"),
}
_wide(
    "agg_23_program_options",
    f""", a AS ({_axes_sql(_PROGRAM_AXES, "pw")})
SELECT axis, name, n, CAST(row_number() OVER (PARTITION BY axis ORDER BY CASE WHEN axis IN ('drugs', 'targets', 'biomarkers') THEN -n WHEN axis = 'phases' THEN {_at_sql(L.PHASE_ORDER)} ELSE 0 END, name) AS INTEGER) AS place FROM a""",
)(lambda spark, d: P.program_options(_p(spark, d)))
_LITERATURE_AXES = {
    "conferences": "[conference]",
    "years": "[CAST(\"year\" AS VARCHAR)]",
    "phases": "CASE WHEN len(phases) = 0 THEN ['NA'] ELSE phases END",
    "modalities": "modality_list",
    "cancers": "cancer_list",
    "countries": "[country]",
    "companies": "companies_normalized",
    "targets": "target_list",
    "biomarkers": "biomarker_list",
    "presentationKinds": "[kind]",
}
_wide(
    "agg_24_literature_options",
    f""", a AS ({_axes_sql(_LITERATURE_AXES, "lc")})
SELECT axis, name, n, CAST(row_number() OVER (PARTITION BY axis ORDER BY CASE WHEN axis = 'phases' THEN {_at_sql(L.PHASE_ORDER)} WHEN axis = 'presentationKinds' THEN {_at_sql(L.KINDS)} WHEN axis = 'years' THEN -CAST(name AS INTEGER) ELSE 0 END, name) AS INTEGER) AS place FROM a""",
)(lambda spark, d: P.literature_options(_l(spark, d)))
_MOST = {"targets": 20, "biomarkers": 5, "companies": 12}
_PROGRAM_FACETS = {"cancers": _CANCERS, "modalities": "[modality]", "targets": "[nullif(target, 'Unknown')]", "biomarkers": "biomarkers", "companies": "[company_normalized]"}
_LITERATURE_FACETS = {"cancers": "cancer_list", "modalities": "modality_list", "targets": "target_list", "biomarkers": "biomarker_list", "companies": "companies_normalized"}
_wide(
    "agg_35_global_facets",
    f""", a AS ({_axes_sql(_PROGRAM_FACETS, "pw")} UNION ALL {_axes_sql(_LITERATURE_FACETS, "lw")}), b AS (SELECT axis, name, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY axis ORDER BY CASE WHEN axis IN ('targets', 'biomarkers', 'companies') THEN -n ELSE 0 END, name) AS INTEGER) AS place FROM b)
SELECT * FROM r WHERE place <= CASE axis WHEN 'targets' THEN 20 WHEN 'biomarkers' THEN 5 WHEN 'companies' THEN 12 ELSE place END""",
)(lambda spark, d: P.global_facets(_p(spark, d), _l(spark, d), _MOST))
_wide("agg_21_company_sidebar", 'SELECT company, count(*) AS "count" FROM (SELECT unnest(list_concat([company], collaborators)) AS company FROM pw) GROUP BY 1')(lambda spark, d: P.company_sidebar(_p(spark, d)))
_wide("agg_03_accessor_counts", "SELECT name, count(*) AS \"count\" FROM (SELECT unnest(CASE WHEN len(collaborators) = 0 THEN ['Unknown'] ELSE collaborators END) AS name FROM pw) GROUP BY 1")(lambda spark, d: P.accessor_counts(_p(spark, d), F.col("collaborators")))
_LABEL = "array_to_string(list_transform(string_split(raw, '/'), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.PHASE_LABELS.items()) + " ELSE x END), '/')"
_wide(
    "agg_04_phase_labels",
    f"""SELECT {_LABEL} AS name, raw, count(*) AS "count", CAST(list_position(['EARLY_PHASE1', 'PHASE1', 'PHASE1/PHASE2', 'PHASE2', 'PHASE2/PHASE3', 'PHASE3', 'PHASE4', 'NA', 'UNKNOWN'], raw) AS INTEGER) AS place FROM (SELECT phase AS raw FROM pw) GROUP BY raw""",
)(lambda spark, d: P.phase_label_counts(_p(spark, d)))
_wide(
    "agg_15_literature_phases",
    f"""SELECT {_LABEL} AS name, raw, count(*) AS "count", CAST(list_position(['EARLY_PHASE1', 'PHASE1', 'PHASE2', 'PHASE3', 'PHASE4', 'NA'], raw) AS INTEGER) AS place FROM (SELECT unnest(CASE WHEN len(phases) = 0 THEN ['NA'] ELSE phases END) AS raw FROM lw) GROUP BY raw""",
)(lambda spark, d: P.literature_phases(_l(spark, d)))
_wide("agg_08_company_elements", top_n_sql('SELECT name, count(*) AS "count" FROM (SELECT unnest(companies_normalized) AS name FROM lw) GROUP BY 1', 5))(lambda spark, d: A.top_n_other(A.element_counts(_l(spark, d), F.col("companies_normalized")), 5))
_wide("agg_10_journals", top_n_sql('SELECT journal AS name, count(*) AS "count" FROM lw WHERE is_pub GROUP BY 1', 2))(lambda spark, d: A.top_n_other(P.scalar_counts(_l(spark, d).where("is_pub"), F.col("journal")), 2))
_wide("agg_13_countries_normalized", top_n_sql('SELECT country AS name, count(*) AS "count" FROM lc WHERE country IS NOT NULL GROUP BY 1', 3))(lambda spark, d: A.top_n_other(P.scalar_counts(_l(spark, d), N.country(F.col("country_raw"))), 3))
_wide("agg_14_institutions", top_n_sql('SELECT affiliation AS name, count(*) AS "count" FROM lw WHERE affiliation IS NOT NULL GROUP BY 1', 8))(lambda spark, d: A.top_n_other(P.scalar_counts(_l(spark, d), N.institution(F.col("affiliation"))), 8))
_wide("agg_01_all_groups", 'SELECT CAST(row_number() OVER (ORDER BY "count" DESC, name) AS INTEGER) AS rank, name, "count", false AS is_other FROM (SELECT company AS name, count(*) AS "count" FROM pw GROUP BY 1)')(lambda spark, d: A.top_n_other(A.counts(_p(spark, d), F.col("company")), 0))
_wide(
    "agg_16_literature_summary",
    """SELECT count(*) AS total, (SELECT count(DISTINCT c) FROM (SELECT unnest(companies_normalized) AS c FROM lw)) AS companies, (SELECT count(DISTINCT c) FROM (SELECT unnest(cancer_list) AS c FROM lw)) AS cancers,
count(DISTINCT conference || ' ' || "year") AS datasets, CAST(floor(count(*) FILTER (len(modality_list) > 0) * 100.0 / count(*) + 0.5) AS BIGINT) AS therapeutic_pct FROM lw""",
)(lambda spark, d: P.literature_summary(_l(spark, d)))
_wide(
    "qry_05_biomarker_split",
    """, t AS (SELECT name, count(*) AS "count" FROM (SELECT unnest(biomarkers) AS name FROM pw) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), w AS (SELECT count(*) FILTER (len(biomarkers) > 0) AS m, count(*) AS n FROM pw)
SELECT name, "count", CAST(floor("count" * 100.0 / max("count") OVER () + 0.5) AS BIGINT) AS share, m AS mentioned, n - m AS not_mentioned, CAST(floor(m * 100.0 / n + 0.5) AS BIGINT) AS mentioned_pct FROM t, w""",
)(lambda spark, d: P.biomarker_split(_p(spark, d)))
_wide(
    "qry_06_cdx_synergy",
    "SELECT target, modality, target IN ('Brand#3', 'Brand#9') AS target_fits, modality IN ('ECONOMY') AS modality_fits, count(*) AS n FROM pw GROUP BY ALL",
)(lambda spark, d: _p(spark, d).groupBy("target", "modality").agg(F.count("*").alias("n")).select("target", "modality", F.col("target").isin("Brand#3", "Brand#9").alias("target_fits"), F.col("modality").isin("ECONOMY").alias("modality_fits"), "n"))

# Manifests, partitions, tables.

_wide("agg_07_manifest_by_year", 'SELECT "year", CAST(sum(n) AS BIGINT) AS n FROM (SELECT conference, "year", count(*) AS n FROM lw GROUP BY 1, 2) GROUP BY 1')(lambda spark, d: _manifest(spark, d).groupBy("year").agg(F.sum("n").alias("n")))
_wide("agg_47_header_totals", 'SELECT count(*) AS total, count(DISTINCT conference) AS conferences, max("year") AS newest, count(DISTINCT "year") AS years FROM lw')(lambda spark, d: P.header_totals(_manifest(spark, d)))
_wide("agg_47_embargo_counters", "SELECT conference, count(*) FILTER (status = 'available') AS available, count(*) FILTER (status = 'embargoed') AS embargoed, count(*) AS total FROM lw GROUP BY 1")(
    lambda spark, d: _l(spark, d).groupBy("conference").agg(F.count_if(F.col("status") == "available").alias("available"), F.count_if(F.col("status") == "embargoed").alias("embargoed"), F.count("*").alias("total"))
)
_wide("j_24_newest_partitions", "SELECT uid FROM lw JOIN (SELECT conference AS c, max(\"year\") AS y FROM lw WHERE conference IN ('src1', 'src2') GROUP BY 1) ON conference = c AND \"year\" = y")(
    lambda spark, d: P.newest_partitions(_l(spark, d), _manifest(spark, d), ["src1", "src2"]).select("uid")
)
_wide("j_20_author_badges", "SELECT uid, n AS n_author FROM lw LEFT JOIN (SELECT author AS a, affiliation AS f, count(*) AS n FROM lw GROUP BY 1, 2 HAVING count(*) >= 2) ON author = a AND affiliation IS NOT DISTINCT FROM f")(
    lambda spark, d: K.author_badges(_l(spark, d))
)
_wide(
    "qry_10_program_page",
    """, g AS (SELECT drug_id, nct_id, completion_date, count(*) AS n FROM pw WHERE (company = 'Supplier#000000002' OR list_contains(collaborators, 'Supplier#000000002')) AND partnership_status = 'partnered' GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY completion_date DESC, drug_id, nct_id) AS INTEGER) AS place FROM g) SELECT * FROM r WHERE place BETWEEN 26 AND 50""",
)(
    lambda spark, d: P.page(
        _p(spark, d).where(ProgramFilter(any_company="Supplier#000000002", partnership="partnered").column(_p(spark, d).columns)).groupBy("drug_id", "nct_id", "completion_date").agg(F.count("*").alias("n")),
        [F.desc("completion_date"), F.asc("drug_id"), F.asc("nct_id")],
        1,
        25,
    )
)
_wide("qry_11_literature_page", ", r AS (SELECT uid, \"year\", CAST(row_number() OVER (ORDER BY \"year\" DESC, uid) AS INTEGER) AS place FROM lw WHERE status <> 'embargoed' AND conference IN ('src1', 'src2')) SELECT * FROM r WHERE place <= 50")(
    lambda spark, d: P.page(_l(spark, d).where(LiteratureFilter(conferences=["src1", "src2"]).column(_l(spark, d).columns)).select("uid", "year"), [F.desc("year"), F.asc("uid")], 0)
)
_wide("flt_53_option_search", "SELECT DISTINCT drug_name AS name FROM pw WHERE lower(drug_name) LIKE '%ri%' ORDER BY 1 LIMIT 10")(lambda spark, d: P.option_search(_p(spark, d).select(F.col("drug_name").alias("name")).distinct(), "RI", 10))
_wide("qry_17_trial_focus", "SELECT DISTINCT drug_id, uid FROM pw, lw WHERE list_contains(pw.nct_ids, 'NCT00000042') AND list_contains(lw.nct_ids, 'NCT00000042')")(
    lambda spark, d: _p(spark, d).where(ProgramFilter(trial="NCT00000042").column(_p(spark, d).columns)).select("drug_id", F.lit("NCT00000042").alias("t")).distinct().join(_l(spark, d).where(F.array_contains("nct_ids", "NCT00000042")).select("uid", F.lit("NCT00000042").alias("t")), "t").select("drug_id", "uid")
)

# Links.


def _drugs(spark: SparkSession, d: str) -> DataFrame:
    """A drug for each name and code: (code_name, drug_name, nct_ids)."""
    return _p(spark, d).select("code_name", "drug_name", "nct_ids")


_LINKS = """, ti AS (SELECT DISTINCT a.code_name, b.uid FROM (SELECT DISTINCT code_name, unnest(nct_ids) AS t FROM pw) a JOIN (SELECT DISTINCT uid, unnest(nct_ids) AS t FROM lw) b USING (t)),
na AS (SELECT DISTINCT a.code_name, b.uid FROM (SELECT DISTINCT code_name, 'abx' || substr(code_name, 5) AS t FROM pw) a JOIN (SELECT uid, 'abx' || string_split(code_title, ' ')[5] AS t FROM lw) b USING (t)),
k AS (SELECT code_name, uid, bool_or(bt) AS by_trial FROM (SELECT *, true AS bt FROM ti UNION ALL SELECT *, false FROM na) GROUP BY 1, 2)"""
_wide("j_10_drug_links", f"{_LINKS} SELECT * FROM k")(lambda spark, d: K.drug_links(_drugs(spark, d), _l(spark, d), "code_name", "code_name", "code_title"))
_wide(
    "agg_38_linked_records",
    f"""{_LINKS}, f AS (SELECT k.*, CASE WHEN is_pub THEN 'publication' ELSE 'conference' END AS axis, CASE WHEN is_pub THEN journal ELSE conference END AS venue, "year" FROM k JOIN lw USING (uid)),
r AS (SELECT *, row_number() OVER (PARTITION BY code_name ORDER BY by_trial DESC, "year" DESC, uid) AS rank, count(*) FILTER (axis = 'publication') OVER (PARTITION BY code_name) AS n_pub, count(*) FILTER (axis = 'conference') OVER (PARTITION BY code_name) AS n_conf, count(*) OVER (PARTITION BY code_name) AS total FROM f)
SELECT code_name, CAST(rank AS INTEGER) AS rank, uid, axis, venue, "year", CASE WHEN by_trial THEN 'nct' ELSE 'title' END AS why, n_pub, n_conf, total FROM r WHERE rank <= 15""",
)(lambda spark, d: K.linked_records(K.drug_links(_drugs(spark, d), _l(spark, d), "code_name", "code_name", "code_title"), _l(spark, d), "code_name"))
_wide("flt_46_code_tokens", "SELECT uid, 'abx' || string_split(code_title, ' ')[5] AS codes FROM lw")(lambda spark, d: _l(spark, d).select("uid", F.array_join(K.code_tokens(F.col("code_title")), ",").alias("codes")))


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lit = _l(spark, d).withColumn("t", F.concat(F.lit("On "), F.regexp_replace(F.coalesce(F.get("drugs_mentioned", F.lit(0)), F.lit("")), " ", ""), F.lit(" in use")))
    return _p(spark, d).withColumnRenamed("drug_id", "old_id").withColumn("drug_id", F.col("drug_name")), lit


_EVIDENCE = """, ti AS (SELECT DISTINCT a.drug_name, b.uid FROM (SELECT DISTINCT drug_name, unnest(nct_ids) AS t FROM pw) a JOIN (SELECT DISTINCT uid, unnest(nct_ids) AS t FROM lw) b USING (t)),
na AS (SELECT DISTINCT a.drug_name, b.uid FROM (SELECT DISTINCT drug_name, replace(drug_name, ' ', '') AS t FROM pw WHERE length(replace(drug_name, ' ', '')) >= 5) a JOIN (SELECT uid, lower(replace(drugs_mentioned[1], ' ', '')) AS t FROM lw) b USING (t)),
k AS (SELECT drug_name AS drug_id, uid, bool_or(bt) AS by_trial FROM (SELECT *, true AS bt FROM ti UNION ALL SELECT *, false FROM na) GROUP BY 1, 2)"""
_wide("j_11_evidence_links", f"{_EVIDENCE} SELECT * FROM k")(lambda spark, d: K.evidence_links(*_named(spark, d), "drug_id", "drug_name", "t"))
_wide(
    "mrg_06_evidence_by_title",
    f"{_EVIDENCE}, r AS (SELECT drug_id, k.uid, row_number() OVER (PARTITION BY drug_id ORDER BY by_trial DESC, llm_confidence DESC, k.uid) AS rank FROM k JOIN lw USING (uid)) SELECT drug_id, uid, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8",
)(lambda spark, d: M.evidence(K.evidence_links(*_named(spark, d), "drug_id", "drug_name", "t"), _l(spark, d)).select("drug_id", "uid", "rank"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    p, lit = _named(spark, d)
    found = K.evidence_links(p, lit, "drug_id", "drug_name", "t").join(lit.select("uid", F.col("llm_confidence").alias("confidence"), "modality_list", "target_list"), "uid")
    one = p.select("drug_id", "is_oncology", "modality", "target").distinct()
    return K.cross_check_candidates(one, found, 0.9).select("drug_id", "modality", "target")


_wide(
    "flt_48_cross_check",
    f"""{_EVIDENCE}, e AS (SELECT drug_id, list_distinct(flatten(list(modality_list))) AS mods, list_distinct(flatten(list(target_list))) AS tgts FROM k JOIN lw USING (uid) WHERE llm_confidence >= 0.9 GROUP BY 1),
o AS (SELECT DISTINCT drug_name AS drug_id, modality, target FROM pw WHERE is_oncology)
SELECT drug_id, modality, target FROM o JOIN e USING (drug_id) WHERE target = 'Unknown' OR NOT list_contains(mods, modality) OR NOT list_contains(tgts, target)""",
)(_candidates)
_wide(
    "j_12_first_known_trial",
    """, kn AS (SELECT nct_id, coalesce(string_agg(DISTINCT conference, '/' ORDER BY conference) FILTER (NOT is_pub), '') AS conferences, count(*) FILTER (is_pub) AS n_pub FROM (SELECT unnest(nct_ids) AS nct_id, conference, is_pub FROM lw) GROUP BY 1),
ids AS (SELECT drug_name, nct_id, min(pos) AS pos FROM (SELECT drug_name, unnest(nct_ids) AS nct_id, generate_subscripts(nct_ids, 1) AS pos FROM pw) GROUP BY 1, 2),
r AS (SELECT drug_name, nct_id, conferences, n_pub, row_number() OVER (PARTITION BY drug_name ORDER BY pos, nct_id) AS rn FROM ids JOIN kn USING (nct_id)) SELECT drug_name, nct_id, conferences, n_pub FROM r WHERE rn = 1""",
)(lambda spark, d: K.first_known_trial(_p(spark, d), _l(spark, d), "drug_name"))
_wide(
    "j_16_restored_papers",
    ", q AS (SELECT DISTINCT drug_name, uid FROM (SELECT drug_name, unnest(nct_ids) AS t FROM pw) a JOIN (SELECT uid, unnest(nct_ids) AS t FROM lw WHERE is_pub) b USING (t)), r AS (SELECT *, row_number() OVER (PARTITION BY drug_name ORDER BY uid) AS rn FROM q) SELECT drug_name, string_agg(uid, ',' ORDER BY uid) AS papers FROM r WHERE rn <= 3 GROUP BY 1",
)(lambda spark, d: K.restored_papers(_p(spark, d), _l(spark, d).where("is_pub").select(F.explode("nct_ids").alias("nct_id"), F.col("uid").alias("pmid")), "drug_name").withColumn("papers", F.array_join("papers", ",")))
_wide(
    "j_17_trials_of_papers",
    """, f AS (SELECT DISTINCT uid, nct_id AS t FROM (SELECT uid, 'NCT' || lpad(CAST(length(title) % 7 AS VARCHAR), 8, '0') AS nct_id FROM lw UNION ALL SELECT uid, nct_id FROM lw)),
a AS (SELECT uid, unnest(nct_ids) AS t, generate_subscripts(nct_ids, 1) AS pos FROM lw UNION ALL SELECT uid, t, 9 FROM f), b AS (SELECT uid, t, min(pos) AS pos FROM a GROUP BY 1, 2) SELECT uid, string_agg(t, ',' ORDER BY pos, t) AS nct_ids FROM b GROUP BY 1""",
)(
    lambda spark, d: K.trials_of_papers(
        _l(spark, d), _l(spark, d).select("uid", F.concat(F.lit("NCT"), F.lpad((F.length("title") % 7).cast("string"), 8, "0")).alias("nct_id")).union(_l(spark, d).select("uid", "nct_id"))
    ).withColumn("nct_ids", F.array_join("nct_ids", ","))
)


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/part.parquet").where("p_size < 20").groupBy(F.col("p_brand").alias("old")).agg(F.min("p_name").alias("new"))
    return K.with_default(_p(spark, d).groupBy("target").agg(F.count("*").alias("n")), table, "target", "canonical")


_wide("j_08_canon_with_default", "SELECT target, n, coalesce(new, target) AS canonical FROM (SELECT target, count(*) AS n FROM pw GROUP BY 1) LEFT JOIN (SELECT p_brand AS old, min(p_name) AS new FROM part WHERE p_size < 20 GROUP BY 1) ON target = old")(_renamed)
_FIXES = [("red", {"Brand#1": "Brand#99", "Brand#2": "Brand#98"}), ("re", {"Brand#3": "x"}), ("hot g", {"Brand#3": "Brand#97"})]
_wide(
    "j_22_prefix_fixes",
    """SELECT target, target_pre_manualfix, moa, count(*) AS n FROM (SELECT coalesce(t, target) AS target, CASE WHEN t IS NOT NULL THEN target END AS target_pre_manualfix, CASE WHEN t IS NOT NULL THEN modality || ' targeting ' || t ELSE moa END AS moa
FROM (SELECT *, CASE WHEN drug_name LIKE 'red%' THEN CASE target WHEN 'Brand#1' THEN 'Brand#99' WHEN 'Brand#2' THEN 'Brand#98' END WHEN drug_name LIKE 'hot g%' THEN CASE target WHEN 'Brand#3' THEN 'Brand#97' END END AS t FROM pw)) GROUP BY 1, 2, 3""",
)(lambda spark, d: K.prefix_fixes(_p(spark, d), _FIXES).groupBy("target", "target_pre_manualfix", "moa").agg(F.count("*").alias("n")))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    better = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.concat(F.lit("uid-"), F.col("doc_id").cast("string")).alias("uid")).agg(F.max(F.concat(F.lit(" A better title of "), F.col("source"))).alias("new_title"))
    return K.fixed_titles(_l(spark, d).withColumn("title", F.when(F.col("year") == 2019, F.upper("title")).otherwise(F.col("title"))), better).select("uid", "title")


_wide(
    "j_25_fixed_titles",
    r""", t AS (SELECT uid, conference, CASE WHEN "year" = 2019 THEN upper(replace(title, 'ß', 'SS')) ELSE title END AS t FROM lw), b AS (SELECT uid, t, max(conference) OVER (PARTITION BY uid) AS c FROM t)
SELECT uid, CASE WHEN (regexp_matches(trim(coalesce(t, ''), ' '), '^[0-9]{0,2}[a-z]{2,}[0-9]{6,}|CLINICAL SCIENCE|SYMPOSI|^[A-Z ]{25,}') OR length(trim(coalesce(t, ''), ' ')) > 300 OR length(trim(coalesce(t, ''), ' ')) < 8) AND c IS NOT NULL THEN 'A better title of ' || c ELSE t END AS title FROM b""",
)(_titles)
_wide("j_26_variants", "SELECT upper(company) AS canonical, string_agg(DISTINCT company, ',' ORDER BY company) AS raw FROM pw GROUP BY 1")(
    lambda spark, d: K.variants(_p(spark, d).select(F.col("company").alias("name")), _p(spark, d).select(F.col("company").alias("name"), F.upper("company").alias("canonical")).distinct()).withColumn("raw", F.array_join("raw", ","))
)

# Merges.


def _answers(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").groupBy(F.lower("p_name").alias("name_key"))
    bio = F.array(F.concat(F.lit(" M"), (F.min("p_size") % 3).cast("string")), F.lit(" "))
    return part.agg(F.min("p_type").alias("modality"), F.max("p_brand").alias("target"), bio.alias("biomarkers"), (F.max("p_partkey") % 41 / 40.0).alias("confidence"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = _p(spark, d).withColumnRenamed("biomarkers", "biomarker_list").withColumn("modality", F.when(F.col("modality") == "ECONOMY", "Unknown").otherwise(F.col("modality")))
    return M.merge_models(rows, _answers(spark, d))


_FLAG = "CASE WHEN {0}_rule <> 'Unknown' AND {1} <> 'Unknown' AND NOT {2} AND c >= 0.8 THEN CASE WHEN c >= 0.85 THEN '{0}_conflict_resolved' ELSE '{0}_conflict' END END"
_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')".format
_SAME = f"(contains({_KEY('target_rule')}, {_KEY('atg')}) OR contains({_KEY('atg')}, {_KEY('target_rule')}))"
_MERGED = f""", a AS (SELECT lower(p_name) AS k, min(p_type) AS am, max(p_brand) AS atg, 'M' || (min(p_size) % 3) AS ab, (max(p_partkey) % 41) / 40e0 AS c FROM part GROUP BY 1),
j AS (SELECT *, CASE WHEN modality = 'ECONOMY' THEN 'Unknown' ELSE modality END AS modality_rule, target AS target_rule FROM pw LEFT JOIN a ON lower(drug_name) = k),
m AS (SELECT *, {_FLAG.format("modality", "am", "am = modality_rule")} AS fm, {_FLAG.format("target", "atg", _SAME)} AS ft FROM j),
g AS (SELECT CASE WHEN (modality_rule = 'Unknown' AND c >= 0.6) OR fm LIKE '%resolved' THEN am ELSE modality_rule END AS modality, CASE WHEN (target_rule = 'Unknown' AND c >= 0.6) OR ft LIKE '%resolved' THEN atg ELSE target_rule END AS target,
  modality_rule, target_rule, fm, ft, c, concat_ws(',', fm, ft) AS flags, c >= 0.6 AS add, len(biomarkers) AS nb, array_to_string(CASE WHEN c >= 0.6 THEN list_concat(biomarkers, [ab]) ELSE biomarkers END, ',') AS biomarker_list FROM m)"""
_wide(
    "mrg_01_whole_merge",
    f"""{_MERGED} SELECT modality, target, modality_rule, target_rule, biomarker_list, CASE WHEN (modality_rule = 'Unknown' AND c >= 0.6) OR fm LIKE '%resolved' THEN 'llm' ELSE 'rule' END AS modality_src,
CASE WHEN (target_rule = 'Unknown' AND c >= 0.6) OR ft LIKE '%resolved' THEN 'llm' ELSE 'rule' END AS target_src, CASE WHEN add THEN CASE WHEN nb > 0 THEN 'llm+rule' ELSE 'llm' END ELSE 'rule' END AS biomarker_src, flags,
CASE WHEN target <> 'Unknown' THEN modality || ' targeting ' || target ELSE modality END AS moa, count(*) AS n FROM g GROUP BY ALL""",
)(
    lambda spark, d: _merged(spark, d)
    .groupBy("modality", "target", "modality_rule", "target_rule", F.array_join("biomarker_list", ",").alias("biomarker_list"), "modality_src", "target_src", "biomarker_src", F.array_join("data_flags", ",").alias("flags"), "moa")
    .agg(F.count("*").alias("n"))
)
_COUNTED = ", ".join(
    f"count(*) FILTER ({c}_rule = 'Unknown' AND {c} <> 'Unknown') AS {c}_filled, count(*) FILTER ({f} = '{c}_conflict') AS {c}_conflict, count(*) FILTER ({f} = '{c}_conflict_resolved') AS {c}_conflict_resolved, count(*) FILTER ({c}_rule = 'Unknown') AS {c}_unknown_before, count(*) FILTER ({c} = 'Unknown') AS {c}_unknown_after"
    for c, f in (("modality", "fm"), ("target", "ft"))
)
_wide("agg_46_merge_statistics", f"{_MERGED} SELECT count(*) AS rows, count(c) AS have_llm, {_COUNTED}, count(*) FILTER (add) AS biomarkers_added FROM g")(lambda spark, d: M.merge_statistics(_merged(spark, d)))

# Opportunity and maturity.


def _opportunity_sql(programs: str, records: str) -> str:
    sb = "CASE overall_status WHEN 'RECRUITING' THEN 100 WHEN 'COMPLETED' THEN 115 WHEN 'TERMINATED' THEN 50 ELSE 90 END"
    return f""", b AS (SELECT *, {_PB} AS pb, {sb} AS sw FROM ({programs})),
ev AS (SELECT target, CAST(left(start_date, 4) AS INTEGER) AS y, 1 AS clin, CASE pb WHEN 'P1' THEN 10 WHEN 'P1/2' THEN 15 WHEN 'P2' THEN 20 WHEN 'P2/3' THEN 25 WHEN 'P3' THEN 30 WHEN 'P4' THEN 40 END * sw AS w, {_IDX} AS ix FROM b
  UNION ALL SELECT target, "year", 0, NULL, 0 FROM ({records})),
f AS (SELECT * FROM ev WHERE target NOT IN ('Unknown', 'DNA', 'RNA', 'N/A', 'NONE', '-', '')), m AS (SELECT max(y) AS my FROM f),
a AS (SELECT target, count(*) AS size_total, CAST(sum(clin) AS BIGINT) AS clinical_total, count(*) FILTER (y IN (my, my - 1)) AS recent, count(*) FILTER (y IN (my - 4, my - 3)) AS early,
  any_value(my) - max(y) AS years_stale, sum(w) AS w, max(ix) AS ix, sum(pow(0.5e0, (my - y) / 2e0)) AS dec, count(y) AS dated FROM f, m GROUP BY 1),
o AS (SELECT target, size_total, clinical_total, recent, early, floor((recent + 1e0) / (early + 1e0) * 100e0 + 0.5e0) / 100e0 AS growth_ratio, CAST(coalesce(years_stale, 999) AS INTEGER) AS years_stale,
  CASE WHEN w IS NOT NULL THEN floor(w / 100e0 + 0.5e0) / 10e0 WHEN size_total > clinical_total THEN 0.3e0 ELSE 0e0 END AS clin_maturity,
  CASE WHEN ix > 0 THEN ['P1', 'P1/2', 'P2', 'P2/3', 'P3', 'P4'][ix] WHEN size_total > clinical_total THEN 'Preclinical' ELSE 'NA' END AS max_phase, floor(dec / (dated + 5e0) * 1000e0 + 0.5e0) / 1000e0 AS recency FROM a),
q AS (SELECT *, recent >= 4 AND growth_ratio >= 1.3e0 AND clin_maturity <= 5e0 AS emerging FROM o)"""


_BIO = _opportunity_sql("SELECT unnest(biomarkers) AS target, phase, overall_status, start_date FROM pw", 'SELECT unnest(biomarker_list) AS target, "year" FROM lw')
_wide("agg_30_biomarker_opportunity", f"{_BIO} SELECT * FROM q")(
    lambda spark, d: A.opportunity_rows(_p(spark, d).withColumn("bm", F.explode(F.array_distinct("biomarkers"))), _l(spark, d), entity="bm", lists="biomarker_list")
)
_TGT = _opportunity_sql("SELECT target, phase, overall_status, start_date FROM pw WHERE start_date >= '2000'", "SELECT unnest(target_list) AS target, \"year\" - 20 AS \"year\" FROM lw")
_wide(
    "agg_29_opportunity_table",
    f"""{_TGT},
pr AS (SELECT target, CAST(left(start_date, 4) AS INTEGER) AS y, overall_status AS st, NULL AS pub, CAST([] AS VARCHAR[]) AS mods FROM pw WHERE start_date >= '2000'
  UNION ALL SELECT unnest(list_distinct(target_list)), "year" - 20, NULL, is_pub, modality_list FROM lw),
more AS (SELECT target, count(*) FILTER (st = 'RECRUITING') AS clin_ongoing, count(*) FILTER (st = 'COMPLETED') AS clin_completed, count(*) FILTER (st = 'TERMINATED') AS clin_stopped,
  count(*) FILTER (NOT pub) AS abstract_count, count(*) FILTER (pub) AS pub_count, CAST(len(list_distinct(flatten(list(mods)))) AS INTEGER) AS modalities, max(y) AS last_active FROM pr GROUP BY 1),
yc AS (SELECT target, string_agg(y || ':' || n, ',' ORDER BY y) AS year_counts FROM (SELECT target, y, count(*) AS n FROM pr WHERE y > 0 GROUP BY 1, 2) GROUP BY 1)
SELECT q.*, more.* EXCLUDE (target), coalesce(year_counts, '') AS year_counts FROM q JOIN more USING (target) LEFT JOIN yc USING (target)""",
)(
    lambda spark, d: A.opportunity_table(_p(spark, d).where("start_date >= '2000'"), _l(spark, d).withColumn("year", F.col("year") - 20)).withColumn(
        "year_counts", F.array_join(F.transform(F.map_entries("year_counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    )
)
_BOARD = """SELECT target, recent, size_total, growth_ratio, CAST(row_number() OVER (ORDER BY recent DESC, size_total DESC, target) AS INTEGER) AS place, emerging OR row_number() OVER (ORDER BY size_total DESC, target) <= 6 AS labelled,
CAST(CASE WHEN emerging THEN row_number() OVER (PARTITION BY emerging ORDER BY recent * growth_ratio DESC, target) END AS INTEGER) AS emerging_place FROM q WHERE years_stale <= 5"""
_COLUMNS = ["target", "recent", "size_total", "growth_ratio", "place", "labelled", "emerging_place"]
_wide("qry_14_opportunity_board", f"{_TGT} {_BOARD}")(
    lambda spark, d: P.opportunity_board(A.opportunity_rows(_p(spark, d).where("start_date >= '2000'"), _l(spark, d).withColumn("year", F.col("year") - 20)), labelled=6).select(*_COLUMNS)
)
_wide("qry_15_biomarker_board", f"{_BIO} {_BOARD}")(
    lambda spark, d: P.opportunity_board(A.opportunity_rows(_p(spark, d).withColumn("bm", F.explode(F.array_distinct("biomarkers"))), _l(spark, d), entity="bm", lists="biomarker_list"), labelled=6).select(*_COLUMNS)
)


def _known_drugs(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").where("p_name not like '%rod'")
    return part.groupBy(F.lower(F.trim("p_name")).alias("name_key")).agg(F.min("p_name").alias("drug"), F.max("p_brand").alias("target"))


_KNOWN = ", kd AS (SELECT lower(trim(p_name)) AS nk, min(p_name) AS drug, max(p_brand) AS kt FROM part WHERE p_name NOT LIKE '%rod' GROUP BY 1), pre AS (SELECT * FROM lw WHERE len(phases) = 0), me AS (SELECT uid, unnest(drugs_mentioned) AS m FROM pre)"
_wide("j_07_preclinical_programs", f"{_KNOWN} SELECT DISTINCT kt AS target, lower(drug) AS drug FROM me JOIN kd ON lower(trim(m)) = nk")(lambda spark, d: O.preclinical_programs(_l(spark, d), _known_drugs(spark, d)))
_wide(
    "agg_27_coverage",
    f"""{_KNOWN}, e AS (SELECT pre.uid, count(m) AS mentions, count(nk) AS hits FROM pre LEFT JOIN me USING (uid) LEFT JOIN kd ON lower(trim(m)) = nk GROUP BY 1)
SELECT count(*) AS records, count(*) FILTER (mentions > 0) AS with_drug, count(*) FILTER (hits = 0) AS no_known_drug, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits, CAST(coalesce(sum(mentions - hits), 0) AS BIGINT) AS misses FROM e""",
)(lambda spark, d: O.coverage(_l(spark, d), _known_drugs(spark, d)))
_wide("agg_27_top_misses", f"{_KNOWN} SELECT m AS name, count(*) AS n FROM me WHERE lower(trim(m)) NOT IN (SELECT nk FROM kd) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")(lambda spark, d: O.top_misses(_l(spark, d), _known_drugs(spark, d), 5))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    lit = _l(spark, d)
    rows = O.of_cancer(_p(spark, d), "Basket", "cancer_categories", "cancer_category")
    return O.scored_maturity(rows, O.preclinical_programs(lit, _known_drugs(spark, d)), O.mentions(lit))


_CELLS = ", ".join(f"count(*) FILTER (pb = '{p}') AS {p.replace('/', '_').lower()}_total" for p in A.CLINICAL)
_NAMES = [f"{p.replace('/', '_').lower()}_total" for p in A.CLINICAL]
_MATRIX = f"""{_KNOWN}, b AS (SELECT target, {_PB} AS pb FROM pw WHERE list_contains(cancer_categories, 'Basket')),
c AS (SELECT target, count(*) AS ct, sum(CASE pb WHEN 'P1' THEN 10 WHEN 'P1/2' THEN 15 WHEN 'P2' THEN 20 WHEN 'P2/3' THEN 25 WHEN 'P3' THEN 30 WHEN 'P4' THEN 40 ELSE 0 END) AS w, max({_IDX}) AS ix, {_CELLS} FROM b GROUP BY 1),
z AS (SELECT kt AS target, count(DISTINCT lower(drug)) AS pc FROM me JOIN kd ON lower(trim(m)) = nk GROUP BY 1), mt AS (SELECT t AS target, count(*) AS mentions FROM (SELECT unnest(list_distinct(target_list)) AS t FROM pre) GROUP BY 1),
s AS (SELECT coalesce(c.target, z.target) AS target, coalesce(ct, 0) AS clinical_total, {", ".join(f"coalesce({n}, 0) AS {n}" for n in _NAMES)}, coalesce(pc, 0) AS preclinical, coalesce(ct, 0) + coalesce(pc, 0) AS total_activity,
  (coalesce(w, 0) + coalesce(pc, 0) * 3) / 10e0 AS maturity_score, CASE WHEN ix > 0 THEN ['P1', 'P1/2', 'P2', 'P2/3', 'P3', 'P4'][ix] WHEN pc > 0 THEN 'Preclinical' ELSE 'NA' END AS max_phase FROM c FULL JOIN z ON c.target = z.target),
x AS (SELECT s.*, coalesce(mentions, 0) AS mentions, round_even(preclinical / CAST(total_activity AS DOUBLE), 2) AS emerging_ratio, CAST(row_number() OVER (ORDER BY maturity_score DESC, total_activity DESC, s.target) AS INTEGER) AS place FROM s LEFT JOIN mt ON s.target = mt.target)"""
_wide("agg_26_scored_maturity", f"{_MATRIX} SELECT * FROM x")(_matrix)
_wide(
    "flt_54_cohorts",
    f"""{_MATRIX} SELECT * FROM (SELECT 'established' AS cohort, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS place, target FROM x WHERE place <= 30 AND max_phase IN ('P3', 'P4')) WHERE place <= 10
UNION ALL SELECT * FROM (SELECT 'emerging', CAST(row_number() OVER (ORDER BY preclinical DESC, mentions DESC, target) AS INTEGER) AS r, target FROM x WHERE target <> 'Unknown' AND preclinical >= 3 AND max_phase IN ('Preclinical', 'P1', 'P1/2')) WHERE r <= 15
UNION ALL SELECT * FROM (SELECT 'research_hot', CAST(row_number() OVER (ORDER BY mentions DESC, target) AS INTEGER) AS r, target FROM x WHERE target <> 'Unknown' AND mentions >= 15 AND preclinical <= 2 AND clinical_total <= 3) WHERE r <= 15""",
)(lambda spark, d: O.cohorts(_matrix(spark, d)))
_RESEARCH = """, pre AS (SELECT * FROM lw WHERE len(phases) = 0), e AS (SELECT uid, "year", unnest(list_distinct(target_list)) AS target, companies_normalized AS orgs, modality_list AS mods FROM pre),
wh AS (SELECT target, count(*) AS records, count(*) FILTER ("year" IN (2019, 2020)) AS early, count(*) FILTER ("year" IN (2023, 2024)) AS recent, min("year") AS first_year FROM e GROUP BY 1),
og AS (SELECT target, count(*) AS orgs, count(*) FILTER (r AND NOT f) AS new_orgs FROM (SELECT target, org, bool_or("year" IN (2023, 2024)) AS r, bool_or("year" IN (2019, 2020)) AS f FROM (SELECT target, "year", unnest(orgs) AS org FROM e) GROUP BY 1, 2) GROUP BY 1),
mo AS (SELECT target, count(DISTINCT m) AS modalities FROM (SELECT target, unnest(mods) AS m FROM e) GROUP BY 1),
rs AS (SELECT wh.target, records, early, recent, first_year, coalesce(orgs, 0) AS orgs, coalesce(new_orgs, 0) AS new_orgs, coalesce(modalities, 0) AS modalities FROM wh LEFT JOIN og USING (target) LEFT JOIN mo USING (target))"""
_wide("agg_39_intensity", f"{_RESEARCH} SELECT * FROM rs")(lambda spark, d: O.intensity(_l(spark, d), [2019, 2020], [2023, 2024]))
_SHAPE = f", sh AS (SELECT target, count(*) AS clinical_total, CAST(max({_IDX}) AS INTEGER) AS max_idx FROM (SELECT target, {_PB} AS pb FROM pw WHERE target <> 'Unknown') GROUP BY 1)"
_wide("agg_41_clinical_shape", f"{_SHAPE} SELECT *, CASE WHEN max_idx > 0 THEN ['P1', 'P1/2', 'P2', 'P2/3', 'P3', 'P4'][max_idx] ELSE 'NA' END AS max_phase FROM sh")(lambda spark, d: O.clinical_shape(_p(spark, d)))
_OUT = ["target", "records", "early", "recent", "first_year", "orgs", "new_orgs", "modalities", "clinical_total", "max_idx", "growth_ratio", "emerging", "brand_new", "old_score", "old_preclinical"]
_wide(
    "qry_18_study_rows",
    f"""{_MATRIX.replace("), pre AS", "), pre0 AS").replace("FROM pre)", "FROM pre0)")}{_RESEARCH}{_SHAPE}, y AS (SELECT coalesce(rs.target, sh.target) AS target, coalesce(records, 0) AS records, coalesce(early, 0) AS early, coalesce(recent, 0) AS recent, first_year, coalesce(orgs, 0) AS orgs, coalesce(new_orgs, 0) AS new_orgs,
  coalesce(modalities, 0) AS modalities, coalesce(clinical_total, 0) AS clinical_total, coalesce(max_idx, 0) AS max_idx FROM rs FULL JOIN sh ON rs.target = sh.target),
g AS (SELECT *, floor((recent + 1e0) / (early + 1e0) * 100e0 + 0.5e0) / 100e0 AS growth_ratio FROM y)
SELECT g.target, records, early, recent, first_year, orgs, new_orgs, modalities, g.clinical_total, max_idx, growth_ratio, recent >= 2 AND growth_ratio >= 1.5 AND max_idx <= 6 AS emerging, coalesce(first_year >= 2019, false) AS brand_new,
coalesce(x.maturity_score, 0e0) AS old_score, coalesce(x.preclinical, 0) AS old_preclinical FROM g LEFT JOIN x ON g.target = x.target""",
)(lambda spark, d: O.study_rows(O.intensity(_l(spark, d), [2019, 2020], [2023, 2024]), O.clinical_shape(_p(spark, d)), _matrix(spark, d), 2019, 2, 1.5, 6).select(*_OUT))
def _spelled(spark: SparkSession, d: str) -> DataFrame:
    # equal lists are counted before their names are taken apart and spelled, so that a few rows are
    rows = _p(spark, d).groupBy((F.length("drug_name") % 2 == 0).alias("odd"), "biomarkers").agg(F.count("*").alias("n")).select("odd", F.explode("biomarkers").alias("b"), "n")
    return rows.groupBy(F.when(F.col("odd"), F.regexp_replace("b", "BM", "bm ")).otherwise(F.col("b")).alias("name")).agg(F.sum("n").alias("count"))


_wide(
    "agg_44_biomarker_map",
    """, nm AS (SELECT name, count(*) AS c FROM (SELECT CASE WHEN length(drug_name) % 2 = 0 THEN replace(b, 'BM', 'bm ') ELSE b END AS name FROM (SELECT drug_name, unnest(biomarkers) AS b FROM pw)) GROUP BY 1), ky AS (SELECT *, replace(lower(name), ' ', '') AS k FROM nm),
r AS (SELECT k, name AS canonical, row_number() OVER (PARTITION BY k ORDER BY c DESC, length(name), name DESC) AS rn, sum(c) OVER (PARTITION BY k) AS n FROM ky) SELECT name, canonical FROM ky JOIN r USING (k) WHERE rn = 1 AND n >= 3 AND lower(name) <> lower(canonical)""",
)(lambda spark, d: O.biomarker_map(_spelled(spark, d)))


# News, labels, samples, sinks.


def _posted(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d).withColumns({"first_post": F.col("start_date"), "last_update": F.col("completion_date")})


_wide(
    "agg_36_news_lists",
    """, n AS (SELECT DISTINCT CASE WHEN start_date >= '2001-06-01' THEN 'new' WHEN completion_date >= '2001-06-01' THEN 'updated' END AS kind, nct_id AS nct, drug_name AS drug, company_normalized AS company, target, start_date AS date FROM pw),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY date DESC, nct, drug, company NULLS FIRST, target) AS INTEGER) AS place FROM n WHERE kind IS NOT NULL) SELECT * FROM r WHERE place <= 150""",
)(lambda spark, d: P.news(_posted(spark, d), "2001-06-01"))
_wide("scl_s30_presentation_kind", "SELECT uid, kind FROM lc")(lambda spark, d: _l(spark, d).select("uid", L.presentation_kind(F.col("presentation_type"), F.col("abstract_id"), F.col("conference")).alias("kind")))
_STATUS = "CASE overall_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.STATUS_LABELS.items()) + " ELSE overall_status END"
_wide("scl_s34_status_labels", f"SELECT {_STATUS} AS label, CASE WHEN length(official_title) > 20 THEN left(official_title, 20) || '…' ELSE official_title END AS short, count(*) AS n FROM pw GROUP BY 1, 2")(
    lambda spark, d: _p(spark, d).groupBy(L.status_label(F.col("overall_status")).alias("label"), L.shortened(F.col("official_title")).alias("short")).agg(F.count("*").alias("n"))
)
_wide("prj_07_link_lite", "SELECT uid, CASE WHEN is_pub THEN 'publication' ELSE 'conference' END AS axis, CASE WHEN is_pub THEN journal ELSE conference END AS venue, \"year\" FROM lw")(lambda spark, d: K.link_lite(_l(spark, d)))
_wide("prj_12_table_columns", "SELECT uid, kind, affiliation, country, is_pub FROM lc")(
    lambda spark, d: _l(spark, d).select("uid", L.presentation_kind(F.col("presentation_type"), F.col("abstract_id"), F.col("conference")).alias("kind"), N.institution(F.col("affiliation")).alias("affiliation"), N.country(F.col("country_raw")).alias("country"), "is_pub")
)
_wide("win_03_longest_title", "SELECT name, title FROM (SELECT unnest(drugs_mentioned) AS name, title, uid FROM lw) QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(title) DESC, uid) = 1")(
    lambda spark, d: P.longest_title(_l(spark, d).withColumn("m", F.explode("drugs_mentioned")), F.col("m"))
)


def _bars_sql(n: int) -> str:
    cell = lambda p: f"concat_ws(' / ', CASE WHEN {p}o > 0 THEN '진행' || {p}o END, CASE WHEN {p}c > 0 THEN '완료' || {p}c END, CASE WHEN {p}s > 0 THEN '중단' || {p}s END) AS {p}_cell"
    counts = ", ".join(f"count(*) FILTER (pb = '{b}' AND overall_status = '{s}') AS {b.lower()}{k}" for b in ("P1", "P2", "P3") for k, s in (("o", "RECRUITING"), ("c", "COMPLETED"), ("s", "TERMINATED")))
    return f""", b AS (SELECT *, {_PB} AS pb FROM pw WHERE target <> 'Unknown'), c AS (SELECT target, count(*) AS t, max({_IDX}) AS ix, {counts} FROM b WHERE pb <> 'NA' GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY t DESC, target) AS INTEGER) AS place FROM c), u AS (SELECT *, (SELECT max(t) FROM r) AS big FROM r WHERE place <= {n}),
h AS (SELECT *, ln(1 + t) / ln(1 + big) AS q FROM u)
SELECT target, place, t AS total_activity, floor(log10(t + 1e0) / log10(big + 1e0) * 100e0 * 1000e0 + 0.5e0) / 1000e0 AS bar, printf('#%02x%02x%02x', CAST(floor(255 + q * -218 + 0.5) AS INTEGER), CAST(floor(255 + q * -156 + 0.5) AS INTEGER), CAST(floor(255 + q * -20 + 0.5) AS INTEGER)) AS colour,
{cell("p1")}, {cell("p2")}, {cell("p3")}, ['P1', 'P1/2', 'P2', 'P2/3', 'P3', 'P4'][ix] AS max_phase FROM h"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "target string, drug string")
    return P.maturity_bars(A.maturity_matrix(_p(spark, d), none, F.col("target")), 12)


_wide("qry_12_maturity_bars", _bars_sql(12))(_bars)
_wide("scl_h01_program_id", "SELECT drug_id, count(*) AS n FROM pw GROUP BY 1")(lambda spark, d: _p(spark, d).groupBy("drug_id").agg(F.count("*").alias("n")))


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_rows(_l(spark, d).select("uid"), 20, ["uid"])


query("scl_r01_sample")(_sampled)
_wide("snk_06_lite_programs", "SELECT drug_id, target, array_to_string(biomarkers, ',') AS biomarkers, count(*) AS n FROM pw GROUP BY 1, 2, 3")(
    lambda spark, d: S.lite_programs(_p(spark, d), ["drug_id", "target", "biomarkers"]).groupBy("drug_id", "target", F.array_join("biomarkers", ",").alias("biomarkers")).agg(F.count("*").alias("n"))
)
_wide("str_05_new_items", "SELECT count(*) AS n FROM (SELECT DISTINCT nct_id FROM pw WHERE nct_id NOT IN (SELECT nct_id FROM lw))")(
    lambda spark, d: K.missing_from(_p(spark, d).select("nct_id").distinct(), _l(spark, d), "nct_id").agg(F.count("*").alias("n"))
)
_wide("nrm_01_target_counts", "SELECT target AS name, count(*) AS n FROM pw GROUP BY 1")(lambda spark, d: _p(spark, d).groupBy(X.known(N.target(F.col("target"))).alias("name")).agg(F.count("*").alias("n")))

# Texts: drugs, cancers, sponsors and author keys over whole texts.


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document, with a sentence behind it that names drugs by its id, so that the rules have something to find."""
    docs, k = spark.read.parquet(f"{d}/documents.parquet"), F.col("doc_id")
    said = F.concat_ws(" ", F.lit(" In"), F.upper("lang"), F.lit("Osimertinib"), F.concat(F.lit("ABC-"), (k % 40 + 10).cast("string")), F.lit("PFS-12 osimertinib and"), F.get(F.array(*map(F.lit, ["ALL of", "all of", "NSCLC", "breast"])), (k % 4).cast("int")))
    return docs.withColumn("said", F.concat(F.coalesce("text", F.lit("")), said))


_DOCS = "WITH d AS (SELECT doc_id, source, coalesce(text, '') || concat_ws(' ', ' In', upper(lang), 'Osimertinib', 'ABC-' || (doc_id % 40 + 10), 'PFS-12 osimertinib and', ['ALL of', 'all of', 'NSCLC', 'breast'][doc_id % 4 + 1]) AS said FROM documents)"
_ENDINGS = "|".join(sorted(T.DRUG_ENDINGS, key=len, reverse=True))
query(
    "scl_s12_drugs",
    rf"""{_DOCS}, f AS (SELECT doc_id, list_concat(regexp_extract_all(said, '\b([A-Za-z]{{5,}}(?:{_ENDINGS}))\b', 1), list_filter(regexp_extract_all(said, '\b([A-Z]{{2,5}}-[0-9]{{2,6}}[A-Z]{{0,2}}[0-9]{{0,2}})\b', 1), lambda c: split_part(c, '-', 1) NOT IN ({", ".join(repr(x) for x in T.NO_DRUG)}))) AS xs FROM d)
SELECT doc_id, array_to_string(list_filter(xs, lambda x, i: list_position(list_transform(xs, lambda y: lower(y)), lower(x)) = i)[1:10], ',') AS drugs FROM f""",
    raw=True,
)(lambda spark, d: _documents(spark, d).select("doc_id", F.array_join(T.drugs(F.col("said")), ",").alias("drugs")))


def _cancer_sql(name: str, words: list[str]) -> str:
    quote = lambda w: w.replace("'", "''")
    tests = [f"contains(lower(said), '{quote(w.lower())}')" for w in words if not w.isupper()]
    tests += [f"regexp_matches(said, '(^|[^A-Za-z]){quote(w)}([^A-Za-z]|$)')" for w in words if w.isupper()]
    return f"CASE WHEN {' OR '.join(tests)} THEN '{quote(name)}' END"


query("scl_s09_cancers", f"{_DOCS} SELECT doc_id, array_to_string(list_filter([{', '.join(_cancer_sql(*kv) for kv in D.CANCER.items())}], lambda x: x IS NOT NULL), ',') AS cancers FROM d", raw=True)(
    lambda spark, d: _documents(spark, d).select("doc_id", F.array_join(T.cancers(F.lit(None).cast("string"), F.col("said")), ",").alias("cancers"))
)
query(
    "scl_s16_sponsor",
    r"SELECT s_suppkey, CASE WHEN lower(trim(regexp_replace(trim(raw), '\.+$', ''))) NOT IN ('none', '') THEN trim(regexp_replace(trim(raw), '\.+$', '')) END AS sponsor FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' ' || s_name || ' Inc. .' WHEN 1 THEN 'None.' ELSE s_name || '..' END AS raw FROM supplier)",
    raw=True,
)(
    lambda spark, d: spark.read.parquet(f"{d}/supplier.parquet").select(
        "s_suppkey", T.sponsor(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), "s_name", F.lit(" Inc. ."))).when(F.col("s_suppkey") % 3 == 1, "None.").otherwise(F.concat("s_name", F.lit("..")))).alias("sponsor")
    )
)
query(
    "scl_s14_author_key",
    """SELECT doc_id, trim(regexp_replace(strip_accents(lower(n)), '[^a-z0-9]+', '_', 'g'), '_') || '|' || regexp_replace(left(trim(lower(split_part(source || ' Université, Paris', ',', 1))), 20), '[^a-z0-9]+', '_', 'g') AS key
FROM (SELECT doc_id, source, 'José Ångström-' || coalesce(text, '') AS n FROM documents)""",
    raw=True,
)(
    lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", T.author_key(F.concat(F.lit("José Ångström-"), F.coalesce("text", F.lit(""))), F.concat("source", F.lit(" Université, Paris"))).alias("key")
    )
)
_FOUND = "SELECT 'x' || (p_partkey * 3) AS doi, p_name AS lead, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS lead_affiliation, 'US' AS lead_country FROM part"


def _found(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    affiliation = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand"))
    return part.select(F.concat(F.lit("X"), (F.col("p_partkey") * 3).cast("string")).alias("doi"), F.col("p_name").alias("lead"), affiliation.alias("lead_affiliation"), F.lit("US").alias("lead_country"), F.array(F.lit("Pfizer Inc"), F.lit("x")).alias("institutions"))


def _with_doi(spark: SparkSession, d: str) -> DataFrame:
    return _l(spark, d).withColumn("doi", F.concat(F.lit("x"), F.substring("uid", 5, 18)))


_wide("j_05_authorships", f", f AS ({_FOUND}) SELECT uid, lead, CASE WHEN f.doi IS NOT NULL THEN lead_affiliation ELSE affiliation END AS affiliation, CASE WHEN f.doi IS NOT NULL THEN lead_country ELSE country_raw END AS country_raw, CASE WHEN f.doi IS NOT NULL THEN 'Pfizer' ELSE '' END AS companies FROM lw LEFT JOIN f ON 'x' || substr(uid, 5) = f.doi")(
    lambda spark, d: K.with_authorships(_with_doi(spark, d), _found(spark, d)).select("uid", "lead", "affiliation", "country_raw", F.array_join("companies_normalized", ",").alias("companies"))
)
_wide("j_06_affiliations", f", f AS ({_FOUND}) SELECT uid, coalesce(nullif(lead_affiliation, ''), affiliation) AS affiliation FROM lw LEFT JOIN f ON 'x' || substr(uid, 5) = f.doi")(
    lambda spark, d: K.with_affiliations(_with_doi(spark, d), _found(spark, d)).select("uid", "affiliation")
)


def _papers(spark: SparkSession, d: str) -> DataFrame:
    lit = _l(spark, d)
    title = F.concat(F.lit("Trial of"), F.lower(F.coalesce(F.get("drugs_mentioned", F.lit(0)), F.lit(" none"))), F.lit(" against others"))
    return lit.select(F.explode("nct_ids").alias("nct_id"), F.col("uid").alias("pmid"), title.alias("title"), F.when(F.col("year") == 2019, "Review").otherwise("Article").alias("kind"), F.length("abstract_id").alias("cited"))


_wide(
    "src_09_papers_of_trials",
    """, pa AS (SELECT unnest(nct_ids) AS nct_id, uid AS pmid, 'Trial of' || lower(coalesce(drugs_mentioned[1], ' none')) || ' against others' AS title, length(abstract_id) AS cited FROM lw WHERE "year" <> 2019),
q AS (SELECT DISTINCT a.nct_id, drug_name, pmid, cited FROM (SELECT DISTINCT nct_id, drug_name FROM pw) a JOIN pa USING (nct_id) WHERE contains(title, lower(drug_name))),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY nct_id, drug_name ORDER BY cited DESC, pmid) AS INTEGER) AS rank FROM q) SELECT nct_id, drug_name, rank, pmid FROM r WHERE rank <= 5""",
)(lambda spark, d: K.papers_of_trials(_p(spark, d), _papers(spark, d)))
