"""Programs and literature with the list-valued and derived columns that pages and links need, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.plans.bridge import literature, programs


def _none() -> Column:
    return F.array().cast("array<string>")


def _supplier(k: Column) -> Column:
    return F.concat(F.lit("Supplier#00000000"), k.cast("string"))


def _trial(k: Column) -> Column:
    return F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0"))


def wide_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``programs`` with collaborators, partnership, lists of phases, cancers, trials and combined drugs, titles, code name and id."""
    p, n = programs(spark, sf_dir), F.length("drug_name")
    partners = F.when(F.col("is_combination"), F.array(_supplier(n % 9 + 1))).when(n % 7 == 0, F.array(F.col("company"))).otherwise(_none())
    phases = F.when(F.col("is_oncology").isNull(), F.array(F.lit("UNKNOWN"))).when((F.col("phase") == "PHASE4") & (n % 4 == 0), _none()).otherwise(F.split("phase", "/"))
    return p.withColumns(
        {
            "collaborators": partners,
            "partnership_status": F.when(F.size(partners) > 0, "partnered").otherwise("solo"),
            "phases": phases,
            "cancer_categories": F.when(n % 3 == 0, F.array(F.col("cancer_category"), F.lit("Basket"))).otherwise(_none()),
            "nct_ids": F.array(F.col("nct_id"), _trial(n)),
            "combo_drugs": F.when(F.col("is_combination"), F.array(F.concat("drug_name", F.lit(" plus")))).otherwise(_none()),
            "condition": F.concat("cancer_category", F.lit(" tumour")),
            "official_title": F.concat(F.lit("Trial of "), F.col("drug_name"), F.lit(" in "), F.col("cancer_category")),
            "moa": F.when(F.col("target") == "Unknown", F.col("modality")).otherwise(F.concat_ws(" ", F.col("modality"), F.lit("targeting"), F.col("target"))),
            "code_name": F.concat(F.lit("ABX-"), (F.substring("nct_id", 4, 8).cast("int") % 400 + 1000).cast("string")),
            "drug_id": F.left(F.sha1(F.concat_ws("|", F.lower("drug_name"), F.lower("company"), "phase", "cancer_category")), F.lit(16)),
        }
    )


WIDE_PROGRAMS_SQL = """pw AS (SELECT *, CASE WHEN is_combination THEN ['Supplier#00000000' || (length(drug_name) % 9 + 1)] WHEN length(drug_name) % 7 = 0 THEN [company] ELSE CAST([] AS VARCHAR[]) END collaborators,
  CASE WHEN is_combination OR length(drug_name) % 7 = 0 THEN 'partnered' ELSE 'solo' END partnership_status,
  CASE WHEN is_oncology IS NULL THEN ['UNKNOWN'] WHEN phase = 'PHASE4' AND length(drug_name) % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(phase, '/') END phases,
  CASE WHEN length(drug_name) % 3 = 0 THEN [cancer_category, 'Basket'] ELSE CAST([] AS VARCHAR[]) END cancer_categories,
  [nct_id, 'NCT' || lpad(CAST(length(drug_name) AS VARCHAR), 8, '0')] nct_ids, CASE WHEN is_combination THEN [drug_name || ' plus'] ELSE CAST([] AS VARCHAR[]) END combo_drugs,
  cancer_category || ' tumour' condition, 'Trial of ' || drug_name || ' in ' || cancer_category official_title, CASE WHEN target = 'Unknown' THEN modality ELSE modality || ' targeting ' || target END moa,
  'ABX-' || (CAST(substr(nct_id, 4, 8) AS INTEGER) % 400 + 1000) code_name, left(sha1(lower(drug_name) || '|' || lower(company) || '|' || phase || '|' || cancer_category), 16) drug_id FROM p)"""


def wide_literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``literature`` with lists of cancers, companies, biomarkers, phases, trials and drugs, the first author and the kind of presentation."""
    lit = literature(spark, sf_dir)
    k = F.substring("uid", 5, 18).cast("long")
    text = lambda x: x.cast("string")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) if not isinstance(v, Column) else v for v in values]), (k % n).cast("int"))
    phases = [[], ["PHASE1"], ["PHASE2"], ["PHASE3"], ["PHASE1", "PHASE2"], ["PHASE2", "PHASE3"]]
    bm = lambda n: F.concat(F.lit("BM"), text(k % n))
    drug = F.concat(F.lit(" "), F.get(F.array(*map(F.lit, ["Red", "Blue", "COLD", "hot"])), (k % 4).cast("int")), F.lit(" "), F.get(F.array(*map(F.lit, ["ring", "Bolt", "gear", "rod"])), (k % 7 % 4).cast("int")))
    return lit.withColumns(
        {
            "cancer_list": F.when(k % 4 == 0, F.array(F.col("cancer_category"), F.lit("Other"))).otherwise(F.array("cancer_category")),
            "companies_normalized": F.when(k % 2 == 0, F.array_distinct(F.array(_supplier(k % 9 + 1), _supplier(k % 5 + 1)))).otherwise(_none()),
            "biomarker_list": F.when(k % 3 != 1, F.array_distinct(F.array(bm(7), bm(5)))).otherwise(_none()),
            "phases": F.get(F.array(*[F.array(*map(F.lit, x)) if x else _none() for x in phases]), (k % 6).cast("int")),
            "nct_ids": F.when(k % 9 == 0, F.array(F.col("nct_id"), _trial(k % 50))).otherwise(F.array("nct_id")),
            "drugs_mentioned": F.when(k % 5 == 0, _none()).when(k % 5 == 1, F.array(drug, F.lit("HeLa"))).otherwise(F.array(drug)),
            "affiliation": F.when(k % 13 != 0, F.concat(F.lit("University of N"), text(k % 12))),
            "country_raw": pick(["China.", "CA", "Republic of Korea", "PR", None], 5),
            "presentation_type": pick(["Poster", "e-abstract", "Oral", None, None, None, None], 7),
            "abstract_id": F.concat(pick(["LBA", "TPS", "CT", "SY", "E", "", "LB", "X"], 8), text(k)),
            "is_pub": k % 3 == 0,
            "journal": F.concat(F.lit("Journal "), text(k % 6)),
            "llm_confidence": (k % 10) / F.lit(10.0),
            "code_title": F.concat(F.lit("Study "), text(k % 3), F.lit(" of ABX "), text(k % 400 + 1000), F.lit(" with PD-1 and Lu-177")),
        }
    )


WIDE_LITERATURE_SQL = """lk AS (SELECT *, CAST(substr(uid, 5) AS BIGINT) k FROM l),
lw AS (SELECT * EXCLUDE (k), CASE WHEN k % 4 = 0 THEN [cancer_category, 'Other'] ELSE [cancer_category] END cancer_list,
  CASE WHEN k % 2 <> 0 THEN CAST([] AS VARCHAR[]) WHEN k % 9 = k % 5 THEN ['Supplier#00000000' || (k % 9 + 1)] ELSE ['Supplier#00000000' || (k % 9 + 1), 'Supplier#00000000' || (k % 5 + 1)] END companies_normalized,
  CASE WHEN k % 3 = 1 THEN CAST([] AS VARCHAR[]) WHEN k % 7 = k % 5 THEN ['BM' || (k % 7)] ELSE ['BM' || (k % 7), 'BM' || (k % 5)] END biomarker_list,
  CASE k % 6 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['PHASE1'] WHEN 2 THEN ['PHASE2'] WHEN 3 THEN ['PHASE3'] WHEN 4 THEN ['PHASE1', 'PHASE2'] ELSE ['PHASE2', 'PHASE3'] END phases,
  CASE WHEN k % 9 = 0 THEN [nct_id, 'NCT' || lpad(CAST(k % 50 AS VARCHAR), 8, '0')] ELSE [nct_id] END nct_ids,
  CASE k % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [' ' || ['Red', 'Blue', 'COLD', 'hot'][k % 4 + 1] || ' ' || ['ring', 'Bolt', 'gear', 'rod'][k % 7 % 4 + 1], 'HeLa'] ELSE [' ' || ['Red', 'Blue', 'COLD', 'hot'][k % 4 + 1] || ' ' || ['ring', 'Bolt', 'gear', 'rod'][k % 7 % 4 + 1]] END drugs_mentioned,
  CASE WHEN k % 13 <> 0 THEN 'University of N' || (k % 12) END affiliation, CASE k % 5 WHEN 0 THEN 'China.' WHEN 1 THEN 'CA' WHEN 2 THEN 'Republic of Korea' WHEN 3 THEN 'PR' END country_raw,
  CASE k % 7 WHEN 0 THEN 'Poster' WHEN 1 THEN 'e-abstract' WHEN 2 THEN 'Oral' END presentation_type, ['LBA', 'TPS', 'CT', 'SY', 'E', '', 'LB', 'X'][k % 8 + 1] || k abstract_id,
  k % 3 = 0 is_pub, 'Journal ' || (k % 6) journal, (k % 10) / 10e0 llm_confidence, 'Study ' || (k % 3) || ' of ABX ' || (k % 400 + 1000) || ' with PD-1 and Lu-177' code_title FROM lk),
lc AS (SELECT *, CASE country_raw WHEN 'China.' THEN 'China' WHEN 'CA' THEN 'USA' WHEN 'Republic of Korea' THEN 'South Korea' WHEN 'PR' THEN 'Puerto Rico' END country,
  CASE WHEN presentation_type <> 'e-abstract' THEN presentation_type WHEN abstract_id LIKE 'LB%' THEN 'Late-Breaking' WHEN abstract_id LIKE 'TPS%' THEN 'Trials in Progress' WHEN abstract_id LIKE 'CT%' THEN 'Clinical Trial'
    WHEN abstract_id LIKE 'SY%' THEN 'Symposium' WHEN presentation_type = 'e-abstract' OR (conference = 'ASCO' AND regexp_matches(abstract_id, '^E[0-9]')) THEN 'Online only' WHEN regexp_matches(abstract_id, '^[0-9]') THEN 'Presented' END kind FROM lw)"""
