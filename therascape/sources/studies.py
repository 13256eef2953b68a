"""Trial registry files: nested JSON studies to flat programs (snapshots, deltas, parsing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.functions import drugs
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.operators.merges import moa

#: The fields of a study that are read; the JSON reader skips all others.
STUDY = (
    "protocolSection STRUCT<identificationModule: STRUCT<nctId: STRING, briefTitle: STRING, officialTitle: STRING>, "
    "statusModule: STRUCT<overallStatus: STRING, primaryCompletionDateStruct: STRUCT<date: STRING>, startDateStruct: STRUCT<date: STRING>, "
    "lastUpdatePostDateStruct: STRUCT<date: STRING>, studyFirstPostDateStruct: STRUCT<date: STRING>>, "
    "sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING>, collaborators: ARRAY<STRUCT<name: STRING>>>, "
    "descriptionModule: STRUCT<briefSummary: STRING>, eligibilityModule: STRUCT<eligibilityCriteria: STRING>, "
    "armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<type: STRING, name: STRING, description: STRING>>>, "
    "outcomesModule: STRUCT<primaryOutcomes: ARRAY<STRUCT<measure: STRING>>, secondaryOutcomes: ARRAY<STRUCT<measure: STRING>>>, "
    "conditionsModule: STRUCT<conditions: ARRAY<STRING>>, designModule: STRUCT<phases: ARRAY<STRING>, enrollmentInfo: STRUCT<count: INT>>, "
    "contactsLocationsModule: STRUCT<locations: ARRAY<STRUCT<country: STRING>>>, "
    "referencesModule: STRUCT<references: ARRAY<STRUCT<pmid: STRING, type: STRING, citation: STRING>>>>"
)
# fixed values: kinds of intervention that are drugs, words of conditions that are no cancer
DRUG_KINDS = ["DRUG", "BIOLOGICAL", "COMBINATION_PRODUCT"]
NOT_ONCOLOGY = (
    r"(?iU)\b(pain|nausea|vomit|emesis|mucositis|neutropenia|anemia|anaemia|cachexia|thrombocytopenia|myasthenia|arthritis|infection|hepatitis|fibrosis|diabet|"
    r"obesity|healthy volunteer|fatigue|neuropathy|dermatitis|psoriasis|colitis)\b"
)


def read_studies(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-05: studies of JSON files, either {"studies": [...]} each or (``lines``) one study a line, which alone can be split at scale."""
    if lines:
        return spark.read.schema(STUDY).json(path)
    return spark.read.schema(f"studies ARRAY<STRUCT<{STUDY.replace(' STRUCT', ': STRUCT', 1)}>>").option("multiLine", True).json(path).select(F.explode("studies").alias("s")).select("s.*")


def latest_snapshot(files: DataFrame, column: str = "path", prefix: str = "full_") -> DataFrame:
    """SRC-04: (day): the newest date in names such as full_2024-05-01.json; null if there is none."""
    day = F.regexp_extract(F.col(column), prefix + r"(\d{4}-\d{2}-\d{2})", 1)
    return files.agg(F.max(F.nullif(day, F.lit(""))).alias("day"))


def updated_since(studies: DataFrame, day: str) -> DataFrame:
    """SRC-03: studies updated on a day or later."""
    return studies.where(F.col("protocolSection.statusModule.lastUpdatePostDateStruct.date") >= day)


def _texts(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def references(refs: Column) -> Column:
    """PRJ-10: the papers a study refers to, without background reading, each pmid once; the title is the citation up to its first full stop."""
    kept = F.filter(refs, lambda r: ~r["type"].eqNullSafe("BACKGROUND") & (N.strip(F.coalesce(r["pmid"], F.lit(""))) != ""))
    ids = F.transform(kept, lambda r: N.strip(r["pmid"]))
    once = F.filter(kept, lambda r, i: F.array_position(ids, N.strip(r["pmid"])) == i + 1)
    link = lambda r: F.struct(N.strip(r["pmid"]).alias("pmid"), N.strip(F.split_part(F.coalesce(r["citation"], F.lit("")), F.lit("."), F.lit(1))).alias("title"), F.coalesce(r["type"], F.lit("")).alias("ref_type"))
    return F.coalesce(F.transform(once, link), F.array().cast("array<struct<pmid:string,title:string,ref_type:string>>"))


def to_programs(studies: DataFrame) -> DataFrame:
    """PRJ-01: one program a study; studies without any intervention go.  Missing texts read empty, missing lists empty lists."""
    p = F.col("protocolSection")
    text = lambda *path: F.coalesce(_get(p, *path), F.lit(""))
    names = F.col("__drugs")
    used = F.filter(_get(p, "armsInterventionsModule", "interventions"), lambda i: F.upper(F.coalesce(i["type"], F.lit(""))).isin(DRUG_KINDS))
    every = _get(p, "armsInterventionsModule", "interventions")
    base = studies.withColumn("__used", F.when(F.size(used) > 0, used).otherwise(every)).where(F.size("__used") > 0)
    base = base.withColumn("__drugs", drugs.lead_first(F.transform("__used", lambda i: i["name"])))
    lead = F.get(names, F.lit(0))
    own = F.filter("__used", lambda i: F.lower(drugs.clean_name(F.coalesce(i["name"], F.lit("")))) == F.lower(lead))
    description = F.coalesce(F.nullif(F.get(own, F.lit(0))["description"], F.lit("")), F.array_join(F.transform("__used", lambda i: F.coalesce(i["description"], F.lit(""))), " "))
    conditions, phases = _texts(_get(p, "conditionsModule", "conditions")), _texts(_get(p, "designModule", "phases"))
    categories = F.when(F.size(conditions) == 0, F.array(F.lit("Other"))).otherwise(X.cancer_categories(conditions))
    collaborators = F.coalesce(F.transform(_get(p, "sponsorCollaboratorsModule", "collaborators"), lambda c: F.coalesce(c["name"], F.lit(""))), F.array().cast("array<string>"))
    countries = F.array_distinct(F.transform(F.filter(_get(p, "contactsLocationsModule", "locations"), lambda x: F.coalesce(x["country"], F.lit("")) != ""), lambda x: N.strip(x["country"])))
    summary, sponsor, nct = text("descriptionModule", "briefSummary"), text("sponsorCollaboratorsModule", "leadSponsor", "name"), text("identificationModule", "nctId")
    measures = lambda k: F.coalesce(F.transform(_get(p, "outcomesModule", k), lambda o: F.coalesce(o["measure"], F.lit(""))), F.array().cast("array<string>"))
    out = base.select(
        lead.alias("drug_name"),
        F.slice(names, F.lit(2), F.size(names)).alias("combo_drugs"),
        names.alias("all_drugs"),
        (F.size(names) > 1).alias("is_combination"),
        sponsor.alias("company"),
        F.get(N.companies(sponsor), F.lit(0)).alias("company_normalized"),
        collaborators.alias("collaborators"),
        _texts(countries).alias("countries"),
        F.when(F.size(collaborators) > 0, "partnered").otherwise("solo").alias("partnership_status"),
        F.coalesce(F.get(conditions, F.lit(0)), F.lit("")).alias("condition"),
        conditions.alias("conditions"),
        X.cancer_category(F.coalesce(F.get(conditions, F.lit(0)), F.lit(""))).alias("cancer_category"),
        categories.alias("cancer_categories"),
        F.when(F.size(phases) > 0, F.array_join(phases, "/")).otherwise("UNKNOWN").alias("phase"),
        phases.alias("phases"),
        text("statusModule", "overallStatus").alias("overall_status"),
        text("statusModule", "primaryCompletionDateStruct", "date").alias("primary_completion_date"),
        text("statusModule", "startDateStruct", "date").alias("start_date"),
        text("statusModule", "lastUpdatePostDateStruct", "date").alias("last_update_date"),
        text("statusModule", "studyFirstPostDateStruct", "date").alias("first_post_date"),
        _get(p, "designModule", "enrollmentInfo", "count").alias("enrollment_count"),
        X.modality(F.concat_ws(" ", lead, description)).alias("modality"),
        X.target(F.concat_ws(" ", lead, summary)).alias("target"),
        X.biomarkers(F.concat_ws(" ", text("eligibilityModule", "eligibilityCriteria"), summary)).alias("biomarker_list"),
        F.when(nct != "", F.array(nct)).otherwise(F.array().cast("array<string>")).alias("nct_ids"),
        text("identificationModule", "briefTitle").alias("brief_title"),
        text("identificationModule", "officialTitle").alias("official_title"),
        summary.alias("brief_summary"),
        measures("primaryOutcomes").alias("primary_outcomes"),
        measures("secondaryOutcomes").alias("secondary_outcomes"),
        references(_get(p, "referencesModule", "references")).alias("pubmed_links"),
    )
    oncology = (F.array_join("cancer_categories", "|") != "Other") | ~F.array_join("conditions", " ").rlike(NOT_ONCOLOGY)
    return out.withColumns({"is_oncology": oncology, "biomarker_mentioned": F.size("biomarker_list") > 0, "moa": moa(F.col("modality"), F.col("target"))})


def _get(col: Column, *path: str) -> Column:
    for name in path:
        col = col.getField(name)
    return col
