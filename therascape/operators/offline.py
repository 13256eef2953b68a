"""The offline study of one cancer: preclinical programs, maturity with scores, research intensity, entrants, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.functions import dictionaries as D
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.operators import aggregates as A
from therascape.operators.aggregates import CLINICAL, NO_TARGET

#: Phase weights in tenths, so that scores are sums of whole numbers.
_TENTHS = {p: round(10 * w) for p, w in D.PHASE_WEIGHT.items()}


def of_cancer(df: DataFrame, cancer: str, lists: str, one: str) -> DataFrame:
    """FLT-42: rows that bear a cancer in their list, or as their only one where the list is empty."""
    return df.where(F.when(F.coalesce(F.size(lists), F.lit(0)) > 0, F.array_contains(lists, cancer)).otherwise(F.coalesce(F.col(one) == cancer, F.lit(False))))


def without_phase(literature: DataFrame) -> DataFrame:
    """FLT-43: records that name no phase count as preclinical."""
    return literature.where(F.coalesce(F.size("phases"), F.lit(0)) == 0)


def _target(raw: Column) -> Column:
    return F.coalesce(F.nullif(N.target(raw), F.lit("")), F.lit("Unknown"))


def preclinical_programs(literature: DataFrame, known: DataFrame) -> DataFrame:
    """J-07, AGG-27: (target, drug), distinct: the drugs that preclinical records mention and the answers know.

    ``known``: (name_key, drug, target), a row for each lower-cased, trimmed name; mentions it lacks, such as cell lines, fall out.
    """
    named = without_phase(literature).select(F.explode("drugs_mentioned").alias("m")).select(F.lower(F.trim("m")).alias("name_key")).distinct()
    return named.join(known, "name_key").select(_target(F.col("target")).alias("target"), F.lower("drug").alias("drug")).distinct()


def coverage(literature: DataFrame, known: DataFrame) -> DataFrame:
    """AGG-27: one row of what the mentions of preclinical records give: records, those with mentions, with none known, mentions known and not."""
    rows = without_phase(literature).select("uid", F.explode_outer("drugs_mentioned").alias("m")).withColumn("name_key", F.lower(F.trim("m")))
    hit = rows.join(known.select("name_key", F.lit(1).alias("hit")), "name_key", "left")
    each = hit.groupBy("uid").agg(F.count("m").alias("mentions"), F.count("hit").alias("hits"))
    return each.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("mentions") > 0).alias("with_drug"),
        F.count_if(F.col("hits") == 0).alias("no_known_drug"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.col("mentions") - F.col("hits")), F.lit(0)).alias("misses"),
    )


def top_misses(literature: DataFrame, known: DataFrame, k: int = 15) -> DataFrame:
    """AGG-27: (name, n): the k most frequent mentions that the answers do not know."""
    rows = without_phase(literature).select(F.explode("drugs_mentioned").alias("name")).withColumn("name_key", F.lower(F.trim("name")))
    missed = rows.join(known.select("name_key"), "name_key", "left_anti").groupBy("name").agg(F.count("*").alias("n"))
    return missed.orderBy(F.desc("n"), "name").limit(k)


def mentions(literature: DataFrame) -> DataFrame:
    """(target, mentions): preclinical records by each of their targets, Unknown for none."""
    named = F.array_distinct(F.transform("target_list", _target))
    named = F.when(F.coalesce(F.size("target_list"), F.lit(0)) == 0, F.array(F.lit("Unknown"))).otherwise(named)
    return without_phase(literature).select(F.explode(named).alias("target")).groupBy("target").agg(F.count("*").alias("mentions"))


def scored_maturity(programs: DataFrame, preclinical: DataFrame, mentioned: DataFrame) -> DataFrame:
    """AGG-26, SRT-02: a target's programs, phases and score, NA phases and Unknown kept; ``place`` orders by score, then activity, then name.

    The score sums phase weights (whole tenths); the emerging ratio is the preclinical share of the activity.
    """
    pb = X.phase_bucket(F.col("phase"))
    rows = programs.select(_target(F.col("target")).alias("target"), pb.alias("pb"))
    idx = F.array_position(F.array(*map(F.lit, CLINICAL)), F.col("pb"))
    weight = F.coalesce(*[F.when(F.col("pb") == p, F.lit(_TENTHS[p])) for p in CLINICAL], F.lit(0))
    clinical = rows.groupBy("target").agg(F.count("*").alias("clinical_total"), F.sum(weight).alias("w"), F.max(idx).alias("idx"), *[F.count_if(F.col("pb") == p).alias(f"{p.replace('/', '_').lower()}_total") for p in CLINICAL])
    before = preclinical.groupBy("target").agg(F.count_distinct("drug").alias("preclinical"))
    out = clinical.join(before, "target", "full_outer").join(mentioned, "target", "left")
    out = out.fillna(0)
    total = F.col("clinical_total") + F.col("preclinical")
    score = (F.col("w") + F.col("preclinical") * round(10 * D.PRECLINICAL_WEIGHT)) / F.lit(10.0)
    latest = F.when(F.col("idx") > 0, F.get(F.array(*map(F.lit, CLINICAL)), F.col("idx").cast("int") - 1)).when(F.col("preclinical") > 0, "Preclinical").otherwise("NA")
    ratio = F.when(total > 0, F.bround(F.col("preclinical") / total, 2)).otherwise(F.lit(0.0))
    out = out.withColumns({"total_activity": total, "maturity_score": score, "max_phase": latest, "emerging_ratio": ratio})
    place = F.row_number().over(Window.orderBy(F.desc("maturity_score"), F.desc("total_activity"), "target"))  # one row a target
    return out.drop("w", "idx").withColumn("place", place)


def cohorts(matrix: DataFrame, top: int = 30) -> DataFrame:
    """FLT-54: (cohort, place, target): established, emerging and research-hot targets of a scored matrix."""
    named, early = F.col("target") != "Unknown", F.col("max_phase").isin("Preclinical", "P1", "P1/2")
    established = matrix.where(F.col("place") <= top).where(F.col("max_phase").isin("P3", "P4"))
    emerging = matrix.where(named & (F.col("preclinical") >= 3) & early)
    hot = matrix.where(named & (F.col("mentions") >= 15) & (F.col("preclinical") <= 2) & (F.col("clinical_total") <= 3))

    def best(df: DataFrame, name: str, order: list[Column], k: int) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(*order))
        return df.orderBy(*order).limit(k).select(F.lit(name).alias("cohort"), rank.alias("place"), "target")

    return (
        best(established, "established", [F.asc("place")], 10)
        .union(best(emerging, "emerging", [F.desc("preclinical"), F.desc("mentions"), F.asc("target")], 15))
        .union(best(hot, "research_hot", [F.desc("mentions"), F.asc("target")], 15))
    )


def intensity(literature: DataFrame, early: list[int], recent: list[int]) -> DataFrame:
    """AGG-39, WIN-09, SET-03: research on each target in preclinical records: records, organisations, modalities, windows, first year, entrants.

    Entrants are organisations of the recent years that the early ones lack.  Organisations are aggregated by (target, organisation)
    first, so a target moves a row for each of its organisations, not for each record.
    """
    named = F.filter(F.array_distinct(F.transform("target_list", _target)), lambda t: ~t.isin([*NO_TARGET, ""]))
    rows = without_phase(literature).select(F.explode(named).alias("target"), "year", F.col("companies_normalized").alias("orgs"), F.col("modality_list").alias("mods"))
    in_early, in_recent = F.col("year").isin(early), F.col("year").isin(recent)
    whole = rows.groupBy("target").agg(F.count("*").alias("records"), F.count_if(in_early).alias("early"), F.count_if(in_recent).alias("recent"), F.min("year").alias("first_year"))
    of = rows.select("target", F.explode("orgs").alias("org"), in_early.alias("e"), in_recent.alias("r")).where("org <> ''").groupBy("target", "org").agg(F.max("e").alias("e"), F.max("r").alias("r"))
    orgs = of.groupBy("target").agg(F.count("*").alias("orgs"), F.count_if(F.col("r") & ~F.col("e")).alias("new_orgs"))
    mods = rows.select("target", F.explode("mods").alias("m")).where("m <> ''").distinct().groupBy("target").agg(F.count("*").alias("modalities"))
    return whole.join(orgs, "target", "left").join(mods, "target", "left").fillna(0, ["orgs", "new_orgs", "modalities"])


def clinical_shape(programs: DataFrame) -> DataFrame:
    """AGG-41: (target, clinical_total, max_idx, max_phase): programs by target, and the latest phase (0 and NA for none)."""
    idx = F.array_position(F.array(*map(F.lit, CLINICAL)), X.phase_bucket(F.col("phase")))
    rows = programs.select(_target(F.col("target")).alias("target"), idx.alias("i")).where(~F.col("target").isin(NO_TARGET))
    out = rows.groupBy("target").agg(F.count("*").alias("clinical_total"), F.max("i").cast("int").alias("max_idx"))
    return out.withColumn("max_phase", F.coalesce(F.get(F.array(*map(F.lit, CLINICAL)), F.col("max_idx") - 1), F.lit("NA")))


def study_rows(research: DataFrame, shape: DataFrame, matrix: DataFrame, new_since: int, least: int = 8, growth: float = 1.5, latest: int = 2) -> DataFrame:
    """J-18, J-19, AGG-42: research and clinic of each target side by side, with growth, entrants, flags and the scored matrix's figures."""
    both = research.join(shape, "target", "full_outer").fillna(0).fillna("NA")
    first = F.nullif(F.col("first_year"), F.lit(0))
    ratio = X.round_half_up((F.col("recent") + 1.0) / (F.col("early") + 1.0), 2)
    old = matrix.select("target", F.col("maturity_score").alias("old_score"), F.col("preclinical").alias("old_preclinical"))
    out = both.withColumns({"first_year": first, "growth_ratio": ratio})
    flags = {
        "emerging": (F.col("recent") >= least) & (F.col("growth_ratio") >= growth) & (F.col("max_idx") <= latest),
        "brand_new": F.coalesce(F.col("first_year") >= new_since, F.lit(False)),
    }
    return out.withColumns(flags).join(old, "target", "left").fillna(0, ["old_score", "old_preclinical"])


def folded(name: Column, rounds: int = 3) -> Column:
    """The key under which spellings of a biomarker meet: without states at its end, blanks, hyphens, slashes and underscores."""
    return F.regexp_replace(F.lower(N.without_state(F.trim(name), rounds)), r"[\s\-_/]+", "")


def biomarker_map(counted: DataFrame, least: int = 3) -> DataFrame:
    """AGG-44, SNK-10: (name, canonical) from (name, count): spellings with one folded key take the most frequent, then the shortest one.

    Keys that count under ``least`` in all are left out, and so are names that are canonical already.
    """
    keyed = counted.withColumn("key", folded(F.col("name")))
    order = F.struct(F.col("count"), -F.length("name"), F.col("name"))
    best = keyed.groupBy("key").agg(F.max_by("name", order).alias("canonical"), F.sum("count").alias("n")).where(F.col("n") >= least)
    plain = lambda c: F.lower(F.trim(c))
    return keyed.join(best, "key").where(plain("name") != plain("canonical")).select("name", "canonical").distinct()


def target_names(programs: DataFrame, answers: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(name, canonical) of all targets that three sources name: each program and each answer counts, each different name of the abstracts once.

    ``programs`` and ``answers``: target; ``abstracts``: target_list.
    """
    told = abstracts.select(F.explode("target_list").alias("target")).where("target <> ''").distinct()
    names = programs.select("target").unionByName(answers.select("target")).unionByName(told).select(N.target(F.col("target")).alias("name"))
    return A.format_canon(names.where("name <> ''").groupBy("name").agg(F.count("*").alias("count")))


def target_canon(programs: DataFrame, answers: DataFrame, abstracts: DataFrame) -> DataFrame:
    """AGG-45, first half: (raw, canonical) of every target as programs and abstracts write it."""
    told = abstracts.select(F.explode("target_list").alias("raw"))
    raw = programs.select(F.col("target").alias("raw")).unionByName(told).where("raw <> ''").distinct()
    known = target_names(programs, answers, abstracts)
    return raw.withColumn("name", N.target(F.col("raw"))).where("name <> ''").join(known, "name").select("raw", "canonical")


def drug_targets(programs: DataFrame, answers: DataFrame, abstracts: DataFrame) -> DataFrame:
    """AGG-45, second half: (drug, target, shown, modality) of the answers by their drug's key; of several answers to one key the most frequent counts, then the first by name.

    answers: drug (the key, in lower case), target, drug_name, modality; answers without a target are left out.
    """
    known = target_names(programs, answers, abstracts)
    named = answers.withColumn("name", N.target(F.col("target"))).where("name <> '' AND drug <> ''").join(known, "name")
    told = named.select("drug", F.col("canonical").alias("target"), F.coalesce(F.nullif("drug_name", F.lit("")), F.col("drug")).alias("shown"), F.coalesce(F.nullif("modality", F.lit("")), F.lit("Unknown")).alias("modality"))
    often = told.groupBy("drug", "target", "shown", "modality").agg(F.count("*").alias("c"))
    best = F.min_by(F.struct("target", "shown", "modality"), F.struct(-F.col("c"), F.col("target"), F.col("shown"), F.col("modality")))
    return often.groupBy("drug").agg(best.alias("b")).select("drug", "b.*")
