"""What pages show: option lists, sidebars, literature distributions and summaries, table orders and pages, news."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.functions import labels as L
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.operators import aggregates as A


def _years(date: Column) -> Column:
    """FLT-55: the year of a date, if it is one of 2001 to 2039, as an array of a text."""
    y = F.regexp_extract(F.coalesce(date, F.lit("")), r"^\s*(\d{1,4})", 1).try_cast("int")
    return F.array(F.when(y.between(2001, 2039), y.cast("string")))


def phase_options(phases: Column) -> Column:
    """The phases of one row, NA where it has none but UNKNOWN."""
    named = F.filter(F.coalesce(phases, F.array().cast("array<string>")), lambda p: (p != "") & (p != "UNKNOWN"))
    return F.when(F.size(named) == 0, F.array(F.lit("NA"))).otherwise(named)


def ordered(options: DataFrame, by_count: list[str], fixed: dict[str, list[str]], newest_first: tuple[str, ...] = ()) -> DataFrame:
    """(axis, name, n, place): options in the order of their axis: by count, by a fixed list, or by name.

    An axis holds the distinct values of one column; places are counted axis by axis.
    """
    at = lambda names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("name")), F.lit(0)), F.lit(len(names) + 1))
    rank = reduce(lambda c, kv: c.when(F.col("axis") == kv[0], at(kv[1])), fixed.items(), F.when(F.col("axis").isin(by_count), -F.col("n"))).otherwise(F.lit(0))
    back = F.when(F.col("axis").isin(list(newest_first)), -F.col("name").try_cast("long")).otherwise(F.lit(0))
    order = Window.partitionBy("axis").orderBy(rank, back, "name")
    return options.withColumn("place", F.row_number().over(order))


def program_options(programs: DataFrame) -> DataFrame:
    """AGG-23: (axis, name, n, place): the option lists of the program table; drugs, targets and biomarkers by frequency."""
    one = lambda c: (F.col(c), F.array)
    cancers = F.when(F.size("cancer_categories") > 0, F.col("cancer_categories")).otherwise(F.array("cancer_category"))
    axes = {
        "companies": one("company_normalized"),
        "drugs": one("drug_name"),
        "cancers": (cancers, None),
        "phases": (F.col("phases"), phase_options),
        "modalities": one("modality"),
        "targets": (F.col("target"), lambda t: F.array(F.when(t != "Unknown", t))),
        "biomarkers": (F.col("biomarkers"), None),
        "statuses": one("overall_status"),
        "startYears": (F.col("start_date"), _years),
        "completionYears": (F.col("completion_date"), _years),
    }
    return ordered(_options(programs, axes), ["drugs", "targets", "biomarkers"], {"phases": L.PHASE_ORDER})


def by_own_columns(df: DataFrame, sets: dict[str, list[Column]]) -> DataFrame:
    """(of, x0, x1, ..., n): for each set the distinct values of its columns and how many rows have them; all sets in one pass over the rows.

    What is made of a set's columns is so made once for equal ones.  ``of`` names the set; column k of set s is ``<s>_<k>``, null in rows of other sets.
    """
    names = {s: [f"{s}_{k}" for k in range(len(columns))] for s, columns in sets.items()}
    every = [n for s in sets for n in names[s]]
    ids = {s: sum(1 << (len(every) - 1 - at) for at, n in enumerate(every) if n not in names[s]) for s in sets}
    rows = df.select(*[c.alias(n) for s, columns in sets.items() for n, c in zip(names[s], columns)])
    out = rows.groupingSets([[F.col(n) for n in names[s]] for s in sets], *every).agg(F.count("*").alias("n"), F.grouping_id().alias("id"))
    return out.withColumn("of", F.coalesce(*[F.when(F.col("id") == i, F.lit(s)) for s, i in ids.items()])).drop("id")


def _options(df: DataFrame, axes: dict[str, tuple[Column, Callable[[Column], Column] | None]]) -> DataFrame:
    """(axis, name, n) of all axes in one pass; an axis is a column and what makes an array of values of it (none: it is one)."""
    rows = by_own_columns(df, {a: [column] for a, (column, _) in axes.items()})
    made = reduce(lambda c, kv: c.when(F.col("of") == kv[0], (kv[1][1] or (lambda x: x))(F.col(f"{kv[0]}_0")).cast("array<string>")), axes.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    named = rows.select(F.col("of").alias("axis"), F.explode(made).alias("name"), "n").where("name <> ''")
    return named.groupBy("axis", "name").agg(F.sum("n").alias("n"))


def literature_options(literature: DataFrame) -> DataFrame:
    """AGG-24: (axis, name, n, place): the option lists of the literature table; years newest first, kinds and phases in fixed order."""
    kind = L.presentation_kind(F.col("presentation_type"), F.col("abstract_id"), F.col("conference"))
    phases = F.when(F.size("phases") == 0, F.array(F.lit("NA"))).otherwise(F.col("phases"))
    axes = {
        "conferences": (F.col("conference"), F.array),
        "years": (F.col("year"), lambda y: F.array(y.cast("string"))),
        "phases": (phases, None),
        "modalities": (F.col("modality_list"), None),
        "cancers": (F.col("cancer_list"), None),
        "countries": (F.col("country_raw"), lambda c: F.array(N.country(c))),
        "companies": (F.col("companies_normalized"), None),
        "targets": (F.col("target_list"), lambda ts: F.array_remove(ts, "Unknown")),
        "biomarkers": (F.col("biomarker_list"), None),
        "presentationKinds": (kind, F.array),
    }
    return ordered(_options(literature, axes), [], {"phases": L.PHASE_ORDER, "presentationKinds": L.KINDS}, ("years",))


def global_facets(programs: DataFrame, literature: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """AGG-35: (axis, name, n, place): cancers, modalities and the most frequent targets, biomarkers and companies of all sources.

    Targets and biomarkers are normalised; ``most`` bounds the top lists (a feature of the page: 300, 300 and 500).
    """
    most = most or {"targets": 300, "biomarkers": 300, "companies": 500}
    known = lambda xs: F.array_remove(F.transform(xs, lambda t: F.coalesce(N.target(t), F.lit("Unknown"))), "Unknown")
    cancers = F.when(F.size("cancer_categories") > 0, F.col("cancer_categories")).otherwise(F.array("cancer_category"))
    of_programs = {"cancers": (cancers, None), "modalities": (F.col("modality"), F.array), "targets": (F.col("target"), lambda t: known(F.array(t))), "biomarkers": (F.col("biomarkers"), N.biomarkers), "companies": (F.col("company_normalized"), F.array)}
    of_records = {"cancers": (F.col("cancer_list"), None), "modalities": (F.col("modality_list"), None), "targets": (F.col("target_list"), known), "biomarkers": (F.col("biomarker_list"), N.biomarkers), "companies": (F.col("companies_normalized"), None)}
    both = _options(programs, of_programs).union(_options(literature, of_records)).groupBy("axis", "name").agg(F.sum("n").alias("n"))
    out = ordered(both, list(most), {})
    bound = reduce(lambda c, kv: c.when(F.col("axis") == kv[0], F.lit(kv[1])), most.items(), F.when(F.lit(False), F.lit(0)))
    return out.where(F.col("place") <= F.coalesce(bound, F.col("place")))


def company_sidebar(programs: DataFrame) -> DataFrame:
    """AGG-21: (company, count): a program counts for its sponsor and for each collaborator, for Unknown if it has neither."""
    names = F.filter(F.concat(F.array("company"), F.coalesce("collaborators", F.array().cast("array<string>"))), lambda c: c.isNotNull() & (c != ""))
    return programs.select(F.explode(F.when(F.size(names) == 0, F.array(F.lit("Unknown"))).otherwise(names)).alias("company")).groupBy("company").agg(F.count("*").alias("count"))


def accessor_counts(df: DataFrame, values: Column) -> DataFrame:
    """AGG-03: (name, count) over the elements of an array; a row without any counts as Unknown."""
    named = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return df.select(F.explode(F.when(F.size(named) == 0, F.array(F.lit("Unknown"))).otherwise(named)).alias("name")).groupBy("name").agg(F.count("*").alias("count"))


def scalar_counts(df: DataFrame, value: Column, exclude_unknown: bool = False) -> DataFrame:
    """AGG-10: (name, count); null and empty values, and Unknown if asked, are left out."""
    out = df.select(value.alias("name")).where("name <> ''")
    return (out.where("name <> 'Unknown'") if exclude_unknown else out).groupBy("name").agg(F.count("*").alias("count"))


def phase_label_counts(programs: DataFrame) -> DataFrame:
    """AGG-04, SRT-04: (name, raw, count, place) by joint phase, in the order of phases, unlisted ones last."""
    every = ["EARLY_PHASE1", "PHASE1", "PHASE1/PHASE2", "PHASE2", "PHASE2/PHASE3", "PHASE3", "PHASE4", "NA", "UNKNOWN"]
    counted = programs.groupBy(F.coalesce(F.nullif("phase", F.lit("")), F.lit("UNKNOWN")).alias("raw")).agg(F.count("*").alias("count"))
    return _placed(counted, every)


def _placed(counted: DataFrame, every: list[str]) -> DataFrame:
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, every)), F.col("raw")), F.lit(0)), F.lit(99))
    return counted.select(L.phase_label(F.col("raw")).alias("name"), "raw", "count", at.cast("int").alias("place"))


def literature_phases(literature: DataFrame) -> DataFrame:
    """AGG-15: (name, raw, count, place) by phase of the literature, NA where a record has none."""
    counted = literature.select(F.explode(phase_options(F.col("phases"))).alias("raw")).groupBy("raw").agg(F.count("*").alias("count"))
    return _placed(counted, L.PHASE_ORDER)


def literature_summary(literature: DataFrame) -> DataFrame:
    """AGG-16: one row: records, distinct companies, cancers and conference years, percent with a modality.

    Distinct values are counted over (kind, value) pairs that are made distinct before they meet.
    """
    pair = lambda kind, xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    year = F.when((F.col("conference") != "") & F.col("year").isNotNull(), F.array(F.concat_ws(" ", "conference", "year")))
    pairs = literature.select(F.explode(F.concat(pair("company", F.col("companies_normalized")), pair("cancer", F.col("cancer_list")), pair("dataset", year))).alias("p")).select("p.*").distinct()
    several = pairs.agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in (("company", "companies"), ("cancer", "cancers"), ("dataset", "datasets"))])
    whole = literature.agg(F.count("*").alias("total"), F.count_if(F.size("modality_list") > 0).alias("m"))
    pct = F.coalesce(F.floor(F.col("m") * 100.0 / F.nullif("total", F.lit(0)) + 0.5), F.lit(0)).cast("long")
    return whole.crossJoin(several).select("total", "companies", "cancers", "datasets", pct.alias("therapeutic_pct"))


def biomarker_split(programs: DataFrame, k: int = 5) -> DataFrame:
    """AGG-19, QRY-05: (name, count, share, mentioned, not_mentioned, mentioned_pct): the k most frequent biomarkers, their share of the first one, and how many programs name any."""
    top = A.element_counts(programs, F.col("biomarkers")).orderBy(F.desc("count"), "name").limit(k)
    whole = programs.agg(F.count_if(F.size("biomarkers") > 0).alias("mentioned"), F.count("*").alias("total"))
    best = top.agg(F.max("count").alias("best"))
    pct = lambda a, b: F.floor(F.col(a) * 100.0 / F.nullif(F.col(b), F.lit(0)) + 0.5).cast("long")
    out = top.crossJoin(best).crossJoin(whole)
    return out.select("name", "count", pct("count", "best").alias("share"), "mentioned", (F.col("total") - F.col("mentioned")).alias("not_mentioned"), pct("mentioned", "total").alias("mentioned_pct"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """SRT-05: one page of a sorted table, with each row's place in the whole; pages are counted from 0."""
    first = number * size
    top = df.orderBy(*order).limit(first + size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > first)


def option_search(options: DataFrame, typed: str, most: int = 200) -> DataFrame:
    """FLT-53: the first options that hold what was typed, whatever its case."""
    return options.where(F.contains(F.lower("name"), F.lit(typed.lower()))).orderBy("name").limit(most)


def maturity_bars(matrix: DataFrame, n: int, width: float = 100.0) -> DataFrame:
    """QRY-12, SRT-01: the n targets of most activity, with the place, the length of the bar and the colour and text of its cells."""
    top = matrix.orderBy(F.desc("total_activity"), F.desc("clinical_total"), "target").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("total_activity"), F.desc("clinical_total"), "target"))
    largest = top.agg(F.max("total_activity").alias("largest"))
    out = top.withColumn("place", place).crossJoin(largest)
    cell = lambda p: L.phase_cell(*[F.col(f"{p}_{s}") for s in ("ongoing", "completed", "stopped")])
    length = X.round_half_up(L.log_length(F.col("total_activity"), F.col("largest"), width), 3)
    return out.select("target", "place", "total_activity", length.alias("bar"), L.heat_colour(F.col("total_activity"), F.col("largest")).alias("colour"), *[cell(p).alias(f"{p}_cell") for p in ("p1", "p2", "p3")], "max_phase")


def opportunity_board(rows: DataFrame, most_stale: int = 5, labelled: int = 28) -> DataFrame:
    """QRY-14, FLT-52, SRT-03, SRT-07: targets active of late, with their place by recent activity, the place of emerging ones by recent times growth, and whether the chart labels them."""
    kept = rows.where(F.col("years_stale") <= most_stale)
    by = lambda *order: F.row_number().over(Window.orderBy(*order))
    # one row a target; the places are those of a page that shows all of them
    out = kept.withColumns({"place": by(F.desc("recent"), F.desc("size_total"), "target"), "by_size": by(F.desc("size_total"), "target")})
    lead = F.when(F.col("emerging"), F.row_number().over(Window.partitionBy("emerging").orderBy(F.desc(F.col("recent") * F.col("growth_ratio")), "target")))
    return out.withColumns({"emerging_place": lead, "labelled": F.col("emerging") | (F.col("by_size") <= labelled)}).drop("by_size")


def news(programs: DataFrame, since: str, most: int = 150) -> DataFrame:
    """AGG-36, FLT-44, PRJ-06, SRT-08: (kind, place, nct, drug, company, target, date): the newest new and updated trials since a day.

    ``programs`` have first_post and last_update; a trial first posted since then is new, one updated since then and older is updated.
    """
    first, last = F.coalesce("first_post", F.lit("")), F.coalesce("last_update", F.lit(""))
    kind = F.when(first >= since, "new").when(last >= since, "updated")
    date = F.coalesce(F.nullif("first_post", F.lit("")), F.col("last_update"))
    rows = programs.select(kind.alias("kind"), F.get("nct_ids", F.lit(0)).alias("nct"), F.col("drug_name").alias("drug"), F.col("company_normalized").alias("company"), "target", date.alias("date")).where("kind is not null").distinct()
    order = [F.desc("date"), F.asc("nct"), F.asc("drug"), F.asc_nulls_first("company"), F.asc("target")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("nct", "drug"), F.lit(64)))
    part = salted.withColumn("n", F.row_number().over(Window.partitionBy("kind", "salt").orderBy(*order))).where(F.col("n") <= most)
    return part.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("place") <= most).drop("salt", "n")


def header_totals(manifest: DataFrame) -> DataFrame:
    """AGG-47, AGG-49: one row over a manifest (conference, year, n): records, conferences, the newest year and how many years."""
    return manifest.agg(F.sum("n").alias("total"), F.count_distinct("conference").alias("conferences"), F.max("year").alias("newest"), F.count_distinct("year").alias("years"))


def newest_partitions(literature: DataFrame, manifest: DataFrame, conferences: list[str] | None = None) -> DataFrame:
    """J-24: the records of each chosen conference's newest year; the manifest is small and decides which partitions are read."""
    chosen = manifest.where(F.col("conference").isin(conferences)) if conferences else manifest
    newest = chosen.groupBy("conference").agg(F.max("year").alias("year"))
    return literature.join(newest, ["conference", "year"], "left_semi")


def longest_title(literature: DataFrame, key: Column) -> DataFrame:
    """WIN-03: (name, title): of each name the longest title, the first by uid of equals; null titles count as empty."""
    named = literature.select(key.alias("name"), F.coalesce("title", F.lit("")).alias("title"), "uid").where("name <> ''")
    return named.groupBy("name").agg(F.min_by("title", F.struct(-F.length("title"), F.col("uid"))).alias("title"))


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """SCL-R01: n rows chosen by a seeded hash of their key, the same in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
