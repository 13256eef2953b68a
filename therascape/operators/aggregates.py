"""Facets, Top-N roll-ups, pivots, trends, summaries, maturity and opportunity as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.functions import dictionaries as D
from therascape.functions import text as X


def counts(df: DataFrame, value: Column) -> DataFrame:
    """(name, count); null and empty read Unknown."""
    return df.groupBy(X.known(value).alias("name")).agg(F.count("*").alias("count"))


def element_counts(df: DataFrame, values: Column, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(name, count) over the elements of an array, duplicates counted; null, empty and excluded ones are left out."""
    out = df.select(F.explode(values).alias("name")).where((F.col("name") != "") & ~F.col("name").isin(list(exclude)))
    return out.groupBy("name").agg(F.count("*").alias("count"))


def all_ranked(counted: DataFrame) -> DataFrame:
    """(name, count, rank): rank by count, then name, of any number of groups.

    Groups are partitioned by ranges of the order; a row's rank is its place in its range and the sizes of the ranges before it, of
    which there are as many as shuffle partitions.  The
    ranged rows are kept in memory or on disk until dropped: the ranges are sampled, and two samples might differ.
    """
    order = [F.desc("count"), F.asc("name")]
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = counted.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).persist()
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("place", place).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("name", "count", (F.col("before") + F.col("place")).cast("long").alias("rank"))


def top_n_other(counted: DataFrame, n: int) -> DataFrame:
    """(rank, name, count, is_other): the n largest and one row "Other (k)" for the k groups behind them, if it counts any.

    With n = 0 all groups stay, ranked.  The top is a limit, and the rest follows from totals, so no task sorts all groups.
    """
    if not n:
        return all_ranked(counted).select(F.col("rank").cast("int").alias("rank"), "name", "count", F.lit(False).alias("is_other"))
    top = counted.orderBy(F.desc("count"), "name").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "name")))
    whole = counted.agg(F.count("*").alias("k"), F.coalesce(F.sum("count"), F.lit(0)).alias("s"))
    head = top.agg(F.count("*").alias("k0"), F.coalesce(F.sum("count"), F.lit(0)).alias("s0"))
    rest = whole.crossJoin(head).where("s > s0").select((F.col("k0") + 1).cast("int").alias("rank"), F.concat(F.lit("Other ("), (F.col("k") - F.col("k0")).cast("string"), F.lit(")")).alias("name"), (F.col("s") - F.col("s0")).alias("count"), F.lit(True).alias("is_other"))
    return ranked.select("rank", "name", "count", F.lit(False).alias("is_other")).unionByName(rest)


def phase_by_status(programs: DataFrame, statuses: list[str]) -> DataFrame:
    """(phase, total, one column a status): joint phases count for both; none reads NA."""
    parts = F.filter(F.split(F.coalesce("phase", F.lit("")), "/"), lambda p: (p != "") & (p != "UNKNOWN"))
    parts = F.when(F.size(parts) == 0, F.array(F.lit("NA"))).otherwise(parts)
    rows = programs.select(F.explode(parts).alias("phase"), F.coalesce(F.nullif("overall_status", F.lit("")), F.lit("UNKNOWN")).alias("status"))
    return rows.groupBy("phase").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def year_by_key(literature: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(year, one column a value, total)."""
    return literature.groupBy("year").agg(*[F.count_if(F.col(key) == v).alias(v) for v in values], F.count("*").alias("total"))


def trend(literature: DataFrame, values: str, k: int) -> DataFrame:
    """(year, name, count): the k most frequent elements (duplicates counted) by year (distinct in a record), zeros filled."""
    top = element_counts(literature, F.col(values)).orderBy(F.desc("count"), "name").limit(k).select("name")
    years = literature.select("year").where("year is not null").distinct()
    seen = literature.select("year", F.explode(F.array_distinct(values)).alias("name")).join(F.broadcast(top), "name", "left_semi").groupBy("year", "name").agg(F.count("*").alias("n"))
    grid = years.crossJoin(F.broadcast(top))  # years by at most k names
    return grid.join(seen, ["year", "name"], "left").select("year", "name", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def program_summary(programs: DataFrame) -> DataFrame:
    """One row: programs, distinct companies and cancers, share with a biomarker in percent."""
    return programs.agg(
        F.count("*").alias("total"),
        F.count_distinct(F.nullif("company", F.lit(""))).alias("companies"),
        F.count_distinct(F.nullif("cancer_category", F.lit(""))).alias("cancers"),
        F.coalesce(F.floor(F.count_if(F.size("biomarkers") > 0) * 100.0 / F.nullif(F.count("*"), F.lit(0)) + 0.5), F.lit(0)).cast("long").alias("biomarker_pct"),
    )


CLINICAL = ["P1", "P1/2", "P2", "P2/3", "P3", "P4"]


def maturity_matrix(programs: DataFrame, preclinical: DataFrame, entity: Column) -> DataFrame:
    """Counts by phase and status for each entity, with distinct preclinical drugs; NA phases and Unknown are left out.

    ``preclinical`` holds (target, drug).  One partially aggregated shuffle a side, joined on the entity.
    """
    cell = lambda p, s: F.count_if((F.col("pb") == p) & (F.col("sb") == s) if s else F.col("pb") == p)
    name = lambda p, s: f"{p.replace('/', '_').lower()}_{s}"
    rows = programs.select(entity.alias("target"), X.phase_bucket(F.col("phase")).alias("pb"), X.status_bucket(F.col("overall_status")).alias("sb")).where("pb <> 'NA' and coalesce(target, 'Unknown') <> 'Unknown'")
    cells = [cell(p, s).alias(name(p, s)) for p in CLINICAL for s in ("ongoing", "completed", "stopped")] + [cell(p, None).alias(name(p, "total")) for p in CLINICAL]
    order = F.max(F.array_position(F.array(*map(F.lit, CLINICAL)), F.col("pb"))).alias("max_idx")
    clinical = rows.groupBy("target").agg(*cells, F.count("*").alias("clinical_total"), order)
    before = preclinical.where("target <> 'Unknown'").groupBy("target").agg(F.count_distinct(F.lower("drug")).alias("preclinical"))
    out = clinical.join(before, "target", "full_outer")
    zero = [c for c in out.columns if c != "target"]
    out = out.select("target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero])
    latest = F.when(F.col("max_idx") > 0, F.element_at(F.array(*map(F.lit, ["Preclinical", *CLINICAL])), (F.col("max_idx") + 1).cast("int"))).when(F.col("preclinical") > 0, "Preclinical").otherwise("NA")
    return out.withColumn("total_activity", F.col("clinical_total") + F.col("preclinical")).withColumn("max_phase", latest).drop("max_idx")


#: How much a program counts by its status.
STATUS_WEIGHT = {"completed": 1.15, "ongoing": 1.0, "unknown": 0.9, "stopped": 0.5}
#: Names that are no target.
NO_TARGET = ["Unknown", "DNA", "RNA", "N/A", "NONE", "-"]
EMERGING = {"min_recent": 4, "min_growth": 1.3, "max_maturity": 5.0}


#: The columns of the board; ``opportunity_table`` has more.
BOARD = ["target", "size_total", "clinical_total", "recent", "early", "growth_ratio", "years_stale", "clin_maturity", "max_phase", "recency", "emerging"]


def opportunity_rows(programs: DataFrame, abstracts: DataFrame, half_life: float = 2.0, smoothing: int = 5, entity: str = "target", lists: str = "target_list") -> DataFrame:
    """Activity, growth, clinical maturity and smoothed recency for each target, or for another ``entity`` (AGG-30)."""
    return opportunity_table(programs, abstracts, half_life, smoothing, entity, lists).select(*BOARD)


def opportunity_accumulators(programs: DataFrame, abstracts: DataFrame, entity: str = "target", lists: str = "target_list") -> DataFrame:
    """(target, y, n, clin, pub, ongoing, completed, stopped, w, wn, idx, kinds): all that is known of a target in a year, over all sources (AGG-29).

    ``programs``: the entity, phase, overall_status, start_date; ``abstracts``: its list, year, and where they are there modality_list and
    is_pub.  Rows of one target and year add up (kinds: unite), so accumulators of parts of the data can be put together in the same way.
    """
    pb, sb = X.phase_bucket(F.col("phase")), X.status_bucket(F.col("overall_status"))
    weight = X.phase_weight(pb) * F.create_map(*[F.lit(x) for kv in STATUS_WEIGHT.items() for x in kv])[sb]
    weight = F.round(weight * 1000).cast("long")  # whole thousandths, so that sums do not depend on their order
    idx = F.array_position(F.array(*map(F.lit, CLINICAL)), pb)
    none = F.lit(None).cast("array<string>")
    status = {s: (sb == s).cast("int") for s in ("ongoing", "completed", "stopped")}
    clin = programs.select(F.col(entity).alias("target"), X.year_of(F.col("start_date")).alias("y"), F.lit(1).alias("clin"), F.lit(0).alias("pub"), *[c.alias(k) for k, c in status.items()], F.when(pb != "NA", weight).alias("w"), idx.alias("idx"), none.alias("kinds"))
    pub = F.coalesce(F.col("is_pub"), F.lit(False)).cast("int") if "is_pub" in abstracts.columns else F.lit(0)
    kinds = F.array_sort(F.filter("modality_list", lambda m: m != "")) if "modality_list" in abstracts.columns else none
    lit = abstracts.select(
        F.explode(F.array_distinct(lists)).alias("target"), F.col("year").alias("y"), F.lit(0).alias("clin"), pub.alias("pub"), *[F.lit(0).alias(k) for k in status], F.lit(None).cast("long").alias("w"), F.lit(0).cast("long").alias("idx"), kinds.alias("kinds")
    )
    events = clin.unionByName(lit).where(F.col("target").isNotNull() & ~F.col("target").isin([*NO_TARGET, ""]))
    sums = [F.sum(c).alias(c) for c in ("clin", "pub", *status, "w")]
    return events.groupBy("target", "y").agg(F.count("*").alias("n"), *sums, F.count("w").alias("wn"), F.max("idx").alias("idx"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))


def opportunity_table(programs: DataFrame, abstracts: DataFrame, half_life: float = 2.0, smoothing: int = 5, entity: str = "target", lists: str = "target_list") -> DataFrame:
    """The whole opportunity row of each target (AGG-29, AGG-31): the board's columns, programs by status, abstracts, papers, modalities, years.

    Both feeds become one table of events that is aggregated by (target, year) first, so a hot target moves a few rows a task; windows,
    growth, recency and the map of years are then read from a row a year, and the latest year of all is a scalar.
    """
    yearly = opportunity_accumulators(programs, abstracts, entity, lists)
    top = yearly.agg(F.max("y").alias("max_year"))
    y, m = F.col("y"), F.col("max_year")
    spread = yearly.crossJoin(F.broadcast(top))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    out = spread.groupBy("target").agg(
        F.sum("n").alias("size_total"),
        F.sum("clin").alias("clinical_total"),
        total((y == m) | (y == m - 1)).alias("recent"),
        total((y == m - 4) | (y == m - 3)).alias("early"),
        F.max("y").alias("last_active"),
        F.max("max_year").alias("max_year"),
        F.sum("w").alias("w"),
        F.sum("wn").alias("wn"),
        F.max("idx").alias("idx"),
        F.sum(F.when(y.isNotNull(), F.col("n") * F.pow(F.lit(0.5), (m - y) / F.lit(half_life)))).alias("decayed"),
        F.sum(F.when(y.isNotNull(), F.col("n"))).alias("dated"),
        *[F.sum(c).alias(f"clin_{c}") for c in ("ongoing", "completed", "stopped")],
        F.sum("pub").alias("pub_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("modalities"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(y > 0, F.struct(y.alias("y"), F.col("n").alias("n")))))).alias("year_counts"),
    )
    research = F.col("size_total") > F.col("clinical_total")
    maturity = F.when(F.col("wn") > 0, F.floor(F.col("w") / 100.0 + 0.5) / 10.0).when(research, F.lit(D.PRECLINICAL_WEIGHT)).otherwise(F.lit(0.0))
    out = out.select(
        "target",
        "size_total",
        F.col("clinical_total").cast("long").alias("clinical_total"),
        "recent",
        "early",
        X.round_half_up((F.col("recent") + 1.0) / (F.col("early") + 1.0), 2).alias("growth_ratio"),
        F.coalesce(F.col("max_year") - F.col("last_active"), F.lit(999)).cast("int").alias("years_stale"),
        maturity.alias("clin_maturity"),
        F.when(F.col("idx") > 0, F.element_at(F.array(*map(F.lit, CLINICAL)), F.greatest(F.col("idx"), F.lit(1)).cast("int"))).when(research, "Preclinical").otherwise("NA").alias("max_phase"),
        F.coalesce(X.round_half_up(F.col("decayed") / (F.col("dated") + F.lit(float(smoothing))), 3), F.lit(0.0)).alias("recency"),
        "clin_ongoing",
        "clin_completed",
        "clin_stopped",
        (F.col("size_total") - F.col("clinical_total") - F.col("pub_count")).alias("abstract_count"),
        "pub_count",
        "modalities",
        "year_counts",
        "last_active",
    )
    rule = (F.col("recent") >= EMERGING["min_recent"]) & (F.col("growth_ratio") >= EMERGING["min_growth"]) & (F.col("clin_maturity") <= EMERGING["max_maturity"])
    return out.withColumn("emerging", rule)


def representatives(programs: DataFrame, keys: list[str], latest: str, tie: list[str]) -> DataFrame:
    """One row a key: the one with the latest date (ties by ``tie``), with the distinct trial ids of its group, sorted."""
    best = F.max_by(F.struct(latest, *tie), F.struct(F.coalesce(F.col(latest), F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tie])).alias("best")
    out = programs.groupBy(*keys).agg(best, F.array_sort(F.collect_set("nct_id")).alias("nct_ids"), F.count("*").alias("n"))
    return out.select(*keys, "best.*", "nct_ids", "n")


def dedup_by_regimen(programs: DataFrame, regimen: list[str], latest: str, tie: list[str], unions: list[str]) -> DataFrame:
    """AGG-40: one row for each drug, company (both by normalised name), phase, cancer and regimen: the one with the latest date (ties by ``tie``).

    ``unions`` are array columns; each becomes the distinct elements of its group, those of the latest row first.
    """
    keyed = programs.withColumns({"name_key": X.collapse(F.lower("drug_name")), "company_key": F.lower(F.trim("company"))})
    no_null = [F.coalesce(F.col(c), F.array().cast(programs.schema[c].dataType)).alias(c) for c in unions]
    keys = ["name_key", "company_key", "phase", "cancer_category", *regimen]
    # whole rows are shuffled, each value once; most regimens have one row, so nothing is gathered before
    dealt = keyed.select(*keys, F.struct(latest, *tie).alias("best"), *no_null).repartition(*keys)
    out = dealt.groupBy(*keys).agg(F.collect_list(F.struct("best", *unions)).alias("rows"))
    rank = lambda r: [F.coalesce(r["best"][c].cast("string"), F.lit("")).alias(f"rank_{k}") for k, c in enumerate([latest, *tie])]
    ranked = F.transform("rows", lambda r: F.struct(*rank(r), *[r[c].alias(c) for c in unions], r["best"].alias("best")))
    out = out.withColumn("rows", F.sort_array(ranked, asc=False)).withColumn("best", F.col("rows")[0]["best"])
    return out.select(*keys, "best.*", *[F.array_distinct(F.flatten(f"rows.{c}")).alias(c) for c in unions], F.size("rows").cast("long").alias("n"))


def format_canon(named: DataFrame) -> DataFrame:
    """(name, canonical) from (name, count): spellings with one format key take the most frequent one, then one with a hyphen, then the shortest."""
    order = F.struct(F.col("count"), F.col("name").contains("-").cast("int"), -F.length("name"), F.col("name"))
    best = named.groupBy(X.format_key(F.col("name")).alias("k")).agg(F.max_by("name", order).alias("canonical"))
    return named.withColumn("k", X.format_key(F.col("name"))).join(best, "k").select("name", "canonical")
