"""Literature in partitions, and the one scan that all views share (SRC-12, SRC-18, FLT-37, J-24, NRM-08)."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.functions import normalize as N
from therascape.operators.filters import LiteratureFilter
from therascape.sources import store as S

#: Axes that choose partitions, and those that only say what is shown.
PARTS = {"conferences": "conference", "years": "year"}
SHOWN = ("show_embargoed", "author_affiliation")


def write_literature(literature: DataFrame, path: str) -> None:
    """The records by conference and year, and beside them how many each has."""
    S.write_partitioned(literature, f"{path}/data", list(PARTS.values()))
    S.manifest(literature, list(PARTS.values())).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def search_active(f: LiteratureFilter) -> bool:
    """FLT-37: something is looked for, beyond a choice of conferences and years; then all years are read."""
    return any(getattr(f, x.name) for x in fields(f) if x.name not in (*PARTS, *SHOWN))


def any_filter(f: LiteratureFilter) -> bool:
    """FLT-37: anything at all is chosen."""
    return search_active(f) or any(getattr(f, name) for name in PARTS)


def read_literature(spark: SparkSession, path: str, f: LiteratureFilter | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """The records that a filter shows, from the partitions that it can be in, with clean biomarkers.

    Chosen conferences and years are predicates of partitions.  Where no year is chosen and nothing is looked for, it is the newest year of the chosen
    conferences, told by a subquery of the manifest that runs before any file is listed.
    """
    f = f or LiteratureFilter()
    data, manifest = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/manifest")
    if f.conferences:
        data, manifest = (x.where(F.col("conference").isin(f.conferences)) for x in (data, manifest))
    if f.years:
        data = data.where(F.col("year").isin([int(y) for y in f.years]))
    elif not search_active(f):
        data = data.where(F.col("year") == manifest.agg(F.max("year")).scalar())
    data = data.where(f.column(data.columns))
    return data if dictionary is None else clean_lists(data, ["uid"], "biomarker_list", dictionary)


def clean_lists(df: DataFrame, key: list[str], column: str, dictionary: DataFrame) -> DataFrame:
    """NRM-08: ``column`` without blocked names, each by its canonical name, once whatever its case, in the order of the list.

    dictionary: (name, canon, blocked), of any size, a row a name in lower case; other names stay as they are, without blanks around.  ``key`` tells the rows of
    ``df`` apart; a null list becomes an empty one.
    """
    known = dictionary.select(F.col("name").alias("__name"), "canon", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    items = df.select(*key, F.posexplode(column).alias("at", "raw")).withColumn("raw", N.strip(F.col("raw"))).where("raw <> ''")
    named = items.join(known, F.lower("raw") == F.col("__name"), "left").where("blocked IS NOT TRUE")
    named = named.withColumn("shown", F.coalesce("canon", "raw"))
    once = named.groupBy(*key, F.lower("shown").alias("low")).agg(F.min(F.struct("at", "shown")).alias("x"))
    lists = once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["shown"]).alias("__clean"))
    clean = F.coalesce("__clean", F.array().cast("array<string>"))
    return df.join(lists, key, "left").withColumn(column, clean).select(*df.columns)
