"""Writing and reading of tables: partitioned literature with a manifest, metadata, CSV, append-if-absent, cached answers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.functions import normalize as N
from therascape.functions import text as X

#: Rows of one written file at most, so that a large conference year becomes many files.
FILE_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only on a local master, where that may be unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder of one's own in the shared one."""
    return f"{shared_dir(spark)}/therascape/{tag}-{uuid.uuid4().hex}"


def lite(literature: DataFrame, keep: list[str]) -> DataFrame:
    """PRJ-05: the kept columns with normalised lists, the first author alone, and whether there is a body."""
    out = literature.withColumn("has_body", F.coalesce(F.col("abstract_text"), F.lit("")) != "") if "abstract_text" in literature.columns else literature.withColumn("has_body", F.lit(False))
    if "biomarker_list" in keep:
        out = out.withColumn("biomarker_list", N.biomarkers(F.col("biomarker_list")))
    if "target_list" in keep:
        out = out.withColumn("target_list", N.targets(F.col("target_list")))
    if "authors" in keep:
        whole = lambda a: a.withField("affiliation", N.institution(a["affiliation"])).withField("affiliations", N._each_once(N.institution)(a["affiliations"]))
        out = out.withColumn("authors", F.transform(F.slice("authors", F.lit(1), F.lit(1)), whole))
    return out.select(*[c for c in keep if c in out.columns and c != "has_body"], "has_body")


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """SNK-04 and SNK-05: Parquet folders by conference and year, or by year."""
    df.write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def manifest(df: DataFrame, by: list[str]) -> DataFrame:
    """AGG-33: the partitions and how many rows each has."""
    return df.groupBy(*by).agg(F.count("*").alias("count"))


def read_partitions(spark: SparkSession, path: str, **values) -> DataFrame:
    """SRC-14: the rows of some partitions; others are not listed into the scan."""
    df = spark.read.parquet(path)
    for name, wanted in values.items():
        df = df.where(F.col(name).isin(wanted if isinstance(wanted, list | tuple | set) else [wanted]))
    return df


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-15: a table with the given schema; empty if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def metadata(programs: DataFrame) -> DataFrame:
    """SNK-03: one row: number of programs and of different companies."""
    return programs.agg(F.count("*").alias("total"), F.count_distinct("company").alias("companies"))


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-07: CSV with a header line in each file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_missing(new: DataFrame, path: str, key: str, by: list[str]) -> None:
    """SNK-11: rows whose key the table lacks are appended to their partitions; of several new rows with one key one stays.

    Only the key column of the table is read, and the join strategy follows the sizes.
    """
    one = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    known = read_or_empty(new.sparkSession, path, f"`{key}` {new.schema[key].dataType.simpleString()}")
    one.join(known.select(key).distinct(), key, "left_anti").write.mode("append").partitionBy(*by).parquet(path)


def cached_answers(raw: DataFrame, answer: str, value: str = "value") -> DataFrame:
    """SRC-13: (key, ...answer fields) of a cache whose rows hold a JSON object from keys to answers; ``answer`` is the answers' DDL."""
    one = raw.select(F.explode(F.from_json(value, f"map<string,struct<{answer}>>")).alias("key", "a"))
    return one.select("key", "a.*")


def lite_programs(programs: DataFrame, keep: list[str]) -> DataFrame:
    """SNK-06: the columns that pages need, with targets and biomarkers in their usual forms."""
    forms = {"target": X.known(N.target(F.col("target"))), "biomarkers": N.biomarkers(F.col("biomarkers"))}
    return programs.select(*[forms[c].alias(c) if c in forms else F.col(c) for c in keep])


def write_snapshot(df: DataFrame, folder: str, day: str, prefix: str = "full_") -> str:
    """SRC-02, SNK-01: a dated JSON snapshot, as ``studies.latest_snapshot`` finds it; returns its path."""
    path = f"{folder}/{prefix}{day}.json"
    df.write.mode("overwrite").json(path)
    return path
