"""Programs and literature derived from the relational tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One program a line item; the joins' sides are pruned to the columns used, and Spark picks each strategy by size."""
    line, order, part, supp, cust = (_t(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier", "customer"))
    df = (
        line.join(order, line.l_orderkey == order.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .join(supp, line.l_suppkey == supp.s_suppkey)
        .join(cust, order.o_custkey == cust.c_custkey)
    )
    phases = ["EARLY_PHASE1", "PHASE1", "PHASE1/PHASE2", "PHASE2", "PHASE2/PHASE3", "PHASE3"]
    phase = F.coalesce(*[F.when(F.col("l_linenumber") == k + 1, F.lit(p)) for k, p in enumerate(phases)], F.lit("PHASE4"))
    status = F.when(F.col("l_returnflag") == "R", "TERMINATED").when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RECRUITING").otherwise("UNKNOWN")
    bm = lambda k: F.concat(F.lit("BM"), (F.col("p_size") % k).cast("string"))
    return df.select(
        F.concat(F.lit("NCT"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("nct_id"),
        F.col("p_name").alias("drug_name"),
        F.col("s_name").alias("company"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("company_normalized"),
        F.col("c_mktsegment").alias("cancer_category"),
        F.col("p_type").alias("modality"),
        F.when(F.col("p_size") == 1, "Unknown").otherwise(F.col("p_brand")).alias("target"),
        F.when(F.col("l_tax") < 0.02, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(bm(7), bm(5)))).alias("biomarkers"),
        phase.alias("phase"),
        status.alias("overall_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("completion_date"),
        (F.col("l_quantity") > 25).alias("is_combination"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("boolean")).otherwise(F.col("l_discount") <= 0.08).alias("is_oncology"),
    )


PROGRAMS_SQL = """p AS (SELECT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') nct_id, p_name drug_name, s_name company,
  CASE WHEN s_acctbal >= 0 THEN s_name END company_normalized, c_mktsegment cancer_category, p_type modality,
  CASE WHEN p_size = 1 THEN 'Unknown' ELSE p_brand END target,
  CASE WHEN l_tax < 0.02 THEN CAST([] AS VARCHAR[]) WHEN p_size % 7 = p_size % 5 THEN ['BM' || (p_size % 7)] ELSE ['BM' || (p_size % 7), 'BM' || (p_size % 5)] END biomarkers,
  CASE l_linenumber WHEN 1 THEN 'EARLY_PHASE1' WHEN 2 THEN 'PHASE1' WHEN 3 THEN 'PHASE1/PHASE2' WHEN 4 THEN 'PHASE2' WHEN 5 THEN 'PHASE2/PHASE3' WHEN 6 THEN 'PHASE3' ELSE 'PHASE4' END phase,
  CASE WHEN l_returnflag = 'R' THEN 'TERMINATED' WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'RECRUITING' ELSE 'UNKNOWN' END overall_status,
  strftime(o_orderdate, '%Y-%m-%d') start_date, strftime(l_shipdate, '%Y-%m-%d') completion_date, l_quantity > 25 is_combination,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_discount <= 0.08 END is_oncology
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document; axes that the table lacks follow from its id."""
    k = F.col("doc_id")
    named = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    return _t(spark, sf_dir, "documents").select(
        F.concat(F.lit("uid-"), k.cast("string")).alias("uid"),
        F.col("source").alias("conference"),
        (F.lit(2018) + k % 8).cast("int").alias("year"),
        F.col("lang").alias("cancer_category"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.array(named("M", 5), named("M", 3)).alias("modality_list"),
        F.array(F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("target_list"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(named("NATION_", 25))).alias("countries"),
        F.when(k % 11 == 0, "embargoed").otherwise("available").alias("status"),
        F.concat(F.lit("Author "), (k % 97).cast("string")).alias("author"),
        F.concat(F.lit("NCT"), F.lpad((k % 500).cast("string"), 8, "0")).alias("nct_id"),
    )


LITERATURE_SQL = """l AS (SELECT 'uid-' || doc_id uid, source conference, CAST(2018 + doc_id % 8 AS INTEGER) "year", lang cancer_category, split_part(text, chr(10), 1) title, text body,
  ['M' || (doc_id % 5), 'M' || (doc_id % 3)] modality_list, ['Brand#' || (doc_id % 25 + 1)] target_list,
  CASE WHEN doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['NATION_' || (doc_id % 25)] END countries,
  CASE WHEN doc_id % 11 = 0 THEN 'embargoed' ELSE 'available' END status, 'Author ' || (doc_id % 97) author, 'NCT' || lpad(CAST(doc_id % 500 AS VARCHAR), 8, '0') nct_id FROM documents)"""
