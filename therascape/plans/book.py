"""A conference book made of the documents: some boxes a document, a book a source; the same view as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "doc_id"
_FIRST = "split_part(text, chr(10), 1)"
#: Boxes of a document by their order; those that are null are left out.  These expressions are read by Spark and by SQL engines alike.
BOXES = [
    f"CASE WHEN {_K} % 5 = 0 THEN CASE {_K} % 3 WHEN 0 THEN 'LUNG CANCER—NON-SMALL CELL' WHEN 1 THEN 'BREAST CANCER' ELSE 'DEVELOPMENTAL THERAPEUTICS' END END",
    f"CASE {_K} % 9 WHEN 4 THEN concat('Visit meetings.asco.org and search by abstract for the full list', chr(10), 'of authors. May 12, 2026.') WHEN 5 THEN concat(CAST({_K} % 900 AS VARCHAR(9)), 's') END",
    f"CASE WHEN {_K} % 17 = 0 THEN '1000' WHEN {_K} % 7 = 0 THEN concat('LBA', CAST({_K} AS VARCHAR(19))) WHEN {_K} % 11 = 0 THEN concat('TPS', CAST({_K} AS VARCHAR(19))) "
    f"WHEN {_K} < 100 THEN lpad(CAST({_K} AS VARCHAR(19)), 3, '0') ELSE CAST({_K} AS VARCHAR(19)) END",
    f"CASE WHEN {_K} % 13 = 0 THEN 'Notes of the session' WHEN {_K} % 4 = 0 THEN 'Poster Session' WHEN {_K} % 4 = 1 THEN 'ORAL ABSTRACT SESSION' "
    f"WHEN {_K} % 4 = 2 THEN concat('Clinical Science Symposium', chr(10), {_FIRST}) ELSE ' Rapid Oral Abstract Session ' END",
    f"CASE WHEN {_K} % 6 = 0 THEN concat({_FIRST}, '. First Author: Ann Lee, Lab, City, CA') WHEN {_K} % 10 <> 3 THEN {_FIRST} END",
    f"CASE WHEN {_K} % 6 <> 0 AND {_K} % 19 <> 1 THEN concat('First  Author: N', CAST({_K} AS VARCHAR(19)), ' Doe, Insti-', chr(10), ' tute of ', coalesce(source, ''), ', Town, Spain') END",
    f"CASE WHEN {_K} % 4 = 1 THEN concat('The full,  final', chr(10), 'text of this abstract will be available later ', text) WHEN {_K} % 8 = 3 THEN text ELSE concat('Background: ', text) END",
    f"CASE WHEN {_K} % 3 <> 1 THEN concat('Research Sponsor: Acme ', coalesce(lang, ''), '.', chr(10), chr(10), 'Clinical trial information: NCT', lpad(CAST({_K} % 100000000 AS VARCHAR(19)), 8, '0')) END",
]
PLACES = 8


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, place, text): the boxes in reading order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = F.posexplode(F.array(*[F.expr(b) for b in BOXES])).alias("i", "box")
    return docs.select(F.coalesce("source", F.lit("")).alias("book"), "doc_id", made).select("book", (F.col("doc_id") * PLACES + F.col("i")).alias("place"), F.col("box").alias("text")).where("text IS NOT NULL")


BOXES_SQL = "boxes AS (" + " UNION ALL ".join(f"SELECT coalesce(source, '') AS book, doc_id * {PLACES} + {i} AS place, {b} AS text FROM documents" for i, b in enumerate(BOXES)) + ")"
