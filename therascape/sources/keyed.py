"""A table by key that is brought up to date a batch at a time and goes on after any stop (STR-04, SNK-02, SNK-12, J-15).

Rows lie in ``buckets`` by a hash of their key: ``<folder>/data/version=<v>/bucket=<b>``.  A manifest says which version each bucket has; it is
one small file, ``<folder>/manifest/version=<v>``, written after all data of its version.  So a batch writes the buckets that it changes and no
others, readers see all of a batch or nothing, and a batch that stopped between data and manifest leaves the table as it was: the
next one writes the same version over what was left behind.  Older versions stay readable as the copy before each change.

Of rows of one key, old or new, the one of the largest ``order`` columns stays; if these are equal, or there are none, the one with the larger hash of the
whole row, so batches lead to the same table in whatever order or number they come.  Rows that change nothing write nothing: a batch, a restart or a new
checkpoint that brings known rows makes no new version.  One writer at a time; null keys are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class KeyedStore:
    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: str, order: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order or [], buckets
        self.schema = spark.createDataFrame([], schema).schema

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest version, or the given one, and the version of each of its buckets; -1 of an empty store."""
        try:
            found = self.spark.read.schema("made int, buckets int, at map<int,int>").parquet(f"{self.folder}/manifest")
            row = found.where(F.lit(True) if version is None else F.col("made") == version).orderBy(F.desc("made")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        if row is None:
            return -1, {}
        if row.buckets != self.buckets:
            raise ValueError(f"{self.folder} has {row.buckets} buckets, not {self.buckets}")
        return row.made, dict(row["at"])

    def _of(self, at: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its newest version, or of an older one."""
        return self._of(self.manifest(version)[1])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _rank(self, names: list[str]):
        return F.struct(*[F.col(c) for c in self.order], F.xxhash64(*names).alias("hash"))

    def upsert(self, batch: DataFrame) -> list[int]:
        """The batch's rows put in; the buckets that were written."""
        names = self.schema.names
        whole = F.struct(*names)
        new = batch.select(*names).dropna(subset=self.key).groupBy(*self.key).agg(F.max_by(whole, self._rank(names)).alias("new")).select("new.*")
        made, at = self.manifest()
        new = new.withColumn("bucket", self._bucket())
        staged = f"{self.folder}/staged/version={made + 1}"
        # the batch is computed once; only the old rows of its own buckets are read
        new.write.mode("overwrite").parquet(staged)
        new = self.spark.read.schema(new.schema).parquet(staged)
        seen = [r[0] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = self._of(at, seen)
        both = old.select(self._bucket(), whole.alias("r"), F.lit(False).alias("fresh")).unionByName(new.select("bucket", whole.alias("r"), F.lit(True).alias("fresh")))
        best = both.select("bucket", "r", "fresh", *[F.col("r")[k].alias(f"__k{i}") for i, k in enumerate(self.key)], self._of_row(names).alias("rank"))
        # of equal rows the old one counts, so that known rows are no change
        kept = best.groupBy("bucket", *[f"__k{i}" for i in range(len(self.key))]).agg(F.max_by(F.struct("r", "fresh"), F.struct("rank", (~F.col("fresh")).alias("known"))).alias("x"))
        kept = kept.select("bucket", "x.r.*", "x.fresh")
        changed = sorted(r[0] for r in kept.where("fresh").select("bucket").distinct().collect())
        if not changed:
            return []
        version = made + 1
        rows = kept.where(F.col("bucket").isin(changed)).drop("fresh")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={version}")
        self._swap(version, at | dict.fromkeys(changed, version))
        return changed

    def _of_row(self, names: list[str]):
        r = F.col("r")
        return F.struct(*[r[c] for c in self.order], F.xxhash64(*[r[c] for c in names]).alias("hash"))

    def _swap(self, version: int, at: dict[int, int]) -> None:
        one = self.spark.createDataFrame([(version, self.buckets, at)], "made int, buckets int, at map<int,int>")
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def todo(self, candidates: DataFrame, limit: int | None = None) -> DataFrame:
        """J-15: the candidates whose key the newest version lacks, in the order of their keys if only some are wanted."""
        left = candidates.dropna(subset=self.key).join(self.read().select(*self.key), self.key, "left_anti")
        return left.orderBy(*self.key).limit(limit) if limit else left


def fill(store: KeyedStore, candidates: DataFrame, answer: Callable[[DataFrame], DataFrame], limit: int | None = None, error: str = "error") -> list[int]:
    """What is still to be done, answered and put in; answers with an ``error`` are left out, so that the next run asks again."""
    answers = answer(store.todo(candidates, limit))
    return store.upsert(answers.where(F.col(error).isNull()) if error in answers.columns else answers)
