"""Pages of registered works as they were fetched: a data source that follows cursors (SRC-06, SRC-08).

Answers are landed as Parquet in one folder a date window, ``<path>/window=<from>_<until>``, a row an answer: ``cursor`` (what was asked for, ``*`` at
first), ``attempt`` and ``body`` (what came back).  Each window is one partition of the scan; its task starts at ``*`` and goes on to the
answer's next cursor, and ends at a page without works, without a next cursor, or with fewer works than a page has.  So pages landed beyond
the end of a list, or by an earlier run with other cursors, are not read.  A page that was cut off or says nothing is taken from its next attempt; if no attempt can be
read, the window ends there (``on_broken`` "stop") or the scan fails ("fail").  A cursor that came before ends the window as well.

Filters by ``window_from`` and ``window_until`` are pushed down: other windows' folders are not opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Works of a full page.
PAGE_ROWS = 500
SCHEMA = "window_from date, window_until date, page int, place int, work string"
_HOLDS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class Window(InputPartition):
    def __init__(self, folder: str, first: date, last: date):
        self.folder, self.first, self.last = folder, first, last


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WorkPagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows, self.on_broken = options["path"].rstrip("/"), int(options.get("pagerows", PAGE_ROWS)), options.get("onbroken", "stop")
        self.wanted: list[tuple[str, type, date]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a window's days are done by choosing folders; all others go back to Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if type(f) in _HOLDS and name in (("window_from",), ("window_until",)) and isinstance(f.value, date):
                self.wanted.append((name[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Window]:
        from pyarrow import fs

        files, root = _files(self.path)
        out = []
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.Directory and info.base_name.startswith("window="):
                first, last = map(date.fromisoformat, info.base_name.removeprefix("window=").split("_"))
                days = {"window_from": first, "window_until": last}
                if all(_HOLDS[kind](days[name], value) for name, kind, value in self.wanted):
                    out.append(Window(info.base_name, first, last))
        return sorted(out, key=lambda w: (w.first, w.last))

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        landed, cursor, page, seen = Landed(f"{self.path}/{partition.folder}"), "*", 0, set()
        while cursor and cursor not in seen:
            seen.add(cursor)
            works, following, tries = None, None, landed.where.get(cursor, [])
            for body in landed.bodies(cursor):
                works, following = _answer(body)
                if works is not None:
                    break
            if works is None and (page == 0 or len(tries)) and self.on_broken == "fail":
                raise ValueError(f"no readable answer to cursor {cursor!r} in {partition.folder}")
            if not works:
                return
            n = len(works)
            yield pa.record_batch(
                {
                    "window_from": pa.array([partition.first] * n, pa.date32()),
                    "window_until": pa.array([partition.last] * n, pa.date32()),
                    "page": pa.array([page] * n, pa.int32()),
                    "place": pa.array(range(n), pa.int32()),
                    "work": pa.array([json.dumps(w, ensure_ascii=False) for w in works], pa.string()),
                }
            )
            if n < self.rows:
                return
            cursor, page = following, page + 1


class Landed:
    """A window's answers: where each one is, and the bodies of one row group at a time.

    Only cursors and attempts are read of all of them.  Answers that were landed in the order of their cursors are then read once.
    """

    def __init__(self, folder: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = _files(folder)
        found = sorted(i.path for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name.endswith(".parquet") and not i.base_name.startswith(("_", ".")))
        self.open = [pq.ParquetFile(files.open_input_file(path)) for path in found]
        self.where: dict[str, list[tuple]] = {}
        for k, f in enumerate(self.open):
            for group in range(f.num_row_groups):
                named = f.read_row_group(group, columns=["cursor", "attempt"])
                for row, (cursor, attempt) in enumerate(zip(named["cursor"].to_pylist(), named["attempt"].to_pylist())):
                    self.where.setdefault(cursor, []).append((attempt, k, group, row))
        self.at, self.held = None, None

    def bodies(self, cursor: str) -> Iterator[str | None]:
        """The answers to a cursor, first attempts first."""
        for _, k, group, row in sorted(self.where.get(cursor, [])):
            if self.at != (k, group):
                self.at, self.held = (k, group), self.open[k].read_row_group(group, columns=["body"])["body"]
            yield self.held[row].as_py()


#: Bytes of a row group of landed answers, as a task holds one.
GROUP_BYTES = 8 << 20


def _answer(body: str | None) -> tuple[list | None, str | None]:
    """The works and the next cursor of an answer; no list if it cannot be read."""
    try:
        said = json.loads(body or "")
    except ValueError:
        return None, None
    said = said.get("message", said) if isinstance(said, dict) else {}
    works = said.get("items")
    return (works if isinstance(works, list) else None), said.get("next-cursor")


class WorkPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "work_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkPagesReader:
        return WorkPagesReader({k.lower(): v for k, v in self.options.items()})


def read_work_pages(spark: SparkSession, path: str, page_rows: int = PAGE_ROWS, on_broken: str = "stop") -> DataFrame:
    """(window_from, window_until, page, place, work): the works of all windows in the order of their pages; ``work`` is JSON."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkPages)
    return spark.read.format("work_pages").option("pageRows", page_rows).option("onBroken", on_broken).load(path)


def land_pages(answers: DataFrame, path: str) -> None:
    """Answers (window_from, window_until, cursor, attempt, body) added to the landing folder, best in the order of their pages."""
    name = F.concat_ws("_", F.col("window_from").cast("string"), F.col("window_until").cast("string"))
    answers.select(name.alias("window"), "cursor", F.col("attempt").cast("int").alias("attempt"), "body").write.mode("append").option("parquet.block.size", GROUP_BYTES).partitionBy("window").parquet(path)


def works_of(pages: DataFrame, fields: str, ids: DataFrame | None = None) -> DataFrame:
    """The works' fields (DDL) beside their place; ``ids`` (DOI) keeps the works of a list, whatever their case."""
    out = pages.select("window_from", "page", "place", F.from_json("work", fields).alias("w")).select("window_from", "page", "place", "w.*")
    if ids is None:
        return out
    wanted = ids.select(F.lower("DOI").alias("__doi")).where("__doi IS NOT NULL").distinct()
    return out.join(wanted, F.lower("DOI") == F.col("__doi"), "left_semi")


def first_seen(rows: DataFrame, key: str | Column) -> DataFrame:
    """Of rows of one key the one on the earliest page; rows without a key go."""
    order = F.struct("window_from", "page", "place")
    of = F.col(key) if isinstance(key, str) else key
    return rows.withColumn("__key", of).where("__key IS NOT NULL").groupBy("__key").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
