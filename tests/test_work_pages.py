import json

import pytest

from therascape.sources import work_pages as W


def page(dois, cursor):
    return json.dumps({"message": {"items": [{"DOI": d, "title": [f"t {d}"]} for d in dois], "next-cursor": cursor}})


def land(spark, path, rows):
    W.land_pages(spark.createDataFrame(rows, "window_from date, window_until date, cursor string, attempt int, body string"), path)


def day(x):
    from datetime import date

    return date.fromisoformat(x)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "x")
    may, june, july = (day("2025-05-01"), day("2025-05-31")), (day("2025-06-01"), day("2025-06-30")), (day("2025-07-01"), day("2025-07-31"))
    land(
        spark,
        path,
        [
            (*may, "*", 1, page(["A", "B", "C"], "c1")),
            (*may, "c1", 1, page(["D", "a", "E"], "c2")[:40]),  # cut off
            (*may, "c1", 2, page(["D", "a", "E"], "c2")),
            (*may, "c2", 1, page(["F"], "c3")),  # short: the list ends
            (*may, "c3", 1, page(["Z1", "Z2", "Z3"], None)),
            (*june, "*", 1, page(["B", "G", "H"], "x")),
            (*june, "x", 1, '{"message": {"items": []}}'),
            (*july, "*", 1, page(["I", "J", "K"], "*")),  # a cursor that came before
        ],
    )
    return path


def test_cursors_are_followed_to_the_first_end(spark, landed):
    rows = W.works_of(W.read_work_pages(spark, landed, 3), "DOI STRING").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.window_from, r.page, r.place)):
        got.setdefault(r.window_from.month, []).append(r.DOI)
    assert got == {5: ["A", "B", "C", "D", "a", "E", "F"], 6: ["B", "G", "H"], 7: ["I", "J", "K"]}


def test_the_first_page_wins_and_lists_keep_their_works(spark, landed):
    from pyspark.sql import functions as F

    works = W.works_of(W.read_work_pages(spark, landed, 3), "DOI STRING, title ARRAY<STRING>")
    one = {r.DOI: (r.window_from.month, r.page, r.place) for r in W.first_seen(works, F.lower("DOI")).collect()}
    assert one["A"] == (5, 0, 0) and "a" not in one and one["B"] == (5, 0, 1) and len(one) == 11
    ids = spark.createDataFrame([("a",), ("K",), (None,), ("none",)], "DOI string")
    assert sorted(r.DOI for r in W.works_of(W.read_work_pages(spark, landed, 3), "DOI STRING", ids).collect()) == ["A", "K", "a"]


def test_days_are_pushed_to_the_windows(spark, landed):
    df = W.read_work_pages(spark, landed, 3).where("window_from >= DATE '2025-06-01' AND window_until < DATE '2025-07-01' AND page = 0")
    (condition,) = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Filter " in x]
    assert "page" in condition and ">=" not in condition and "<" not in condition  # what is left to Spark
    assert df.count() == 3 and df.rdd.getNumPartitions() == 1


def test_a_page_that_cannot_be_read_ends_or_fails(spark, landed, tmp_path):
    june = (day("2025-06-01"), day("2025-06-30"))
    land(spark, f"{tmp_path}/x", [(*june, "*", 1, page(["A", "B"], "n")), (*june, "n", 1, "{"), (*june, "n", 2, None)])
    assert W.read_work_pages(spark, f"{tmp_path}/x", 2).count() == 2
    with pytest.raises(Exception, match="no readable answer to cursor 'n'"):
        W.read_work_pages(spark, f"{tmp_path}/x", 2, "fail").collect()
