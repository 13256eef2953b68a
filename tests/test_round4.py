"""Cases of the fourth round's findings."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from therascape.functions import normalize as N
from therascape.llm import decontaminate, toxicity
from therascape.llm.features import word_counts
from therascape.operators import dashboards as B
from therascape.sources import store as S


def test_lists_of_biomarkers_are_brought_to_one_form(spark):
    names = ["KRAS  G12C", None, "kras", " ", "Her2-low", "HER2 amplification"]
    one = [r[0] for r in spark.createDataFrame([(x,) for x in names], "x string").select(N.biomarker(F.col("x"))).collect()]
    df = spark.createDataFrame([(names,), ([],), (None,)], "names array<string>")
    assert [r[0] for r in df.select(N.biomarkers(F.col("names"))).collect()] == [list(dict.fromkeys(x for x in one if x is not None)), [], []]
    assert "KRAS" in one


def test_charts_of_normalised_biomarkers(spark):
    df = spark.createDataFrame([(["KRAS  G12C", "KRAS mutation"],), (["KRAS"],), (None,)], "xs array<string>")
    assert [(r.name, r["count"]) for r in B.counted(df, {"c": B.Chart(F.col("xs"), of=N.biomarkers)}).collect()] == [("KRAS", 2)]


def test_lite_programs_with_biomarkers(spark):
    df = spark.createDataFrame([("T", ["KRAS  G12C", None, "KRAS mutation"]), (None, None)], "target string, biomarkers array<string>")
    assert [tuple(r) for r in S.lite_programs(df, ["target", "biomarkers"]).collect()] == [("T", ["KRAS"]), ("Unknown", [])]


def test_shards_are_written_in_small_pieces(spark, tmp_path):
    words = np.random.default_rng(1).integers(97, 123, (1 << 21, 6), np.uint8)
    words[:, 5] = 32
    docs = spark.createDataFrame([(words[k :: 64].tobytes().decode(),) for k in range(64)], "text string").repartition(1)
    files = decontaminate.indexed(docs).inputFiles()
    found = [m for f in files if (m := pq.ParquetFile(f.removeprefix("file:").replace("//", "/")).metadata).num_rows]
    assert sum(m.num_rows for m in found) > 4
    # a reader and its codec hold a row group or a page at a time
    assert all(m.row_group(k).num_rows <= 3 for m in found for k in range(m.num_row_groups))


def test_the_driver_gets_the_fitted_model_alone(spark, monkeypatch):
    rows = [(k, "bad worse word" if k % 2 else "fine good word", k % 2) for k in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, y int").drop("y"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")

    def here(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity.Model, "_descend", here)
    model = toxicity.fit(docs, labels)
    over = lambda t: model.over(*word_counts(t))[0]
    assert over(b"worse bad") > 0.9 and over(b"good fine") < 0.1
    assert toxicity.fit(docs, labels.limit(0)).column is None
