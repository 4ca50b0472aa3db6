import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.operators import crossval as CV
from revlens.operators import prepare as P
from revlens.operators import scoring as SC
from revlens.settings import CompareOptions
from revlens.streaming import flows


def test_stream_preparation_equals_batch(spark, inputs, tmp_path):
    source = str(tmp_path / "raw")
    inputs.raw.repartition(3).write.parquet(source)
    stream = flows.read_stream(spark, source, inputs.raw.schema, files_per_trigger=1)
    flows.drain(flows.clean_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in P.usable_rows(P.tag_rows(inputs.raw)).collect()}


def test_draining_again_adds_only_new_files(spark, inputs, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("raw", "out", "cp"))
    half = inputs.raw.where("row_id % 2 = 0")
    half.write.parquet(source)
    for rest in (None, inputs.raw.where("row_id % 2 = 1")):
        if rest is not None:
            rest.write.mode("append").parquet(source)
        stream = flows.read_stream(spark, source, inputs.raw.schema)
        flows.drain(flows.clean_stream(stream), out, cp)
    assert spark.read.parquet(out).count() == P.usable_rows(P.tag_rows(inputs.raw)).count()


def test_stream_scores_equal_batch(spark, inputs, tmp_path):
    options = CompareOptions(linear_iterations=5)
    model = CV.fit_final(inputs.prepared, "tfidf", "logistic_regression", options)
    reviews = inputs.table("conversations").select("conv_id", "turn", "text")
    source = str(tmp_path / "reviews")
    reviews.write.parquet(source)
    stream = flows.read_stream(spark, source, reviews.schema)
    flows.drain(flows.score_stream(stream, model), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.conv_id, r.turn): r.p_positif for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.conv_id, r.turn): r.p_positif for r in SC.score_reviews(reviews, model).collect()}
    assert got == pytest.approx(want)


def test_stream_deduplication(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i), t) for i, t in enumerate(["Enak!", "enak", "mahal", "ENAK."])]
    source = str(tmp_path / "raw")
    df = spark.createDataFrame(rows, "row_id long, at timestamp, text string")
    for part in range(4):
        df.where(F.col("row_id") == part).coalesce(1).write.mode("append").parquet(source)
    stream = flows.read_stream(spark, source, df.schema)
    kept = flows.dedupe_stream(flows.digest_stream(stream), "at", "1 hour")
    flows.drain(kept.select("row_id", "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    texts = [r.text.lower().strip("!.") for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(texts) == ["enak", "mahal"]
