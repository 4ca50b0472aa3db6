"""Joins and pooling with hot keys."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from revlens.operators import insights as I
from revlens.operators import skew as SK


def sizes(rows, on, parts=8):
    dealt = rows.repartition(parts, *on, "_salt").groupBy(F.spark_partition_id().alias("p")).count()
    return [r["count"] for r in dealt.collect()]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """70 % of the rows hold one key, 10 % another one."""
    rows = spark.range(20_000).select(
        F.expr("CASE WHEN id % 10 < 7 THEN 'the' WHEN id % 10 = 7 THEN 'of' ELSE concat('w', id % 997) END").alias("word"),
        F.col("id").alias("row_id"),
    )
    path = str(tmp_path_factory.mktemp("hot") / "rows")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_heavy_keys_are_found(hot):
    heavy = SK.heavy_keys(hot, ["word"], parts=100)
    by_word = {r.word: r.h for r in hot.select("word", F.xxhash64("word").alias("h")).distinct().collect()}
    assert heavy[by_word["the"]] == 70 and heavy[by_word["of"]] == 10
    assert len(heavy) < 10 and sum(heavy.values()) < 200


def test_no_task_holds_twice_the_median(hot):
    plain = hot.withColumn("_salt", F.lit(0))
    assert max(sizes(plain, ["word"])) > 0.7 * 20_000
    heavy = SK.heavy_keys(hot, ["word"], parts=128)
    dealt = sizes(SK.salted(hot, ["word"], F.col("row_id"), heavy), ["word"])
    assert max(dealt) <= 2 * median(dealt)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_are_those_of_a_plain_join(spark, hot, how):
    known = [("the", 1.0), ("of", 2.0), ("of", 2.5), ("w5", 3.0), (None, 9.0), ("unused", 4.0)]
    right = spark.createDataFrame(known, "word string, v double")
    left = hot.unionByName(spark.createDataFrame([(None, -1)], "word string, row_id long"))
    got = SK.skew_join(left, right, ["word"], F.col("row_id"), how=how)
    want = left.join(right, ["word"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    with pytest.raises(ValueError, match="unsupported"):
        SK.skew_join(left, right, ["word"], F.col("row_id"), how="outer")


def test_nothing_heavy_is_a_plain_join(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert SK.heavy_keys(rows, ["k"], parts=100) == {}
    assert SK.heavy_keys(rows.where("false"), ["k"]) == {}
    joined = SK.skew_join(rows, rows.withColumn("v", F.lit(1)), ["k"], F.col("k"))
    assert joined.count() == 1000


def test_collocations_with_one_word_in_most_pairs(spark, scratch):
    texts = [(k % 2, ["hub", f"spoke{k % 400}", "hub", f"rim{k % 350}", f"spoke{k % 400}"]) for k in range(3000)]
    words = spark.createDataFrame(texts, "label int, words array<string>")
    got = {tuple(r[:4]): r.score for r in I.collocations(words, scratch=scratch).collect()}
    from collections import Counter

    pairs, single, total = Counter(), Counter(), Counter()
    for label, tokens in texts:
        pairs.update((label, a, b) for a, b in zip(tokens, tokens[1:]))
        single.update((label, t) for t in tokens)
        total[label] += len(tokens)
    assert set(got) == {(*k, n) for k, n in pairs.items()}
    cells = [
        tuple(map(float, (n, single[k[:2]], single[k[0], k[2]], total[k[0]], got[(*k, n)])))
        for k, n in pairs.items()
    ]
    table = spark.createDataFrame(cells, "a double, b double, c double, d double, got double")
    wrong = table.where(F.abs(I.dunning(F.col("a"), F.col("b"), F.col("c"), F.col("d")) - F.col("got")) > 1e-9)
    assert wrong.count() == 0
    # The pairs of the hub, as the join deals them out.
    rows = scratch.table(spark.createDataFrame([k for k in pairs], "label int, first string, second string"), "p")
    on = ["label", "first"]
    heavy = SK.heavy_keys(rows, on, parts=128)
    assert len(heavy) == 2
    dealt = sizes(SK.salted(rows, on, F.col("second"), heavy), on)
    assert max(dealt) <= 2 * median(dealt)


def test_plan_salts_only_hot_keys(spark, scratch):
    words = spark.createDataFrame([(1, ["a", f"b{k}"]) for k in range(2000)], "label int, words array<string>")
    plan = I.collocations(words, scratch=scratch)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_salt") > 2 and "explode(sequence" in plan
    even = spark.createDataFrame([(1, [f"a{k}", f"b{k}"]) for k in range(2000)], "label int, words array<string>")
    assert "_salt" not in I.collocations(even, scratch=scratch)._jdf.queryExecution().optimizedPlan().toString()
