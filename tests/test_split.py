from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlens.operators import split as S


def labelled(spark, first, n_first, n_second, shift=0):
    """Classes interleaved, with ``first`` appearing first."""
    rows = [(i + shift, first) for i in range(n_first)]
    rows += [(10_000 + i + shift, 1 - first) for i in range(n_second)]
    return spark.createDataFrame(rows, "row_id long, label int")


def test_golden_fold_sizes(spark):
    rows = S.stratified_folds(labelled(spark, 1, 326, 371), 10).collect()
    sizes = Counter(r.fold for r in rows)
    positives = Counter(r.fold for r in rows if r.label == 1)
    assert [sizes[k] for k in range(1, 11)] == [70] * 7 + [69] * 3
    assert [positives[k] for k in range(1, 11)] == [33] * 6 + [32] * 4
    assert len({r.row_id for r in rows}) == 697


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_folds_do_not_depend_on_ranges_or_partitions(spark, digits):
    df = labelled(spark, 0, 150, 77)
    want = {(r.row_id, r.fold) for r in S.stratified_folds(df, 5, 7).collect()}
    got = S.stratified_folds(df.orderBy(F.rand(1)).repartition(6), 5, 7, digits=digits)
    assert {(r.row_id, r.fold) for r in got.collect()} == want


def test_seed_changes_folds(spark):
    df = labelled(spark, 0, 100, 100)
    a, b = ({(r.row_id, r.fold) for r in S.stratified_folds(df, 5, s).collect()} for s in (1, 2))
    assert a != b


def test_golden_holdout(spark):
    rows = S.holdout(labelled(spark, 1, 326, 371)).collect()
    assert Counter(r.split for r in rows) == {"train": 557, "valid": 70, "test": 70}
    assert sum(r.label for r in rows if r.split == "test") == 33


def test_quotas_of_large_classes(spark):
    counts = spark.createDataFrame(
        [(0, 7_000_000_000_001), (1, 3_000_000_000_002)], "label int, n long"
    )
    got = S._quota(counts, "q", F.lit(9_000_000_000_003), "n", F.lit(10_000_000_000_003)).collect()
    assert sum(r.q for r in got) == 9_000_000_000_003


def test_class_weights(spark):
    rows = {r.label: r.weight for r in S.class_weights(labelled(spark, 1, 326, 371)).collect()}
    assert rows[1] == pytest.approx(697 / (2 * 326)) and rows[0] == pytest.approx(697 / (2 * 371))


def test_fold_sides(spark):
    folded = S.stratified_folds(labelled(spark, 1, 30, 30), 5)
    train, valid = S.fold_sides(folded, 2)
    assert (train.count(), valid.count()) == (48, 12)


def test_cuts_are_those_of_a_full_sort(spark):
    """Classes of all sizes, down to those without a test row; repeated ids too."""
    import hashlib

    rows = [(k % 700, 0) for k in range(900)] + [(k, 1) for k in range(900, 937)] + [(999, 2), (1000, 3), (1001, 3)]
    df = spark.createDataFrame(rows, "row_id long, label int").repartition(3)
    got = S.holdout(df, 7)
    assert got.columns == ["row_id", "label", "split"]
    quotas = {r.label: (r.test_n, r.valid_n) for r in S.holdout_quotas(df).collect()}
    for label, (test_n, valid_n) in quotas.items():
        own = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for i, y in rows if y == label)
        at = {}
        for rank, key in enumerate(own, start=1):
            # Rows that repeat an id stay together, on the side of the last cut that holds one.
            at.setdefault(key, "test" if rank <= test_n else "valid" if rank <= test_n + valid_n else "train")
        for r in got.where(F.col("label") == label).collect():
            assert r.split == at[hashlib.md5(f"7:{r.row_id}".encode()).hexdigest(), r.row_id]
    assert got.count() == len(rows)
    assert S.holdout(df.where("false"), 7).count() == 0
