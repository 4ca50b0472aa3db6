import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import prepare as P
from revlens.operators.dedupe import first_wins, mark_first
from revlens.sources import readers
from revlens.sources.readers import RAW_SCHEMA

# row_id, sentimen, kategori, stars, perbaikan, textTranslated, text
ROWS = [
    (1, "Positif", "rasa", "5", None, None, "Enak sekali!"),
    (2, "negatif", "rasa", "1", "  ", "enak SEKALI", "x"),  # copy of 1, other label
    (3, "NETRAL", None, "3", "bagus", None, None),
    (4, "campuran", None, "3", "bagus", None, None),
    (5, "Positif", " ka te ", None, None, None, " N/A "),
    (6, "Positif", "", "4", " ", None, None),  # all blank
    (7, "Negatif", "", "4", "123 !!", None, None),  # empty key
    (8, "Positif", "", "4", None, "456", None),  # empty key again
    (9, "Negatif", "", "4", "nan", None, None),
    (10, None, "", "4", "tidak", None, None),
    (11, "Netral", "", "1", "Enak sekali", None, None),  # dropped before it can be a copy
    (12, "Positif", "", "2", None, None, "enak,  sekali"),
]
REASONS = {
    2: "duplicate", 3: "netral", 4: "other_label", 5: "bad_text", 6: "bad_text",
    8: "duplicate", 10: "other_label", 11: "netral", 12: "duplicate",
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, RAW_SCHEMA)


def test_prepared_rows(raw, scratch):
    rows = {r.row_id: r for r in P.prepare(raw, scratch).collect()}
    assert sorted(rows) == [1, 7, 9]
    assert rows[1].text == "Enak sekali!" and rows[1].source_column == "text"
    assert (rows[1].label, rows[1].label_name) == (1, "Positif")
    assert rows[7].source_column == "perbaikan"
    assert rows[9].text == "nan"


def test_drop_reasons(raw, scratch):
    got = {r.row_id: r.drop_reason for r in P.drop_reasons(raw, scratch).collect()}
    assert got == {i: REASONS.get(i) for i in range(1, 13)}


def test_summary_adds_up(raw):
    s = P.summarize(P.tag_rows(raw)).first().asDict()
    assert s == {
        "original_rows": 12, "dropped_netral": 2, "dropped_other_label": 2, "dropped_bad_text": 2,
        "dropped_duplicates": 3, "kept_rows": 3, "negatif": 2, "positif": 1,
    }
    kept = P.summarize(P.tag_rows(raw), dedupe=False).first()
    assert (kept.dropped_duplicates, kept.kept_rows, kept.negatif, kept.positif) == (0, 6, 3, 3)


def test_blank_source_column(raw):
    row = P.choose_text(raw).where("row_id = 6").first()
    assert row.source_column == "text"


def test_missing_text_columns(spark, scratch):
    raw = spark.createDataFrame([(1, "positif", "enak")], "row_id long, sentimen string, text string")
    row = P.prepare(raw, scratch).first()
    assert (row.text, row.kategori, row.stars) == ("enak", "", "")


def test_no_rows(raw, scratch):
    none = raw.where("row_id < 0")
    assert P.prepare(none, scratch).count() == 0
    assert P.summarize(P.tag_rows(none)).first().kept_rows == 0


def test_input_order_does_not_matter(spark, inputs, scratch):
    raw = inputs.raw
    shuffled = raw.orderBy(F.rand(3)).repartition(7)
    a = {tuple(r) for r in P.prepare(raw, scratch).collect()}
    assert a == {tuple(r) for r in P.prepare(shuffled, scratch).collect()}


@pytest.mark.parametrize("broadcast_keys", [1, 5, 1000])
def test_dedupe_with_hot_keys(spark, scratch, broadcast_keys):
    """A third of all rows has one key, and the broadcast bound is passed."""
    rng = random.Random(5)
    keys = ["hot"] * 400 + [f"k{rng.randrange(60)}" for _ in range(600)] + [f"u{i}" for i in range(200)]
    rng.shuffle(keys)
    data = list(enumerate(keys)) + [(5000 + i, None) for i in range(50)]
    rows = spark.createDataFrame(data, "row_id long, key string").withColumn(
        "digest", F.encode("key", "UTF-8")
    ).repartition(5)
    first = {}
    for i, k in data:
        if k is not None:
            first.setdefault(k, i)
    kept = first_wins(rows, "digest", "row_id", scratch, broadcast_keys).collect()
    assert sorted(r.row_id for r in kept) == sorted([*first.values(), *range(5000, 5050)])
    marked = mark_first(rows, "digest", "row_id", scratch, broadcast_keys).collect()
    assert len(marked) == len(data)
    assert {r.row_id for r in marked if r.is_first} == {r.row_id for r in kept}


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 1)], "text string, label int")
    with pytest.raises(ValueError, match="label_name"):
        readers.labelled(df)


def test_labelled(spark):
    df = spark.createDataFrame(
        [(" a ", "1", "POSITIF"), ("b", "0", "negatif"), ("c", "1", "Netral"), ("  ", "1", "Positif"), (None, "0", "Negatif")],
        "text string, label string, label_name string",
    )
    rows = {(r.text, r.label, r.label_name) for r in readers.labelled(df).collect()}
    assert rows == {("a", 1, "Positif"), ("b", 0, "Negatif")}


def test_raw_formats(spark, raw, tmp_path):
    want = {tuple(r) for r in raw.collect()}
    raw.write.json(str(tmp_path / "json"))
    raw.write.parquet(str(tmp_path / "parquet"))
    for fmt in ("json", "parquet"):
        schema = RAW_SCHEMA if fmt == "json" else None
        got = readers.read_raw(spark, str(tmp_path / fmt), fmt, schema)
        assert {tuple(r) for r in got.collect()} == want
    messy = raw.where("row_id = 1").withColumnRenamed("text", " text ")
    messy.write.option("header", True).csv(str(tmp_path / "csv"))
    back = readers.read_raw(spark, str(tmp_path / "csv"), "csv").first()
    assert back["text"] == "Enak sekali!"


def test_missing_file_is_empty(spark, tmp_path):
    empty = readers.read_if_present(spark, str(tmp_path / "nothing"), RAW_SCHEMA)
    assert empty.count() == 0 and empty.schema == RAW_SCHEMA
