"""Word vectors: pairs, sampling, training, pooling."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from revlens.functions.rows import numbered
from revlens.operators import ml_features as MF
from revlens.operators import word2vec as W
from revlens.settings import Word2VecOptions
from tests.test_text import py_tokens


def brute_pairs(sentences, window):
    out = Counter()
    for s in sentences:
        for i, a in enumerate(s):
            for d in range(1, window + 1):
                if i + d < len(s):
                    out[tuple(sorted((a, s[i + d])))] += window - d + 1
    return out


def test_cooccurrences_equal_brute_force(spark):
    sentences = [list("abcab"), ["a"], [], list("aabbccdde" * 3), ["x", "x"]]
    df = spark.createDataFrame([(s,) for s in sentences], "terms array<string>")
    for window in (1, 2, 5):
        got = {(r.a, r.b): r.w for r in W.cooccurrences(df, window).collect()}
        assert got == brute_pairs(sentences, window)


def test_numbers_follow_the_order(spark, scratch):
    words = spark.createDataFrame([(f"w{k:03d}", k % 7) for k in range(500)], "word string, n long").repartition(6)
    got = numbered(words, scratch, F.desc("n"), F.asc("word"), name="idx").collect()
    want = sorted(((-r.n, r.word) for r in got))
    assert [(-r.n, r.word) for r in sorted(got, key=lambda r: r.idx)] == want
    assert sorted(r.idx for r in got) == list(range(500))


def test_alias_table_draws_in_proportion():
    weights = np.array([1.0, 5.0, 0.0, 2.5, 0.5, 1.0])
    drawn = W.draw(W.alias_table(weights), 200_000, np.random.default_rng(1))
    share = np.bincount(drawn, minlength=6) / len(drawn)
    np.testing.assert_allclose(share, weights / weights.sum(), atol=0.005)


def test_steps_hold_every_pair_once():
    rng = np.random.default_rng(2)
    i = np.sort(rng.choice(700, 5000, p=np.arange(700, 0, -1) / (701 * 350)).astype(np.int32))
    i[:1500] = 0  # one word with more pairs than a step
    j = rng.integers(0, 300, 5000).astype(np.int32)
    w = rng.random(5000).astype(np.float32)
    steps = W.Steps(700, i, j, w)
    ends = [r[1] for r in steps.runs]
    assert [r[0] for r in steps.runs] == [0, *ends[:-1]] and ends[-1] == 700
    got = [(b + o, near[c], x) for b, _, near, own, col, ws in steps.runs for o, c, x in zip(own, col, ws)]
    assert Counter(got) == Counter(zip(i.tolist(), j.tolist(), w.tolist()))


def test_a_pass_follows_the_gradient():
    """Small steps lower the objective of a pair of ranges."""
    rng = np.random.default_rng(3)
    n, d = 40, 6
    words, contexts = (
        W.Side(rng.normal(0, 0.3, (n, d)).astype(np.float32), np.zeros(n, np.float32)) for _ in range(2)
    )
    i = np.sort(rng.integers(0, n, 300)).astype(np.int32)
    j, w = rng.integers(0, n, 300).astype(np.int32), np.ones(300, np.float32)
    mass = np.bincount(i, minlength=n).astype(np.float32)
    noise = np.bincount(j, minlength=n) ** W.NOISE_POWER

    def loss():
        s = words.x @ contexts.x.T
        good = -np.log(W._sigmoid(s[i, j])).sum()
        return good + 5 * (mass[:, None] * noise / noise.sum() * -np.log(W._sigmoid(-s))).sum()

    before = loss()
    for _ in range(30):
        W.train_pair(words, contexts, mass, W.alias_table(noise), 1.0, W.Steps(n, i, j, w), 5, 0.02, rng)
    assert loss() < 0.95 * before


def corpus(spark, texts=400):
    """Two sets of words that stand in two kinds of places."""
    rng = np.random.default_rng(4)
    hot, cold = ["sun", "fire", "oven", "lava"], ["snow", "ice", "frost", "hail"]
    rows = []
    for k in range(texts):
        side, near = ((hot, "warm glow heat"), (cold, "chill white freeze"))[k % 2]
        words = [w for _ in range(4) for w in (rng.choice(side), rng.choice(near.split()), "the")]
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows, "row_id long, text string"), hot, cold


def fitted(df, seed=5, **options):
    o = Word2VecOptions(**{"vector_size": 12, "epochs": 20, "passes": 5, "partitions": 3} | options)
    return MF.ReviewVectors(o, seed).fit(df)


def vectors(model):
    return {r.word: r.vector.toArray() for r in model.stages[1].getVectors().collect()}


def test_words_of_like_places_are_alike(spark):
    df, hot, cold = corpus(spark)
    found = vectors(fitted(df, epochs=60, passes=20))

    def cosine(a, b):
        return found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])

    same = [cosine(a, b) for s in (hot, cold) for a in s for b in s if a != b]
    other = [cosine(a, b) for a in hot for b in cold]
    assert np.mean(same) > np.mean(other) + 0.3


def test_vectors_depend_on_seed_and_not_on_layout(spark):
    df, _, _ = corpus(spark, 60)
    one = vectors(fitted(df, epochs=4))
    again = vectors(fitted(df.repartition(7).orderBy(F.desc("row_id")), epochs=4))
    assert one.keys() == again.keys()
    assert all((one[w] == again[w]).all() for w in one)
    assert any((one[w] != v).any() for w, v in vectors(fitted(df, seed=6, epochs=4)).items())


def test_ranges_bound_what_a_task_holds(spark, scratch, monkeypatch):
    df, _, _ = corpus(spark, 60)
    terms = MF.ReviewTokens().transform(df)
    seen = []
    monkeypatch.setattr(
        W.Trainer, "_start",
        lambda self, known, pairs, blocks, words, total: seen.append((blocks, words)) or (_ for _ in ()).throw(KeyError),
    )
    for o in (Word2VecOptions(range_words=1), Word2VecOptions(range_pairs=1), Word2VecOptions()):
        with pytest.raises(KeyError):
            W.Trainer(o, 1, scratch).fit(terms)
    (by_words, n), (by_pairs, _), (plain, _) = seen
    assert by_words == n > 8 and by_pairs > 8 and plain == 8


@pytest.mark.parametrize("limit", [128 << 20, 1])
def test_mean_of_known_tokens(spark, limit):
    """Broadcast, and joined because the table is above the limit: same means."""
    df, _, _ = corpus(spark, 60)
    model = fitted(df, epochs=2, broadcast_bytes=limit)
    table = vectors(model)
    texts = ["sun unknownword the the", "nothing known here", "", None, "ice " * 300 + "sun", "sun sun"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("keep", F.lit("k"))
    out = model.transform(rows)
    assert out.columns[:3] == ["row_id", "text", "keep"]
    got = {r.row_id: r.features.toArray() for r in out.collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        known = [table[t] for t in py_tokens(text or "") if t in table]
        want = np.mean(known, axis=0) if known else np.zeros(12)
        np.testing.assert_allclose(got[k], want, atol=1e-6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (limit == 1)


def test_streams_need_a_broadcast(spark, tmp_path):
    df, _, _ = corpus(spark, 20)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    fitted(df, epochs=1).transform(stream)
    with pytest.raises(ValueError, match="too large"):
        fitted(df, epochs=1, broadcast_bytes=1).transform(stream)


def test_saved_with_its_table(spark, tmp_path):
    df, _, _ = corpus(spark, 60)
    model = fitted(df, epochs=2)
    path = str(tmp_path / "model")
    model.write().save(path)
    back = PipelineModel.load(path)
    assert back.stages[1].getOrDefault("path").startswith(path) and back.stages[1].uid == model.stages[1].uid
    a, b = ({r.row_id: r.features for r in m.transform(df).collect()} for m in (model, back))
    assert a == b


def test_no_words_no_vectors(spark, scratch):
    none = spark.createDataFrame([([],), (None,)], "terms array<string>")
    assert W.Trainer(Word2VecOptions(), 1, scratch).fit(none).count() == 0
    df, _, _ = corpus(spark, 20)
    few = vectors(fitted(df, epochs=1, min_count=15))
    counts = Counter(t for r in df.collect() for t in py_tokens(r.text))
    assert set(few) == {w for w, n in counts.items() if n >= 15}
