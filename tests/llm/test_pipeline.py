import corpus_pipeline as P
from revlens.llm import bpe
from tests_llm_prose import sentences


def corpus(tmp_path, make_docs):
    shared = sentences(100, 50)
    texts = [
        sentences(1),
        sentences(1),
        sentences(1).replace(" the ", " THE "),
        sentences(2) + " " + shared,
        shared + " " + sentences(3),
        sentences(4) + ' token = "0123456789abcdef01234567"',
        "###" * 50,
        None,
        "short",
    ]
    path = str(tmp_path / "in")
    make_docs(texts).write.parquet(f"{path}/documents.parquet")
    return path, shared


def test_each_stage(spark, tmp_path, make_docs):
    path, shared = corpus(tmp_path, make_docs)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert sorted(seen["quality_rules"]) == [0, 1, 2, 3, 4, 5]
    assert sorted(seen["minhash_near_dedup"]) == [0, 3, 4, 5]
    for k in (3, 4):
        assert shared not in seen["substring_dedup"][k].text
        assert seen["substring_dedup"][k].n_chars == len(seen["substring_dedup"][k].text)
    assert seen["substring_dedup"][0].text == sentences(1)
    assert seen["secret_scans"][5].text == sentences(4) + ' [assign]"'


def test_run(spark, tmp_path, make_docs, vocabulary):
    path, _ = corpus(tmp_path, make_docs)
    rows = P.run(spark, path).collect()
    own = bpe.Tokenizer(vocabulary)
    parts = sorted((r.doc_id, r.start, list(r.ids)) for r in rows)
    ids = [i for d, _, p in parts if d == 0 for i in p]
    import numpy as np

    assert ids[-1] == 1 and own.decode(np.array(ids[:-1], "<u4").tobytes()) == sentences(1)
    assert {d for d, _, _ in parts} == {0, 3, 4, 5}


def test_repeated_rows_leave_one_whole_document(spark, tmp_path, make_docs):
    near = sentences(3, 300)
    texts = [sentences(1)] * 2 + [sentences(2)] * 3 + [near, near + " more"]
    docs = make_docs(texts, ids=[1, 1, None, None, None, 3, 3])
    for name, stage in P.STAGES[1:3]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = {(r.doc_id, r.text) for r in docs.collect()}
    assert docs.count() == len(got) == 3
    assert {(1, sentences(1)), (None, sentences(2))} < got
    assert {(3, near), (3, near + " more")} & got
