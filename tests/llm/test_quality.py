import re

from pyspark.sql import functions as F

from revlens.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    inside = {p + d for at in windows.values() if len(at) > 1 for p in at for d in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
        failed,
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_equal_brute_force(make_docs, odd_texts):
    texts = odd_texts + ["a b c d e f g h a b c d e f g h i", "one\ntwo\none\n\n\n one", "a " * 50]
    rows = Q.quality(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute(texts[r.doc_id]), r.doc_id


def test_all_documents_of_a_folder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.quality(docs).collect():
        assert tuple(r[n] for n in NAMES) == brute(texts[r.doc_id])


def test_verdict_keeps_prose_and_rejects_junk(make_docs):
    from tests_llm_prose import sentences

    junk = [
        " ".join(w + "###" for w in sentences(0).split()),
        " | ".join(sentences(1).split()),
        sentences(2).upper(),
        "\n".join(["same line of words here"] * 12),
    ]
    good = [sentences(k) for k in range(3, 9)]
    kept = {r.doc_id: r.kept for r in Q.quality(make_docs(junk + good)).collect()}
    assert [kept[k] for k in range(10)] == [False] * 4 + [True] * 6


def test_rows_stay_whole_when_filtered(make_docs):
    from tests_llm_prose import sentences

    docs = make_docs([sentences(1), None, "short", sentences(1)], ids=[5, None, 6, 5])
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.where("doc_id = 5").collect()]
    assert Q.keep_good(docs.where("false")).count() == 0


def test_no_python_no_shuffle_and_filters_stay_above(make_docs):
    found = Q.quality(make_docs(["a"])).where(F.col("kept"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    # the words are split once, in the projection below the generator
    assert plan.count("split(") <= 3
