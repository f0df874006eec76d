from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.functions.text import clean_tokens
from sparkwell.operators import bm25, corpus, dense, fusion, generate, index, metrics

DOCS = [(0, "work", "Alpha beta", "alpha alpha gamma"), (1, "work", "Beta", "beta delta"), (2, "study", "", ""), (3, None, None, "gamma delta delta delta")]


@pytest.fixture(scope="module")
def ix(spark):
    return index.build_index(spark.createDataFrame(DOCS, "doc_id long, topic string, title string, text string"))


def brute(query: str, field: int) -> dict[int, float]:
    docs = {d[0]: (d[field] or "").lower().split() for d in DOCS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out: dict[int, float] = {}
    for t in set(query.split()):
        df = sum(t in w for w in docs.values())
        for d, w in docs.items():
            if t in w:
                tf = w.count(t)
                out[d] = out.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.7 + 0.3 * len(w) / avg))
    return out


def test_statistics_count_empty_documents(ix):
    stats = {r["field"]: (r["n"], r["avgdl"]) for r in ix.field_stats.collect()}
    assert stats == {"topic": (4, 0.75), "title": (4, 0.75), "text": (4, 9 / 4)}
    idf = {(r["field"], r["term"]): (r["df"], r["idf"]) for r in ix.term_stats.collect()}
    assert idf["text", "gamma"] == (2, pytest.approx(math.log(1 + 2.5 / 2.5)))


def test_postings(ix):
    got = {(r["field"], r["term"], r["doc_id"]): r["tf"] for r in ix.postings.collect()}
    assert got["text", "alpha", 0] == 2 and got["text", "delta", 3] == 3 and ("text", "alpha", 1) not in got


def test_empty_corpus(spark):
    ix = index.build_index(spark.createDataFrame([], "doc_id long, topic string, title string, text string"))
    assert {(r["n"], r["avgdl"]) for r in ix.field_stats.collect()} == {(0, 0.0)}
    assert bm25.search(ix, spark.createDataFrame([(1, "alpha")], "query_id long, query string")).count() == 0


def test_search_weighs_fields(spark, ix):
    queries = spark.createDataFrame([(1, "alpha delta"), (2, " "), (3, None), (4, "alpha alpha delta")], "query_id long, query string")
    rows = bm25.search(ix, queries, 10).orderBy("query_id", "rank").collect()
    want: dict[int, float] = {}
    for field, w in ((1, 3.0), (2, 2.0), (3, 3.0)):
        for d, s in brute("alpha delta", field).items():
            want[d] = want.get(d, 0) + w * s
    order = sorted(want, key=lambda d: (-round(want[d], 6), d))
    for q in (1, 4):
        own = [r for r in rows if r["query_id"] == q]
        assert [r["doc_id"] for r in own] == order
        assert [r["score"] for r in own] == [pytest.approx(want[d], abs=1e-6) for d in order]
    assert {r["query_id"] for r in rows} == {1, 4}


def test_queries_are_rewritten(spark):
    ix = index.build_index(spark.createDataFrame([(7, "", "", "optional practical training")], "doc_id long, topic string, title string, text string"))
    assert [r["doc_id"] for r in bm25.search(ix, spark.createDataFrame([(1, "OPT?")], "query_id long, query string")).collect()] == [7]


def test_index_round_trip(spark, ix, tmp_path):
    index.save_index(ix, str(tmp_path))
    back = index.load_index(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, "alpha delta")], "query_id long, query string")
    assert sorted(map(tuple, bm25.search(back, queries).collect())) == sorted(map(tuple, bm25.search(ix, queries).collect()))
    assert (back.k1, back.b) == (1.5, 0.3)


def test_repartitioning_changes_nothing(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, topic string, title string, text string")
    a, b = (index.build_index(d, tokenize=clean_tokens) for d in (df, df.repartition(3)))
    assert sorted(map(tuple, a.term_stats.collect())) == sorted(map(tuple, b.term_stats.collect()))


def test_dense_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[10] = v[20]
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<float>").repartition(5)
    queries = data.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    got: dict[int, list] = {}
    for r in dense.search(data, queries, 5, block=9, chunk=31).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    s = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 6)
    for q in range(0, 300, 7):
        want = sorted(range(300), key=lambda d: (-s[q, d], d))[:5]
        assert [d for d, _ in got[q]] == want


def test_encoder_gives_unit_vectors(spark):
    out = dense.encode(spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string"), "t", encoder=dense.hashing_encoder(16))
    norms = {r["id"]: r["n"] for r in out.select("id", dense.norm(F.col("embedding")).alias("n")).collect()}
    assert norms[1] == pytest.approx(1.0, abs=1e-6) and norms[2] == 0.0


HITS = "query_id long, rank int, doc_id long, score double"


def test_fusion_ties_and_missing_sides(spark):
    a = spark.createDataFrame([(1, 1, 10, 9.0), (1, 2, 11, 8.0)], HITS)
    b = spark.createDataFrame([(1, 1, 12, 0.9), (1, 2, 11, 0.8), (2, 1, 5, 0.1)], HITS)
    rows = [tuple(r) for r in fusion.hybrid(a, b, 10).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in rows] == [11, 10, 12, 5]
    assert rows[0][3] == pytest.approx(round(2 / 62, 6))
    assert rows[1][4:] == (1, 9.0, None, 0.0) and rows[2][4:] == (None, 0.0, 1, 0.9)


def test_fusion_of_two_lists_equals_the_hybrid(spark):
    a = spark.createDataFrame([(1, i + 1, i, 1.0) for i in range(6)], HITS)
    b = spark.createDataFrame([(1, i + 1, 9 - i, 1.0) for i in range(6)], HITS)
    assert [r["doc_id"] for r in fusion.fuse([a, b], 5).orderBy("rank").collect()] == [r["doc_id"] for r in fusion.hybrid(a, b, 5).orderBy("rank").collect()]


def test_metadata_prefers_the_first_side(spark):
    fused = spark.createDataFrame([(1, 10), (1, 12)], "query_id long, doc_id long")
    a = spark.createDataFrame([(1, 10, "", "raw")], "query_id long, doc_id long, title string, raw_document string")
    b = spark.createDataFrame([(1, 10, "B"), (1, 12, "C")], "query_id long, doc_id long, title string")
    rows = {r["doc_id"]: r for r in fusion.with_metadata(fused, a, b, ("title",)).collect()}
    assert rows[10]["title"] == "" and rows[10]["raw_document"] == "raw"
    assert rows[12]["title"] == "C" and rows[12]["raw_document"] is None


def test_metrics_edges(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    gold = spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "query_id long, doc_id long")
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 7, 9), (3, 1, 1)], "query_id long, rank int, doc_id long")
    per = metrics.evaluate(queries, gold, hits, 5)
    rows = {r["query_id"]: tuple(r)[1:] for r in per.collect()}
    assert rows[1] == (2, 0.2, 0.5, 1.0, 1.0, round(2 * 0.2 * 0.5 / 0.7, 6))
    assert rows[2] == (1, 0.0, 0.0, round(1 / 7, 6), 0.0, 0.0)
    assert rows[3] == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    mean = metrics.summary(per).first()
    assert mean["n_queries"] == 3 and mean["precision"] == round(0.2 / 3, 6)
    compared = {r["metric"]: r for r in metrics.compare(per, per).collect()}
    assert compared["hit"]["delta"] == 0 and compared["hit"]["delta_pct"] == 0
    assert metrics.summary(per.where("query_id < 0")).first()["rr"] is None


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert metrics.porter_stem(word) == stem


def test_rouge(spark):
    pairs = spark.createDataFrame([(1, "the cat sat on the mat", "the cat was on the mat"), (2, "", "x"), (3, "studies apply", "study applied")], "pair_id long, prediction string, reference string")
    rows = {r["pair_id"]: r for r in metrics.rouge(pairs).collect()}
    assert rows[1]["rouge1"] == pytest.approx(5 / 6, abs=1e-6) and rows[1]["rouge2"] == pytest.approx(0.6) and rows[1]["rougeL"] == pytest.approx(5 / 6, abs=1e-6)
    assert rows[2]["rouge1"] == 0 and rows[3]["rouge1"] == 1.0
    assert {r["pair_id"]: r["f"] for r in metrics.rouge_n(pairs, 1).collect()} == {1: pytest.approx(5 / 6, abs=1e-6), 2: 0.0, 3: 0.0}


def test_embedding_match_of_equal_texts(spark):
    pairs = spark.createDataFrame([(1, "a b", "b a"), (2, "", "a")], "pair_id long, prediction string, reference string")
    rows = {r["pair_id"]: r for r in metrics.embedding_match(pairs, dense.hashing_encoder(32)).collect()}
    assert rows[1]["f"] == pytest.approx(1.0) and rows[2]["f"] == 0.0


SHOWN = "query_id long, rank int, doc_id long, title string, section string, text string, raw_document string"


def test_prompts_and_fallbacks(spark):
    queries = spark.createDataFrame([(1, "why?"), (2, "nothing")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, 7, "T", "", "", "raw " * 300), (1, 2, 8, "U", "S", "two", ""), (1, 4, 9, "V", "", "four", "")], SHOWN)
    context = generate.contexts(hits).first()["context"]
    assert context == f"Document ID: 7\nTitle: T\nSection: \nText: {('raw ' * 300)[:800]}\n\n---\nDocument ID: 8\nTitle: U\nSection: S\nText: two\n"
    answers = {r["query_id"]: r["answer"] for r in generate.summarize(queries, hits).collect()}
    assert answers[1] == generate.UNAVAILABLE + "\n\n" + ("raw " * 300)[:500] and answers[2] == generate.NOTHING


def test_generator_answers_or_falls_back(spark):
    queries = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, 7, "T", "", "x", ""), (2, 1, 7, "T", "", "x", "")], SHOWN)

    def load():
        def answer(prompt):
            if "bad" in prompt:
                raise TimeoutError
            return "  fine \n"

        return answer

    answers = {r["query_id"]: r["answer"] for r in generate.summarize(queries, hits, load).collect()}
    assert answers == {1: "fine", 2: generate.UNAVAILABLE + "\n\nx", 3: generate.NOTHING}


def test_corpora(spark):
    df = spark.createDataFrame([(5, "t", " ", None, ""), (3, "t", "OPT", "Work", "Apply."), (9, "u", "A", "", "b")], "pos long, topic string, title string, section string, text string")
    out = corpus.embedding_corpus(df, ["pos"]).orderBy("row_id").collect()
    assert [(r["row_id"], r["natural_text"]) for r in out] == [(0, "OPT. Work. Apply."), (1, "A. b")]
    cleaned = corpus.cleaned_corpus(df.drop("pos")).where("topic = 'u'").first()
    assert cleaned["raw_document"] == "A\nb" and cleaned["cleaned_document"] == "b"
    with pytest.raises(ValueError, match="topic"):
        corpus.cleaned_corpus(df.drop("topic"))


def test_token_lengths(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate((10, 600, 512, 513))], "row_id long, n int")
    r = corpus.token_length_report(df, F.col("n")).first()
    assert (r["max_tokens"], r["n_over"], r["first_over"]) == (600, 2, [1, 3])
    empty = corpus.token_length_report(df.where("n < 0"), F.col("n")).first()
    assert (empty["max_tokens"], empty["n_over"], empty["first_over"]) == (0, 0, [])


def test_keep_first_and_numbers(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4), (None, 0)], "k string, pos long")
    assert {tuple(r) for r in corpus.keep_first(df, ["k"], ["pos"]).collect()} == {("a", 1), ("b", 3), (None, 0)}
    big = spark.range(5000).selectExpr("(id * 7919) % 5000 AS pos")
    assert all(r["doc_id"] == r["pos"] for r in corpus.number_rows(big, ["pos"]).collect())
