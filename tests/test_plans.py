from __future__ import annotations

import json

import pytest

from sparkwell import cli
from sparkwell.operators.dense import hashing_encoder
from sparkwell.operators.index import load_index
from sparkwell.plans.build import build
from sparkwell.plans.evaluate import evaluate_retrieval, evaluate_summaries
from sparkwell.plans.search import HybridSearch
from sparkwell.streaming.search import search_stream

PAGES = [("a", "<article><h2>Training</h2><p>Optional practical training lets students work.</p><h3>Limits</h3><p>Twelve months at most.</p></article>"), ("b", "<article><h2>Travel</h2><p>Carry the form when you travel abroad.</p></article>")]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    build(spark.createDataFrame(PAGES, "path string, html string"), path, hashing_encoder(64))
    return HybridSearch(load_index(spark, f"{path}/bm25"), spark.read.parquet(f"{path}/embeddings"), hashing_encoder(64))


def test_search_and_answer(spark, engine):
    queries = spark.createDataFrame([(1, "OPT"), (2, "travel form"), (3, " ")], "query_id long, query string")
    best = {r["query_id"]: r for r in engine.search(queries).where("rank = 1").collect()}
    assert best[1]["title"] == "Training" and best[1]["bm25_rank"] == 1 and best[2]["title"] == "Travel" and 3 not in best
    assert "travel abroad" in {r["query_id"]: r["answer"] for r in engine.answer(queries).collect()}[2]


def test_evaluation(spark, engine):
    gold = spark.createDataFrame([(0, "OPT", [0]), (1, "zzz", [1])], "query_id long, query string, relevant array<long>")
    compared, base, both = evaluate_retrieval(engine, gold)
    assert {r["metric"] for r in compared.collect()} == {"precision", "recall", "rr", "hit", "f1"}
    assert {r["query_id"]: r["rr"] for r in base.collect()} == {0: 1.0, 1: 0.0} and both.count() == 2
    scores = evaluate_summaries(engine, spark.createDataFrame([(0, "OPT", "Practical training lets students work")], "query_id long, query string, reference string")).first()
    assert 0 < scores["rougeL"] < 1


def test_stream(spark, engine, tmp_path):
    for name in ("in", "out"):
        (tmp_path / name).mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"query_id": 1, "query": "travel"}))
    stream = spark.readStream.schema("query_id long, query string").json(str(tmp_path / "in"))
    run = search_stream(stream, engine, str(tmp_path / "out"), str(tmp_path / "check"), 1).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Travel"]


def test_cli_wants_something_to_evaluate(capsys):
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "store", "--no-ir", "--no-summarizer"])
    assert "nothing to evaluate" in capsys.readouterr().err
    assert cli.parser().parse_args(["search", "store", "a", "b", "--top-k", "3"]).query == ["a", "b"]


def test_queries_are_lemmatised_as_documents_are(spark, tmp_path):
    lexicon = {"v": {"studies": "study", "studying": "study"}, "n": {"students": "student"}}
    pages = [("a", "<article><h2>Work</h2><p>A student may study and work.</p></article>"), ("b", "<article><h2>Tax</h2><p>Forms are due in April.</p></article>")]
    build(spark.createDataFrame(pages, "path string, html string"), str(tmp_path), hashing_encoder(64), lexicon)
    stored, vectors = load_index(spark, f"{tmp_path}/bm25"), spark.read.parquet(f"{tmp_path}/embeddings")
    asked = spark.createDataFrame([(1, "studies"), (2, "Studying students")], "query_id long, query string")
    plain, own = (HybridSearch(stored, vectors, hashing_encoder(64), lexicon=x) for x in (None, lexicon))
    assert plain.keywords(asked).count() == 0
    assert {(r["query_id"], r["doc_id"]) for r in own.keywords(asked).collect()} == {(1, 0), (2, 0)}
    assert own.search(asked).where("rank = 1 AND bm25_rank = 1").count() == 2


def test_what_is_shown_comes_from_either_side(spark, engine):
    store = spark.createDataFrame([(0, "dense topic", "dense title"), (2, "dense topic", None)], "doc_id long, topic string, title string")
    both = HybridSearch(engine.index, engine.embeddings, engine.encoder, dense_store=store)
    rows = {r["doc_id"]: r for r in both.search(spark.createDataFrame([(1, "OPT")], "query_id long, query string")).collect()}
    assert rows[0]["title"] == "Training" and any(r["bm25_rank"] is None and r["topic"] == "dense topic" and r["title"] in ("dense title", None) for r in rows.values())
