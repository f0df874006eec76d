"""What the findings of round 3 were about, in the small."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkwell.functions import html as H
from sparkwell.functions import text as X
from sparkwell.operators import bm25, corpus, crawl, dense, index, metrics
from sparkwell.plans import registry
from sparkwell.sources import readers, sinks


def test_csv_keeps_white_space_at_the_ends(spark, tmp_path):
    odd = [" a", "a ", "\ta", "a\n", "\na", "a\r", "\r\n", " ", "   ", "\n", "\x01", "a\x0b ", '"', ' "a" ', "\\", 'a\\"', "a,b", "a\r\nb", " x", "x\x00y", "null"]
    df = spark.createDataFrame(list(enumerate(odd)), "i long, text string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {int(r["i"]): r["text"] for r in readers.read_csv(spark, str(tmp_path / "csv")).collect()} == dict(enumerate(odd))


def test_references_end_in_a_semicolon():
    page = "<article><h1>a&amp;b&amp</h1><p>&lt;x&gt; &quo &#65; &#x42; &#67 &nope; &ampx; &amp;lt; R&D &copy;</p></article><a href='/q?a=1&copy=2&amp;b=3'>l</a>"
    root = H.parse(page)
    assert H.first(root, "h1").text() == "a&b&amp"
    assert H.first(root, "p").text() == "<x> &quo A B &#67 &nope; &ampx; &lt; R&D ©"
    assert H.links(root) == ["/q?a=1&copy=2&b=3"]


def test_blocks_of_a_title_cut_within_a_reference(spark):
    pages = spark.createDataFrame([("a", "<article><h1>x&amp;&amp</h1><p>t &quo &amp; u</p></article>")], "path string, html string")
    assert [tuple(r) for r in corpus.structured_corpus(pages, title_tag="h1", section_tag="h2").collect()] == [(0, "", "x&&amp", "", "t &quo & u")]


def test_a_crawl_folds_seeds_in_a_stream():
    """Seeds of one task, one after the other and across batches; what a seed has kept isn't held for the next."""
    rows = [(s, u, 1, None, q, None, h, old) for s in ("s1", "s2") for u, q, h, old in (("a", 0, "A", True), ("b", 1, "A", False), ("c", 2, "C", False), ("d", 3, "C", False), ("e", 4, None, False), ("f", 5, "F", False))]
    whole = pa.Table.from_pylist([dict(zip((*crawl.KEPT_NAMES, "old"), r, strict=True)) for r in rows])
    for size in (1, 5, 100):
        out = pa.Table.from_batches(list(crawl.keep_new(iter(whole.to_batches(max_chunksize=size)), 3)))
        assert [tuple(r[c] for c in ("seed_url", "url")) for r in out.to_pylist()] == [(s, u) for s in ("s1", "s2") for u in ("c", "e")]
        assert out.column_names == crawl.KEPT_NAMES


def test_crawl_pages_has_a_row_for_each_distinct_page(spark, tmp_path):
    text = "<article>one</article>"
    pages = [(0, "http://x.com/a/", text), (1, "http://x.com/a/", text + "<p>foot"), (2, "https://www.x.com/a", text + "<p>more"), (3, "https://x.com/a#top", text), (4, "https://x.com/b", "<article>cut &amp</article>"), (5, "https://x.com/c", "<p>none"), (6, "https://x.com/c", "<p>none either")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {(r[0], r[4]) for r in con.execute(registry.oracle()["crawl_pages"]).fetchall() if r[0] != "https://x.com/c"}
    rows = [(r["seed_url"], r["article_hash"]) for r in registry.crawl_pages(spark, str(tmp_path)).collect()]
    assert set(rows) == want | {("https://x.com/c", None)}  # SQL hashes an empty text where there is no article
    assert len(rows) == 6


def test_separators_are_what_is_no_letter_digit_or_hyphen(spark):
    chars = [chr(i) for i in (*range(1, 0x300), 0x130, 0x212A, 0x2028, 0x3000, 0xFEFF, 0xFFFF, 0x1F600, 0x10FFFF)]
    df = spark.createDataFrame([(f"{c}a{c}-b {c}{c}Z9",) for c in chars], "text string")
    lower = F.regexp_replace(F.lower("text"), r"[^a-z0-9\s-]+", " ")
    assert df.where(X.normalize(F.col("text")) != F.trim(F.regexp_replace(lower, r"\s+", " "))).count() == 0
    assert "[^" not in X.SEPARATORS  # twenty times as slow


def test_terms_leave_a_task_in_chunks(spark, monkeypatch):
    docs = [(0, ["a", "b", "a"]), (1, []), (2, None), (3, ["c"] * 9), (4, ["a"])]
    df = spark.createDataFrame([("text", i, t) for i, t in docs], "field string, doc_id long, tokens array<string>").coalesce(1)
    want = [("text", "a", 0, 2, 3), ("text", "a", 4, 1, 1), ("text", "b", 0, 1, 3), ("text", "c", 3, 9, 9)]
    for chunk in (1, 4, 1000):
        monkeypatch.setattr(index, "CHUNK", chunk)
        assert sorted(map(tuple, index.term_rows(df).collect())) == want


def test_a_search_gathers_scores_once(spark):
    """One exchange for the scores of all fields, beside those of the terms' statistics and of the ranks."""
    docs = spark.createDataFrame([(i, "news", f"title {i % 4}", f"some words {i} {i % 3} title") for i in range(40)], "doc_id long, topic string, title string, text string")
    own, queries = index.build_index(docs), spark.createDataFrame([(0, "title words 3"), (1, "news 7")], "query_id long, query string")
    found = bm25.search(own, queries, 5, {"title": 2.0, "text": 3.0}, terms=bm25.query_terms(queries, X.clean_tokens))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(query_id") == 2
    each = bm25.score_fields(own, bm25.query_terms(queries, X.clean_tokens)).collect()
    of = {(r["query_id"], r["doc_id"], r["field"]): r["score"] for r in each}
    for r in found.collect():
        title, text = (of.get((r["query_id"], r["doc_id"], f), 0.0) for f in ("title", "text"))
        assert (r["bm25_title"], r["bm25_text"]) == (round(title, 6), round(text, 6)) and abs(r["score"] - 2 * title - 3 * text) < 1e-6


def test_a_small_lexicon_moves_no_token(spark, monkeypatch):
    rows = [(0, ["studies", "rows", "b-2s", "x", "studies"]), (1, []), (2, None), (3, ["rows", None]), (None, ["x", "rows"])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    lexicon = spark.createDataFrame([("v", "studies", "study"), ("n", "studies", "no"), ("v", "rows", "rows"), ("n", "rows", "row"), ("v", "b-2s", "b"), ("n", None, "z"), ("n", "x", None)], "pos string, surface string, lemma string")
    want = [(0, ["study", "row", "b-2s", "x", "study"]), (1, []), (2, []), (3, ["row", None]), (None, ["x", "row"])]
    got = X.lemmatize_table(df, "t", "k", lexicon)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(X, "LITERAL_LEXICON", 0)
    assert sorted(map(tuple, X.lemmatize_table(df, "t", "k", lexicon).collect()), key=repr) == sorted(want, key=repr)


def test_matching_holds_some_similarities_at_a_time(spark, monkeypatch):
    pairs = spark.createDataFrame([(i, " ".join(f"w{j * i % 7}" for j in range(i + 1)), " ".join(f"w{j % 5}" for j in range(9 - i))) for i in range(10)], "pair_id long, prediction string, reference string").coalesce(1)
    want = sorted(map(tuple, metrics.embedding_match(pairs, dense.hashing_encoder(16)).collect()))
    monkeypatch.setattr(metrics, "SIMILARITIES", 7)
    monkeypatch.setattr(metrics, "PAIRS", 3)
    assert sorted(map(tuple, metrics.embedding_match(pairs, dense.hashing_encoder(16)).collect())) == want


def test_encoding_goes_in_slices(spark):
    """A task yields what it has encoded before it encodes the rest of a batch."""
    df = spark.createDataFrame([(i, f"w{i % 11} w{i % 3}") for i in range(600)], "doc_id long, text string").coalesce(1)
    got = dense.encode(df, "text", encoder=dense.hashing_encoder(16)).select("doc_id", "embedding", F.spark_partition_id()).orderBy("doc_id").collect()
    model = dense.hashing_encoder(16)()
    v = model([f"w{i % 11} w{i % 3}" for i in range(600)])
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    assert np.allclose(np.array([r["embedding"] for r in got]), v, atol=1e-6) and [r["doc_id"] for r in got] == list(range(600))


def test_a_store_is_cut_to_the_hits_before_it_moves(spark):
    store = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    hits = spark.createDataFrame([(0, 1, 7), (0, 2, 99), (1, 1, 7)], "query_id long, rank int, doc_id long")
    got = bm25.look_up(hits, store)
    assert "LeftSemi, BuildRight" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("query_id", "rank", "doc_id", "text").collect())) == [(0, 1, 7, "text 7"), (0, 2, 99, None), (1, 1, 7, "text 7")]
