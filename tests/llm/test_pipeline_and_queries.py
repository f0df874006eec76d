from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from sparkwell.llm.oracle import ORACLE_SQL
from sparkwell.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([r[i] for i in order]) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, DIR)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), [d[0] for d in want.description])


def test_one_query_for_each_operator():
    names = entry.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(QUERIES) <= set(names) and "pipeline" in names


@needs_tables
def test_rows_of_the_other_queries(spark):
    n = {t: spark.read.parquet(f"{DIR}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, table in (("op4_token_file", "documents"), ("op6_sharding", "documents"), ("op7_toxicity", "documents"), ("op9_html_text", "pages"), ("op10_byte_bpe", "documents")):
        assert QUERIES[name](spark, DIR).count() == n[table], name


LINE = "A line that very many of these documents share, word for word, to no end"
LEAK = "What unusual zebras gallop across frozen violet meadows while twelve patient owls recite forgotten algebra quietly"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"document number {i} says thing{i} and thing{i + 1} of topic{i % 7}", "en", "s", 0) for i in range(60)]
    docs += [(100 + i, f"{LINE}\nown words here {i} alpha{i} beta{i} gamma{i}", "en", "s", 0) for i in range(8)]
    copy = " ".join(f"copied{k}" for k in range(40))
    docs += [(200, copy, "en", "s", 0), (201, copy, "en", "s", 0), (202, copy + " extra", "en", "s", 0)]
    docs += [(300, f"before it all {LEAK} and after it", "en", "s", 0)]
    docs += [(400 + i, f"document number {i + 60} says thing{i + 60} moron and thing{i + 61} of topic{i % 7}", "en", "s", 0) for i in range(30)]
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, "no id at all", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0) for i in range(60)] + [(400 + i, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, "nothing of this is anywhere in the corpus at all today")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_does_its_part(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    clean = P.drop_toxic(spark, docs, small)
    assert ids(docs) - ids(clean) == set(range(400, 430)) and clean.columns == columns
    lined = P.drop_repeated_lines(spark, docs, small)
    texts = {r["doc_id"]: r for r in lined.collect()}
    assert lined.columns == columns and ids(lined) == ids(docs)
    assert [LINE in texts[100 + i]["text"] for i in range(8)] == [False] * 7 + [True] and texts[100]["n_chars"] == len(texts[100]["text"])
    single = P.drop_near_duplicates(spark, docs, small)
    assert {200} == ids(single) & {200, 201, 202} and ids(docs) - ids(single) <= {201, 202} | set(range(101, 108))
    free = P.drop_benchmark(spark, docs, small)
    assert ids(docs) - ids(free) == {300} and free.columns == columns


def test_columns_of_any_names_pass_the_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = ("score", "predicted", "n_lines", "n_dropped", "component_id", "kept", "id", "ids", "a.b", "__gone", "item_id")
    odd = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in extra))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns, name
        rows = out.toDF(*(f"c{i}" for i in range(len(odd.columns)))).collect()
        assert rows and all(r[len(docs.columns) + k] == (f"{c}{r[0]}" if r[0] is not None else None) for r in rows for k, c in enumerate(extra)), name
    assert P.STAGES[-1][1](spark, odd, small).count() == odd.count()


def brute_stages(docs, benchmark, toxic):
    """What should be left of (doc_id, text) rows after the first four stages, by plain Python."""
    from .test_decontaminate import brute as leaks
    from .test_line_dedup import brute as lined
    from .test_near_dedup import brute as groups

    left = [(i, t) for i, t in docs if not toxic(t)]
    left = [(i, t) for i, t, _, _ in lined(left)]
    kept = groups({i: t for i, t in left if i is not None})
    left = [(i, t) for i, t in left if i is None or kept[i][2]]
    gone = {i for i, _ in leaks(left, benchmark)}
    return {(i, t) for i, t in left if i is None or i not in gone}


def test_run_equals_brute_force(spark, small):
    """The whole pipeline: rows that stay, with the library's ids of their texts."""
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    from sparkwell.llm import toxicity

    docs, labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.fit(docs, labels)
    want = brute_stages([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], lambda t: model.score(t) >= 0.5)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(" ".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest()
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.run(spark, small).collect()]
    assert sorted(got, key=repr) == sorted(((i, len(library.encode_ordinary(t or "")), digest(t), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want), key=repr)


@needs_tables
def test_sharding_by_brute_force(spark):
    """The law of op6: sizes near equal, gapless slots, equal texts together, sizes and checksums of whole texts."""
    import zlib
    from collections import Counter, defaultdict

    path = DIR.replace("0.001", "0.01")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op6_sharding"](spark, path).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    shards, places, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None) and 0 <= r["shard"] < 8
        shards[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        homes[t].add(r["shard"])
    mean = sum(shards.values()) / 8
    heaviest = max(n * (len(t) + 1) for t, n in Counter(texts.values()).items())
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(shards) == 8
    assert max(abs(v - mean) for v in shards.values()) <= 0.05 * mean + heaviest and all(len(h) == 1 for h in homes.values())


def test_run(spark, small):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "byte BPE"]
    rows = {r["doc_id"]: r for r in P.run(spark, small).collect()}
    assert set(rows) == set(range(60)) | set(range(100, 108)) | {200, 500, 501, None}
    assert rows[501]["n_tokens"] == 0 and rows[200]["ids_sha256"] and len(rows[200]["ids"]) == rows[200]["n_tokens"]


def test_run_on_empty_tables(spark, small, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
