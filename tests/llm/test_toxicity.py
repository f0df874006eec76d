from __future__ import annotations

import math
import os
import random
import zlib

import pytest

from sparkwell.llm import toxicity as T
from sparkwell.llm.queries import QUERIES


def data(spark, n=900, biased=False):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(("Moron!", "trash,", "vileX", "vileQQ", "vilest")))
        if biased and (rng.random() < 0.9) == toxic:
            words.append("women")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_generalises(spark):
    docs, labels = data(spark)
    model = T.fit(docs, labels)
    out = T.score(docs, model).join(labels, "doc_id").where(T.held_out(docs["doc_id"]))
    rows = out.collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97 and len(rows) > 100
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert model.score("quiet word1 vileNEW") > 0.5 > model.score("quiet word1 word2")


def test_identity_terms_carry_no_weight(spark):
    docs, labels = data(spark, biased=True)
    plain = T.fit(docs, labels, swap_weight=0.0)
    fair = T.fit(docs, labels)
    neutral = "word1 word2 women word3"
    assert plain.score(neutral) > fair.score(neutral) and fair.score(neutral) < 0.5
    assert abs(fair.score(neutral) - fair.score(neutral.replace("women", "men"))) < 0.1
    assert fair.score("word1 moron women") > 0.5


def test_held_out_rows_are_never_learned_from(spark):
    docs, labels = data(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = T.fit(docs, labels), T.fit(docs, flipped)
    assert a.features == b.features and (a.weights == b.weights).all() and a.bias == b.bias
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", T.held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())


def test_sample_is_bounded(spark):
    docs, labels = data(spark)
    model = T.fit(docs, labels, max_rows=200, max_features=10)
    assert len(model.features) <= 10 + len(T.KINDS)


def test_an_id_on_a_third_of_the_rows_is_one_row_of_the_sample(spark, monkeypatch):
    seen = []
    plain = T._train
    monkeypatch.setattr(T, "_train", lambda x, *rest: seen.append(len(x)) or plain(x, *rest))
    docs, labels = data(spark, 300)
    hot = next(i for i in range(300) if zlib.crc32(str(i).encode()) % 5)
    more = docs.unionByName(spark.range(3000).selectExpr(f"{hot}L AS doc_id", "concat('zzz ', id) AS text"))
    a, b = T.fit(docs, labels), T.fit(more, labels.unionByName(labels))
    assert len(set(seen)) == 1 and seen[0] <= 300
    assert a.features == b.features and (a.weights == b.weights).all() and a.bias == b.bias
    T.fit(more, labels, max_rows=20)
    assert seen[-1] == 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_query_on_tables(spark):
    """Scores against the model's own formula over plain sets, and what is held out, by the labels it hasn't seen."""
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs.select("doc_id", "text"), labels)
    weight = dict(zip(model.features, model.weights, strict=True))
    cut = str.maketrans(dict.fromkeys("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r", " "))

    def brute(text):
        z = model.bias
        words = {w.encode("utf-8", "surrogatepass") for w in (text or "").lower().translate(cut).split(" ") if w}
        for f in {w + b" " for w in words} | {w[:n] for w in words for n in (4, 5, 6) if len(w) > n}:
            z += weight.get(f, 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, path).collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r["score"] == pytest.approx(brute(texts[i]), abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    known = [(rows[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    pos, neg = ([s for s, y in known if y == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert len(known) > 500 and auc > 0.9 and sum((s >= 0.5) == y for s, y in known) / len(known) > 0.9


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(2, None), (None, 1), (77777, 0)]])
def test_too_few_labels(spark, rows):
    docs = spark.createDataFrame([(1, "moron"), (2, ""), (3, None), (None, "x y"), (4, "z " * 100_000)], "doc_id long, text string")
    out = T.score(docs, T.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))).collect()
    assert len(out) == 5 and len({r["score"] for r in out}) == 1


def test_columns_and_empty_table(spark):
    docs, labels = data(spark, 60)
    odd = docs.selectExpr("doc_id", "text", "'old' AS score", "1 AS id", "2 AS toxic")
    out = T.score(odd, T.fit(odd, labels))
    assert out.columns == ["doc_id", "text", "score", "id", "toxic", "predicted"] and out.schema["score"].dataType.simpleString() == "double"
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels)).count() == 0
