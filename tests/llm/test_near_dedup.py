from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sparkwell.llm import near_dedup as N
from sparkwell.llm.queries import QUERIES


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())


def brute(docs):
    """docs: {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def run(spark, docs, **options):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(df, **options).collect()}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, i = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice((1, 1, 2, 3, 9, 25))):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            i += rng.randint(1, 5)
            docs[i] = rng.choice((" ", "\n", "\t ")).join(w.upper() if rng.random() < 0.2 else w for w in text)
    return docs


@pytest.mark.parametrize(("seed", "few"), [(1, 16), (2, 16), (3, 0), (4, 0), (5, 2)])
def test_same_as_brute_force(spark, seed, few):
    docs = corpus(seed)
    assert run(spark, docs, few=few) == brute(docs)


def test_many_ids_go_through_a_filter(spark, monkeypatch):
    monkeypatch.setattr(N, "SENT_IDS", 0)
    docs = corpus(6)
    assert run(spark, docs, few=0) == brute(docs)


@pytest.mark.parametrize(("a", "b"), [(1, 1), (100, 100), (75, 100), (76, 100), (99, 100), (3, 4), (300, 360)])
def test_prefixes_are_long_enough(a, b):
    """Sets that overlap just enough share a token of their prefixes, whichever tokens they share."""
    need = -(-75 * (a + b) // 175)
    as_small, as_large = (int(x) for x in (N.prefix_lengths(np.array([a]), 75)[0][0], N.prefix_lengths(np.array([b]), 75)[1][0]))
    assert need <= a and as_small >= a - need + 1 and as_large >= b - need + 1
    rng = np.random.default_rng(a)
    for _ in range(200):
        shared = rng.permutation(10_000)[: a + b - need]
        x, y = np.sort(shared[:a]), np.sort(np.concatenate([shared[:need], shared[a:]]))
        assert len(y) == b and np.intersect1d(x[:as_small], y[:as_large]).size


def test_a_bucket_of_documents_that_are_not_alike_enough(spark, monkeypatch):
    """Each is its own component, and they meet in many buckets; what is verified grows with them, not with their pairs."""
    pairs = {}
    plain = N.Verifier.__call__
    monkeypatch.setattr(N.Verifier, "__call__", lambda self, p, name: pairs.__setitem__(name, p.count()) or plain(self, p, name))
    base = [f"common{i}" for i in range(200)]

    def texts(n):
        out = {}
        for k in range(n):
            t = list(base)
            for j in range(17):  # 34 of 199 shingles are its own, so two share 70 %
                t[5 + 11 * j] = f"own{k}x{j}"
            out[k] = " ".join(t)
        return out

    n_pairs = {}
    for n in (60, 240):
        got = run(spark, texts(n))
        assert all(c == i and kept for i, (_, c, kept) in got.items())
        n_pairs[n] = pairs["rest"]
    assert n_pairs[240] <= 240 * 16 and n_pairs[240] < 240 * 239 / 2 / 10


def test_chain_through_a_bucket(spark):
    # neighbours overlap enough, ends don't: links must not hang on one member of a bucket
    text = [f"t{i}" for i in range(220)]
    docs = {100 - k: " ".join(text[4 * k : 4 * k + 100]) for k in range(12)}
    want = brute(docs)
    assert run(spark, docs) == want and len({c for _, c, _ in want.values()}) == 1


def test_odd_texts(spark):
    docs = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "ONE", 6: "one one", 7: "É é", 8: "é É", 9: "\x85", 10: "a " * 50_000, 11: "a a", 12: "\xa0", 13: " a\x0bb\x0c"}
    assert run(spark, docs) == brute(docs)


def test_hot_group_and_empty_table(spark):
    docs = {i: "the same words in every one of these documents" for i in range(400)} | {1000: "something else entirely here"}
    got = run(spark, docs)
    assert all(got[i] == (8, 0, i == 0) for i in range(400)) and got[1000][2]
    assert run(spark, {}) == {}


def test_repeated_and_null_ids_and_columns(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (2, "a b c d", "z"), (None, "a b c d", "n"), (None, None, "m"), (3, "q r", "k"), (3, "s t", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = N.near_duplicates(df).collect()
    assert sorted(r["id"] for r in found) == [1, 2, 3] and {r["id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3}
    out = N.dedup_near(df)
    assert out.columns == df.columns and sorted(r["component_id"] for r in out.collect()) == ["k", "l", "m", "n", "x", "y"]


def test_repeated_id_is_compared_by_the_row_of_the_smallest_digest(spark):
    from xxhash import xxh3_128_digest

    texts = [" ".join(f"r{k}w{i}" for i in range(60)) for k in range(12)]
    sets = {t: N.shingle_set(t.encode()) for t in texts}
    first = min(texts, key=lambda t: xxh3_128_digest(sets[t].tobytes()))
    # another row of the same id comes first by its numbers, not by its digest
    other = min((t for t in texts if t != first), key=lambda t: sets[t].view(np.int64).tolist())
    assert sets[other].view(np.int64).tolist() < sets[first].view(np.int64).tolist()
    rows = [(1, first), (1, other), (2, first + " and more")]
    found = {r["id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1}


def test_query_has_a_row_for_each_null_id(spark, tmp_path):
    rows = [(1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "a b c d"), (None, None), (None, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in QUERIES["op3_near_dedup"](spark, str(tmp_path)).collect()), key=repr)
    assert found == [(1, 3, 1, True), (2, 3, 1, False), (None, 0, None, True), (None, 1, None, True), (None, 3, None, True), (None, 3, None, True)]


def test_signatures_estimate_overlap():
    a = N.shingle_set(" ".join(f"w{i}" for i in range(1000)).encode())
    b = N.shingle_set(" ".join(f"w{i}" for i in range(200, 1200)).encode())
    sig = N.signatures([a, b, a], 512)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.08 and (sig[0] == sig[2]).all()
    keys = N.band_keys(sig, 128)
    assert (keys[0] == keys[2]).all() and len(np.unique(keys[0])) == 128
