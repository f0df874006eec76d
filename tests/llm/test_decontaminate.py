from __future__ import annotations

import os
import random

import numpy as np
import pytest

from sparkwell.llm import decontaminate as D
from sparkwell.llm.common import Workspace
from sparkwell.llm.queries import QUERIES

RNG = random.Random(11)
VOCABULARY = [f"term{i}" for i in range(3000)]
COMMON = "the of and to a in is that it for".split()


def prose(n):
    return [RNG.choice(COMMON) if RNG.random() < 0.4 else RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(prose(RNG.randint(12, 60))).capitalize() + ".") for i in range(40)] + [(50, " ".join(prose(300))), (51, "too short"), (52, None), (53, ITEM_COPY := " ".join(prose(20))), (54, ITEM_COPY)]


def planted():
    docs, want = [], set()
    items = dict(ITEMS)
    for i in range(200):
        words = prose(RNG.randint(0, 400))
        kind = i % 10
        if kind < 5:
            k = RNG.choice([x for x in items if x < 51 or x > 52])
            w = D.words_of(items[k])
            w = [x.decode() for x in w]
            if kind == 1:
                w = [x.upper() for x in w]
            if kind == 2:  # reworded: every sixth word another, a few dropped
                w = [RNG.choice(VOCABULARY) if n % 6 == 2 else x for n, x in enumerate(w) if n % 11 != 5]
            if kind == 3:  # a few words of it are no leak
                w = w[: max(3, len(w) // 6)]
            else:
                want.add((i, k))
                if k in (53, 54):
                    want |= {(i, 53), (i, 54)}
            at = RNG.randint(0, len(words))
            words[at:at] = w
        docs.append((i, (", " if kind == 1 else " ").join(words)))
    return docs, want


def found(spark, docs, items=ITEMS, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in D.find_items(d, b, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"items_per_pass": 10}])
def test_planted_items_are_found_and_nothing_else(spark, options):
    docs, want = planted()
    assert found(spark, docs, **options) == want


def test_brute_force_by_subsequence(spark):
    docs, _ = planted()
    want = set()
    for i, t in docs:
        own = [w.decode() for w in D.words_of(t)]
        for k, item in ITEMS:
            w = [x.decode() for x in D.words_of(item)]
            if len(w) >= 8:
                for s in range(0, max(len(own) - len(w), 0) + 1):
                    if sum(x == y for x, y in zip(w, own[s : s + len(w)], strict=False)) >= 0.95 * len(w):
                        want.add((i, k))
    assert want <= found(spark, docs)


@pytest.mark.parametrize("every", [1, 3])
def test_item_of_many_documents_among_words_of_others(spark, every):
    rng = random.Random(5)
    hot = " ".join(f"hot{i}" for i in range(20))
    items = [(0, hot)] + [(k, " ".join(f"rare{k}x{i}" for i in range(20))) for k in range(1, 31)]
    docs, want = [], set()
    for i in range(120):
        k = rng.randint(1, 30)
        words = [rng.choice(items[1:])[1].split()[rng.randrange(20)] for _ in range(60)]
        at = rng.randint(0, 60)
        if i % every == 0:
            own = hot.split()
            if i % 2:  # between the words of another item, itself whole
                own += items[k][1].split()
                want.add((i, k))
            words[at:at] = own
            want.add((i, 0))
        docs.append((i, " ".join(words)))
    assert found(spark, docs, items) == want


def test_more_passages_than_dimensions(spark):
    # 300 pairs of items that share most of their words would fill a space of 256 dimensions; the 40 others have words of their own
    rng = random.Random(9)
    pairs = [[f"p{g}x{i}" for i in range(12)] + [f"p{g}y{h}x{i}" for i in range(4)] for g in range(300) for h in range(2)]
    alone = [[f"a{k}x{i}" for i in range(16)] for k in range(40)]
    items = [(k, " ".join(w)) for k, w in enumerate(alone + pairs)]
    docs, want = [], set()
    for i in range(400):
        k = rng.randrange(40)
        words = list(alone[k])
        if i % 2:  # reworded: four words of sixteen
            words[1:12:3] = [f"other{i}x{n}" for n in range(4)]
        beside = [x for _ in range(6) for x in rng.choice(pairs)[:8]]
        docs.append((i, " ".join(beside[:24] + words + beside[24:])))
        want.add((i, k))
    assert found(spark, docs, items) == want


def lcs(a, b):
    return D.lcs_length(D.lcs_masks(a), len(a), b)  # held against the textbook's table below


def brute(docs, items):
    """The same rule of acceptance on every window of every document for every item, without a search."""
    plain = lambda t: [w.decode() for w in D.words_of(t)]
    known = {k: plain(t) for k, t in items if plain(t)}
    held = {w for x in known.values() for w in x}
    texts = [(i, plain(t)) for i, t in docs]
    df = {w: 0 for w in held}
    for _, own in texts:
        for w in set(own) & held:
            df[w] += 1
    idf = {w: max(np.log((1 + len(docs)) / (1 + n)), D.FLOOR) for w, n in df.items()}
    out = set()
    for i, own in texts:
        for k, item in known.items():
            n = len(item)
            if n < 8:
                if f" {' '.join(item)} " in f" {' '.join(own)} ":
                    out.add((i, k))
                continue
            if len(set(item) & set(own)) < 0.4 * len(set(item)):
                continue  # fewer than half of its words can't be in order
            around, answer = max(0, n - D.PIECE) + D.STEP, item[-max(3, n // 5) :]
            for block in range(len(own) // D.STEP + 1):
                region = [w for w in own[max(block * D.STEP - around, 0) : (block + D.SPAN) * D.STEP + around] if w in held]
                share = lcs(item, region) / n
                if share < 0.5:
                    continue
                here = set(region)
                shared = sum(idf[w] for w in item if w in here) / sum(idf[w] for w in item)
                if (share >= 0.65 and shared >= 0.5) or (lcs(answer, region) / len(answer) >= 0.8 and shared >= 0.6):
                    out.add((i, k))
                    break
    return out


def reworded(rng, words, share):
    """Every n-th word another, some dropped, some put in."""
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < share / 4 else [rng.choice(VOCABULARY)] if r < share else [w]
        if rng.random() < share / 4:
            out.append(rng.choice(COMMON))
    return out


def test_two_sided_against_brute_force(spark):
    """More items than a space has dimensions, copies reworded by up to a third: nothing but what brute force finds, and at least nine tenths of it."""
    rng = random.Random(21)
    items = [(k, " ".join(prose(rng.randint(10, 40)))) for k in range(300)] + [(900, "seven words are not quite enough here"), (901, "zweiundvierzig")]
    docs = []
    for i in range(90):
        words = prose(rng.randint(0, 160))
        if i % 3:
            own = reworded(rng, rng.choice(items)[1].split(), rng.choice((0.0, 0.1, 0.2, 0.3, 0.35)))
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((i, " ".join(words)))
    want, got = brute(docs, items), found(spark, docs, items)
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 40


def test_short_items_are_found_verbatim(spark):
    items = [(1, "Five short words of it."), (2, "one"), (3, "Five short words"), (4, "!!!"), (5, None), (6, "five short words of it"), (7, "of it one")]
    docs = [(1, "So: FIVE, short words... of it all"), (2, "five short new words of it"), (3, "not in ones own"), (4, "of it one"), (5, "words of it\none"), (6, "five short words"), (7, None), (8, "x " * 70_000 + "five short words of it")]
    plain = lambda t: b" " + b" ".join(D.words_of(t)) + b" "
    texts, known = [(i, plain(t)) for i, t in docs], [(k, plain(x)) for k, x in items if D.words_of(x)]
    want = {(i, k) for i, t in texts for k, x in known if x in t}
    assert found(spark, docs, items) == want and {(1, 1), (1, 6), (1, 3), (4, 2), (4, 7), (5, 7), (8, 1)} <= want and not {(2, 1), (3, 2)} & want


def test_corpus_topics(spark):
    """Against the singular vectors of the whole matrix of passages."""
    rng = np.random.default_rng(4)
    m, rows, passages = 60, [], []
    for i in range(150):
        n = int(rng.integers(0, 200))
        ids = np.where(rng.random(n) < 0.7, rng.integers(0, 6, n) + 6 * (i % 3), rng.integers(0, m, n))
        places = np.cumsum(rng.integers(1, 4, n))
        rows.append((i, ids.astype("<u2").tobytes(), np.diff(places, prepend=0).astype("<u2").tobytes()))
        passages += [np.bincount(ids[places // D.PASSAGE == p], minlength=m) for p in np.unique(places // D.PASSAGE)]
    idf = rng.uniform(0.5, 3, m)
    df = spark.createDataFrame(rows, "doc_id long, ids binary, gaps binary").repartition(4)
    got = D.corpus_topics(df, "<u2", idf, 4, passes=4)
    want = np.linalg.svd(np.array(passages) * idf)[2][:4].T
    assert got.shape == (m, 4) and np.linalg.svd(got.T @ want, compute_uv=False).min() > 0.99
    assert D.corpus_topics(df.limit(0), "<u2", idf, 4).shape == (m, 0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_query_on_tables(spark):
    """Every document that holds an item word for word, by a plain search, and none that shares less than half of it."""
    path = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: b" ".join(D.words_of(r["text"])) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    items = {r["item_id"]: b" ".join(D.words_of(r["text"])) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x and b" " + x + b" " in b" " + t + b" "}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontaminate"](spark, path).collect()}
    assert want and want <= got
    for i, k in got - want:
        item = items[k].split()
        assert lcs(item, texts[i].split()) >= 0.5 * len(item)


def test_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, "!!!"), (None, ITEM_COPY), (4, ITEM_COPY + " zz"), (4, ITEM_COPY), (5, "x " * 120_000 + ITEM_COPY)]
    assert found(spark, docs) == {(i, k) for i in (None, 4, 5) for k in (53, 54)}
    assert found(spark, []) == set() and found(spark, docs, []) == set() and found(spark, docs, [(1, "short one")]) == set()


def test_documents_stay_or_go_whole(spark):
    docs = spark.createDataFrame([(1, ITEM_COPY, "a"), (2, "fine", "b"), (None, ITEM_COPY, "c"), (2, "also fine", "d")], "doc_id long, text string, item_id string")
    out = D.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r["item_id"] for r in out.collect()) == ["b", "c", "d"]


def test_randomised_svd(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((60, 8)) @ rng.standard_normal((8, 200)) * (rng.random((60, 200)) < 0.5)
    rows = [(i, np.flatnonzero(x).tolist(), x[np.flatnonzero(x)].tolist()) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "row long, terms array<int>, weights array<double>").repartition(3)
    v, s = D.randomized_svd(df, 200, 60, Workspace(spark, "svd"))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(s[:40], want[:40], rtol=1e-3)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    top = D.randomized_svd(df, 200, 5, Workspace(spark, "svd"), powers=3)[1]
    assert np.allclose(top, want[:5], rtol=0.02)


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D.lcs_length(D.lcs_masks(a), len(a), b) == t[-1][-1]
