from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwell.llm import byte_bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})


def ids(text):
    return np.frombuffer(B.encoder(PATH, PATTERN).encode(text), "<i4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abeth'sl .,!1é語\n\t\r\x0b\x85\xa0😀", " ", " ", "the", "ing", "  ", "'ll"]), max_size=40).map("".join))
def test_same_as_the_library(library, text):
    got = ids(text)
    assert got.tolist() == library.encode_ordinary(text)
    assert B.encoder(PATH, PATTERN).decode(got) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text).tolist() == library.encode_ordinary(text)


def test_very_long_pre_tokens(library):
    rng = random.Random(2)
    for text in ("a" * 20_000, "ab" * 10_000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), " " * 5000, "é" * 3000, "-" * 3000):
        assert ids(text).tolist() == library.encode_ordinary(text)
    assert len(ids("xy" * 500_000)) > 0


def test_queue_is_empty_between_calls():
    e = B.encoder(PATH, PATTERN)
    ids("somethingverylongandunusualqqq")
    assert not any(e.low) and all(b is None for b in e.buckets)


def test_tables_are_bounded(monkeypatch, library):
    monkeypatch.setattr(B, "HELD_BYTES", 4_000)
    e = B.ByteBPE(B.load_ranks(PATH), PATTERN)
    text = " ".join(f"w{chr(97 + i % 26)}{'xyz'[i % 3]}q{'k' * (i % 7)}" for i in range(500))
    assert np.frombuffer(e.encode(text), "<i4").tolist() == library.encode_ordinary(text)
    held = [(k, v) for t in (e.plain, e.spaced, e.old_plain, e.old_spaced) for k, v in t.items()]
    assert 0 < sum(B.ENTRY_BYTES + len(k) + len(v) for k, v in held) <= 2 * (4_000 + B.ENTRY_BYTES + 200) and e.old_spaced
    assert np.frombuffer(e.encode(text[::-1] + " " + text), "<i4").tolist() == library.encode_ordinary(text[::-1] + " " + text)


def test_tables(spark, library):
    rows = [(1, "Hello, world", "x"), (2, None, "x"), (3, "", "x"), (4, "naïve  café\n", "x"), (1, "Hello, world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = B.encode(df, PATH, PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    apart = B.decode(B.encode(df, PATH, PATTERN).drop("text"), PATH, PATTERN)
    assert sorted(bytes(r["decoded"]) for r in apart.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert B.encode(df.limit(0), PATH, PATTERN).count() == 0
    text = out.where("doc_id = 4").select(B.ids_text("ids").alias("t")).first()["t"]
    assert text == " ".join(map(str, library.encode_ordinary("naïve  café\n")))
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytes(B.decode(nulls, PATH, PATTERN).first()["decoded"]) == b""


def test_query_digests(spark, library, tmp_path):
    from sparkwell.llm.queries import op10_byte_bpe

    rows = [(i, t) for i, t in enumerate(["one two", None, "", "Ünï\n\ncode " * 50])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op10_byte_bpe(spark, str(tmp_path)).collect():
        text = rows[r["doc_id"]][1] or ""
        want = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
