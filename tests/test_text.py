from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import text as X

LEXICON = {"v": {"studying": "study", "training": "train", "studies": "study", "applied": "apply"}, "n": {"students": "student", "visas": "visa", "studies": "study"}}


def one(spark, column_of, value):
    return spark.createDataFrame([(value,)], "c string").select(column_of(F.col("c")).alias("x")).first()["x"]


def test_there_are_178_stopwords(spark):
    assert len(X.stopwords()) == 178
    assert not {"s", "would"} & set(X.stopwords())
    assert {"o", "mightn", "that'll"} <= set(X.stopwords())


@pytest.mark.parametrize(("raw", "want"), [("F-1, visa.", "f-1 visa"), ("Form I-20 (2024)", "form i-20 2024"), (None, ""), ("", ""), ("  café au  lait ", "caf au lait"), ("student's", "student s")])
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize, raw) == want


def test_collapse_space_knows_unicode(spark):
    assert one(spark, X.collapse_space, "hello  world\x1c foo ") == "hello world foo"
    assert one(spark, X.collapse_space, None) == ""


def test_clean_tokens(spark):
    assert one(spark, X.clean_tokens, "The students - are -- studying F-1") == ["students", "studying", "f-1"]
    assert one(spark, X.clean_tokens, None) == []
    assert one(spark, X.clean_tokens, "the and of") == []


def test_lexicon_is_tried_as_verb_then_noun_and_spares_codes(spark):
    clean = lambda c: X.clean_text(c, LEXICON)
    assert one(spark, clean, "The students are studying.") == "student study"
    assert one(spark, clean, "on-campus training i20 unknownword") == "on-campus train i20 unknownword"
    assert one(spark, lambda c: X.clean_text(c), "students") == "students"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("F1 visa", "f-1 visa"),
        ("my e verify", "mye-verify"),
        ("e verify", "e-verify"),
        ("ssa-l676", "ssa-l676"),
        ("ssa l676", "ssa-l676"),
        ("I 20 and OPT", "i-20 and optional practical training"),
        ("h 1 b", "h-1b"),
        ("adopt", "adopt"),
        ("i 515a i515", "i-515a i-515"),
        (None, ""),
    ],
)
def test_rewrite_query(spark, raw, want):
    assert one(spark, X.rewrite_query, raw) == want


def test_there_are_88_rules_longest_first():
    rules = X.rewrite_rules()
    assert len(rules) == 88
    assert [len(a) for a, _ in rules] == sorted((len(a) for a, _ in rules), reverse=True)


def test_documents_by_parts(spark):
    row = spark.createDataFrame([("OPT ", "   ", "Students apply.")], "title string, section string, text string")
    cols = [F.col(c) for c in row.columns]
    got = row.select(X.raw_document(cols).alias("raw"), X.natural_text(cols).alias("natural"), X.clean_row(cols).alias("clean")).first()
    assert got["raw"] == "OPT \nStudents apply."
    assert got["natural"] == "OPT. Students apply."
    assert got["clean"] == "opt students apply"


def test_natural_text_of_nothing_is_empty(spark):
    row = spark.createDataFrame([(None, " ", "")], "title string, section string, text string")
    assert row.select(X.natural_text([F.col(c) for c in row.columns]).alias("x")).first()["x"] == ""


def test_markdown(spark):
    assert one(spark, X.markdown_to_html, "***a*** **b**\n*c* <d> & 'e' \"f\"") == "<strong><em>a</em></strong> <strong>b</strong><br><em>c</em> &lt;d&gt; &amp; &#39;e&#39; &#34;f&#34;"
    assert one(spark, X.markdown_to_html, "**a\nb**") == "<strong>a<br>b</strong>"


def test_lexicon_table(spark):
    rows = [(pos, a, b) for pos, kind in LEXICON.items() for a, b in kind.items()]
    lexicon = spark.createDataFrame(rows, "pos string, surface string, lemma string")
    df = spark.createDataFrame([(1, ["students", "studying", "x-1", "students"]), (2, []), (3, ["zzz", "studies"])], "id long, t array<string>")
    got = {r["id"]: r["t"] for r in X.lemmatize_table(df, "t", "id", lexicon).collect()}
    assert got == {1: ["student", "study", "x-1", "student"], 2: [], 3: ["zzz", "study"]}
    literal = {r["id"]: r["t"] for r in df.select("id", X.lemmatize(F.col("t"), LEXICON).alias("t")).collect()}
    assert got == literal
