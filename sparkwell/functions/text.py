"""Text functions as Column expressions: everything runs in the JVM and fuses with its surroundings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python understands it; Java's \s is ASCII only.
UNICODE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

#: What the stopword list has beyond Spark's English list, and what it lacks of it.
EXTRA_STOPWORDS = "o y m d ma ve re ll won shan isn ain aren weren wasn hasn hadn haven didn doesn couldn wouldn mightn mustn needn mightn't needn't should've shouldn that'll".split()
MISSING_STOPWORDS = "s who's what's when's where's why's how's here's there's that's let's can't cannot could would ought i'm i'd i'll i've he'd he'll he's she'd she'll we'd we'll we're we've they'd they'll they're they've".split()


@lru_cache(1)
def stopwords() -> tuple[str, ...]:
    """178 English words that aren't indexed. Those with an apostrophe never meet a normalised token."""
    base = set(StopWordsRemover.loadDefaultStopWords("english"))
    return tuple(sorted((base - set(MISSING_STOPWORDS)) | set(EXTRA_STOPWORDS)))


def collapse_space(c: Column) -> Column:
    """Runs of any white space (no-break spaces too) become one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), UNICODE_SPACE, " "))


#: Runs of what is no a-z, 0-9 or hyphen, as ranges: the negated class takes Java's matcher twenty times as long.
SEPARATORS = r"[\x00-,./:-`{-\x{10ffff}]+"


def normalize(c: Column) -> Column:
    """Lower case; anything but a-z, 0-9, white space and hyphens becomes a space; one space between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SEPARATORS, " "))


def drop_stopwords(tokens: Column) -> Column:
    """Without empty tokens, bare hyphens and stopwords."""
    return F.filter(tokens, lambda t: (F.btrim(t, F.lit("-")) != "") & ~t.isin(*stopwords()))


#: Surfaces of a lexicon that may be a literal of the plan.
LITERAL_LEXICON = 1_000


def lemmatize(tokens: Column, lexicon: Mapping[str, Mapping[str, str]] | None) -> Column:
    """Each token's lemma by a lexicon ``{"v": {surface: lemma}, "n": {...}}``: as a verb, or failing that as a noun.

    Tokens with a hyphen or a digit keep their form; without a lexicon all do. The lexicon
    is a literal of the plan and so meant to be small; ``lemmatize_table`` joins a large one.
    """
    if not lexicon:
        return tokens
    verbs, nouns = (F.create_map(*(F.lit(x) for kv in sorted(lexicon.get(pos, {}).items()) for x in kv)) if lexicon.get(pos) else None for pos in "vn")

    def lemma(t: Column) -> Column:
        as_noun = F.coalesce(nouns[t], t) if nouns is not None else t
        as_verb = F.coalesce(verbs[t], t) if verbs is not None else t
        return F.when(t.rlike("[-0-9]"), t).when(as_verb != t, as_verb).otherwise(as_noun)

    return F.transform(tokens, lemma)


def lemmatize_table(df: DataFrame, tokens: str, key: str, lexicon: DataFrame) -> DataFrame:
    """``lemmatize`` by a lexicon table (pos, surface, lemma) of any size: (key, tokens) with each token's lemma; [] for null.

    A lexicon of at most ``LITERAL_LEXICON`` rows (counted) becomes a literal, and no token moves. Of a
    larger one each row's distinct tokens are looked up, and those that it changes go back to the row.
    """
    own = lexicon.where("pos IN ('v', 'n') AND surface IS NOT NULL AND lemma IS NOT NULL").groupBy("surface").agg(*(F.max(F.when(F.col("pos") == pos, F.col("lemma"))).alias(f"__{pos}") for pos in "vn"))
    rows, filled = df.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias(tokens)), F.col(tokens)
    few = own.limit(LITERAL_LEXICON + 1).collect()
    if len(few) <= LITERAL_LEXICON:
        return rows.select(key, lemmatize(filled, {pos: {r["surface"]: r[f"__{pos}"] for r in few if r[f"__{pos}"] is not None} for pos in "vn"}).alias(tokens))
    lemma = F.when(F.col("__v") != F.col("surface"), F.col("__v")).otherwise(F.coalesce("__n", "surface"))
    changed = own.where(~F.col("surface").rlike("[-0-9]")).select("surface", lemma.alias("lemma")).where("lemma <> surface")
    each = rows.select(F.col(key).alias("__key"), F.explode(F.array_distinct(filled)).alias("surface")).join(changed, "surface")
    own_map = each.groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("surface", "lemma"))).alias("__map"))  # one row's tokens
    found = rows.join(own_map, F.col(key).eqNullSafe(F.col("__key")), "left")
    return found.select(key, F.when(F.col("__map").isNull(), filled).otherwise(F.transform(filled, lambda t: F.coalesce(F.col("__map")[t], t))).alias(tokens))


def clean_tokens(c: Column, lexicon: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """Normalised words without stopwords (dropped before lemmas are taken), as an array; [] for null or empty."""
    return lemmatize(drop_stopwords(F.split(normalize(c), " ")), lexicon)


def clean_text(c: Column, lexicon: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    return F.array_join(clean_tokens(c, lexicon), " ")


def clean_row(columns: Sequence[Column], lexicon: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """All non-empty columns of a row, joined and cleaned as one text."""
    return clean_text(F.concat_ws(" ", *(F.when(c != "", c) for c in columns)), lexicon)


def raw_document(columns: Sequence[Column]) -> Column:
    """The columns that aren't blank, a line each, as they are."""
    return F.concat_ws("\n", *(F.when(collapse_space(c) != "", c) for c in columns))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{UNICODE_SPACE}|{UNICODE_SPACE}$", "")


def natural_text(columns: Sequence[Column]) -> Column:
    """The columns that aren't blank, stripped and joined by full stops."""
    return F.concat_ws(". ", *(F.nullif(strip(c), F.lit("")) for c in columns))


# --- query rewriting ----------------------------------------------------------------------


def _families() -> dict[str, str]:
    """Compact and spaced spellings of codes and forms, and compounds, to their hyphenated form."""
    out: dict[str, str] = {}
    for letter, digits in (("f", "12"), ("m", "12"), ("j", "12"), ("b", "12")):
        for d in digits:
            out |= {f"{letter}{d}": f"{letter}-{d}", f"{letter} {d}": f"{letter}-{d}"}
    out |= dict.fromkeys(("h1b", "h 1b", "h 1 b", "h1-b"), "h-1b")
    for n in (9, 17, 20, 94, 129, "290b", 515, "515a", 539, 765, 766, 797, "797a", 901, 983):
        out |= {f"i{n}": f"i-{n}", f"i {n}": f"i-{n}"}
    for a, b in (("w", "7"), ("ds", "2019")):
        out |= {a + b: f"{a}-{b}", f"{a} {b}": f"{a}-{b}"}
    hyphened = "cap-gap e-verify full-time k-12 off-campus on-campus part-time post-completion post-secondary pre-completion re-enter re-entry sevp-certified ssa-l676 transfer-in transfer-out up-to-date"
    out |= {x.replace("-", " "): x for x in hyphened.split()}
    return out | {"everify": "e-verify", "my e verify": "mye-verify"}


#: Abbreviations, spelled as documents spell them.
EXPANSIONS = {
    "cbp": "customs border protection", "cpt": "curricular practical training", "opt": "optional practical training",
    "dmv": "department motor vehicles", "dhs": "department homeland security", "ead": "employment authorization document",
    "ssa": "social security administration", "ssn": "social security number", "dsos": "designated school officials", "dso": "designated school official",
    "itin": "individual taxpayer identification number", "irs": "internal revenue service", "uscis": "united states citizenship immigration services",
    "sevp": "student exchange visitor program", "sevis": "student exchange visitor information system",
}


def rewrite_rules() -> list[tuple[str, str]]:
    """(source, target), longest source first, so that a phrase goes before its parts."""
    return sorted((_families() | EXPANSIONS).items(), key=lambda kv: (-len(kv[0]), kv[0]))


def rewrite_query(c: Column, rules: Sequence[tuple[str, str]] | None = None) -> Column:
    """Query terms as the index spells them. A chain of regular expressions: for the query side only."""
    edge = "[a-zA-Z0-9-]"
    return reduce(lambda acc, rule: F.regexp_replace(acc, rf"(?<!{edge})\Q{rule[0]}\E(?!{edge})", rule[1]), rules if rules is not None else rewrite_rules(), F.lower(F.coalesce(c, F.lit(""))))


def clean_query(c: Column, lexicon: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    return clean_text(rewrite_query(c), lexicon)


# --- display and prompts ------------------------------------------------------------------


def markdown_to_html(c: Column) -> Column:
    """Escaped text with bold and italic marks and line breaks as tags."""
    steps = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;"))
    out = reduce(lambda acc, s: F.replace(acc, F.lit(s[0]), F.lit(s[1])), steps, F.coalesce(c, F.lit("")))
    for pattern, into in ((r"(?s)\*\*\*(.*?)\*\*\*", "<strong><em>$1</em></strong>"), (r"(?s)\*\*(.*?)\*\*", "<strong>$1</strong>"), (r"(?s)\*(.*?)\*", "<em>$1</em>")):
        out = F.regexp_replace(out, pattern, into)
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))
