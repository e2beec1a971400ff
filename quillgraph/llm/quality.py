"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text or fail a base rule go.

All in DataFrame expressions on the document's own row: no shuffle, no Python. Rules for a line with at least one word:

- punctuation: at least ``line_symbols`` characters of ``#*$%&|<>`` and more than ``symbols_per_word`` for each word;
- navigation: at least ``separators`` separators (``|``, ``»``, ``›``, ``•``) with at most ``words_per_separator`` words each;
- boilerplate: at least three ``!`` and more than ``shouts_per_word`` for each word, or short and with a phrase of PHRASES.

Lines without a word are kept as they are. A document's text after cleaning is its remaining lines. A null text counts as
empty: no words, so the base rule rejects it. Every row is judged by itself; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: White space of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
#: Phrases of page furniture; they only count in lines of at most PHRASE_WORDS words.
PHRASES = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "sign up for our newsletter", "subscribe to our newsletter", "click here to", "javascript is disabled", "enable javascript", "lorem ipsum", "add to cart", "skip to content")
PHRASE_WORDS = 20

DEFAULTS = {"line_symbols": 3, "symbols_per_word": 0.3, "separators": 3, "words_per_separator": 3, "shouts_per_word": 0.5, "max_lost": 0.3, "min_words": 10, "max_repeat": 0.2}


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def has_word(line: Column) -> Column:
    return line.rlike("[^ \\t-\\r]")


def repeated_words(words: Column, size: int = 5) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice or more in the array.

    Windows are compared by a 64-bit hash chained over their words. Most texts have no window twice, which a hash set shows; only
    for the others windows are sorted with their places, and covered words counted from place to place.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(size)]))

    def places(placed: Column) -> Column:
        """Starts of windows that equal the next or the previous of the sorted ones."""
        near = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def count(ws: Column) -> Column:
        placed = F.array_sort(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), 0).otherwise(bound(bound(placed, places), covered))

    return bound(F.when(n >= size, hashes).otherwise(F.array().cast("array<bigint>")), count).cast("long")


def line_fails(line: Column, rules: dict) -> Column:
    """Whether a line fails a rule; false for lines without a word."""
    # Words of a line: each becomes one character, then white space goes.
    n = F.length(F.regexp_replace(F.regexp_replace(line, "[^ \\t-\\r]+", "w"), "[ \\t-\\r]+", ""))

    def judged(x: Column) -> Column:
        heavy = (x["symbols"] >= rules["line_symbols"]) & (x["symbols"] > x["n"] * rules["symbols_per_word"])
        nav = (x["bars"] >= rules["separators"]) & (x["n"] <= x["bars"] * rules["words_per_separator"])
        shout = (x["shouts"] >= 3) & (x["shouts"] > x["n"] * rules["shouts_per_word"])
        return (x["n"] > 0) & (heavy | nav | shout | (x["phrase"] & (x["n"] <= PHRASE_WORDS)))

    figures = F.struct(n.alias("n"), occurrences(line, SYMBOLS).alias("symbols"), occurrences(line, "!").alias("shouts"), occurrences(line, SEPARATORS).alias("bars"), has_phrase(line).alias("phrase"))
    return bound(figures, judged)


def has_phrase(text: Column) -> Column:
    return F.lower(text).rlike("|".join(PHRASES))


def quality_rules(df: DataFrame, text_col: str = "text", **changes: float) -> DataFrame:
    """``df`` with a column ``quality``: a struct of the base figures, ``clean_text``, ``lost_chars``, ``base_failed``, ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` of them in repeated 5-word windows. ``kept``: not
    that, and the removed lines hold at most ``max_lost`` of the characters in words.
    """
    rules = DEFAULTS | changes
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n", -1)
    n_lines = bound(F.filter(lines, has_word), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    per_words = bound(
        words_of(text),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("chars"), repeated_words(ws).alias("n_repeat_words")),
    )
    # A line can only fail if its text has what the rule counts, so most texts are passed without a look at their lines.
    suspicious = (occurrences(text, SYMBOLS) >= rules["line_symbols"]) | (occurrences(text, "!") >= 3) | (occurrences(text, SEPARATORS) >= rules["separators"]) | has_phrase(text)
    clean = F.when(suspicious, F.array_join(F.filter(lines, lambda x: ~line_fails(x, rules)), "\n")).otherwise(text)
    names = [c for c in df.columns if c != "quality"]
    own = unused(names, "__figures")
    figures = df.select(
        *[F.col(f"`{c}`") for c in names],
        F.struct(
            per_words.alias("w"),
            occurrences(text, SYMBOLS).cast("long").alias("symbols"),
            n_lines.cast("long").alias("lines"),
            clean.alias("clean"),
            text.alias("text"),
            # Not deterministic, so a filter on the verdict stays above these figures and they aren't worked out a second time for it.
            F.monotonically_increasing_id().alias("row"),
        ).alias(own),
    )
    f = F.col(own)
    words, chars, repeated = f["w"]["n_words"], f["w"]["chars"], f["w"]["n_repeat_words"]
    lost = F.when(f["clean"] == f["text"], 0).otherwise(chars - F.length(without(f["clean"], SPACES)))
    if rules["max_repeat"] == DEFAULTS["max_repeat"]:  # in whole numbers
        base_failed = (words < rules["min_words"]) | (repeated * 100 > words * 20)
    else:
        base_failed = (words < rules["min_words"]) | (repeated > words * rules["max_repeat"])
    judged = F.struct(lost.cast("long").alias("lost"), base_failed.alias("failed"))
    with_lost = figures.withColumn(unused([*names, own], "__judged"), judged)
    j = F.col(with_lost.columns[-1])
    out = F.struct(
        words.alias("n_words"),
        chars.alias("word_chars"),
        f["symbols"].alias("n_symbols"),
        f["lines"].alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        f["clean"].alias("clean_text"),
        j["lost"].alias("lost_chars"),
        j["failed"].alias("base_failed"),
        (~j["failed"] & (j["lost"] <= chars * rules["max_lost"]) & (f["row"] >= 0)).alias("kept"),
    )
    return with_lost.select(*[F.col(f"`{c}`") for c in names], out.alias("quality"))
