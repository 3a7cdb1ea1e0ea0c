"""Quality rules, line first: lines that fail a punctuation, navigation or boilerplate rule go, then documents that lost
too much text go. Everything is a column expression; nothing is shuffled.

Long expressions are kept apart by an ``explode`` of a one-element array: Spark would otherwise inline a word array into
the functions that index it and split the text again for each element.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

BLANKS = " \t\n\x0b\f\r"
# Marks that end a sentence, and what may close after them.
ENDING, CLOSING = ".!?:;\u2026\u3002\uFF01\uFF1F", "\"')]\u00BB\u201D\u2019"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict."""

    words_per_mark: int = 50       #: a line that doesn't end in a mark needs one sentence mark in so many words
    words_per_shout: int = 3       #: fails with more than one ``!`` or ``?`` in so many words
    words_per_bar: int = 8         #: navigation: one separator in so many words, two at least
    chars_per_symbol: int = 10     #: boilerplate: one symbol in so many characters, three at least
    phrase_words: int = 15         #: a boilerplate phrase fails lines of at most so many words
    max_lost: float = 0.5          #: documents that lose more than this share of their word characters go


# Phrases of page furniture, compared in lower case.
PHRASES = ["accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "log in to",
           "powered by", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to",
           "terms of service", "terms of use", "use of cookies"]


def _column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later projections read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _count(text: Column, characters: str) -> Column:
    """Occurrences of the characters, by what replacing each takes from the bytes."""
    found = [(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c)))) / F.lit(len(c.encode())) for c in characters]
    return sum(found[1:], found[0]).cast("long")


def _line_fails(line: Column, r: Rules) -> Column:
    """Null-free verdict on one line (``line``, ``trimmed``, ``words``) that has a word."""
    trimmed, n = line["trimmed"], F.size(line["words"]).cast("long")
    # Closing marks may follow the mark a line ends in.
    ends = F.right(F.rtrim(trimmed, F.lit(CLOSING)), F.lit(1)).isin(*ENDING)
    marks = _count(trimmed, ".!?")
    shouts, bars, symbols = _count(trimmed, "!?"), _count(trimmed, "|»›•"), _count(trimmed, "#*$%&|<>")
    punctuation = (~ends & (marks * r.words_per_mark < n)) | (shouts * r.words_per_shout > n)
    navigation = (bars >= 2) & (bars * r.words_per_bar >= n)
    phrase = (n <= r.phrase_words) & F.lower(trimmed).rlike("|".join(PHRASES))
    boilerplate = phrase | ((symbols >= 3) & (symbols * r.chars_per_symbol >= F.length(trimmed)))
    return punctuation | navigation | boilerplate


def evaluate(df: DataFrame, keep: list[str], rules: Rules = Rules()) -> DataFrame:
    """Adds the counts, ``base_failed``, ``lost`` (share of word characters in failed lines), ``cleaned`` and ``kept`` to ``keep``.

    ``df`` has the column ``text``; other columns are not read. Null, empty and blank texts have no words, fail the base rule and are
    cleaned to an empty text. Lines without a word never fail and stay. A line repeated in a text is a duplicate from its second
    occurrence on; duplicates are counted, not removed.
    """
    keys = F.struct(*[frames.col(c) for c in keep])
    df = df.select(keys.alias("_keep"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    empty, longs = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    # Words never cross a line, so each line is trimmed and split once and the text's words are those of its lines.
    df = _column(df, "_trimmed", F.transform(F.split("_text", "\n", -1), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("trimmed"))))
    df = _column(df, "_lines", F.transform("_trimmed", lambda x: F.struct(
        x["line"].alias("line"), x["trimmed"].alias("trimmed"),
        F.when(x["trimmed"] == "", empty).otherwise(F.split(x["trimmed"], "[\\x20\\x09-\\x0D]+", -1)).alias("words"))))
    df = _column(df, "_hashes", F.transform(F.flatten(F.transform("_lines", lambda x: x["words"])), lambda w: F.xxhash64(w)))
    # Three-word windows from their words' hashes. Only texts where one occurs twice sort them with their places; equal neighbours
    # are repeats.
    hashes, n = F.col("_hashes"), F.size("_hashes")
    df = _column(df, "_windows", F.when(n < 3, longs).otherwise(F.transform(
        F.slice("_hashes", 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))))
    df = _column(df, "_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    ranked = F.col("_sorted")

    def repeats(x: Column, j: Column) -> Column:
        return F.coalesce(F.get(ranked, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["h"] == x["h"], F.lit(False))

    none = F.array().cast("array<int>")
    df = _column(df, "_places", F.when(ranked.isNull(), none).otherwise(F.sort_array(F.transform(F.filter(ranked, repeats), lambda x: x["i"]))))
    places = F.col("_places")
    full = F.transform(F.filter("_lines", lambda x: x["trimmed"] != ""), lambda x: x["line"])
    df = _column(df, "_full", full)
    kept = F.filter("_lines", lambda x: (x["trimmed"] == "") | ~_line_fails(x, rules))
    df = _column(df, "_cleaned", F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    word_chars = lambda text: F.length(text) - _count(F.col(text), BLANKS)
    df = df.select(
        *[F.col("_keep").getField(c).alias(c) for c in keep],
        F.size("_hashes").cast("long").alias("n_words"),
        word_chars("_text").alias("word_chars"),
        _count(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.aggregate(F.transform("_places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3)))),
                    F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.col("_cleaned").alias("cleaned"), word_chars("_cleaned").alias("_left"),
    )
    n_words, chars = F.col("n_words"), F.col("word_chars")
    df = df.withColumn("base_failed", (n_words < 50) | (100 * F.col("n_repeat_words") > 50 * n_words))
    df = df.withColumn("lost", F.when(chars == 0, F.lit(1.0)).otherwise(1.0 - F.col("_left") / chars)).drop("_left")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.max_lost))


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with their cleaned text; other columns and repeated rows stay as they are."""
    found = evaluate(frames.packed(docs, text), ["doc"], rules).where("kept")
    return frames.unpacked(found, docs.columns, text, F.col("cleaned"))
