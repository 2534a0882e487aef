"""Quality rules that clean line by line first and judge the document by what is left, with DataFrame functions only.

Each line is held against three rules: navigation (menu words, or parts between separators),
boilerplate (fixed phrases of notices and page furniture) and punctuation (many symbols for its words,
or a sentence's length without any mark). Failing lines go. A document that loses more than a share of
its letters with them goes as a whole, as does one that fails the base rules on its length and on
repeated passages. Everything is local to a row: no row moves, however common a line may be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_MARK = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·→"
MARKS = r"[.!?,;:…。！？、，；：]"
# Fixed phrases, matched on lower-cased lines.
MENU = (
    r"^[^a-z]*(home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|next page|previous|previous page|back|back to top|"
    r"skip to content|skip to main content|contact|contact us|about|about us|site ?map|share|tweet|reply|read more|load more|"
    r"show more|comments|leave a comment|print|close|faq|help)[^a-z]*$"
)
BOILERPLATE = (
    r"(all rights reserved|copyright (©|\(c\)|[0-9]{4})|© ?[0-9]{4}|terms of (use|service)|privacy policy|cookie policy|"
    r"(use|uses|using|accept|accepting) (all )?cookies|(enable|requires|turn on) javascript|lorem ipsum|"
    r"subscribe to our newsletter|click here to|powered by [a-z]|licen[cs]ed under|spdx-license-identifier|"
    r"permission is hereby granted, free of charge)"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are in percent."""

    least_words: int = 20
    repeat_share: int = 30
    window: int = 8  # a power of two
    words_per_symbol: int = 3
    words_per_separator: int = 4
    sentence_words: int = 8
    lost_share: int = 50


def occurrences(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def failure(line: Column, rules: LineRules) -> Column:
    """The first rule that a line fails: navigation, boilerplate or punctuation; null where it passes or has no word.

    Its words are only counted where a rule needs their number.
    """
    words, between = F.size(words_of(line)), occurrences(line, SEPARATORS)
    menu = line.rlike(f"(?i){MENU}") | (line.rlike(f"[{SEPARATORS}]") & (between >= 2) & (rules.words_per_separator * between >= words))
    dense = line.rlike(f"[{SYMBOLS}]") & (rules.words_per_symbol * occurrences(line, SYMBOLS) > words)
    return (
        F.when(~line.rlike(WORD_MARK), F.lit(None).cast("string"))
        .when(menu, "navigation").when(line.rlike(f"(?i){BOILERPLATE}"), "boilerplate")
        .when(dense | (~line.rlike(MARKS) & (words >= rules.sentence_words)), "punctuation")
    )


def repeated_words(df: DataFrame, words: str, window: int) -> DataFrame:
    """Adds n_repeat_words: words in windows of ``window`` words that are found twice or more in the row's list.

    Windows are compared by 64-bit hashes. Their places are only sorted where some hash repeats.
    """
    none = F.array().cast("array<bigint>")
    hashed = df.withColumn("_1", F.transform(words, lambda w: F.xxhash64(w)))
    width = 1
    while width < window:  # each step joins neighbours, so that a hash stands for twice as many words
        left = F.slice(f"_{width}", 1, F.size(f"_{width}") - width)
        right = F.slice(f"_{width}", width + 1, F.size(f"_{width}") - width)
        pairs = F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))
        hashed = hashed.withColumn(f"_{2 * width}", F.when(F.size(f"_{width}") > width, pairs).otherwise(none)).drop(f"_{width}")
        width *= 2
    hashed = hashed.withColumnRenamed(f"_{width}", "_windows")
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")))

    def beside(k: Column, s: Column) -> Column:
        return F.coalesce(F.get("_ordered", k)["h"] == s["h"], F.lit(False))

    again = F.filter("_ordered", lambda s, k: beside(k - 1, s) | beside(k + 1, s))
    places = F.array_sort(F.transform(again, lambda s: s["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
    covered = F.aggregate(
        places, start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).cast("long").alias("n"), i.alias("last")),
        lambda a: a["n"])
    return hashed.withColumn("n_repeat_words", covered).drop("_windows", "_ordered")


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: doc_id, cleaned text, the base figures, n_lines, removed (counts by rule), lost_chars, base_failed, kept.

    Words are runs without ASCII white space; lines are cut at each newline, and only lines with a word
    are judged, counted or removed. Null counts as the empty text, which has no words and fails the base
    rules; ``text`` is then empty. Rows are judged one by one: repeated ids and repeated rows each give a
    row of their own, a null id is handed through, an empty table gives an empty result, and further
    columns are ignored, whatever their names.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    split = rows.select("doc_id", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n", -1).alias("lines"))
    figures = repeated_words(split, "words", rules.window).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        occurrences(F.col("text"), SYMBOLS).alias("n_symbols"), "n_repeat_words",
        F.filter("lines", lambda x: x.rlike(WORD_MARK)).alias("worded"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), failure(x, rules).alias("fails"))).alias("judged"))
    cleaned = figures.select(
        "*", F.array_join(F.transform(F.filter("judged", lambda x: x["fails"].isNull()), lambda x: x["line"]), "\n").alias("text"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        ((F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_share * F.col("n_words"))).alias("base_failed"))

    def failing(rule: str) -> Column:
        return F.size(F.filter("judged", lambda x: x["fails"].eqNullSafe(F.lit(rule)))).cast("long").alias(rule)

    gone = F.array_join(F.transform(F.filter("judged", lambda x: x["fails"].isNotNull()), lambda x: x["line"]), "")
    lost = F.length(F.regexp_replace(gone, SPACE_RUN, "")).cast("long")
    measured = cleaned.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.size("worded").cast("long").alias("n_lines"),
        F.struct(failing("navigation"), failing("boilerplate"), failing("punctuation")).alias("removed"),
        lost.alias("lost_chars"), "base_failed")
    return measured.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.lost_share * F.col("word_chars")))
