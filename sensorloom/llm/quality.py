"""Line-first cleaning of documents.

Every line is judged by itself: by punctuation, as navigation, as boilerplate and by its share of symbols. Failing lines
go; a document that loses more than ``MOST_LOST`` of its word characters with them is rejected. Documents that are too
short or repeat themselves are rejected before that. All of it is one pass of expressions over the
text, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import WORD, apart, pattern, restored

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
MOST_LOST = 0.5
# A line without an end of a sentence fails up to so many words.
UNENDED_WORDS = 5
# Every so many words of a line may be a separator of links, or be shouted, before the line fails.
LINK_WORDS = 5
SHOUT_WORDS = 4

# White space is ASCII and ends are ends of the line in every engine.
SENTENCE_END = r"[.!?:;,\x{2026}\x{3002}\x{FF01}\x{FF1F}][\"'\x{201D}\x{2019}\x{00BB})\]]*[\x20\x09-\x0D]*\z"
SEPARATOR = r"[\x20\x09][|\x{00BB}\x{203A}>\x{2022}\x{00B7}/-]([\x20\x09]|\z)"
SHOUT = r"[!?]{2,}"
NAVIGATION = (
    r"(?i)\A[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|register|search|contact( us)?|about( us)?|sitemap"
    r"|next|previous|back to top|read more|click here|share( this)?)[\x20\x09-\x0D|>]*\z"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright \(c\)|terms (of|and) (use|service|conditions)|privacy policy|cookie policy"
    r"|(uses|use of|accept( all)?) cookies|enable javascript|subscribe to our newsletter|lorem ipsum)"
)
SYMBOL_SHARE = 0.1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, pattern(WORD), F.lit(0))


def _letters(text: Column) -> Column:
    """Code points in words."""
    return F.length(text) - F.regexp_count(text, pattern(r"[\x20\x09-\x0D]"))


def line_fails(line: Column) -> Column:
    """Whether a line breaks one of the rules. Blank lines pass: they carry nothing."""
    words = F.regexp_count(line, pattern(WORD))
    symbols = F.regexp_count(line, pattern(SYMBOLS))
    unended = ~line.rlike(SENTENCE_END) & (words <= UNENDED_WORDS)
    links = F.regexp_count(line, pattern(SEPARATOR))
    navigation = (links >= 2) & (links * LINK_WORDS >= words) | line.rlike(NAVIGATION)
    shouts = F.regexp_count(line, pattern(SHOUT))
    noisy = (symbols > SYMBOL_SHARE * F.length(line)) | (shouts >= 2) & (shouts * SHOUT_WORDS >= words)
    return (words > 0) & (unended | navigation | noisy | line.rlike(BOILERPLATE))


def _repeated(windows: Column) -> Column:
    """Number of words in windows that occur twice or more, from sorted (hash, place) structs of 3-word windows."""

    def same(i: Column, other: Column) -> Column:
        return F.coalesce(F.get(windows, i).getField("h") == F.get(windows, other).getField("h"), F.lit(False))

    twice = F.filter(windows, lambda w, i: same(i, i - 1) | same(i, i + 1))
    return F.sort_array(F.transform(twice, lambda w: w.getField("at")))


def _covered(places: Column, width: int) -> Column:
    gaps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(width)), F.lit(width)))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = ("base_failed", "n_bad_lines", "clean_text", "lost_share", "kept")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with a ``_text`` and, of it, the counts and the lines."""
    words, windows = F.col("_words"), F.col("_windows")
    places = F.when(
        F.size(words) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(
                    F.xxhash64(F.array(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))).alias("h"),
                    i.alias("at"),
                ),
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    lines = F.filter("_lines", lambda line: line.rlike(WORD))
    return (
        rows.withColumns({"_words": _words(F.col("_text")), "_lines": F.split("_text", "\n", -1)})
        .withColumns({"_windows": places, "_worded": lines})
        .withColumn("_places", _repeated(windows))
        .withColumns(
            {
                "n_words": F.size(words).cast("long"),
                "word_chars": _letters(F.col("_text")).cast("long"),
                "n_symbols": F.regexp_count("_text", pattern(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
                "n_repeat_words": _covered(F.col("_places"), 3).cast("long"),
            }
        )
        .drop("_words", "_windows", "_worded", "_places")
    )


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST, text: str = "text") -> DataFrame:
    """Documents with the counts above, ``base_failed``, ``n_bad_lines``, ``clean_text`` (the lines that pass),
    ``lost_share`` of the word characters and ``kept``.

    NULL and empty texts have no words and are not kept. Columns with these names are replaced.
    """
    counted = _counted(apart(docs, _text=F.coalesce(F.col(text), F.lit(""))))
    passing = F.filter("_lines", lambda line: ~line_fails(line))
    cleaned = counted.withColumn("_passing", passing).withColumn("clean_text", F.array_join("_passing", "\n"))
    lost = 1 - _letters(F.col("clean_text")) / F.greatest(F.col("word_chars"), F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = (
        cleaned.withColumns(
            {
                "base_failed": failed,
                "n_bad_lines": (F.size("_lines") - F.size("_passing")).cast("long"),
                "lost_share": F.when(F.col("word_chars") > 0, lost).otherwise(0.0),
            }
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= most_lost))
    )
    return restored(judged, docs.columns, **{name: F.col(name) for name in COUNTS + VERDICT})


def quality_digest(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines"
    )
