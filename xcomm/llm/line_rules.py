"""Line-first cleaning with DataFrame functions only.

Every line is judged by rules on punctuation, navigation and boilerplate; failing lines go, and a
document that loses too much of its text goes as a whole.  All work is on the row itself: no
shuffle, whatever the lengths of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, words

#: A document that keeps less than this share (percent) of its words is rejected.
LEAST_KEPT = 50
SYMBOLS = "#*$%&|<>"

# Rules for one line, as patterns that Java and RE2 read alike.
#: A run of symbols at the end of a word; a line fails when 30 % of its words end so.
SYMBOL_RUN = r"[#*$%&!?<>|~^=+_]{2,}([\x20\x09-\x0D]|$)"
SYMBOL_SHARE = 30
#: Ends as a sentence does (closing quotes and brackets may follow).
ENDS = r"[.!?…。！？:;][\"'”’»)\]]*$"
#: A line without such an end fails when it has fewer words than this.
SHORT = 3
#: Menus: three or more separators that stand alone, or nothing but menu words.
SEPARATOR = r"(^|[\x20\x09-\x0D])([|»›•·>/-]|::)([\x20\x09-\x0D]|$)"
MENU = r"(?i)^[^a-z]*((home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|back|top|share|sitemap|faq|help)[^a-z]*)+$"
#: Boilerplate fails a line of at most so many words.
BOILERPLATE = r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|(uses?|accept) cookies|click here|read more|subscribe (now|to)|sign up (for|to)|enable javascript|javascript (is|must)|share (this|on)|follow us|lorem ipsum|page not found)"
BOILERPLATE_WORDS = 30


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule.  Lines without words never count either way."""
    n = _count(line, WORD)
    punctuation = (_count(line, SYMBOL_RUN) * 100 >= SYMBOL_SHARE * n) | ((n < SHORT) & ~line.rlike(ENDS))
    navigation = ((_count(line, SEPARATOR) >= 3) & (_count(line, SEPARATOR) * 4 >= n)) | line.rlike(MENU)
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return (n > 0) & (punctuation | navigation | boilerplate)


def base_counts(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Repeats: the words of a text are hashed, each three consecutive hashes to one long; windows
    sorted by that long stand next to their repeats; the covered words follow from the sorted
    starts of repeated windows, each of which covers at most three words up to the next start.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    step = rows.withColumns(
        {
            "_h": F.transform(words(F.col(text)), lambda w: F.xxhash64(w)),
            "_lines": lines,
            "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    ).withColumns(
        {
            "n_words": F.size("_h").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_w": F.transform(
                F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(F.col("_h"), i + 1), F.get(F.col("_h"), i + 2)),
            ),
        }
    )
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def repeated(x: Column, i: Column) -> Column:
        near = F.coalesce(F.get(F.col("_sorted"), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(F.col("_sorted"), i + 1)["h"] == x["h"], F.lit(False)
        )
        return F.when(near, x["i"])

    step = step.withColumn("_starts", F.array_sort(F.array_compact(F.transform("_sorted", repeated))))
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_starts"), i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return step.withColumn("base_failed", failed).drop("_h", "_lines", "_w", "_sorted", "_starts")


def clean_lines(docs: DataFrame, text: str = "text", least_kept: int = LEAST_KEPT) -> DataFrame:
    """Judge every document of ``docs``.

    Returns ``row`` (struct of all columns, whatever their names), the base counts, ``cleaned``
    (the text without its failing lines), ``n_kept_words``, ``n_failed_lines`` and ``kept``: true
    when the base counts pass and at least ``least_kept`` percent of the words are left.  Null and
    empty texts have no words and are not kept.  Equal rows get equal results; an empty table gives
    an empty result.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    counted = base_counts(rows, "_text")
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n")
    good = F.filter(lines, lambda x: ~line_fails(x))
    judged = counted.withColumn("_good", good).withColumns(
        {
            "cleaned": F.array_join("_good", "\n"),
            "n_failed_lines": (F.size(lines) - F.size("_good")).cast("long"),
        }
    )
    judged = judged.withColumn("n_kept_words", F.regexp_count(F.col("cleaned"), F.lit(WORD)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_kept_words") * 100 >= F.col("n_words") * least_kept)
    return judged.withColumn("kept", kept).drop("_text", "_good")
