r"""Line-first cleaning, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules and failing lines are removed; a
document that loses too much of its text that way is rejected. Nothing is shuffled: every rule is an
expression over one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a sentence or a quoted one ends in.
TERMINAL = (".", "!", "?", ":", ";", '"', "'", ")", "]", "}", "…", "»", "”", "’", "。", "！", "？")
#: Characters that set menu entries apart.
SEPARATORS = "[|>»•·]"
#: Characters that prose has few of.
NOISE = r"[!#*$%&|<>{}~^=]"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "javascript",
    "cookie",
    "lorem ipsum",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "sign up for our newsletter",
    "click here",
)
_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once and never laid out as a row between two steps."""
    return F.get(F.transform(F.array(value), body), 0)


def _replaced(text: Column, instead: str = "") -> Column:
    """White space by literal search, which is much cheaper than `translate`."""
    for c in _SPACES:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def line_passes(line: Column, max_noise: float = 0.06, max_separators: float = 0.04, short: int = 80) -> Column:
    """Whether a line with a word is text: few of its characters are noise; it ends as a sentence does,
    holds the end of one or is short; it isn't a menu, of three separators or more, that many for its length; and it holds
    no boilerplate phrase."""
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    menu = (separators >= 3) & (separators >= max_separators * F.length(line))
    bare = F.rtrim(F.replace(F.replace(line, F.lit("\r"), F.lit(" ")), F.lit("\t"), F.lit(" ")))
    ended = reduce(or_, [F.endswith(bare, F.lit(c)) for c in TERMINAL])
    furniture = _let(F.lower(line), lambda x: reduce(or_, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))
    return (
        (F.regexp_count(line, F.lit(NOISE)) <= max_noise * F.length(line))
        & ((F.length(line) <= short) | ended | F.contains(line, F.lit(". ")))
        & ~menu
        & ~furniture
    )


def _counted(words: Column) -> Column:
    """Number of words, and of those that stand in a 3-word window found twice or more.

    Windows are compared by 64-bit hash: they are sorted, so that equal ones are neighbours, and each
    repeated one covers three words, or as many as there are up to the next repeated one.
    """

    def repeats(keyed: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce(x["k"] == other["k"], F.lit(False))

        again = F.filter(keyed, lambda x, j: same(x, F.get(keyed, j + 1)) | same(x, F.get(keyed, j - 1)))
        return F.aggregate(
            F.sort_array(F.transform(again, lambda x: x["i"])),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )

    def placed(keys: Column) -> Column:
        # Most texts repeat no window, and then nothing needs sorting.
        keyed = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        some = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(some, _let(F.sort_array(keyed), repeats)).otherwise(F.lit(0).cast("long"))

    keys = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    repeated = F.when(F.size(words) >= 3, _let(keys, placed)).otherwise(F.lit(0).cast("long"))
    return F.struct(F.size(words).cast("long").alias("n_words"), repeated.alias("n_repeat_words"))


def clean_lines(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_kept: float = 0.5,
) -> DataFrame:
    """One row per row of `docs`: doc_id, base counts, verdicts, and `cleaned`, the text of the lines
    that pass.

    Null text is empty and fails for want of words. Repeated rows are judged each; other columns are
    neither read nor returned. `kept` needs the base rules and at least `min_kept` of the characters
    in words to be on passing lines.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        # Splitting at a plain character needs no regular expression.
        _let(F.array_remove(F.split(_replaced(F.col("text"), " "), " "), ""), _counted).alias("counted"),
        F.length(_replaced(F.col("text"))).cast("long").alias("word_chars"),
        F.regexp_count(F.col("text"), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(
            F.filter(F.split("text", "\n"), lambda x: F.length(F.ltrim(x, F.lit(_SPACES))) > 0),
            lambda lines: F.struct(
                F.size(lines).cast("long").alias("n_lines"),
                F.size(F.array_distinct(lines)).cast("long").alias("n_kinds"),
                F.filter(lines, lambda x: line_passes(x)).alias("good"),
            ),
        ).alias("lines"),
    )
    out = base.select(
        "doc_id",
        "counted.n_words",
        "word_chars",
        "n_symbols",
        (F.col("lines.n_lines") - F.col("lines.n_kinds")).alias("n_dup_lines"),
        "counted.n_repeat_words",
        "lines.n_lines",
        (F.col("lines.n_lines") - F.size("lines.good")).alias("n_removed_lines"),
        F.array_join("lines.good", "\n").alias("cleaned"),
    )
    out = out.withColumn("cleaned_chars", F.length(_replaced(F.col("cleaned"))).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    enough = F.col("cleaned_chars") >= min_kept * F.col("word_chars")
    return out.withColumn("kept", ~F.col("base_failed") & enough)
