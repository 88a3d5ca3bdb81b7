"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` lists measures of a text with the least and greatest value allowed; ``verdicts`` compiles
the table into one column each and their conjunction.  Only built-in expressions are used: no
user function, no shuffle, so a hot source or a group of copies costs nothing extra.

Defined cases: a null or empty text, or one of white space only, has no words: every count is 0, all ratios
are 0, ``base_failed`` is true and ``kept`` false.  Equal rows get equal results, an empty table gives
an empty result, columns of the input other than ``text`` are never read: ``measure`` returns ``key`` and
its own columns, ``accepted`` the input's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.work import GAP, stage

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on as with be at by this from or an are not "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "de la le et les des en un une du est pour que qui dans par sur pas plus au "
    "el los las que y una por con para su del se lo como más o al"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range of values that pass."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The method's table.  Ratios are per word, per line or per code point as their names say.
RULES = (
    Rule("mean_word", "chars_per_word", 1.5, 24.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("dup_lines", "dup_lines_per_line", None, 0.6),
    Rule("stop_words", "stop_words_per_word", 0.01, None),
    Rule("letters", "letters_per_char", 0.5, None),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measure(docs: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its key, the counts, the ratios and the two verdicts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda x: F.char_length(F.translate(x, " \t\n\x0b\f\r", "")) > 0
    split = docs.select(
        key,
        text.alias("_text"),
        F.filter(F.split(text, GAP), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), has_word).alias("_lines"),
    )
    n = F.size("_words")
    hashed = split.select(
        "*",
        F.when(
            n > WINDOW,
            F.transform(
                F.sequence(F.lit(1), n - F.lit(WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_windows"),
    )
    # Only texts with a repeated window pay for the sort below.
    paired = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_pairs"),
    )
    last = F.size("_pairs") - 1
    same = lambda j, k: F.col("_pairs")[j]["h"] == F.col("_pairs")[k]["h"]
    starts = paired.select(
        "*",
        F.when(
            F.col("_pairs").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), last),
                        lambda k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0))))
                        | ((k < last) & same(k, F.least(k + 1, last))),
                    ),
                    lambda k: F.col("_pairs")[k]["i"],
                )
            ),
        ).alias("_starts"),
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(
            i.alias("last"),
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("bigint").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    stop = F.filter("_words", lambda w: F.lower(F.translate(w, ".,;:!?\"'()", "")).isin(STOP_WORDS))
    counts = starts.select(
        key,
        n.cast("bigint").alias("n_words"),
        _without(F.col("_text"), " \t\n\x0b\f\r").cast("bigint").alias("word_chars"),
        (F.char_length("_text") - _without(F.col("_text"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(stop).cast("bigint").alias("n_stop_words"),
        F.char_length(F.regexp_replace("_text", r"[\x00-@\[-`{-\x7f]", "")).cast("bigint").alias("n_letters"),
    )
    ratios = counts.select(
        "*",
        _ratio("word_chars", "n_words").alias("chars_per_word"),
        _ratio("n_symbols", "n_words").alias("symbols_per_word"),
        _ratio("n_dup_lines", "n_lines").alias("dup_lines_per_line"),
        _ratio("n_stop_words", "n_words").alias("stop_words_per_word"),
        _ratio("n_letters", "word_chars").alias("letters_per_char"),
    )
    return verdicts(ratios, rules)


def verdicts(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``base_failed``, the names of the broken rules and ``kept``: the table as one projection."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)
    broken = []
    for rule in rules:
        value = F.col(rule.measure)
        outside = F.lit(False)
        if rule.least is not None:
            outside = outside | (value < rule.least)
        if rule.most is not None:
            outside = outside | (value > rule.most)
        broken.append(F.when(outside, F.lit(rule.name)))
    named = measured.select(
        "*",
        failed.alias("base_failed"),
        (F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).alias("broken"),
    )
    return named.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  The judged rows are written to the work folder once."""
    inner = docs.select(F.struct("*").alias("_row"), "text")
    # Written before it is filtered: a filter makes Spark derive constraints from the whole chain of
    # projections, which takes it minutes of planning.
    judged = stage(measure(inner, "_row", rules).select("_row", "kept"), "judged")
    return judged.where("kept").select("_row.*")
