"""Quality rules: a table of thresholds compiled into one projection, without user functions.

The measures are ratios of lengths, symbols, stop words, repeated words and lines. Each row of the table bounds one of
them; a text is kept if it meets all. Bounds are wide: they name junk, not style.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\\x20\\x09-\\x0D]+"

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = "the of and to in is that it for as with on be by this are at from or an le la les des de du un une et en que qui est pour dans sur au par pas avec der die das und ist nicht ein eine mit von zu den im auf für sie als el los las del y no se con por una su para al lo".split()

#: measure, least, most: null means no bound.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 16.0),
    ("symbol_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("upper_word_ratio", None, 0.6),
    ("dup_line_ratio", None, 0.6),
)


def _array_measures(words: str, lines: str) -> dict[str, str]:
    """Expressions over an array of words and an array of lines that hold a word."""
    windows = f"case when size({words}) >= 3 then transform(sequence(0, size({words}) - 3), i -> xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2))) else cast(array() as array<bigint>) end"
    return {
        "n_words": f"cast(size({words}) as bigint)",
        "word_chars": f"cast(length(array_join({words}, '')) as bigint)",
        "n_dup_lines": f"cast(size({lines}) - size(array_distinct({lines})) as bigint)",
        "windows": windows,
        "n_stop": f"size(filter({words}, w -> w in ({', '.join(repr(x) for x in STOP_WORDS)})))",
        "n_upper": f"size(filter({words}, w -> w rlike '^[^a-z]*[A-Z]{{2}}[^a-z]*$'))",
    }


#: Repeated windows up to which positions are found by looking each window up; more are found by sorting.
_FEW = 24


def _repeated_words() -> str:
    """Words in windows that occur twice or more, from ``windows`` (hashes by position) and ``sorted`` (the same, sorted).

    A window counts as many new words as it reaches beyond the repeated window before it, three at most.
    """
    twice = "array_distinct(filter(sorted, (x, i) -> i > 0 and x = get(sorted, i - 1)))"
    by_lookup = "filter(sequence(0, size(windows) - 1), i -> array_contains(twice, get(windows, i)))"
    pairs = "array_sort(transform(windows, (x, i) -> struct(x as h, i as i)))"
    by_sort = f"array_sort(transform(filter(transform({{p}}, (e, k) -> struct(e.i as i, coalesce(e.h = get({{p}}, k - 1).h, false) or coalesce(e.h = get({{p}}, k + 1).h, false) as again)), e -> e.again), e -> e.i))"
    return twice, by_lookup, pairs, by_sort.replace("{p}", "pairs")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures of each whole text to ``docs`` (null: no words), in columns listed in :data:`MEASURES`."""
    twice, by_lookup, pairs, by_sort = _repeated_words()
    keep = docs.columns
    rows = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("__w", F.expr(f"regexp_extract_all(__t, '{WORD}', 0)"))
    rows = rows.withColumn("__l", F.expr(r"filter(split(__t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    named = _array_measures("__w", "__l")
    rows = rows.select(*keep, F.expr(r"cast(length(__t) - length(translate(__t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"), F.expr("cast(size(__l) as bigint)").alias("n_lines"), *[F.expr(v).alias(k) for k, v in named.items()])
    rows = rows.withColumn("sorted", F.expr("sort_array(windows)")).withColumn("twice", F.expr(twice)).drop("sorted")
    pairs = f"case when size(twice) > {_FEW} then {pairs} end"
    rows = rows.withColumn("pairs", F.expr(pairs))
    rows = rows.withColumn("places", F.expr(f"case when size(twice) = 0 then cast(array() as array<int>) when size(twice) <= {_FEW} then {by_lookup} else {by_sort} end"))
    reach = "aggregate(transform(places, (x, k) -> least(3, x - coalesce(get(places, k - 1), -3))), 0, (a, x) -> a + x)"
    rows = rows.withColumn("n_repeat_words", F.expr(f"cast({reach} as bigint)"))
    per = lambda a, b: F.expr(f"coalesce(try_divide({a}, {b}), 0.0)")
    ratios = {"mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_word_ratio": per("n_stop", "n_words"), "upper_word_ratio": per("n_upper", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines")}
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *[v.alias(k) for k, v in ratios.items()])


def verdict(rules=RULES) -> Column:
    """One Boolean expression for all rules; a missing bound is no condition."""
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out &= F.col(name) >= least
        if most is not None:
            out &= F.col(name) <= most
    return out


def base_failed(least_words: int = 50, most_repeated: float = 0.5) -> Column:
    """Too few words, or too large a share of words in repeated three-word windows."""
    return (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``.

    Works row by row: repeated rows are judged alike and stay, a null, empty or blank text has no words and fails, and
    other columns pass through; a column of ``docs`` named as a measure is replaced. Windows are compared by 64-bit hashes.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "upper_word_ratio", "dup_line_ratio", "base_failed", "kept"]
    rows = measure(docs.drop(*[c for c in made if c != text_col]), text_col)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
