"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Words are maximal runs of characters other than U+0020 and U+0009 to U+000D. All measures
are made of whole texts, on the row, without user functions, joins or shuffles; a text is
never compared with another one, so the plan is a scan and a projection at every size.

Defined results: a null text counts as an empty one and fails (no words); ties and repeated
rows are judged row by row, each gets its own result row; an empty table gives an empty
result; input columns named like a measure are replaced in :func:`with_quality` by the
measure, other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages that the rules are meant for.
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "on", "be", "are", "this", "by", "at", "or", "an", "was"),
    *("de", "la", "le", "les", "et", "en", "un", "une", "du", "des", "que", "qui", "dans", "pour", "est", "sur", "au", "par", "avec", "pas"),
    *("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "ist", "nicht", "ein", "eine", "auf", "dem", "im", "für", "auch", "als", "es"),
    *("el", "los", "y", "las", "se", "del", "por", "con", "una", "su", "para", "no", "lo", "como", "más", "pero", "sus", "al", "ha", "o"),
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=50),
    Rule("repeat_word_ratio", high=0.5),
    Rule("mean_word_length", low=2, high=12),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("alpha_word_ratio", low=0.7),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


MEASURES = (
    *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_length", "symbol_ratio"),
    *("stop_word_ratio", "alpha_word_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "n_lines"),
)
RATIOS = ("repeat_word_ratio", "dup_line_ratio")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def _let(value: Column, body) -> Column:
    """Evaluate value once and use it several times within one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(ws: Column, n: int = 3) -> Column:
    """Words in windows of n words that occur twice or more in ws, the first one included.

    Where 64-bit window hashes are all distinct, there are none. Else sorted hashes show which
    occur twice. Where those are few, the places of their windows are looked up in that list;
    else hashes are sorted together with places. Either way the union of the windows' extents is summed from the gaps between places:
    O(n log n) on the row, never a comparison of all pairs.
    """
    few = 16

    def hashes(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, n)))), 1, F.size(w) - n + 1)

    def twice(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, j: F.get(s, j - 1) == x))

    def sorted_places(h: Column) -> Column:
        same = lambda g: lambda x, j: (F.get(g, j - 1)["h"] == x["h"]) | (F.get(g, j + 1)["h"] == x["h"])
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda g: F.sort_array(F.transform(F.filter(g, same(g)), lambda x: x["i"])))

    def places(h: Column) -> Column:
        looked_up = lambda r: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(r, F.get(h, i)))
        none = F.filter(F.array(F.lit(0)), lambda i: i > 0)
        return _let(_let(F.sort_array(h), twice), lambda r: F.when(F.size(r) == 0, none).when(F.size(r) <= few, looked_up(r)).otherwise(sorted_places(h)))

    def extent(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    count = _let(_let(ws, hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(places(h), extent)))
    return F.when(F.size(ws) < n, F.lit(0)).otherwise(count).cast("long")


def lines(text: Column) -> Column:
    r"""Lines, split at \n, that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")


def measures(text: Column, ws: Column, ls: Column) -> dict[str, Column]:
    """Counts and ratios by name; ws must be the words of text and ls its lines."""
    body = F.coalesce(text, F.lit(""))
    n = F.size(ws)
    per_word = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    n_lines = F.greatest(F.size(ls), F.lit(1))
    word_chars = F.length(F.array_join(ws, "")).cast("long")
    n_symbols = F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long")
    some = lambda of: F.size(F.filter(ls, of))
    ends = lambda x: F.rtrim(x, F.lit(" \t"))
    return {
        "n_words": n.cast("long"),
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": repeated_words(ws),
        "mean_word_length": per_word(word_chars),
        "symbol_ratio": per_word(n_symbols),
        "stop_word_ratio": per_word(F.size(F.filter(ws, lambda x: x.isin(*STOP_WORDS, *(s.capitalize() for s in STOP_WORDS))))),
        "alpha_word_ratio": per_word(F.regexp_count(body, F.lit(f"[^{SPACE}\\p{{L}}]*+\\p{{L}}[^{SPACE}]*+"))),
        "bullet_line_ratio": some(lambda x: F.substring(F.ltrim(x, F.lit(" \t")), 1, 1).isin("-", "*", "•")) / n_lines,
        "ellipsis_line_ratio": some(lambda x: ends(x).endswith("...") | ends(x).endswith("…")) / n_lines,
        "n_lines": n_lines.cast("long"),
    }


def verdict(made: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules over a struct of measures, as one boolean expression."""
    kept = F.lit(True)
    for r in rules:
        if r.low is not None:
            kept = kept & (made[r.measure] >= r.low)
        if r.high is not None:
            kept = kept & (made[r.measure] <= r.high)
    return kept


def quality(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of every measure, base_failed and kept: one expression that splits the text once.

    Everything is bound within the expression, so that a filter on kept which Spark moves
    below the projection still works out each measure once.
    """

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*(m[k].alias(k) for k in (*MEASURES, *RATIOS)), failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))

    def rated(m: Column) -> Column:
        return F.struct(
            *(m[k].alias(k) for k in MEASURES),
            F.when(m["n_words"] > 0, m["n_repeat_words"] / m["n_words"]).otherwise(F.lit(0.0)).alias("repeat_word_ratio"),
            (m["n_dup_lines"] / m["n_lines"]).alias("dup_line_ratio"),
        )

    made = _let(F.struct(words(text).alias("words"), lines(text).alias("lines")), lambda x: F.struct(*(c.alias(k) for k, c in measures(text, x["words"], x["lines"]).items())))
    return _let(_let(made, rated), judged)


def with_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with every measure, base_failed and kept; columns of these names are replaced."""
    own = "__quality"
    while own in df.columns:
        own += "_"
    made = (*MEASURES, *RATIOS, "base_failed", "kept")
    low = {k.lower() for k in made}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]
    return df.withColumn(own, quality(F.col(f"`{text}`"), rules)).select(*rest, *(F.col(own)[k].alias(k) for k in made))
