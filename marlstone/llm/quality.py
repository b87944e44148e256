"""Quality rules: one table of thresholds, compiled into one projection over the text.

Every measure is a DataFrame expression, so a document is judged where it is read: there is no shuffle and
nothing is collected, and a hot source or a group of copies costs no more than other rows. Work for a document
grows with its length times the logarithm of it (repeated windows are found by sorting, not by comparing pairs).

Defined results: a null text counts as empty; an empty or white text has zero words, fails the base rules and has
all ratios zero; repeated rows and equal ids are judged row by row; an empty table gives an empty table; extra
columns are passed on, and one whose name clashes with a result column gives way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, kept_where, text_of, words_of

# Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can for from had has have he her his i if in is it "
    "its more no not of on one or out she so that the their them then there they this to up was we were what when "
    "which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er "
    "es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor "
    "war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas "
    "plus pour qu que qui sa se ses son sont sur un une vous y à "
    "al como con cuando de del el ella en era es esta este fue ha hay la las le lo los me muy más ni no nos o para "
    "pero por que se ser si sin sobre su sus también un una y ya"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Documents pass while low <= 1000 * top <= high, in units of bottom: whole numbers, so no rounding decides."""

    name: str
    top: str
    bottom: str
    low: int = 0
    high: int | None = None

    def fails(self) -> Column:
        t, b = F.col(self.top) * 1000, F.col(self.bottom)
        bad = t < b * self.low
        return bad if self.high is None else bad | (t > b * self.high)


#: Ratios in thousandths. Each is judged only for documents that the base rules let through, so no bottom is zero.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols_to_words", "n_symbols", "n_words", 0, 100),
    Rule("stop_words_to_words", "n_stop_words", "n_words", 50),
    Rule("dup_lines_to_lines", "n_dup_lines", "n_lines", 0, 400),
)


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the same list.

    A list without equal windows, which one pass over a hash set shows, costs no sort. In others the windows are
    sorted with their places; equal neighbours mark places, and each place covers three words less the overlap.
    """
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.slice(words, 1, n - 2), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))))

    def covered(wins: Column) -> Column:
        placed = F.sort_array(F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]), x["i"]))
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            spans = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
            return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

        return _once(_once(placed, marked), total)

    return _once(windows, lambda wins: F.when(F.size(wins) > F.size(F.array_distinct(wins)), covered(wins)))


def _once(value: Column, use) -> Column:
    """use(value), with value computed a single time though use may name it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words (all long)."""
    results = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
    kept = [c for c in docs.columns if c.lower() not in results]
    w, lines = fresh("words", docs.columns), fresh("lines", docs.columns)
    body = text_of(text)
    stop_list = sorted(set(STOP_WORDS))
    t = docs.select(
        *kept,
        words_of(body).alias(w),
        F.filter(F.split(body, "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0).alias(lines),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    return t.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stop_list))).cast("long").alias("n_stop_words"),
        F.coalesce(repeat_words(F.col(w)), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """measure(docs) with base_failed, a boolean fails_<name> for each rule, and kept."""
    m = measure(docs, text)
    results = {"base_failed", "kept", *(f"fails_{r.name}" for r in rules)}
    m = m.select(*(c for c in m.columns if c.lower() not in results))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | r.fails()
    return m.select("*", base.alias("base_failed"), *(r.fails().alias(f"fails_{r.name}") for r in rules), (~base & ~any_rule).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("doc_text"))
    return kept_where(judge(held, "doc_text", rules).select("doc", "kept"), "kept").select("doc.*")
