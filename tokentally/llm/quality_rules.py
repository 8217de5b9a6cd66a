"""Operator 13: quality rules, compiled from a table of thresholds into one projection.

A rule bounds the ratio of two measures of a text, in per cent: word length, symbols, marks, stop words,
kinds of lines. Measures are whole numbers and rules compare products of whole numbers, so there is no
rounding. `compiled` turns a table of rules into columns: only the measures that some rule names are
computed, each once, and nothing is shuffled. All of it is built-in column functions.

A text is split at 0x20 and 0x09-0x0D. For windows of words that repeat, a word is its 64-bit hash and a
window the hash of these; equal ones are found by sorting within the row, and only in texts that hold some.
Two different windows of one text of n words are taken for equal with a chance of n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SPACE = " \t\n\x0b\f\r"
SYMBOL = "[#*$%&|<>]"
#: Words of a window that may repeat.
WINDOW = 8
#: A text has so many words at least; so many per cent of them at most are in repeated windows.
LEAST_WORDS = 20
MOST_REPEATED = 30

# Common words of the languages at hand, in their usual spelling without accents.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "als auch auf das dem den der die ein eine ist im mit nicht sie sich und von zu "
    "al como con del el los las no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """100 * measure is between least * per and most * per; either bound may be absent."""

    name: str
    measure: str
    per: str
    least: int | None = None
    most: int | None = None

    def broken(self, value: Callable[[str], Column]) -> Column:
        """Whether the row breaks the rule. A row whose `per` is 0 breaks none."""
        whole, per = value(self.measure) * 100, value(self.per)
        out = F.lit(False)
        if self.least is not None:
            out = out | (whole < per * self.least)
        if self.most is not None:
            out = out | (whole > per * self.most)
        return out & (per > 0)


RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("marks", "n_marks", "n_words", most=50),
    Rule("letters", "n_letter_words", "n_words", least=80),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words within windows of so many words that are found twice or more in the array."""

    def window(first: Column, at: Column, hashes: Column) -> Column:
        return F.xxhash64(first, *(F.get(hashes, at + k) for k in range(1, width)))

    def covered(windows: Column) -> Column:
        places = F.sort_array(F.transform(windows, lambda w, at: F.struct(w.alias("w"), at.alias("at"))))

        def again(p: Column) -> Column:
            return F.filter(
                p, lambda e, k: (e["w"] == F.get(p, k - 1)["w"]) | (e["w"] == F.get(p, k + 1)["w"])
            )

        starts = F.sort_array(F.transform(_let(places, again), lambda e: e["at"]))
        steps = _let(
            starts, lambda s: F.transform(s, lambda at, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - at, F.lit(width))))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(h, lambda first, at: window(first, at, h)))
    whole = _let(windows, lambda w: F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0))))
    return _let(
        whole,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )


def _is_cut(line: Column) -> Column:
    return _let(F.rtrim(line, F.lit(SPACE)), lambda x: x.endswith("...") | x.endswith("…"))


#: Each measure from a row's `text` (never null), `words` and `lines` (those with a word).
MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.size("words"),
    "word_chars": lambda: F.char_length(F.array_join("words", "")),
    "n_symbols": lambda: F.regexp_count("text", F.lit(SYMBOL)),
    "n_marks": lambda: F.regexp_count("text", F.lit("[!?]")),
    "n_letter_words": lambda: F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))),
    "n_stop_words": lambda: F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))),
    "n_lines": lambda: F.size("lines"),
    "n_dup_lines": lambda: F.size("lines") - F.size(F.array_distinct("lines")),
    "n_bullet_lines": lambda: F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
    "n_cut_lines": lambda: F.size(F.filter("lines", _is_cut)),
    "n_repeat_words": lambda: repeated_words(F.col("words")),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compiled(rules: Sequence[Rule]) -> tuple[dict[str, Column], Column]:
    """The measures that the rules need, as columns of `text`, `words` and `lines`; and the names of
    the rules that a row with these columns breaks, joined by commas."""
    needed = dict.fromkeys([*BASE, *(m for r in rules for m in (r.measure, r.per))])
    unknown = [m for m in needed if m not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures: {', '.join(unknown)}")
    columns = {m: MEASURES[m]().cast("long") for m in needed}
    names = [F.when(rule.broken(F.col), F.lit(rule.name)) for rule in rules]
    return columns, F.concat_ws(",", *names) if names else F.lit("")


def _measured(rows: DataFrame, rules: Sequence[Rule], *carried: str) -> DataFrame:
    """The carried columns, the measures, base_failed, broken and kept of rows with `text`."""
    columns, broken = compiled(rules)
    parts = rows.select(
        *carried,
        "text",
        F.array_remove(F.split("text", SEPARATORS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    measured = parts.select(*carried, *(column.alias(name) for name, column in columns.items()))
    few, again = F.col("n_words") < LEAST_WORDS, F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    judged = measured.withColumns({"base_failed": few | again, "broken": broken})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))


def judged(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken.

    broken: names of the rules that the text breaks, in the table's order, joined by commas; "" if none.
    kept: neither base_failed nor a broken rule. A null text counts as an empty one: no words, so it
    fails the base. A null doc_id stays null; repeated rows are judged each; an empty table gives an
    empty one. Columns of the documents other than doc_id and text are not looked at.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    return _measured(rows, rules, "doc_id").select("doc_id", *BASE, "base_failed", "kept", "broken")


def kept_documents(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass, with all their columns; each row is judged by itself, without a join."""
    rows = documents.select(
        F.struct(*(documents[c] for c in documents.columns)).alias("document"),
        F.coalesce(documents["text"], F.lit("")).alias("text"),
    )
    return _measured(rows, rules, "document").where("kept").select("document.*")
