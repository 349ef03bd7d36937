"""Quality rules learned as a decision list, emitted as an ordered Spark conditional expression."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import add_columns

BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_stops", "n_marks",
]


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers in ``COUNTS`` for one text; a null text has none of anything and no line with a word."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
        len(set(words)), *(len(raw) - len(raw.translate(None, x)) for x in (UPPER, LOWER, DIGITS)), text.count("."), text.count("!"),
    )


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns ``prefix + COUNTS``, one row for each row, without a shuffle.

    Input columns of the same names are replaced.
    """
    names = [prefix + c for c in COUNTS]
    empty = [[] for _ in names]
    return add_columns(docs, text, lambda texts: list(zip(*map(text_counts, texts))) or empty, [(n, "long") for n in names])


def statistics(prefix: str = "") -> dict[str, Column]:
    """The shares that rules may test, as Spark expressions over the counts."""
    c = {n: F.col(prefix + n).cast("double") for n in COUNTS}

    def share(part: str, whole: str) -> Column:
        return c[part] / F.greatest(c[whole], F.lit(1.0))

    return {
        "words": c["n_words"],
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": c["n_upper"] / F.greatest(c["n_upper"] + c["n_lower"], F.lit(1.0)),
        "digit_share": share("n_digits", "word_chars"),
        "stop_share": share("n_stops", "n_words"),
        "mark_share": share("n_marks", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        values = x[self.name].to_numpy()
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] > self.threshold if self.above else stats[self.name] <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Add the condition with the highest information gain until no good row is covered, or ``most`` conditions stand."""
    rule: Rule = ()
    while len(rule) < most:
        p, n = bad.sum(), (~bad).sum()
        if n == 0 or p == 0:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for name, thresholds in cuts.items():
            values = x[name].to_numpy()
            order = np.argsort(values, kind="stable")
            at = np.searchsorted(values[order], thresholds, side="right")
            below = np.concatenate([[0], np.cumsum(bad[order])])[at]
            for above, pos, size in ((False, below, at), (True, p - below, len(bad) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(pos > 0, pos * (np.log2(pos / size) - before), 0.0)
                k = int(gains.argmax()) if len(gains) else 0
                if len(gains) and gains[k] > gain:
                    best, gain = Condition(name, above, float(thresholds[k])), gains[k]
        if best is None:
            break
        rule += (best,)
        inside = best.holds(x)
        x, bad = x[inside], bad[inside]
    return rule


def _prune(rule: Rule, x: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Drop final conditions while the rest is worth more on rows that the rule wasn't grown on."""

    def worth(r: Rule) -> float:
        inside = _covers(r, x)
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """An ordered list of conjunctions that reject rows, by sequential covering: grow, prune, remove what is covered, repeat.

    A rule is kept if at least ``precision`` of all rows it covers (and of those it was pruned on) are bad and it covers
    ``least`` bad ones; the first rule that isn't ends the list. ``x`` has a column for each statistic, ``bad`` the labels.
    Without bad rows the list is empty.
    """
    rules: list[Rule] = []
    x = x.reset_index(drop=True)
    cuts = {}
    for name in x.columns:
        values = np.unique(x[name].to_numpy())
        middle = (values[1:] + values[:-1]) / 2
        cuts[name] = middle[np.unique(np.linspace(0, len(middle) - 1, min(len(middle), 400)).astype(int))] if len(middle) else middle
    while len(rules) < most_rules and bad.sum() >= least:
        held_out = np.arange(len(x)) % 3 == 2
        grown = _grow(x[~held_out], bad[~held_out], cuts, most_conditions)
        if not grown:
            break
        rule = _prune(grown, x[held_out], bad[held_out])
        inside = _covers(rule, x)
        if (bad & inside).sum() < max(least, precision * inside.sum()):
            break
        rules.append(rule)
        x, bad = x[~inside].reset_index(drop=True), bad[~inside]
    return rules


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> list[Rule]:
    """Learn the list from at most ``max_rows`` labelled documents (``labels``: ``doc_id, quality`` 0 or 1).

    The sample is the labelled rows with the smallest hashes, so a rerun finds the same; rows that the base rules reject
    are left out, since the list never sees them. Its bound makes it safe to broadcast and to bring to the driver.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality")).where("__quality is not null and __id is not null")
    sample = known.orderBy(F.xxhash64("__id"), "__id", "__quality").limit(max_rows)
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id")
    stats = with_counts(own).where(~base_failed())
    rows = stats.select("__id", "__quality", *[v.alias(k) for k, v in statistics().items()]).toPandas()
    rows = rows.sort_values(["__id", "__quality", *statistics()], kind="stable")
    rows = rows.iloc[np.random.default_rng(0).permutation(len(rows))]
    return learn(rows[list(statistics())], rows["__quality"].to_numpy() == 0)


def accepts(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, otherwise the document is kept."""
    stats = statistics(prefix)
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        test = rule[0].column(stats)
        for c in rule[1:]:
            test = test & c.column(stats)
        chain = F.when(test, False) if chain is None else chain.when(test, False)
    return chain.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept`` (all names with ``prefix``; input columns so named are replaced).

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike; labels of unknown documents
    and null labels are ignored, and without labels only the base rules decide.
    """
    rules = fit(docs, labels, max_rows, doc_id, text)
    found = with_counts(docs, text, prefix)
    return found.withColumns({prefix + "base_failed": base_failed(prefix), prefix + "kept": ~base_failed(prefix) & accepts(rules, prefix)})
