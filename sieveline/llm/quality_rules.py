"""Quality rules: a decision list learned by sequential covering over text statistics.

The statistics are integers and their ratios, taken over whole texts. From labelled
rows, rules are grown greedily: each adds the threshold condition with the highest
FOIL gain over the rows that the rules so far leave, until it covers label 0 alone;
a rule is then pruned, last condition first, as long as that does not lower its
worth on rows kept apart, and dropped if it is worth nothing there. Rules are
conjunctions a person can read, tried in order; the first that holds decides. The
list comes out as one Spark ``when`` chain over the statistics columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, fold, prepare

#: The symbol characters of the base statistics.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_distinct_words", "n_stops")
#: What rules may test, as SQL over the statistics.
FEATURES = {
    "n_words": "n_words",
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct_words / n_words",
    "stops_per_word": "n_stops / n_words",
}
#: Labelled rows to learn from at most, of either label; rules, conditions a rule, thresholds a feature at most.
SAMPLE, RULES, CONDITIONS, THRESHOLDS = 20_000, 12, 3, 64
#: A rule must cover so many rows, and be right on this share of those kept apart.
LEAST_COVER, LEAST_RIGHT = 5, 0.8

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in SYMBOLS]] = True


def statistics(col: pa.Array) -> np.ndarray:
    """STATS of each document, one column each."""
    words = K.Words(col)
    data, n = words.data, len(words.doc_at) - 1
    out = np.zeros((n, len(STATS)), np.int64)
    if not len(words.start):
        return out
    per_byte = lambda mask: K.sums(mask, words.doc_at)
    counts = words.counts()
    out[:, 0] = counts
    out[:, 1] = per_byte(((data & 0xC0) != 0x80) & ~K._space[data])
    out[:, 2] = per_byte(_symbol[data])
    upper = (data >= 65) & (data <= 90)
    out[:, 5] = per_byte(upper)
    out[:, 6] = per_byte(upper | ((data >= 97) & (data <= 122)) | (data >= 0xC0))
    out[:, 9] = per_byte((data == 46) | (data == 44))
    h = words.hashes()
    doc = words.doc()
    # lines with a word: the words between two newlines; equal lines have the same bytes
    newline = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([words.doc_at, newline, newline + 1]))
    begin, end = edges[:-1], edges[1:]
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[filled], end[filled]
    line_doc = np.searchsorted(words.doc_at, begin, "right") - 1
    same = K.span_hashes(data, begin, end)
    order = np.lexsort((same, line_doc))
    again = np.zeros(len(order), bool)
    again[1:] = (same[order][1:] == same[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    out[:, 3] = np.bincount(line_doc[order][again], minlength=n)
    out[:, 7] = np.bincount(line_doc, minlength=n)
    # words in three-word windows that the document has more than once
    at, _ = K.gram_starts(words.first, 3)
    if len(at):
        g = K.grams(h, 3)[at]
        owner = doc[at]
        order = np.argsort(g, kind="stable")  # of equal windows, documents stay in order
        equal = (g[order][1:] == g[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        hit = np.zeros(len(h) + 1, np.int64)
        found = at[order[twice]]
        np.add.at(hit, found, 1)
        np.add.at(hit, found + 3, -1)
        out[:, 4] = K.sums(np.cumsum(hit)[:-1] > 0, words.first)
    order = np.argsort(h, kind="stable")
    repeated = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out[:, 8] = counts - np.bincount(doc[order][1:][repeated], minlength=n)
    return out


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        table = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(table[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row; a null text has none of anything."""
    prepare(docs.sparkSession)
    return documents(docs).mapInArrow(_stat_rows, ", ".join(["doc_id long", *(f"{s} long" for s in STATS)]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for c in rule:
        held &= c.holds(x)
    return held


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds halfway between neighbouring values, evenly by rank if there are many."""
    distinct = np.unique(values)
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) > THRESHOLDS:
        middle = np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
    return middle


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    held = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (bad[held] == 0).any():
        p, n = (bad & held).sum(), (~bad & held).sum()
        if not p:
            break
        best = (0.0, None)
        for name, values in x.items():
            cuts = _cuts(values[held])
            if not len(cuts):
                continue
            order = np.sort(values[held & bad]), np.sort(values[held & ~bad])
            low = [np.searchsorted(v, cuts, "right") for v in order]
            for above in (False, True):
                hits, misses = (len(order[0]) - low[0], len(order[1]) - low[1]) if above else low
                gain = np.where(hits > 0, hits * (np.log2(np.maximum(hits, 1e-9) / np.maximum(hits + misses, 1e-9)) - np.log2(p / (p + n))), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        held &= best[1].holds(x)
    return rule


def _worth(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    held = _covers(rule, x, len(bad))
    p, n = (bad & held).sum(), (~bad & held).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Ordered rules, each a conjunction, that say a row is bad; a third of the rows prunes and judges them."""
    apart = np.arange(len(bad)) % 3 == 0
    left = ~apart
    rules: list[list[Condition]] = []
    judge = {k: v[apart] for k, v in x.items()}
    open_ = np.ones(int(apart.sum()), bool)
    while len(rules) < RULES and (bad & left).sum() >= LEAST_COVER:
        rule = _grow({k: v[left] for k, v in x.items()}, bad[left])
        here = {k: v[open_] for k, v in judge.items()}
        while len(rule) > 1 and _worth(rule[:-1], here, bad[apart][open_]) >= _worth(rule, here, bad[apart][open_]):
            rule = rule[:-1]
        held = _covers(rule, x, len(bad)) & left
        if not rule or (bad & held).sum() < LEAST_COVER or _worth(rule, here, bad[apart][open_]) < 2 * LEAST_RIGHT - 1:
            break
        rules.append(rule)
        left &= ~held
        open_ &= ~_covers(rule, judge, len(open_))
    return rules


def decision(rules: list[list[Condition]]) -> Column:
    """True for rows to keep: the first rule that holds rejects, none keeps."""
    chain = None
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        chain = F.when(held, F.lit(False)) if chain is None else chain.when(held, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and bad-labels of at most ``sample`` labelled documents of either label, the first by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("y") == v).select("doc_id", "y", order.alias("o")).orderBy("o", "doc_id").limit(sample) for v in (0, 1)]
    picked = chosen[0].union(chosen[1])
    texts = documents(docs).where("text is not null").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = text_statistics(texts).join(F.broadcast(picked), "doc_id").where(~base_failed())
    table = rows.select("o", "doc_id", "y", *(F.expr(v).cast("double").alias(k) for k, v in FEATURES.items())).toPandas().sort_values(["o", "doc_id", *FEATURES])
    return {k: table[k].to_numpy(float) for k in FEATURES}, table["y"].to_numpy() == 0


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    A null or empty text has no words and fails the base rules. Rules are learned from
    labelled rows that pass them; without labels of both kinds nothing else is rejected.
    Columns of docs besides doc_id and text are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    x, bad = training_rows(docs, labels, sample)
    rules = learn(x, bad)
    stats = text_statistics(docs).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(decision(rules))
    return stats.select("doc_id", *STATS[:5], "base_failed", kept.alias("kept"))
