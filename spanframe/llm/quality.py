"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are boosted on a bounded sample of labelled rows; every path from a root
to a node is a rule, a conjunction of thresholds. A logistic model with an L1 penalty
keeps few rules, and those are compiled into one Spark column expression, so scoring
needs nothing but the statistics of a document. Statistics are taken from whole texts in
one narrow pass. Language, source and identifier are no inputs.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from spanframe.llm.html_text import STOP_WORDS
from spanframe.llm.registry import query, table

#: At most so many labelled rows are used to fit, those of the smallest keyed hash.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "letters", "digits", "upper", "spaces", "marks", "symbols", "beyond_ascii", "sentence_marks",
    "byte_entropy", "distinct_words", "top_word", "same_again", "stop_words", "log_lines", "line_length", "repeated_lines", "lines_closed", "upper_words",
    "marked_words",
)
_STOP = sorted({w for words in STOP_WORDS.values() for w in words.split()})
_CLASS = np.zeros((256, 7))
for _i in range(256):
    _ch = chr(_i)
    _CLASS[_i] = (
        _i < 128 and _ch.isalpha(), 48 <= _i < 58, 65 <= _i < 91, _i in (32, 9, 10, 11, 12, 13), 33 <= _i < 127 and not _ch.isalnum(),
        _i < 128 and _ch in "#$%&*+<=>@[\\]^_`{|}~/", _i >= 128)


def statistics_of(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS; all zero for an empty text."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    share = counts / n
    seen = share[share > 0]
    letters, digits, upper, spaces, marks, symbols, beyond = (share @ _CLASS).tolist()
    words = text.split()
    n_words = len(words) or 1
    count = Counter(words)
    get = count.get
    lines = [x for x in text.split("\n") if x]
    n_lines = len(lines) or 1
    sentence = int(counts[46] + counts[33] + counts[63])
    return [
        math.log1p(len(text)), math.log1p(len(words)), (n - int(counts[[32, 9, 10, 11, 12, 13]].sum())) / n_words, math.log1p(max(map(len, count), default=0)),
        letters, digits, upper, spaces, marks, symbols, beyond, sentence / n_words, float(-(seen * np.log2(seen)).sum()), len(count) / n_words,
        (max(count.values()) / n_words) if words else 0.0, sum(map(eq, words, words[1:])) / n_words, sum(get(w, 0) for w in _STOP) / n_words,
        math.log1p(len(lines)), math.log1p(len(text) / n_lines), 1.0 - len(set(lines)) / n_lines if lines else 0.0,
        sum(x[-1] in ".!?\"'”»" for x in lines) / n_lines, sum(c for w, c in count.items() if w.isupper()) / n_words,
        sum(c for w, c in count.items() if not w[-1].isalnum() and w[-1] not in ".,;:") / n_words,
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def text_statistics(text: pa.Array) -> pa.Array:
    """The statistics of each text; null counts as empty."""
    rows = np.array([statistics_of(t.as_py() or "") for t in text], np.float64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * len(STATISTICS), pa.int32()), pa.array(rows))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold)


def _grow(binned, edges, grad, hess, rows, depth, least, path, out) -> np.ndarray:
    """One tree on gradients; appends each node's path to ``out`` and returns its fitted values."""
    fit = np.zeros(len(grad))
    g, h = grad[rows].sum(), hess[rows].sum()
    fit[rows] = -g / (h + 1.0)
    if path:
        out.append(tuple(path))
    if depth == 0 or len(rows) < 2 * least:
        return fit
    best = (1e-6, None, None)
    for j in range(binned.shape[1]):
        size = len(edges[j]) + 1
        column = binned[rows, j]
        gl = np.cumsum(np.bincount(column, grad[rows], size))[:-1]
        hl = np.cumsum(np.bincount(column, hess[rows], size))[:-1]
        nl = np.cumsum(np.bincount(column, minlength=size))[:-1]
        gain = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0)
        gain[(nl < least) | (len(rows) - nl < least)] = -1.0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), j, int(gain.argmax()))
    if best[1] is None:
        return fit
    _, j, k = best
    low = binned[rows, j] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        fit[side] = _grow(binned, edges, grad, hess, side, depth - 1, least, [*path, (j, above, float(edges[j][k]))], out)[side]
    return fit


def boost_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, seed: int = 17) -> list[Rule]:
    """Distinct paths of boosted trees on a logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rng, f, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        if len(rows) < 2 * least:
            rows = np.arange(len(y))
        found: list[Rule] = []
        _grow(binned, edges, p - y, p * (1 - p), rows, depth, least, [], found)
        # the tree on its sample gives the paths; all rows then move by their leaf
        step = np.zeros(len(y))
        for rule in found:
            on = rule_mask(x, rule)
            step[on] = -(p - y)[on].sum() / ((p * (1 - p))[on].sum() + 1.0)
        f += rate * step
        rules += found
    return list(dict.fromkeys(rules))


def rule_mask(x: np.ndarray, rule: Rule) -> np.ndarray:
    on = np.ones(len(x), bool)
    for j, above, at in rule:
        on &= (x[:, j] > at) if above else (x[:, j] <= at)
    return on


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised."""
    n = len(y)
    a = np.hstack([np.ones((n, 1), np.float32), m.astype(np.float32)])
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):  # power iteration for the step size
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1.0 / (0.25 * float(v @ (a.T @ (a @ v))) / n + 1e-9)
    w = np.zeros(a.shape[1])
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w[0] = math.log(prior / (1 - prior))
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ z.astype(np.float32)).astype(float)))
        new = z - rate * (a.T @ (p - y).astype(np.float32)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


class RuleModel:
    """Weighted rules over named statistics."""

    def __init__(self, intercept: float, rules: list[Rule], weights: list[float]):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    def column(self, statistics: Column) -> Column:
        """The score as a column expression over an array of the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            on = F.lit(True)
            for j, above, at in rule:
                c = F.get(statistics, F.lit(j))
                on = on & ((c > at) if above else (c <= at))
            total = total + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        tell = lambda r: " and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {at:.4g}" for j, above, at in r)
        return [f"{w:+.3f} if {tell(r)}" for r, w in sorted(zip(self.rules, self.weights), key=lambda p: -abs(p[1]))]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.001) -> RuleModel:
    """Fit on a sample. Without two classes the score is the share of label 1 (0.5 without rows)."""
    if len(y) == 0 or y.min() == y.max():
        prior = float(y.mean()) if len(y) else 0.5
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return RuleModel(math.log(prior / (1 - prior)), [], [])
    rules = boost_rules(x, y)
    if not rules:
        return fit_rules(x, np.full(1, float(y.mean())))
    masks = np.stack([rule_mask(x, r) for r in rules], axis=1)
    _, first = np.unique(masks, axis=1, return_index=True)
    rules = [rules[i] for i in sorted(first)]
    masks = masks[:, sorted(first)]
    intercept, weights = lasso_logistic(masks, y, penalty)
    kept = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]
    return RuleModel(intercept, [r for r, _ in kept], [w for _, w in kept])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, penalty: float = 0.001) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, by keyed hash."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
    picked = known.orderBy(F.xxhash64("_id", F.lit("quality sample")), "_id", "_y").limit(sample_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).join(F.broadcast(picked), "_id")  # at most sample_rows
    # ids that repeat in either table must not lift the bound
    sample = rows.select("_y", text_statistics("_t").alias("_s"), F.xxhash64("_id", "_t").alias("_h")).orderBy("_h", "_y").limit(sample_rows).select("_y", "_s").collect()
    x = np.array([r["_s"] for r in sample], np.float64).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r["_y"] for r in sample], np.float64), penalty)


def with_scores(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with _score and _predicted; no shuffle, all columns stay."""
    scored = docs.withColumn("_statistics", text_statistics(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_score", model.column(F.col("_statistics")))
    return scored.drop("_statistics").withColumn("_predicted", (F.col("_score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row: id, held_out, score (0 to 1), predicted (1 from the threshold).

    Null and empty texts are scored like others, by statistics that are all zero. A null
    id is never held out and never learnt from; labels other than 0 and 1 are passed
    over; repeated rows are scored each; without labels the score is 0.5. An empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = with_scores(rows, learn(rows, labels, "id", "text", label, sample_rows), "text", threshold)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
