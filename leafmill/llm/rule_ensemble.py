"""Quality classifier: a sparse ensemble of rules read off trees.

Statistics of a text are Spark column expressions.  On a bounded sample of labelled rows, small trees are boosted over
them; every path from a root to a node is a rule (a conjunction of comparisons).  Logistic regression with a lasso
penalty, by accelerated proximal gradient steps, keeps few of the rules; the penalty is chosen on a quarter of the
sample.  The rules kept are compiled into one column expression, so scoring the corpus is a single scan without Python.

At most ``sample_rows`` labelled rows are fitted on, those with the smallest hashed ids; scoring covers every text.
Null and empty texts have 0 in every statistic and are scored like others.  Labels that are null, or contradict one
another for one id, are left out.  Without labels of both kinds every score is the share of label 1 (0.5 if there is
none at all).  Each input row gives one row; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import read_table

SAMPLE_ROWS = 6_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
PENALTIES = (0.02, 0.005, 0.001)


def statistics(text: Column) -> dict[str, Column]:
    """Name and expression of every statistic of a text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = count(r"[^\x20\x09-\x0D]+")
    n = F.greatest(words, F.lit(1.0))
    chars = F.length(text).cast("double")
    c = F.greatest(chars, F.lit(1.0))
    tokens, lines = F.split(text, " "), F.split(text, "\n")
    return {
        "words": words,
        "chars_per_word": chars / n,
        "upper_runs": count("[A-Z]{2,}") / n,
        "symbols": count(r"[#*$%&<>]+") / n,
        "bars": count(r"\|") / n,
        "exclamations": count("!") / n,
        "digits": count("[0-9]+") / n,
        "sentence_ends": count("[.?]") / n,
        "doubled": count(r"(?<![^\x20\n])([^\x20\n]{1,40})[\x20\n]\1(?![^\x20\n])") / n,
        "new_words": F.size(F.array_distinct(tokens)).cast("double") / F.size(tokens),
        "new_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "line_chars": c / F.size(lines),
    }


class Rule(NamedTuple):
    #: (statistic, above, threshold): above means greater than the threshold, else at most it.
    conditions: tuple[tuple[int, bool, float], ...]


class Ensemble(NamedTuple):
    names: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, stats: dict[str, Column]) -> Column:
        """The chance of label 1 as an expression over columns named like the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, at in rule.conditions:
                value = stats[self.names[k]]
                holds = holds & (value > at if above else value <= at)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _split(binned: np.ndarray, gradient: np.ndarray, rows: np.ndarray, features: np.ndarray):
    """The best (gain, feature, bin) for one node by squared error."""
    best = (1e-9, -1, -1)
    g = gradient[rows]
    total, n = g.sum(), len(rows)
    for k in features:
        sums = np.bincount(binned[rows, k], weights=g, minlength=BINS + 1)
        counts = np.bincount(binned[rows, k], minlength=BINS + 1)
        left, nl = np.cumsum(sums)[:-1], np.cumsum(counts)[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left**2 / nl + (total - left) ** 2 / (n - nl) - total**2 / n
        gain = np.where((nl >= 10) & (n - nl >= 10), gain, -1)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), int(k), at)
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[Rule]:
    """Rules of all nodes of boosted trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        gradient = y - 1 / (1 + np.exp(-margin))
        sample = rng.permutation(len(y))[: max(20, len(y) // 2)]
        nodes = [((), sample, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            below = []
            for conditions, rows, members in nodes:
                features = rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
                found = _split(binned, gradient, rows, features) if depth < DEPTH and len(rows) >= 20 else (0, -1, -1)
                if found[1] < 0:
                    if len(members):
                        p = 1 / (1 + np.exp(-margin[members]))
                        margin[members] += RATE * gradient[members].sum() / max((p * (1 - p)).sum(), 1.0)
                    continue
                k, at = found[1:]
                threshold = float(cuts[k][min(at, len(cuts[k]) - 1)])
                for above in (False, True):
                    side = lambda r, above=above, k=k, at=at: r[(binned[r, k] > at) == above]
                    child = (*conditions, (k, above, threshold))
                    rules[Rule(tuple(sorted(child)))] = None
                    below.append((child, side(rows), side(members)))
            nodes = below
    return list(rules)


def apply_rules(x: np.ndarray, rules) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, above, at in rule.conditions:
            out[:, j] *= (x[:, k] > at) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of L1-penalised logistic regression."""
    n, m = r.shape
    a = np.column_stack([r, np.ones(n)])
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(m + 1)
    ahead, t = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -30, 30)))
        new = ahead - rate * (a.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:m], float(w[m])


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Ensemble:
    share = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble(names, (), (), float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    r = apply_rules(x, rules)
    check = np.arange(len(y)) % 4 == 0
    losses = []
    for penalty in PENALTIES:
        w, b = lasso(r[~check], y[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-np.clip(r[check] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        losses.append(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())
    w, b = lasso(r, y, PENALTIES[int(np.argmin(losses))])
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Ensemble(names, tuple(rules[j] for j in kept), tuple(float(w[j]) for j in kept), b)


def labelled_sample(labels: DataFrame, label: str, id_: str, rows: int) -> DataFrame:
    """(id, y) of at most ``rows`` ids, the smallest by hash, whose labels agree."""
    agreed = labels.where(F.col(label).isNotNull() & F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(
        F.min(label).alias("y"), F.max(label).alias("most")
    )
    return agreed.where("y = most").orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "y")


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
) -> Ensemble:
    stats = statistics(F.col("text"))
    sample = labelled_sample(labels, label, id_, sample_rows)
    # At most sample_rows rows of two numbers: the broadcast is bounded.
    some = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    measured = some.select("id", F.col("y").cast("double").alias("y"), F.struct(*(v.alias(k) for k, v in stats.items())).alias("s"))
    # One row an id, however often it is repeated: the least of its statistics.
    rows = measured.groupBy("id").agg(F.first("y").alias("y"), F.min("s").alias("s")).select("id", "y", "s.*").toPandas().sort_values("id")
    order = np.random.default_rng(5).permutation(len(rows))
    table = rows.to_numpy(dtype=float)[order]
    return fit(table[:, 2:], table[:, 1], tuple(stats))


def score(docs: DataFrame, model: Ensemble, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id, ``score`` and the statistics of every row."""
    stats = statistics(F.col("text"))
    slim = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    measured = slim.select("id", *(v.alias(k) for k, v in stats.items()))
    return measured.select(F.col("id").alias(id_), model.score({k: F.col(k) for k in stats}).alias("score"), *stats)


def op2_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
