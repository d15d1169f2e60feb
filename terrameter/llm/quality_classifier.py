"""Quality classifier: a sparse ensemble of rules that runs as Spark column expressions.

Shallow trees are grown on text statistics of a bounded labelled sample; each path of a tree is a
rule, a conjunction of conditions.  A logistic model with an L1 penalty keeps few rules.  The kept
rules and weights compile into one column expression, so all documents are scored inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import count_chars, let, words
from .trees import forest


@dataclass(frozen=True)
class Limits:
    train_rows: int = 20_000  # labelled documents that the model learns from, by smallest hash
    trees: int = 30
    depth: int = 3  # so a tree has at most 14 rules


def statistics(text: Column) -> dict[str, Column]:
    """Text statistics by name, all from the whole text; ``text`` must not be null."""
    n = F.col("_w.n")
    per_word = lambda c: c / F.greatest(n, F.lit(1))
    return {
        "words": F.log(n + F.lit(1.0)),
        "word_chars": per_word(F.col("_w.chars")),
        "distinct": per_word(F.col("_w.distinct")),
        "bare": per_word(F.col("_w.bare")),
        "symbols": per_word(count_chars(text, "#*$%&<>")),
        "bars": per_word(count_chars(text, "|")),
        "shouts": per_word(count_chars(text, "!")),
        "stops": per_word(count_chars(text, ".?")),
        "commas": per_word(count_chars(text, ",;:")),
        "digits": per_word(count_chars(text, "0123456789")),
        "upper": per_word(count_chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "lines": per_word(F.col("_l.n")),
        "line_repeats": F.col("_l.dup") / F.greatest(F.col("_l.n"), F.lit(1)),
        "quotes": per_word(count_chars(text, "\"'()[]{}=/\\")),
    }


NAMES = ["words", "word_chars", "distinct", "bare", "symbols", "bars", "shouts", "stops", "commas", "digits", "upper", "lines", "line_repeats", "quotes"]


def with_statistics(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and one double column for each statistic; null texts count as empty."""
    rows = docs.select(*keep, F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    kept = rows.columns[:-1]
    bare = lambda w: F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}")))
    rows = rows.select(
        *kept,
        "_t",
        let(words(F.col("_t")), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("distinct"), bare(w).alias("bare"))).alias("_w"),
        let(F.split(F.col("_t"), "\n", -1), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_l"),
    )
    return rows.select(*kept, *[c.cast("double").alias(name) for name, c in statistics(F.col("_t")).items()])


Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for f, greater, cut in rule:
                holds = holds & (F.col(NAMES[f]) > cut if greater else F.col(NAMES[f]) <= cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, cut in rule:
        out &= x[:, f] > cut if greater else x[:, f] <= cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic model by accelerated proximal gradient."""
    n, k = z.shape
    step = 4.0 * n / max(1e-9, float(np.linalg.norm(z, 2)) ** 2 + n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    at_w, at_b, pace = w.copy(), b, 1.0
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-(z @ at_w + at_b))) - y
        new = at_w - step * (z.T @ gap) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = at_b - step * gap.mean()
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        at_w, at_b = new + (pace - 1) / faster * (new - w), new_b + (pace - 1) / faster * (new_b - b)
        w, b, pace = new, new_b, faster
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, limits: Limits = Limits(), seed: int = 3, penalty: float = 0.002) -> Ensemble:
    """Rules from trees, then sparse weights.  With one class only, the score is constant."""
    if not len(y):
        return Ensemble([], [], 0.0)
    if len(np.unique(y)) < 2:
        return Ensemble([], [], 6.0 if y[0] else -6.0)
    unique: dict[bytes, Rule] = {}
    for tree in forest(x, y, limits.trees, limits.depth, seed):
        for rule in tree.paths():
            held = _holds(rule, x)
            if 0 < held.sum() < len(held):
                unique.setdefault(np.packbits(held).tobytes(), rule)
    rules = list(unique.values())
    if not rules:
        return Ensemble([], [], float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    z = np.stack([_holds(r, x) for r in rules], 1).astype(float)
    w, b = lasso_logistic(z, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ensemble:
    """Learn from at most ``limits.train_rows`` labelled documents (by smallest id hash).

    ``learn`` says which ids may be learned from; it is asked of the label table's ids.  Null labels
    teach nothing; several labels of one document all count.  The sampled label table is bounded by
    the limit, so it is broadcast, and only sampled documents' statistics reach the driver.
    """
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(limits.train_rows)
    texts = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("_text"))
    rows = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    seen = with_statistics(rows, [F.col("_id"), F.col("_y")], "_text").orderBy("_id", "_y", *NAMES).limit(2 * limits.train_rows).toPandas()
    return fit_rules(seen[NAMES].to_numpy(float), seen["_y"].to_numpy(float), limits)


def score_documents(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row; null and empty texts are scored as empty ones.

    Repeated rows and null ids stay; other columns are ignored.
    """
    rows = with_statistics(docs, [docs[id_col].alias("_id")], text_col)
    rows = rows.select(F.col("_id").alias(id_col), model.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
