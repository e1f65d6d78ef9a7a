"""Quality classifier: Bradley-Terry scores from preference pairs.

Texts are described by shares of character classes and by statistics of their
words and lines, raw and cut at quantiles. In a pair of a good and a bad text
the good one is preferred; the weights minimise the logistic loss of the
difference of scores. The decision is a threshold at a quantile of the scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import sigmoid

#: Scores of at least this are predicted good.
CUT = 0.3
_MARKS = b".,!?;:-'\"()|#$%&*/\\<>=_@"
_LOW, _UP = bytes(range(97, 123)), bytes(range(65, 91))


def features(text: str | None) -> list[float]:
    """Description of a whole text; that of a null text is that of an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    lower, upper = float(seen[97:123].sum()), float(seen[65:91].sum())
    digits, wide = float(seen[48:58].sum()), float(seen[128:].sum())
    blanks, lines = float(seen[[32, 9, 13]].sum()), float(seen[10])
    letters = max(1.0, lower + upper + wide)
    out = [np.log1p(len(data)), lower / n, upper / n, upper / letters, digits / n, wide / n, blanks / n, lines / n]
    out += [float(seen[c]) / n for c in _MARKS]
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    far = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    top = kinds.most_common(1)[0][1] if kinds else 0
    out += [np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max())]
    out += [len(kinds) / k, pairs / max(1, k - 1), far / max(1, k - 3), doubled / k, top / k]
    rows = [r for r in data.split(b"\n") if r.strip()]
    out += [np.log1p(len(rows)), len(set(rows)) / max(1, len(rows)), len(words) / max(1, len(rows))]
    out += [sum(w.isupper() for w in words) / k, sum(w.isdigit() for w in words) / k, data.count(b"://") / k, float((lengths <= 3).mean())]
    return [float(x) for x in out]


@dataclass
class QualityModel:
    """Weights over standardised features and their cuts at quantiles; scale and cut place the scores between 0 and 1."""

    mean: np.ndarray
    spread: np.ndarray
    cuts: np.ndarray
    weights: np.ndarray
    scale: float
    cut: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        return np.concatenate([z, *((x > c).astype(float) for c in self.cuts)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; CUT where the raw score is at the threshold."""
        return sigmoid(self.scale * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT)))

    def column(self, spark, text: Column) -> Column:
        shared = spark.sparkContext.broadcast(self)

        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                texts = batch.to_pylist()
                x = np.array([features(t) for t in texts]) if texts else np.zeros((0, len(features(None))))
                yield pa.array(shared.value.score(x), pa.float64())

        return F.arrow_udf(apply, "double")(text.cast("string"))


def bradley_terry(better: np.ndarray, worse: np.ndarray, l2: float, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss of (better - worse) and l2 / 2 times their squares, by Newton's method."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = sigmoid(d @ w)
        gradient = d.T @ (p - 1) / len(d) + l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", doc_col: str = "doc_id", label_col: str = "quality", per_class: int = 1500, pairs: int = 20_000, l2: float = 1e-3, seed: int = 23) -> QualityModel | None:
    """Model from labelled documents; None unless both labels occur.

    A sample of about per_class documents of each label, chosen by a hash of the
    id, gives ``pairs`` seeded pairs. Null ids, null texts and null labels are
    left out; of several labels of a document the least counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(doc_col).alias("_id")).agg(F.min(label_col).alias("_label")).where("_id is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    share = {k: min(1.0, per_class / v) for k, v in sizes.items()}
    draw = lambda c: F.pmod(F.xxhash64(F.lit(seed), c.cast("long")), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(draw(F.col("_id")) < F.when(F.col("_label") == 1, share[1]).otherwise(share[0]))
    texts = docs.where((draw(F.col(doc_col)) < max(share.values())) & F.col(text_col).isNotNull()).select(F.col(doc_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    described = F.arrow_udf(lambda texts: pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64())), "array<double>")
    rows = texts.join(chosen, "_id").select("_id", "_label", described("_text").alias("x")).toPandas().sort_values("_id", kind="stable")
    if rows["_label"].nunique() < 2:
        return None
    x, y = np.array(rows["x"].tolist()), rows["_label"].to_numpy()
    cuts = np.quantile(x, (0.02, 0.1, 0.3, 0.7, 0.9, 0.98), axis=0)
    model = QualityModel(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), cuts, np.zeros(0), 1.0, 0.0)
    z = model.expand(x)
    rng = np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    model.weights = bradley_terry(z[good], z[bad], l2)
    raw = z @ model.weights
    model.cut = float(np.quantile(raw, best_quantile(raw, y)))
    model.scale = float(2.0 / max(1e-9, np.abs(raw - model.cut).mean()))
    return model


def best_quantile(raw: np.ndarray, y: np.ndarray, steps: int = 199) -> float:
    """The quantile of the scores at which rejecting what is below separates the labels best (middle of the best range)."""
    levels = np.arange(1, steps + 1) / (steps + 1)
    gain = np.array([(raw[y == 1] >= c).mean() + (raw[y == 0] < c).mean() for c in np.quantile(raw, levels)])
    return float(np.median(levels[gain >= gain.max() - 1e-12]))


def rate(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.3); they replace columns of these names.

    Null and empty texts are scored by the same model. Without a model every
    score is CUT and every document predicted good. Equal texts get equal
    scores; an empty table gives no rows.
    """
    held = docs.drop("score", "predicted")
    score = model.column(docs.sparkSession, F.col(text_col)) if model else F.lit(CUT)
    return held.withColumn("score", score).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
