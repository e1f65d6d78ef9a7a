"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to lower-case letters with everything else as space; n-grams of
one to three characters that hold a letter are hashed into 2**16 buckets. A
text's feature is the bucket's share of its n-grams times the bucket's inverse
document frequency, which is counted over all documents that may be learned
from. Weights are trained by follow-the-regularised-leader with L1 and L2
penalties; a temperature fitted on rows kept apart then calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import golden_min

BITS = 16
BUCKETS = 1 << BITS
SCALE = 40.0
UNKNOWN = "und"
_MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LETTERS_END = 0x32400  # no letters above
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    if not _FOLD:
        made = np.full(_LETTERS_END + 1, 32, dtype=np.uint32)
        for i in range(_LETTERS_END):
            if (c := chr(i)).isalpha():
                low = c.lower()
                made[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(made)
    return _FOLD[0]


def fold(text: str | None) -> np.ndarray:
    """Code points of a text: lower-case letters, else spaces; one space before, two after."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.full(len(points) + 3, 32, dtype=np.uint32)
    out[1:-2] = _fold_table()[np.minimum(points, _LETTERS_END)]
    return out


def buckets(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each position but the last two the buckets of its 1-, 2- and 3-gram; BUCKETS if it holds no letter."""
    c = folded.astype(np.uint64)
    letter = folded != 32
    shift = np.uint64(64 - BITS)
    one = c[:-2] + np.uint64(1)
    two = (one << np.uint64(21)) + c[1:-1]
    three = (two << np.uint64(21)) + c[2:]
    has = [letter[:-2], letter[:-2] | letter[1:-1], letter[:-2] | letter[1:-1] | letter[2:]]
    mixed = ((x ^ (x >> np.uint64(29))) * np.uint64(m) for x, m in zip((one, two, three), _MULTIPLY, strict=True))
    return tuple(np.where(h, (x >> shift).astype(np.int64), BUCKETS) for h, x in zip(has, mixed, strict=True))


def _windows(texts: list[str | None], size: int = 400_000) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Folded texts joined into windows of bounded length, with (text number, start) of what is in each; long texts span several."""
    parts, at, held = [], [], 0
    for k, text in enumerate(texts):
        c = fold(text)
        for first in range(0, len(c) - 2, size):
            part = c[first : first + size + 2]
            at.append((k, held))
            parts.append(part)
            held += len(part)
            if held >= size:
                yield np.concatenate(parts), at
                parts, at, held = [], [], 0
    if parts:
        yield np.concatenate(parts), at


def text_sums(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """For each text the sums of the weight rows of its n-grams; weights has a row of zeros for BUCKETS."""
    out = np.zeros((len(texts), weights.shape[1]))
    for joined, at in _windows(texts):
        # the two positions at the border of two parts start n-grams of spaces and the next part's first letter
        one, two, three = buckets(joined)
        border = np.array([s for _, s in at[1:]], dtype=np.int64)
        for gram in (one, two, three):
            gram[border - 1] = gram[border - 2] = BUCKETS
        rows = weights[one] + weights[two] + weights[three]
        sums = np.add.reduceat(rows, np.array([s for _, s in at]), axis=0)
        np.add.at(out, [k for k, _ in at], sums)
    return out


@dataclass
class LanguageModel:
    """languages, weights (BUCKETS + 1 rows; one column each, IDF applied, and a last column that counts n-grams), bias, temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        sums = text_sums(texts, self.weights)
        n = sums[:, -1]
        return SCALE * sums[:, :-1] / np.maximum(n, 1)[:, None] + self.bias, n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        z, n = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return [(self.languages[b], float(row[b])) if k else (UNKNOWN, 0.0) for b, row, k in zip(best, p, n, strict=True)]

    def column(self, spark, text: Column) -> Column:
        """struct<lang_pred, score> of a text column."""
        shared = spark.sparkContext.broadcast(self)

        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                got = shared.value.predict(batch.to_pylist())
                yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

        return F.arrow_udf(apply, "lang_pred string, score double")(text.cast("string"))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _document_frequency(texts: DataFrame) -> np.ndarray:
    """Documents that hold each bucket; the last entry is the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held = np.zeros(BUCKETS + 1, dtype=bool)
                for joined, _ in _windows([text]):
                    for gram in buckets(joined):
                        held[gram] = True
                held[BUCKETS] = True
                total += held
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for row in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.bucket] = row.n
    return out


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS, classes) and bias by follow-the-regularised-leader with elastic net; the bias is not penalised."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)
    order = np.random.default_rng(seed)

    def solve(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = solve(z[at], n[at])
            g = softmax(x @ w + bias)
            g[labels[i]] -= 1
            step = np.outer(x, g)
            grown = n[at] + step**2
            z[at] += step - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            bias_n += g**2
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    return solve(z, n), bias


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    doc_col: str = "doc_id",
    per_language: int = 500,
    max_languages: int = 1000,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.01,
    seed: int = 11,
) -> LanguageModel:
    """Model learned from all rows of docs with a text and a language.

    Document frequencies are counted over all of them; weights are fitted on a
    sample of about per_language rows of each language, chosen by a hash of the
    id. Without rows the model knows no language and says ``und`` of all texts.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS + 1, 1), dtype=np.float32), np.zeros(0), 1.0)
    names = sorted(sizes)
    frequency = _document_frequency(known.select(F.col(text_col).cast("string")))
    idf = np.log((1.0 + frequency[-1]) / (1.0 + frequency[:-1])) + 1.0

    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_col), F.length(text_col)), F.lit(1_000_000)) / 1_000_000
    share = F.element_at(F.create_map(*(F.lit(x) for k in names for x in (k, min(1.0, per_language / sizes[k])))), F.col(lang_col).cast("string"))
    sample = known.where(draw < share).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.lit(seed + 1), F.col(doc_col)).alias("h"))
    rows, labels, turn = [], [], []
    for r in sample.toLocalIterator():
        counts = np.bincount(np.concatenate([b for joined, _ in _windows([r.t]) for b in buckets(joined)]), minlength=BUCKETS + 1)[:BUCKETS]
        at = np.flatnonzero(counts)
        if len(at):
            rows.append((at, SCALE * counts[at] / counts.sum() * idf[at]))
            labels.append(names.index(r.l))
            turn.append(r.h)
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS + 1, 1), dtype=np.float32), np.zeros(0), 1.0)
    order = np.lexsort((labels, turn))
    rows, labels = [rows[i] for i in order], np.array(labels)[order]
    apart = np.arange(len(rows)) % 5 == 4  # for the temperature
    learn = np.flatnonzero(~apart)
    weights, bias = _ftrl([rows[i] for i in learn], labels[learn], len(names), epochs, alpha, beta, l1, l2, seed)
    temperature = 1.0
    if apart.any() and len(names) > 1:
        z = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in np.flatnonzero(apart)])
        y = labels[apart]
        # as if one more row had been wrong, so that rows without an error don't make every score 1
        goal = np.full((len(y), len(names)), 1 / (len(y) + 1) / (len(names) - 1))
        goal[np.arange(len(y)), y] = len(y) / (len(y) + 1)
        loss = lambda t: -(goal * np.log(np.maximum(softmax(z / np.exp(t)), 1e-30))).sum(axis=1).mean()
        temperature = float(np.exp(golden_min(loss, -3.0, 3.0)))
    table = np.zeros((BUCKETS + 1, len(names) + 1), dtype=np.float32)
    table[:-1, :-1] = weights * idf[:, None]
    table[:-1, -1] = 1.0
    return LanguageModel(names, table, bias, temperature)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (they replace columns of these names).

    A null text and a text without letters get ``und`` with score 0. Equal texts
    get equal answers; an empty table gives no rows.
    """
    held = docs.drop("_lang", "lang_pred", "score")
    return held.withColumn("_lang", model.column(docs.sparkSession, F.col(text_col))).withColumns({"lang_pred": F.col("_lang.lang_pred"), "score": F.col("_lang.score")}).drop("_lang")
