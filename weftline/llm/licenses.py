"""Licence scans by a trained paragraph classifier.

Paragraphs (lines) are described by their word n-grams of one to three words, as
far as licence notices use them. A sparse multinomial logistic regression tells
licence families from ordinary text; its training rows are the notices below,
varied at random and set in lines of the corpus, and plain and shuffled lines.
A temperature and a least probability are fitted on rows kept apart; below it a
paragraph is ordinary text. A family must also be confirmed by a notice: most of
its word pairs must stand in the paragraph. A paragraph that is no family's but
holds half of a notice is of an ``unknown`` licence. Notices that are wrapped over
lines are confirmed over the joined words of the lines in which they stand.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import golden_min
from weftline.llm.decontaminate import split_words
from weftline.llm.langid import softmax

UNKNOWN = "unknown"
#: Short notices of public licences; # stands for any number.
NOTICES = {
    "agpl": ["licensed under the gnu affero general public license version #", "gnu affero general public license as published by the free software foundation"],
    "apache": ["licensed under the apache license version # #", "you may not use this file except in compliance with the license", "spdx license identifier apache # #"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "licensed under the bsd # clause license"],
    "cc-by": ["licensed under cc by # #", "licensed under a creative commons attribution # # international license"],
    "cc-by-nc": ["licensed under cc by nc # #", "licensed under a creative commons attribution noncommercial # # international license"],
    "cc-by-sa": ["licensed under cc by sa # #", "licensed under a creative commons attribution sharealike # # international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related rights", "released under cc0 # #"],
    "gpl": ["this work is licensed under the gnu general public license version #", "under the terms of the gnu general public license as published by the free software foundation", "spdx license identifier gpl # #"],
    "lgpl": ["licensed under the gnu lesser general public license version #", "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit"],
    "mpl": ["subject to the terms of the mozilla public license v # #", "licensed under the mozilla public license version # #"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    UNKNOWN: ["licensed under the terms of the agreement", "all rights reserved under the license", "released under the license", "licensed under the public license"],
}
#: Shares of a notice's word pairs: for a family, and for an unknown licence.
CONFIRM, RESEMBLE = 0.75, 0.5


def paragraph_words(line: bytes) -> list[bytes]:
    """Normalised words of a line; numbers are #."""
    return [b"#" if w.isdigit() else w for w in split_words(line)]


def _grams(words: list) -> list[tuple]:
    return [tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@dataclass
class LicenseModel:
    """classes[0] is ordinary text (None)."""

    classes: list[str | None]
    known: frozenset[bytes]
    index: dict[tuple, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def vector(self, words: list[bytes]) -> list[int]:
        return [k for g in _grams(words) if (k := self.index.get(g)) is not None]

    def judge(self, words: list[bytes]) -> tuple[str | None, float]:
        """Family, unknown or None of a paragraph, and the probability that it is a licence."""
        at = self.vector(words)
        p = softmax((self.weights[at].sum(axis=0) / np.sqrt(max(1, len(at))) + self.bias) / self.temperature)
        score = float(1 - p[0])
        best = int(p.argmax())
        if not best or score < self.least:
            return None, score
        family = self.classes[best]
        if family != UNKNOWN and p[best] >= self.least and confirmed(family, words):
            return family, score
        return (UNKNOWN if any(confirmed(f, words, RESEMBLE) for f in NOTICES) else None), score

    def scan(self, text: str | None) -> list[tuple[int, str, float]]:
        """First line's number, family and score of the licence paragraphs of a whole text.

        Lines are judged alone; then notices wrapped over several lines are sought
        in runs of lines that no blank line and no line of a family divides.
        """
        out: dict[int, tuple[str, float]] = {}
        run: list[tuple[int, list[bytes]]] = []
        for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
            raw = split_words(line)
            words = [b"#" if w.isdigit() else w for w in raw]
            # without two neighbours that notices use, a line is ordinary text
            held = [w in self.known or w.isdigit() for w in raw]
            family, score = self.judge(words) if any(map(bool.__and__, held, held[1:])) else (None, 0.0)
            if family:
                out[k] = family, score
            if words and family in (None, UNKNOWN):
                run.append((k, words))
            else:
                self._wrapped(run, out)
                run = []
        self._wrapped(run, out)
        return [(k, *out[k]) for k in sorted(out)]

    def _wrapped(self, run: list[tuple[int, list[bytes]]], out: dict[int, tuple[str, float]]) -> None:
        """Add the notices that stand in two or more lines of a run; a family replaces what its lines are alone."""
        if len(run) < 2:
            return
        words = [w for _, line in run for w in line]
        ends = list(accumulate(len(line) for _, line in run))
        starts = [0, *ends[:-1]]
        hits = [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in _HOLDERS]
        first, kept = 0, None
        while first < len(run) - 1:
            last = min(bisect_left(ends, ends[first] + _REACH), len(run) - 1)
            near = hits[bisect_left(hits, starts[first]) : bisect_left(hits, ends[last] - 1)]
            # pairs inside one line were judged with it
            if not (kept and kept[0] == first) and (len(near) < 2 or near[-1] + 1 < ends[bisect_right(ends, near[0])]):
                first += 1
                continue
            found = None
            part = lambda i, j: words[starts[i] : ends[j]]
            for f, share in sorted(_shares(part(first, last)).items(), key=lambda x: -x[1]):
                if share < RESEMBLE:
                    break
                i, j = first, last
                while j > i and _shares(part(i, j - 1)).get(f, 0.0) >= share:
                    j -= 1
                while j > i and _shares(part(i + 1, j)).get(f, 0.0) >= share:
                    i += 1
                family, score = self.judge(part(i, j)) if j > i else (None, 0.0)
                if family and (not found or found[2] == UNKNOWN != family):
                    found = i, j, family, score
            if found and found[0] > first:  # look again with the whole reach of its own first line
                kept, first = found, found[0]
                continue
            found = found or (kept if kept and kept[0] == first else None)
            if not found:
                first += 1
                continue
            i, j, family, score = found
            alone = [k for k, _ in run[i : j + 1] if k in out]
            if family != UNKNOWN or not alone:
                for k in alone:
                    del out[k]
                out[run[i][0]] = family, score
                first = j + 1
            else:
                first += 1


def _pairs(notice: str) -> set[tuple[bytes, bytes]]:
    w = notice.encode().split()
    return set(zip(w, w[1:], strict=False))


#: Word pairs of each notice, the notices of each pair, and the words in which a notice that starts in a line ends, with some to spare.
_NOTICE_PAIRS = [(f, _pairs(n)) for f, notices in NOTICES.items() for n in notices]
_HOLDERS = {pair: [k for k, (_, pairs) in enumerate(_NOTICE_PAIRS) if pair in pairs] for _, held in _NOTICE_PAIRS for pair in held}
_REACH = max(len(n.split()) for notices in NOTICES.values() for n in notices) + 8


def _shares(words: list[bytes]) -> dict[str, float]:
    """For each family, the largest share of a notice's word pairs that stand in the paragraph; families without any are left out."""
    counts = Counter(k for pair in set(zip(words, words[1:], strict=False)) if pair in _HOLDERS for k in _HOLDERS[pair])
    out: dict[str, float] = {}
    for k, n in counts.items():
        family, pairs = _NOTICE_PAIRS[k]
        out[family] = max(out.get(family, 0.0), n / len(pairs))
    return out


def confirmed(family: str, words: list[bytes], least: float = CONFIRM) -> bool:
    """Whether most word pairs of one of the family's notices stand in the paragraph."""
    have = set(zip(words, words[1:], strict=False))
    for notice in NOTICES[family]:
        w = notice.encode().split()
        pairs = set(zip(w, w[1:], strict=False))
        if len(pairs & have) >= least * len(pairs):
            return True
    return False


def _sparse_logistic(rows: list[list[int]], y: np.ndarray, width: int, classes: int, l1: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by accelerated proximal gradient descent on the mean log loss with an L1 penalty."""
    x = np.zeros((len(rows), width))
    for i, at in enumerate(rows):
        if at:
            np.add.at(x[i], at, 1.0 / np.sqrt(len(at)))
    target = np.eye(classes)[y]
    rate = 2.0 / (np.linalg.norm(x, 2) ** 2 / len(x) + 1.0)
    w, b = np.zeros((width, classes)), np.zeros(classes)
    v, vb = w.copy(), b.copy()
    for k in range(steps):
        g = (softmax(x @ v + vb) - target) / len(x)
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = vb - rate * g.sum(axis=0)
        pull = k / (k + 3)
        v, vb = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, b


def fit(docs: DataFrame, text_col: str = "text", doc_col: str = "doc_id", documents: int = 300, per_document: int = 10, variants: int = 40, seed: int = 31) -> LicenseModel:
    """Model trained on the notices and on lines of about ``documents`` documents chosen by a hash of the id."""
    total = docs.count()
    share = min(1.0, documents / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_col)), F.lit(1_000_000)) / 1_000_000
    rng = np.random.default_rng(seed)
    plain: list[list[bytes]] = []
    for r in docs.where((draw < share) & F.col(text_col).isNotNull()).select(F.col(doc_col).alias("d"), F.col(text_col).cast("string").alias("t")).orderBy("d", "t").toLocalIterator():
        lines = [w for line in r.t.encode("utf-8", "surrogatepass").split(b"\n") if (w := paragraph_words(line))]
        plain += [lines[i] for i in rng.permutation(len(lines))[:per_document]]
    plain = [w for w in plain if not any(confirmed(f, w) for f in NOTICES)]
    classes: list[str | None] = [None, *NOTICES]
    notices = [(c, n.encode().split()) for c, family in enumerate(classes) if family for n in NOTICES[family]]
    filler = [w for words in plain for w in words] or [b"x"]
    bag = [w for _, n in notices for w in n]
    rows: list[tuple[list[bytes], int]] = [(w, 0) for w in plain]
    for c, n in notices:
        for v in range(variants):
            words = [w for w in n if v == 0 or rng.random() > 0.05]
            before, after = (([filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))] if rng.random() < 0.5 else []) for _ in "ab")
            rows.append(([*before, *words, *after], c))
    rows += [([bag[i] if rng.random() < 0.3 else filler[j] for i, j in zip(rng.integers(0, len(bag), 15), rng.integers(0, len(filler), 15), strict=True)], 0) for _ in range(variants * 10)]
    grams = sorted({g for _, n in notices for g in _grams(n)})
    model = LicenseModel(classes, frozenset(bag), {g: k for k, g in enumerate(grams)}, np.zeros(0), np.zeros(0), 1.0, 0.5)
    order = rng.permutation(len(rows))
    x, y = [model.vector(rows[i][0]) for i in order], np.array([rows[i][1] for i in order])
    apart = np.arange(len(x)) % 4 == 3
    model.weights, model.bias = _sparse_logistic([x[i] for i in np.flatnonzero(~apart)], y[~apart], len(grams), len(classes))
    z = np.array([model.weights[x[i]].sum(axis=0) / np.sqrt(max(1, len(x[i]))) + model.bias for i in np.flatnonzero(apart)])
    truth = y[apart]
    loss = lambda t: -np.log(np.maximum(softmax(z / np.exp(t))[np.arange(len(truth)), truth], 1e-12)).mean()
    model.temperature = float(np.exp(golden_min(loss, -3.0, 2.0)))
    p = softmax(z / model.temperature)
    own = p[np.arange(len(truth)), truth][truth > 0]
    model.least = float(np.clip(np.quantile(own, 0.02), 0.2, 0.6))
    return model


def license_column(spark, model: LicenseModel, text: Column) -> Column:
    """array<struct<line, family, score>> of the licence paragraphs of a text column."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("score", pa.float64())]))

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"line": k, "family": f, "score": s} for k, f, s in shared.value.scan(t)] for t in batch.to_pylist()], kind)

    return F.arrow_udf(apply, "array<struct<line:bigint,family:string,score:double>>")(text.cast("string"))


def scan_licenses(docs: DataFrame, model: LicenseModel, text_col: str = "text") -> DataFrame:
    """docs with licenses, an array of the licence paragraphs' line, family and score (it replaces a column of this name).

    Null and empty texts have none. Equal texts get equal answers; an empty table gives no rows.
    """
    return docs.drop("licenses").withColumn("licenses", license_column(docs.sparkSession, model, F.col(text_col)))
