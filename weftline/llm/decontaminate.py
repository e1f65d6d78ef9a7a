"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items build one suffix automaton over word
numbers. Every training text is streamed through it word by word; the automaton
keeps the length of the longest suffix read so far that occurs in some item. A
span of at least ``window`` words (or a whole shorter item) is a hit. Reports
give counts; ``remove_spans`` cuts the spans out or drops whole documents.

The automaton is broadcast. Its size is bounded: items are dealt into shards of
at most ``shard_words`` words, each shard is its own broadcast, and the hits of
several shards are joined per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import free_name

#: Fixed by the contract: words are runs of anything but ASCII other than letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
COVERAGE = 20

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text; none for null."""
    return text.translate(_TABLE).split() if text else []


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over word numbers."""

    window: int
    vocab: dict[bytes, int] = field(default_factory=dict)
    nexts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Of each state that holds a window: the items that contain it.
    items: dict[int, frozenset] = field(default_factory=dict)
    #: Of each state with short whole items: their lengths and ids.
    shorts: dict[int, list[tuple[int, object]]] = field(default_factory=dict)
    #: Of each state of at least window words: the state of its last window words.
    at_window: dict[int, int] = field(default_factory=dict)
    #: Of each state: the nearest state with short items, itself included, or -1.
    short_up: list[int] = field(default_factory=list)
    pairs: np.ndarray | None = None
    shortest: int = 0

    def _split(self, p: int, c: int, q: int) -> int:
        """State of the strings of q that are one word longer than those of p; q is split if it holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.nexts.append(dict(self.nexts[q]))
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.nexts[p].get(c) == q:
            self.nexts[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        if c in self.nexts[last]:
            return self._split(last, c, self.nexts[last][c])
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.nexts.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.nexts[p]:
            self.nexts[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.nexts[p][c])
        return new

    @classmethod
    def build(cls, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> SuffixAutomaton:
        sam = cls(window)
        coded = [(i, [sam.vocab.setdefault(w, len(sam.vocab) + 1) for w in words]) for i, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = sam.extend(last, c)
        found: dict[int, set] = {}
        grams = set()
        for item, seq in coded:
            grams.update(zip(seq, seq[1:], strict=False))
            state = 0
            for at, c in enumerate(seq, 1):
                state = sam.nexts[state][c]
                if at >= window:
                    up = state
                    while sam.length[sam.link[up]] >= window:
                        up = sam.link[up]
                    found.setdefault(up, set()).add(item)
            if len(seq) < window:
                up = state
                while sam.length[sam.link[up]] >= len(seq):
                    up = sam.link[up]
                sam.shorts.setdefault(up, []).append((len(seq), item))
        sam.items = {k: frozenset(v) for k, v in found.items()}
        sam.shortest = min([window, *(len(seq) for _, seq in coded)])
        order = sorted(range(len(sam.length)), key=sam.length.__getitem__)
        sam.short_up = [-1] * len(sam.length)
        for v in order:
            up = sam.link[v]
            sam.short_up[v] = v if v in sam.shorts else sam.short_up[up] if up >= 0 else -1
            if sam.length[v] >= window:
                sam.at_window[v] = sam.at_window[up] if up >= 0 and sam.length[up] >= window else v
        sam.pairs = np.sort(np.array([a * (len(sam.vocab) + 1) + b for a, b in grams], dtype=np.int64))
        return sam

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of codes in which every word and every pair of neighbours occurs in items; no match crosses their ends."""
        known = codes > 0
        if self.shortest > 1 and len(codes) > 1:
            joined = np.zeros(len(codes), dtype=bool)  # word i and word i + 1 follow each other in some item
            at = np.flatnonzero(known[:-1] & known[1:])
            if len(at) and len(self.pairs):
                key = codes[at] * (len(self.vocab) + 1) + codes[at + 1]
                pos = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                joined[at[self.pairs[pos] == key]] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
            runs = [(s, e + 1) for s, e in zip(edge[::2], edge[1::2], strict=True)]
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            runs = list(zip(edge[::2], edge[1::2], strict=True))
            if self.shortest == 1 and len(codes) > 1:
                return runs
        return [(s, e) for s, e in runs if e - s >= self.shortest]

    def scan(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans [start, end) and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set = set()

        def hit(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                s, e = spans.pop()
                start, end = min(s, start), max(e, end)
            spans.append((start, end))

        for first, stop in self.candidates(codes):
            state = matched = 0
            for at, c in enumerate(codes[first:stop].tolist(), first + 1):
                while state and c not in self.nexts[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if c in self.nexts[state]:
                    state = self.nexts[state][c]
                    matched += 1
                if matched >= self.window:
                    items |= self.items[self.at_window[state]]
                    hit(at - self.window, at)
                v = self.short_up[state]
                while v >= 0:
                    for n, item in self.shorts[v]:
                        if n <= matched:
                            items.add(item)
                            hit(at - n, at)
                    up = self.link[v]
                    v = self.short_up[up] if up >= 0 else -1
        return spans, items


REPORT = T.StructType(
    [
        T.StructField("_n_words", T.LongType()),
        T.StructField("_starts", T.ArrayType(T.LongType())),
        T.StructField("_ends", T.ArrayType(T.LongType())),
        T.StructField("_items", T.ArrayType(T.StringType())),
    ]
)


def _shards(items: DataFrame, item_col: str, text_col: str, shard_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items by shards of bounded size, read one after another from the sorted table."""
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t")
    shard: list[tuple[object, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        words = split_words(row.t.encode("utf-8", "replace") if row.t else None)
        if shard and size + len(words) > shard_words:
            yield shard
            shard, size = [], 0
        if words:
            shard.append((row.i, words))
            size += len(words)
    yield shard


def _scanner(shared):
    """UDF from texts to spans, with the automaton in the broadcast ``shared``."""

    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sam = shared.value
        get = sam.vocab.get
        for batch in texts:
            rows = []
            for text in batch.cast(pa.binary()):
                words = split_words(text.as_py())
                codes = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                spans, found = sam.scan(codes) if sam.vocab else ([], set())
                rows.append((len(codes), [s for s, _ in spans], [e for _, e in spans], sorted(i for i in found if i is not None)))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.name for f in REPORT])

    return F.arrow_udf(scan, REPORT)


def find_spans(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = 2_000_000,
    spans_col: str = "_spans",
) -> DataFrame:
    """docs with a struct column spans_col: word count, starts and ends of the hit spans in words, ids of the items.

    Null and empty texts have no words. Items without words match nothing; null
    item ids cause hits but are not listed. Repeated rows are judged alike. All
    columns of docs stay, but for one named like spans_col, which is replaced. An
    empty items table gives no hits, an empty docs table no rows. A long text is one
    row's work, in a time that grows with its length.
    """
    out = docs.drop(spans_col)
    names = []
    for k, shard in enumerate(_shards(items, item_col, item_text_col, shard_words)):
        names.append(free_name(docs, f"_spans_{k}"))
        scan = _scanner(docs.sparkSession.sparkContext.broadcast(SuffixAutomaton.build(shard, window)))
        out = out.withColumn(names[-1], scan(F.col(text_col).cast("string")))
    merged = F.col(names[0]) if len(names) == 1 else _merged(names)
    return out.withColumn(spans_col, merged).drop(*names)


def _merged(names: list[str]) -> Column:
    """Union of the spans and items of several shards."""
    pairs = F.array_sort(F.flatten(F.array(*(F.arrays_zip(F.col(n)["_starts"].alias("s"), F.col(n)["_ends"].alias("e")) for n in names))))
    kind = "array<struct<s:bigint,e:bigint>>"

    pairs = pairs.cast(kind)

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    spans = F.aggregate(pairs, F.filter(pairs, lambda x: F.lit(False)), join)
    return F.struct(
        F.col(names[0])["_n_words"].alias("_n_words"),
        F.transform(spans, lambda x: x["s"]).alias("_starts"),
        F.transform(spans, lambda x: x["e"]).alias("_ends"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(n)["_items"] for n in names))))).alias("_items"),
    )


def contamination_report(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", coverage: int = COVERAGE, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and coverage * n_hit >= n_words.
    """
    found = find_spans(docs, items, **options)
    r = F.col("_spans")
    hit = F.aggregate(F.zip_with(r["_ends"], r["_starts"], lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col(doc_col).alias("doc_id"),
        r["_n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(r["_items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(r["_items"], ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", coverage: int = COVERAGE, cut: bool = False, **options) -> DataFrame:
    """docs without the contaminated ones; with cut, the hit spans of the others are removed from their texts too.

    A cut text keeps its other words, lower-cased and joined by one space. Columns of
    docs stay, whatever their names; nulls, repeated rows and empty tables as in
    ``find_spans``.
    """
    name = free_name(docs, "_spans")
    found = find_spans(docs, items, text_col=text_col, spans_col=name, **options)
    r = F.col(name)
    hit = F.aggregate(F.zip_with(r["_ends"], r["_starts"], lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    kept = found.where(~((hit > 0) & (coverage * hit >= r["_n_words"])))
    if cut:
        kept = kept.withColumn(text_col, F.when(hit > 0, _cut(F.col(text_col), r["_starts"], r["_ends"])).otherwise(F.col(text_col)))
    return kept.drop(name)


@F.arrow_udf(T.StringType())
def _cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for t, s, e in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        if t is None:
            out.append(None)
            continue
        words = split_words(t.encode("utf-8", "replace"))
        gone = {i for a, b in zip(s, e, strict=True) for i in range(a, b)}
        out.append(" ".join(w.decode("utf-8") for i, w in enumerate(words) if i not in gone))
    return pa.array(out, pa.string())
