"""Alignment of two tokenizers' tokens by the byte offsets where both end a token.

Ends are cumulated on both sides and put into dictionaries from end to index;
the sorted common keys slice both id lists into groups. Links are the pairs of
tokens that end together, so the shorter token's bytes end the longer one's: the
number of different id pairs is bounded by the lengths of the vocabularies'
entries, whatever the corpus, and the table of their counts may be broadcast.

Tokens that are pieces of a text in any of Latin's scripts are found by
tiktoken, with ranks read from the same file; a test holds them against the
file's own tokenizer, which encodes all other texts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import Scratch, widened

#: Folder of the tokenizers' files, the same path on every executor.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How a byte-level vocabulary cuts a text before it merges bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of other characters go to the file's own tokenizer: libraries may know other editions of Unicode.
_RARE = re.compile("[^\x00-ɏ‐-‧]")
#: Tokens of a side that a task holds at once, if no single text has more.
_TOKENS = 100_000


def _byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        special = {x["id"] for x in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        merges = [x if isinstance(x, list) else x.split(" ") for x in file["model"]["merges"]]
        in_order = all(file["model"]["vocab"].get("".join(x)) == 256 + i for i, x in enumerate(merges))
        self.fast = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    @functools.cached_property
    def slow(self):
        """The file's own tokenizer, loaded by the first text that needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(self.path)
        tokens.encode_special_tokens = True
        return tokens

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _RARE.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """Ids and bytes of a sentencepiece file; it puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.lru_cache(maxsize=4)
def _loaded(kind: type, path: str) -> tuple:
    """A tokenizer and the lengths of its tokens, once for each worker."""
    tokens = kind(path)
    return tokens, np.array([len(b) for b in tokens.bytes], np.int64)


def cut(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of tokens of either side up to each common end, in order."""
    a_at = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))
    b_at = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


_NOTHING = tuple(np.zeros(0, np.int64) for _ in range(4))


def _aligned(text: str | None, a_path: str, b_path: str) -> tuple[np.ndarray, ...]:
    """Ids of both sides, and numbers of tokens of either side up to the end of each group."""
    if not text:
        return _NOTHING
    (a, a_len), (b, b_len) = _loaded(ByteTokens, a_path), _loaded(PieceTokens, b_path)
    whole = f" {text}".encode()
    a_ids, b_ids = a.encode(f" {text}"), b.encode(text)
    if b"".join(map(b.bytes.__getitem__, b_ids)) != whole or b"".join(map(a.bytes.__getitem__, a_ids)) != whole:
        return _NOTHING
    a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
    return a_ids, b_ids, *(np.array(x, np.int64) for x in cut(np.cumsum(a_len[a_ids]).tolist(), np.cumsum(b_len[b_ids]).tolist()))


def _sizes(cuts: np.ndarray) -> np.ndarray:
    return np.diff(cuts, prepend=0)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int32()))


def _aligned_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[list, list[tuple[np.ndarray, ...]]]]:
    """Ids of documents and what ``_aligned`` finds, a few texts at a time, so that memory holds no more than their tokens or one long text's."""
    for batch in batches:
        ids, held, size = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            held.append(_aligned(text.as_py(), a_path, b_path))
            size += len(held[-1][0])
            if size > _TOKENS:
                yield ids, held
                ids, held, size = [], [], 0
        if ids:
            yield ids, held


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return widened(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per document: doc_id, a_ids, b_ids, a_sizes, b_sizes (tokens of either side in each group).

    A text is encoded whole, with a space before it and without special tokens,
    whose strings are plain text. Null and empty texts, and those whose tokens'
    bytes are not the text's, have empty lists. Repeated rows and null ids stay as
    they are; other columns are left out; an empty table gives no rows. A text's
    tokens must fit in a task: about 200 bytes a token.
    """
    a_path, b_path = f"{folder}/{a_file}", f"{folder}/{b_file}"
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _aligned_batches(batches, a_path, b_path):
            lists = [[x[0] for x in found], [x[1] for x in found], [_sizes(x[2]) for x in found], [_sizes(x[3]) for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(_lists, lists)], ["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return rows.mapInArrow(aligned, f"doc_id {kind.simpleString()}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def links_of(a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different links of a document, as a * width + b, and how often each occurs. No token is without bytes, so a group's last tokens are its one pair that ends together."""
    return np.unique(a_ids[a_cuts - 1] * width + b_ids[b_cuts - 1], return_counts=True)


@functools.lru_cache(maxsize=4)
def _texts(n_a: int, n_b: int) -> np.ndarray:
    """Texts of ids with what follows, of one width: of A inside and at the end of a group, then of B likewise."""
    return np.array([f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], "S")


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, n_a: int, n_b: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of each group; n_a and n_b are the sizes of the vocabularies."""
    at_end_a, at_end_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    at_end_a[a_cuts - 1] = n_a
    at_end_b[b_cuts - 1] = n_b
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    b_before = np.repeat(np.concatenate([[0], b_cuts])[:-1], _sizes(a_cuts))
    a_before = np.repeat(a_cuts, _sizes(b_cuts))
    order[np.arange(len(a_ids)) + b_before] = a_ids + at_end_a
    order[np.arange(len(b_ids)) + a_before] = b_ids + at_end_b + 2 * n_a
    return _texts(n_a, n_b)[order].tobytes().translate(None, b"\0")[:-1]


def group_digests(docs: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per document, as ``align_tokens`` reads it: doc_id, n_a, n_b, n_groups, groups_sha256 and links (different id pairs a, b and their number n)."""
    a_path, b_path = f"{folder}/{a_file}", f"{folder}/{b_file}"
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _aligned_batches(batches, a_path, b_path):
            n_a, n_b = (len(_loaded(k, p)[1]) for k, p in ((ByteTokens, a_path), (PieceTokens, b_path)))
            texts = [groups_text(*x, n_a, n_b) for x in found]
            links = [links_of(*x, n_b) for x in found]
            pairs, times = (np.concatenate(x) for x in zip(*links, strict=True))
            struct = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (pairs // n_b, pairs % n_b, times)], ["a", "b", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    *(pa.array([len(x[k]) for x in found], pa.int64()) for k in (0, 1, 2)),
                    pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts]),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x, _ in links)]), pa.int32()), struct),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )

    return rows.mapInArrow(digests, f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<a:int,b:int,n:int>>")


def link_counts(digests: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold each id pair. Sums are taken before the shuffle, so its rows are at most those of the vocabularies' pairs a task."""
    return digests.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_link_counts(digests: DataFrame, counts: DataFrame) -> DataFrame:
    """digests with n_links, n_best and count_sum in place of links.

    counts is broadcast. One token of a pair ends the other one's bytes, so for each
    token there are at most as many partners of less bytes as it has bytes, twice
    with B's tokens of single bytes: under a million pairs of these vocabularies,
    for any corpus.
    """
    spark = digests.sparkSession
    table = counts.select("a", "b", "n").toArrow()
    a, b, n = (table.column(k).to_numpy().astype(np.int64) for k in ("a", "b", "n"))
    width = int(b.max(initial=0)) + 1
    order = np.argsort(a * width + b)
    a, b, n = a[order], b[order], n[order]
    most = np.zeros(width, np.int64)
    np.maximum.at(most, b, n)
    shared = spark.sparkContext.broadcast((a * width + b, n, n == most[b]))
    schema = digests.drop("links").schema
    kept = [x.name for x in schema]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            links = batch.column(batch.schema.get_field_index("links"))
            a, b, times = (x.to_numpy().astype(np.int64) for x in links.flatten().flatten())
            at = np.searchsorted(keys, a * width + b)
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times, times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(k)) for k in kept), *(pa.array(x[ends[1:]] - x[ends[:-1]], pa.int64()) for x in sums)],
                [*kept, "n_links", "n_best", "count_sum"],
            )

    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schema)
    return digests.mapInArrow(counted, f"{fields}, n_links long, n_best long, count_sum long")


def alignment_report(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document; texts are encoded once."""
    digests = Scratch(docs.sparkSession).write(group_digests(docs, folder))
    found = with_link_counts(digests, link_counts(digests))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
