import hashlib
import os
import random
from collections import Counter

import pytest

from tests.llm.helpers import words
from weftline.llm import align

pytestmark = pytest.mark.skipif(not os.path.exists(f"{align.TOKENIZERS}/{align.A_FILE}"), reason="no tokenizers here")

TEXTS = [
    None, "", " ", "a", "Hello, world!", "  two  spaces ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁piece", "tabs\tand\nlines\r\n\n", "naïve café ﬁ é", "日本語のテキスト", "😀 emoji 👩‍👩‍👧", "a\x00b", "﻿mark", "we're it's I'll",
    "Étion dans, çouelle un éonierç", "   　x", "word " * 3000, "x" * 20_000, "ﻼ العربية עברית हिन्दी",
]


def encoded(text):
    """Ids and byte ranges' ends of both sides by the files' own libraries; nothing if bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    if not hasattr(encoded, "a"):
        encoded.a = Tokenizer.from_file(f"{align.TOKENIZERS}/{align.A_FILE}")
        encoded.a.encode_special_tokens = True
        encoded.b = sentencepiece.SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/{align.B_FILE}")
        encoded.letters = {ord(ByteLevel().decode([c])): c for c in map(chr, range(256, 324)) if len(ByteLevel().decode([c])) == 1 and ord(ByteLevel().decode([c])) < 128}
    if not text:
        return [], [], [], []
    a = encoded.a.encode(f" {text}", add_special_tokens=False).ids
    b = encoded.b.encode(text)
    byte_of = align._byte_letters()
    a_bytes = [bytes(byte_of[c] for c in encoded.a.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if encoded.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [encoded.b.id_to_piece(i)]]
    whole = f" {text}".encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], [], []
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 500 else list(__import__("itertools").accumulate(map(len, parts)))
    return a, b, ends(a_bytes), ends(b_bytes)


def brute(texts):
    """Rows of the report, by sets of ends and pairs of ends."""
    docs, pairs = [], Counter()
    for text in texts:
        a, b, a_ends, b_ends = encoded(text)
        common = sorted(set(a_ends) & set(b_ends))
        groups, at = [], 0
        for end in common:
            groups.append([[i for i, e in zip(x, ends, strict=True) if at < e <= end] for x, ends in ((a, a_ends), (b, b_ends))] if len(a) < 4000 else None)
            at = end
        where = dict(zip(b_ends, b, strict=True))
        links = [(i, where[e]) for i, e in zip(a, a_ends, strict=True) if e in where]
        pairs.update(links)
        docs.append((a, b, groups, links))
    best = Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in docs:
        text = None if None in groups else ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), text if text is None else hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def test_report_equals_brute_force(spark):
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["a", "b ", " ", "é", "ß", "1", "\n", ".", "日", "the", "ing", "'s", "\t", "😀"]) for _ in range(200)) for _ in range(40)]
    texts = TEXTS + mixed + mixed[:3] + [" ".join(words(300, 2))]
    df = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a long, links string")
    got = {r.doc_id: tuple(r)[1:] for r in align.alignment_report(df).collect()}
    for i, want in enumerate(brute(texts)):
        row = got[i if i else None]
        assert row[:6] == want[:6] and (want[6] is None or row[6] == want[6]), texts[i]
    assert align.alignment_report(df.limit(0)).count() == 0


def test_groups_hold_all_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in align.align_tokens(df).collect():
        a, b, a_ends, b_ends = encoded(TEXTS[r.doc_id])
        assert (r.a_ids, r.b_ids) == (a, b)
        assert sum(r.a_sizes) == len(a) and sum(r.b_sizes) == len(b) and all(r.a_sizes) and all(r.b_sizes)
        at = [0, 0]
        for n, m in zip(r.a_sizes, r.b_sizes, strict=True):
            at = [at[0] + n, at[1] + m]
            assert a_ends[at[0] - 1] == b_ends[at[1] - 1]


def test_fast_way_equals_the_file_s_tokenizer():
    tokens = align.ByteTokens(f"{align.TOKENIZERS}/{align.A_FILE}")
    letters = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    rng = random.Random(4)
    texts = [f" {c}{c} a{c}b 1{c}  x" for c in letters] + [" " + "".join(rng.choices(letters + [" ", "\n", "a", "e", "t"] * 60, k=300)) for _ in range(200)]
    for text in texts:
        assert not align._RARE.search(text)
        assert tokens.encode(text) == tokens.slow.encode(text, add_special_tokens=False).ids, text


def test_pairs_are_few():
    """One token of a pair ends the other, so pairs are bounded by the entries' bytes."""
    sizes = [sum(map(len, kind(f"{align.TOKENIZERS}/{f}").bytes)) for kind, f in ((align.ByteTokens, align.A_FILE), (align.PieceTokens, align.B_FILE))]
    assert 2 * sizes[0] + sizes[1] < 1_000_000
