"""Brute-force versions and small texts."""

import random
import re


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(n, linked):
    part = list(range(n))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                part[find(i)] = find(j)
    return [find(i) for i in range(n)]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
