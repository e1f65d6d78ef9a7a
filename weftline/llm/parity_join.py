"""N-gram Jaccard join by parity sketches.

A document is its set of distinct shingles of five words. Two sets whose Jaccard
similarity is at least 0.8 differ in at most a ninth of the sum of their sizes.
Every shingle is XORed into a bit sketch; sketches of two sets differ in no more
bits than the sets differ in shingles, which bounds the difference from below.

Sketches are compared within size bands. A band cuts the sketch into segments;
by the pigeonhole principle two similar sets differ in at most d segments, so
among m segments at least m - d are equal. Segments are ranked by their content
(number of shingles first), and a set is posted under its d + 1 + x highest: the
highest 1 + x of the equal segments are among these for both sets. Every set then
leaves out its x most frequent postings; the rarest posting of two similar sets
stays in both, so no pair is lost, while sets that share a passage only fall
apart. Postings meet in an equi-join; the distance of whole sketches drops most
chance meetings, and the shingles of the rest are compared.

Copies (equal sequences of words) are one class and are joined once. Within a
posting the classes first meet the least one only. Classes that are then still in
different components meet in blocks of bounded size: a first pass over sketches
names, for each class of a block, the others that it may link with, and a second
pass brings the texts of the named classes to the block, once each, verifies and
passes on a spanning forest of the links. So what leaves a block grows with its
classes and not with their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, free_name, grouped, heavy, join_facts, mix64, widened
from weftline.llm.graph import connected_components

SHINGLE = 5
#: Sizes below this link only with equal sets, and are posted under the whole set.
LEAST = 4
#: Of the postings that a class has in common with others, as many of the least as travel with it.
CARRIED = 16
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[:] = made
    return _POWERS


def normal_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: what stands between spaces and U+0009 to U+000D."""
    return text.lower().split() if text else []


def _hash_ranges(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of joined[start:end]."""
    power, inverse = _powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[np.frombuffer(joined, dtype=np.uint8)] * power[: len(joined)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(words: list[bytes], step: int = 100_000) -> np.ndarray:
    """Sorted distinct hashes of the shingles of five words; all words as one if there are fewer; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    size = min(SHINGLE, n)
    parts = []
    for first in range(0, n - size + 1, step):
        some = words[first : first + step + size - 1]
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        parts.append(_hash_ranges(b" ".join(some), starts[: len(some) - size + 1], ends[size - 1 :]))
    return np.unique(np.concatenate(parts))


def _segments(band: int) -> int:
    return 4 + (LEAST << band)


def _posted(found: np.ndarray, band: int, top: int) -> np.ndarray:
    """Keys of the ``top`` highest segments of a band's sketch."""
    segments = _segments(band)
    at = ((found >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # rises with the hash
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    mark = np.bitwise_xor.reduceat(found, first)
    size, place = np.diff(np.concatenate((first, [len(found)]))), at[first]
    if top < len(first):
        best = np.lexsort((place, mark, size))[-top:]
        mark, place = mark[best], place[best]
    elif top > len(first):
        empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), place)[len(first) - top :]
        mark, place = np.concatenate((mark, np.zeros(len(empty), dtype=np.uint64))), np.concatenate((place, empty))
    return mix64(mark ^ mix64(place + np.uint64((band + 1) << 40)))


def postings(found: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For its own band, and for the one below if a similar set can be there: how many postings may be left out, and the keys."""
    n = len(found)
    if n < LEAST:  # texts that repeat a few words have equal small sets at any length
        return [(0, mix64(np.bitwise_xor.reduce(found, keepdims=True) ^ mix64(np.array([n]))))] if n else []
    band = (n // LEAST).bit_length() - 1
    wanted = [(band, n // 4)]
    below = (LEAST << band) - 1  # largest size of the band below
    if band and 5 * below >= 4 * n:
        wanted.append((band - 1, (below + n) // 9))
    out = []
    for b, differ in wanted:
        spare = ((LEAST << b) // 4 + 1) // 2  # alike for all sets of a band, else a pair could lose its rarest posting
        out.append((spare, _posted(found, b, differ + 1 + spare)))
    return out


def sketch(found: np.ndarray) -> bytes:
    """Parity sketch of a set; its number of bits, a power of two, is two to four times the size."""
    bits = 16 << max(0, (len(found) // LEAST).bit_length() - 1)
    at = (found & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_link(n_a: int, sketch_a: bytes, n_b: int, sketch_b: bytes) -> bool:
    """False only if the sizes or the distance of the sketches rule a link out."""
    if 5 * min(n_a, n_b) < 4 * max(n_a, n_b):
        return False
    a, b = np.frombuffer(sketch_a, np.uint8), np.frombuffer(sketch_b, np.uint8)
    width = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in (a, b))
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n_a + n_b


_LISTS = pa.list_(pa.struct([("spare", pa.int32()), ("keys", pa.list_(pa.int64()))]))


def _features(class_bits: int):
    """doc_id, row_key, class (cid of class_bits bits, cid2 of 64 more), n; sketch and lists where a task first sees a class."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # classes of this task; their copies are not posted again
        for batch in batches:
            cids, others, sizes, sketches, lists = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = normal_words(text.as_py())
                found = shingles(words)
                mark = hashlib.md5(b" ".join(words)).digest() if words else None
                fresh = bool(words) and mark not in seen
                if fresh:
                    seen.add(mark)
                cids.append(int.from_bytes(mark[:8], "little", signed=True) >> (64 - class_bits) if words else None)
                others.append(int.from_bytes(mark[8:], "little", signed=True) if words else None)
                sizes.append(len(found))
                sketches.append(sketch(found) if fresh else None)
                lists.append([{"spare": spare, "keys": keys.view(np.int64)} for spare, keys in postings(found)] if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(cids, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(lists, _LISTS)],
                names=["doc_id", "row_key", "cid", "cid2", "n", "sketch", "lists"],
            )

    return features


#: Rows of candidates: a block (key, i, j), a class of it and those that it may link with.
_NAMED = "key long, i int, j int, cid long, others array<long>"


def _batch(named: list[tuple]) -> pa.RecordBatch:
    types = [("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("cid", pa.int64()), ("others", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*named, strict=True), types, strict=True)], names=[n for n, _ in types])


def _star_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of stars (key: centre, i: part of its rays, cid: ray) that sizes and sketches allow."""
    for batch in batches:
        d = batch.to_pydict()
        held = [may_link(*x) for x in zip(d["n_a"], d["sketch_a"], d["n_b"], d["sketch_b"], strict=True)]
        yield batch.select(["a", "i", "b"]).filter(pa.array(held, pa.bool_()))


def _pairs(key: int, same: bool, left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, int]]:
    """Candidates of a small block, one pair after another: places in left and right."""
    for p, (cid_a, part_a, hub_a, n_a, sketch_a, keys_a) in enumerate(left):
        for q in range(p + 1 if same else 0, len(right)):
            cid_b, part_b, hub_b, n_b, sketch_b, keys_b = right[q]
            if part_a != part_b and not (hub_a or hub_b) and may_link(n_a, sketch_a, n_b, sketch_b) and not any(k < key for k in keys_a if k in keys_b):
                yield p, q


def _many_pairs(key: int, same: bool, left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, int]]:
    """The same by arrays, for large blocks."""
    width = min(len(x[4]) for x in (*left, *right))

    def arrays(side: list[tuple]) -> tuple[np.ndarray, ...]:
        part, hub, n = (np.array([x[c] for x in side]) for c in (1, 2, 3))
        words = np.stack([np.bitwise_xor.reduce(np.frombuffer(x[4], np.uint8).reshape(-1, width), axis=0) for x in side])
        keys = np.full((len(side), CARRIED), key, dtype=np.int64)  # not below key: counts as none
        for k, x in enumerate(side):
            keys[k, : len(x[5])] = x[5]
        return part, hub, n, np.pad(words, ((0, 0), (0, -width % 8))).view(np.uint64), keys

    part_a, hub_a, n_a, words_a, keys_a = arrays(left)
    part_b, hub_b, n_b, words_b, keys_b = (part_a, hub_a, n_a, words_a, keys_a) if same else arrays(right)
    for p in np.flatnonzero(~hub_a).tolist():
        rest = np.arange(p + 1 if same else 0, len(right))
        small, large = np.minimum(n_b[rest], n_a[p]), np.maximum(n_b[rest], n_a[p])
        rest = rest[(part_b[rest] != part_a[p]) & ~hub_b[rest] & (5 * small >= 4 * large)]
        apart = np.bitwise_count(words_b[rest] ^ words_a[p]).sum(axis=1, dtype=np.int64)
        rest = rest[9 * apart <= n_b[rest] + n_a[p]]
        earlier = keys_a[p][keys_a[p] < key]
        if len(earlier) and len(rest):
            rest = rest[~np.isin(keys_b[rest], earlier).any(axis=1)]
        for q in rest.tolist():
            yield p, q


def _near(few: int):
    """Candidates of blocks: for each class that has any, those after it in the block that sizes and sketches allow.

    The hub of a posting has met all its classes before. A pair that also meets under a lesser posting which both classes carry is left to that one.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: list[tuple] = []
        for (key, i, j), held in grouped(batches, 3):
            left = [x[1:] for x in held if x[0] == i]
            right = left if i == j else [x[1:] for x in held if x[0] == j]
            found: dict[int, list[int]] = {}
            for p, q in (_pairs if len(held) <= few else _many_pairs)(key, i == j, left, right) if left and right else ():
                a, b = left[p][0], right[q][0]
                found.setdefault(b, [])
                found.setdefault(a, []).append(b)
            named += [(key, i, j, cid, others) for cid, others in found.items()]
            if len(named) >= 10_000:
                yield _batch(named)
                named = []
        if named:
            yield _batch(named)

    return near


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links within each block."""
    out_a, out_b = [], []
    for _, held in grouped(batches, 3):
        texts = {cid: text for cid, _, text in held}
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def of(cid: int, sets=sets, texts=texts) -> np.ndarray:
            if cid not in sets:
                sets[cid] = shingles(normal_words(texts[cid]))
            return sets[cid]

        def find(v: int, root=root) -> int:
            while (up := root.setdefault(v, v)) != v:
                root[v] = v = root[up]
            return v

        for a, others, _ in held:
            for b in others:
                if (p := find(a)) == (q := find(b)):
                    continue
                x, y = of(a), of(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    root[p] = q
                    out_a.append(a)
                    out_b.append(b)
        if len(out_a) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            out_a, out_b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _links(named: DataFrame, owners: DataFrame, texts: DataFrame, total: int, owner: Scratch) -> DataFrame:
    """Spanning forests (a, b) of the links among candidates; texts come to a block once for each class named there."""
    wanted = owners.join(named.select("cid").distinct(), "cid", "left_semi").select("cid", "row_key", "copies")
    scratch = Scratch(named.sparkSession)
    wanted = scratch.write(wanted).hint("merge")  # it grows with the rows: never broadcast
    held = scratch.write(join_facts(texts.select("row_key", "text"), wanted, "row_key", "copies", total).groupBy("cid").agg(F.first("text").alias("text")))
    met = named.join(held, "cid").select("key", "i", "j", "cid", "others", F.col("text").cast("binary"))
    links = owner.write(_by_block(met).mapInArrow(_verified, "a long, b long"))
    scratch.keep()
    return links


def _crowds(members: DataFrame, classes: DataFrame, few: int, block: int, most: int) -> DataFrame:
    """Candidates (_NAMED) among the open members (key, a, cid, part, sets, mass) of postings, dealt into blocks."""
    carried = members.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list("key")), 1, CARRIED).alias("keys"))  # at most a set's postings
    blocks = F.ceil(F.greatest(F.col("sets") / block, F.col("mass") / most)).cast("int")
    held = members.join(carried.join(classes, "cid"), "cid").withColumns({"at": F.pmod(F.xxhash64("cid", "key"), blocks).cast("int"), "x": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = held.select("key", F.least("at", "x").alias("i"), F.greatest("at", "x").alias("j"), "at", "cid", "part", (F.col("a") == F.col("cid")).alias("hub"), "n", "sketch", "keys")
    return _by_block(dealt).mapInArrow(_near(few), _NAMED)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of an id and a text; rows that agree in both are repeated rows."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.concat(F.lit("|"), text), F.lit(""))))


def jaccard_components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", few: int = 16, block: int = 512, most: int = 1 << 21, class_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, row_key (of id and text).

    component_id is the smallest doc_id that links reach. Null texts and texts
    without words have no shingles, no class, and their own doc_id as component.
    Repeated rows are copies. Null doc_ids are passed over when the smallest is
    sought; a component of null ids only has a null id. Rows that share a doc_id
    but not a text are documents of their own. An empty table gives no rows;
    other columns of docs are not read, whatever their names. Texts of any length
    are taken whole; a long one has more postings, which Spark shuffles.

    Classes of copies are told apart by 128 bits of MD5: ``class_bits`` of them
    name a class, and classes that share a name are renamed. Blocks have at most
    ``block`` classes on each side, and fewer where these have over ``most`` shingles; up to ``few``
    classes are compared one by one, more by arrays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    rows = scratch.write(widened(texts).mapInArrow(_features(class_bits), "doc_id long, row_key string, cid long, cid2 long, n long, sketch binary, lists array<struct<spare:int,keys:array<bigint>>>"))
    while True:
        owners = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("copies"), F.min("row_key").alias("row_key"), F.min("cid2").alias("low"), F.max("cid2").alias("high"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"))
        owners = scratch.write(owners)
        clash = owners.where("low <> high").select("cid", "low")  # about n * n / 2**65 classes at 64 bits
        if clash.isEmpty():
            break
        renamed = F.when(F.col("cid2") != F.col("low"), F.xxhash64("cid", "cid2")).otherwise(F.col("cid"))
        rows = scratch.write(rows.join(clash, "cid", "left").withColumn("cid", renamed).select(rows.columns), rows, owners)
    total = rows.count()
    first = rows.where("lists is not null")
    classes = owners.select("cid", "n", "sketch")

    # postings that several sets share, without the most frequent ones of each set
    by_key = Window.partitionBy("key")
    by_set = Window.partitionBy("cid", "list").orderBy(F.desc("sets"), "key")
    facts = {"least": F.min("cid"), "most": F.max("cid")}
    posted = first.select("cid", F.posexplode("lists").alias("list", "l")).select("cid", "list", "l.spare", F.explode("l.keys").alias("key"))
    crowded = F.broadcast(scratch.write(heavy(posted, "key", *[f.alias(c) for c, f in facts.items()]).withColumnRenamed("n", "sets")))  # SHARE rows at most
    sets = posted.join(F.broadcast(crowded.select("key")), "key", "left_anti").withColumns({**{c: f.over(by_key) for c, f in facts.items()}, "sets": F.count("*").over(by_key)})
    sets = sets.unionByName(posted.join(crowded, "key").select(sets.columns))
    shared = sets.where("least <> most").select("key", "cid", "list", "spare", "sets").distinct().withColumn("rank", F.row_number().over(by_set)).where("rank > spare").select("key", "cid").distinct()
    shared = scratch.write(shared)
    n_shared = shared.count()
    slim = scratch.write(rows.select("doc_id", F.col("n").alias("n_shingles"), "cid", "row_key"), rows)  # sketches and postings are used up

    # the least class of a posting with the others, in parts of bounded size
    centres = scratch.write(shared.groupBy("key").agg(F.min("cid").alias("a"), F.count("*").alias("sets")))
    stars = join_facts(shared, centres, "key", "sets", n_shared).where("a <> cid").select("a", F.col("cid").alias("b")).distinct()
    stars = scratch.write(stars.join(classes.select(F.col("cid").alias("b"), F.col("n").alias("mass")), "b").select("a", "b", "mass"))
    rays = scratch.write(stars.groupBy("a").agg(F.count("*").alias("rays"), F.sum("mass").alias("mass")))
    n_stars = stars.count()
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    centre = scratch.write(rays.join(side("a"), "a"), rays)
    dealt = F.pmod(F.xxhash64("a", "b"), F.ceil(F.greatest(F.col("rays") / block, F.col("mass") / most))).cast("int").alias("i")
    near = join_facts(stars.drop("mass").join(side("b"), "b"), centre, "a", "rays", n_stars).select("a", dealt, "b", "n_a", "sketch_a", "n_b", "sketch_b")
    near = scratch.write(near.mapInArrow(_star_near, "a long, i int, b long"), stars, centre)
    none = F.array().cast("array<long>")
    block_of = [F.col("a").alias("key"), "i", F.lit(0).alias("j")]
    named = near.select(*block_of, F.col("b").alias("cid"), F.array("a").alias("others")).unionByName(near.select(*block_of, F.col("a").alias("cid"), none.alias("others")).distinct())
    links = _links(named, owners, texts, total, scratch)
    found = connected_components(links, owner=scratch)

    # what different components still share
    of = found.select(F.col("node").alias("cid"), "component")
    placed = scratch.write(shared.join(of, "cid", "left").join(classes.select("cid", "n"), "cid").select("key", "cid", "n", F.coalesce("component", "cid").alias("part")), shared, near)
    spread = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("sets"), F.sum("n").alias("mass"))
    spread = scratch.write(spread.where("lo <> hi").join(centres.select("key", "a"), "key").select("key", "a", "sets", "mass"), centres)
    open_ = scratch.write(join_facts(placed, spread, "key", "sets", n_shared).select("key", "a", "cid", "part", "sets", "mass"), placed, spread)
    named = scratch.write(_crowds(open_, classes, few, block, most), open_)
    if not named.isEmpty():
        more = _links(named, owners, texts, total, scratch)
        if not more.isEmpty():
            found = connected_components(links.unionByName(more), owner=scratch)

    parts = owners.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("cid", "least_doc", "copies", F.coalesce("component", "cid").alias("part"))
    least = parts.groupBy("part").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("classes"))
    parts, least = scratch.write(parts), scratch.write(least)
    named = scratch.write(join_facts(parts, least, "part", "classes", parts.count()).select("cid", "copies", "component_id"))
    scratch.keep(named, slim)
    shown = ["doc_id", "n_shingles", "component_id", "row_key"]
    grouped_rows = join_facts(slim.where("cid is not null"), named, "cid", "copies", total).select(shown)
    return grouped_rows.unionByName(slim.where("cid is null").withColumn("component_id", F.col("doc_id")).select(shown))


def near_duplicates_removed(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id; one of its repeated rows stays.

    Two rows are repeated rows if id and text agree. A component of null ids only
    keeps all its texts. Columns of docs may have any names. The texts are
    shuffled once. An empty table stays empty.
    """
    key = free_name(docs, "_row_key")
    kept = jaccard_components(docs, doc_col, text_col).where("doc_id <=> component_id").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col(doc_col).cast("long"), F.col(text_col).cast("string")))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
