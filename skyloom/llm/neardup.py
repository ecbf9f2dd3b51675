"""MinHash near-duplicate detection with SetSketch registers.

A document's set holds the 64-bit hashes of its distinct word shingles. A SetSketch register is
the exponentially spaced, truncated minimum of the elements' exponential variates; registers of a
union are the maxima of the registers, and two registers agree about as often as the sets overlap.
Documents with equal sets are one class. Bands of registers propose pairs of classes, the joint
likelihood of the register counts discards hopeless pairs, and the full sets confirm the rest.

Pairs are proposed in two passes. First each class with the smallest class of each of its
buckets (linear in the input, whatever a bucket's size). Components follow from the confirmed
links. Then, only in buckets that still hold several components, the members of different
components meet, in blocks of bounded size. Members of one component need no more links.

With 288 registers in 48 bands of 6 a pair at similarity 0.75 is missed with probability
(1 - 0.75**6)**48 < 1e-4, at 0.8 < 1e-6.

Nulls: a text that is null or has no word has an empty set (n_shingles 0) and is linked with
nothing. Rows with a null id are linked with nothing and kept. Rows that repeat an id count as
one document, linked with what any of them is linked with: their classes are linked with one another.
Texts are taken some SLICE_BYTES at a time; a longer one is hashed whole, at some 60 times its bytes
of one task's memory. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, components, forget, id_text, mix, packed, released, slices, text_words, texts, written

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 48, 6
SPREAD, TOP = 1.02, 65534  # SetSketch's b and q
BLOCK = 2048  # classes of an unsettled bucket that one task compares at once
SALT = 64  # classes that one task confirms against one copy of the leader
SETS_BYTES = 64 << 20  # full sets that a task keeps while it compares a bucket
FLOOR = 0.55  # pairs whose likeliest similarity is below this are not confirmed on full sets

_seeds = np.random.Generator(np.random.PCG64(77))
_XOR = _seeds.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MUL = _seeds.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ORDER = np.random.Generator(np.random.PCG64(78)).integers(0, 2**63, SHINGLE, dtype=np.int64).view(np.uint64) | np.uint64(1)


def shingle_sets(parts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `size` are one shingle."""
    value, first, last, _ = text_words([x for x in parts], ~SPACE)
    long = np.zeros(max(0, len(value) - size + 1), np.uint64)
    for k in range(size):
        long += value[k : k + len(long)] * _ORDER[k % SHINGLE]
    long = mix(long)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = b - a
        if n >= size:
            yield np.unique(long[a : b - size + 1])
        elif n:
            yield mix((value[a:b] * _ORDER[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            yield value[:0]


def registers(items: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """SetSketch registers: floor(1 - log_b(smallest exponential variate)), cut to 0 ... q + 1."""
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    half = (items >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(half), 512):
        x = half[i : i + 512, None] ^ _XOR[:m]
        x *= _MUL[:m]
        np.minimum(least, x.min(axis=0), out=least)
    u = least.astype(np.float64)
    x = -np.log1p(-(u + 0.5) / 2**32) / 20  # rate a = 20
    return np.clip(np.floor(1 - np.log(x) / math.log(SPREAD)), 0, TOP + 1).astype("<u2")


def joint_estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, m: int) -> np.ndarray:
    """Likeliest Jaccard similarity from set sizes and the registers that are larger and smaller."""
    grid = np.linspace(0, 1, 101)
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.minimum(grid[None, :], most)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SPREAD - 1) / SPREAD) / math.log(SPREAD)
    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    same = np.clip(1 - up - down, 1e-12, 1)
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (m - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), like.argmax(axis=1)]


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, skey, regs): the set's size and 128-bit key, and its registers as bytes."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, key, regs = [], [], []
            for s in shingle_sets(texts(batch), size):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n", "skey", "regs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, skey binary, regs binary")


def _band_rows(reps: DataFrame) -> DataFrame:
    """(key, id) for every band of every class."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _ORDER[np.arange(ROWS) % SHINGLE] * (np.arange(ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = mix(mix(regs * weight).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, "key bigint, id bigint")


def _counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x > y).sum(axis=-1).astype(np.float64), (x < y).sum(axis=-1).astype(np.float64)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose joint estimate reaches FLOOR."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                batch = big.slice(i, 2000)
                na, nb = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 3))
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(len(na), -1) for k in (4, 5))
                keep = joint_estimate(na, nb, *_counts(ra, rb), ra.shape[1]) >= FLOOR
                yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, zipped: DataFrame, reps: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. A leader's text is sent once for
    each SALT of its partners or so, and read before theirs."""
    pairs = written(pairs.select("a", "b"), name)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("s"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("s")).alias("salt"))
    want = many.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s") - 1)).alias("salt"), F.lit(0).alias("role"))
    want = want.unionByName(salted.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("role")))
    want = want.join(reps.select("id", "skey"), "id").join(zipped.withColumnRenamed("doc_id", "id"), "id")
    want = want.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "salt", "role", "id", "skey", "z")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        at, leaders = None, []  # texts of one id, if its rows differ
        for batch in slices(batches, "z", 1 << 20):
            a, salt, role, ids, key = (batch.column(k).to_pylist() for k in range(5))
            out: tuple[list, list] = ([], [])
            for k, s in enumerate(shingle_sets([tool.decompress(z) for z in batch.column(5).to_pylist()], size)):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != key[k]:
                    continue  # another row with this id
                if role[k] == 0:
                    at, leaders = (a[k], salt[k]), [*(leaders if at == (a[k], salt[k]) else []), s]
                elif at == (a[k], salt[k]):
                    for leader in leaders:
                        both = len(np.intersect1d(leader, s, assume_unique=True))
                        if 100 * both >= percent * (len(leader) + len(s) - both):
                            out[0].append(a[k])
                            out[1].append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return written(want.mapInArrow(run, "a bigint, b bigint"), name)


def _unsettled(members: DataFrame, zipped: DataFrame, reps: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Links (a, b) between different components out of buckets (key, id, root, m). A bucket of m
    members is dealt to blocks; a task gets two blocks, compares their registers, confirms what is
    likely on the full sets at once, and compares no more what it has linked so far."""
    parts = F.ceil(F.col("m") / BLOCK)
    mine = F.pmod(F.xxhash64("id"), F.col("p"))
    dealt = members.withColumn("p", parts).withColumn("mine", mine).select("key", "id", "root", "mine", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1)).alias("other"))
    dealt = dealt.select("key", "id", "root", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    dealt = dealt.join(reps.select("id", "n", "regs", "skey"), "id").join(zipped.withColumnRenamed("doc_id", "id"), "id")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "id", "root", "mine", "n", "regs", "skey", "z")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        apart: set[tuple[int, int]] = set()  # pairs that another bucket of this task has found apart

        def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len({r[1] for r in rows}) < 2:
                return
            ids, root, mine, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            regs = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(len(rows), -1)
            across = mine.min() != mine.max()
            held: dict[int, np.ndarray | None] = {}
            bytes_held = 0

            def full(i: int) -> np.ndarray | None:
                nonlocal bytes_held
                if i not in held:
                    if bytes_held > SETS_BYTES:
                        held.clear()
                        bytes_held = 0
                    s = next(iter(shingle_sets([tool.decompress(rows[i][6])], size)))
                    held[i] = s if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == rows[i][5] else None
                    bytes_held += s.nbytes
                return held[i]

            found: tuple[list, list] = ([], [])
            for k in range(len(rows)):
                to = np.flatnonzero((root[k + 1 :] != root[k]) & ((mine[k + 1 :] != mine[k]) | (not across))) + k + 1
                to = to[100 * np.minimum(n[to], n[k]) >= percent * np.maximum(n[to], n[k])]
                if len(to):
                    like = joint_estimate(np.full(len(to), float(n[k])), n[to].astype(float), *_counts(regs[k], regs[to]), regs.shape[1])
                    to = to[like >= FLOOR]
                for i in to.tolist():
                    pair = (min(ids[k], ids[i]), max(ids[k], ids[i]))
                    if root[i] == root[k] or pair in apart:
                        continue
                    one, two = full(k), full(i)
                    if one is None or two is None:
                        continue
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        found[0].append(int(pair[0]))
                        found[1].append(int(pair[1]))
                        root[root == root[i]] = root[k]
                    else:
                        if len(apart) > 500_000:
                            apart.clear()
                        apart.add(pair)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

        at, rows = None, []
        for batch in slices(batches, "z", 1 << 20):
            for r in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if r[:3] != at:
                    yield from compare(rows)
                    at, rows = r[:3], []
                rows.append(r[3:])
        yield from compare(rows)

    return written(dealt.mapInArrow(run, "a bigint, b bigint"), name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs."""
    plain = id_text(docs, id_col, text_col)
    sketch = written(sketches(plain, size), "sketch")
    named = sketch.where("skey is not null and doc_id is not null")
    classes = named.groupBy("skey").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = written(classes, "reps")
    zipped = packed(plain)

    bands = written(_band_rows(reps), "bands")
    # Joins by a bucket's key stand alone in their stages, as sort-merge joins: Spark splits hot keys there.
    lead = written(bands.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1"), "lead")
    star = written(bands.hint("merge").join(lead.hint("merge"), "key").where("id > a").select("key", "a", F.col("id").alias("b"), "m"), "star")
    forget(bands)
    forget(lead)
    pairs = star.select("a", "b").distinct()
    links = _confirmed(_likely(pairs, reps), zipped, reps, size, percent, "links")
    twice = written(named.groupBy("doc_id").agg(F.min("skey").alias("lo"), F.max("skey").alias("hi")).where("lo != hi").select("doc_id"), "twice")
    if not twice.isEmpty():  # classes of one id are linked
        own = named.join(twice, "doc_id").join(reps.select("skey", "id"), "skey").select("doc_id", "id").distinct()
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a < b"))
    found = components(links)

    # Buckets of three or more that still hold several components.
    root = found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    three = star.where("m > 2").join(root, "b", "left").withColumn("rb", F.coalesce("rb", "b"))
    three = three.join(found.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").withColumn("ra", F.coalesce("ra", "a"))
    three = written(three.select("key", "b", "rb", "ra", "m"), "three")
    forget(star)
    mixed = written(three.groupBy("key").agg(F.max(F.col("rb") != F.col("ra")).alias("mixed")).where("mixed").select("key"), "mixed")
    # The leader has met all the others: only these are left to meet.
    members = written(three.hint("merge").join(mixed.hint("merge"), "key").select("key", F.col("b").alias("id"), F.col("rb").alias("root"), "m"), "members")
    forget(three)
    forget(mixed)
    if not members.isEmpty():
        more = _unsettled(members, zipped, reps, size, percent, "links")
        found = components(links.unionByName(more))

    named = reps.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select("skey", F.coalesce("root", "id").alias("component"))
    out = sketch.select("doc_id", "n", "skey").join(named, "skey", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
