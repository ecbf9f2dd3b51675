"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

Windows are the strings of `length` bytes; equal windows have the same smallest hash among their
k-byte grams. Consecutive windows with the same smallest hash form a fragment (the windows' bytes),
so equal windows always meet in the group of one key. Copies of a fragment collapse to one with a
multiplicity: all its windows start elsewhere too. Groups of a key with several different fragments,
or with a fragment that repeats its key within, are sorted: a two-stage suffix array directly sorts
only suffixes smaller than their successors, induces the rest by scanning the buckets of first
bytes, and adjacent common prefixes of `length` bytes mark repeated windows.

A key with more than HOT different fragments is dealt anew by the smallest hash among longer grams,
at last of whole windows, which are only counted; so no task ever holds an unbounded group and
none is cut short. Fragments are written in the shared folder only while they are needed.

Nulls: a null text is empty. Rows with null or repeated ids are told apart by their text; rows that
repeat both are copies of each other, as any equal texts are. Nothing crosses two rows. Texts are
taken some SLICE_BYTES at a time, longer ones in blocks of that size that overlap by a window less one
byte. Ties need no rule: all places of a repeated string count. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, forget, joined, mix, powers, prefix_hash, released, slices, span_hash, texts, written

LENGTH = 200
GRAMS = (32, 128, 176, 192, 200)  # of level 0, 1, ...; the last is the window itself
HOT = 1024  # different fragments of a key that one task sorts
MOST = 4096  # windows in a fragment
SORT_BYTES = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima of blocks of w."""
    if w == 1:
        return x
    n = len(x) - w + 1
    pad = np.full(-len(x) % w + w, _NONE, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def fragments(parts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(index of the text, first window, windows, key, hash of the bytes, key repeats within)."""
    data, start, end = joined(parts, b"\0")
    none = np.zeros(0, np.int64)
    if len(data) < length + 1:
        return none, none, none, none, none, none.astype(bool)
    one, two = prefix_hash(data, 0), prefix_hash(data, 1)
    hashes = mix((one[gram:] - one[:-gram]) * powers(0, len(one), True)[: len(one) - gram])
    low = sliding_min(hashes, length - gram + 1)[: len(data) - length + 1]
    cut = np.ones(len(low), bool)
    cut[1:] = low[1:] != low[:-1]
    cut[start[start < len(low)]] = True
    valid = np.zeros(len(low) + 1, np.int64)
    here = start < len(low)
    fits = here & (end - start >= length)
    np.add.at(valid, start[fits], 1)
    np.add.at(valid, np.minimum(end[fits] - length + 1, len(low)), -1)
    inside = np.cumsum(valid[:-1]) > 0
    cut[1:] |= inside[1:] != inside[:-1]
    head = np.flatnonzero(cut)
    tail = np.append(head[1:], len(low))
    keep = inside[head]
    head, tail = head[keep], tail[keep]
    if len(head) and (tail - head).max() > MOST:  # split very long runs
        n = -(-(tail - head) // MOST)
        first = np.repeat(head, n) + MOST * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        tail = np.minimum(first + MOST, np.repeat(tail, n))
        head = first
    key = low[head]
    text = np.searchsorted(start, head, "right") - 1
    # Equal windows in one fragment make it periodic, so the key's gram then is the first gram of one
    # of its windows and the last gram of one, at two places.
    span = length - gram
    lead = np.flatnonzero(hashes[: len(low)] == low)
    trail = np.flatnonzero(hashes[span : span + len(low)] == low)
    i, j = np.searchsorted(lead, head), np.searchsorted(trail, tail) - 1
    lead, trail = np.append(lead, len(data)), np.append(trail, -1)
    first, last = lead[i], trail[j]
    repeats = (first < tail) & (last >= head) & (first != last + span)
    code = span_hash(two, head, tail + length - 1, 1)
    return text, head - start[text], tail - head, key.view(np.int64), code.view(np.int64), repeats


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : k + len(data)]
    return out


def _direct_sort(at: np.ndarray, room: np.ndarray, eight: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Places `at` in the order of the suffixes there, by 8 bytes at a time, up to `length` bytes;
    groups of equal whole windows are not split further. room: bytes to the fragment's end."""
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    done = np.zeros(len(at), bool)
    for step in range(0, length, 8):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        o = order[live]
        left = np.clip(room[o] - step, 0, 8).astype(np.uint64)
        word = eight[np.minimum(at[o] + step, len(eight) - 1)]
        shift = (np.uint64(8) - left) * np.uint64(8)
        word = np.where(left == 0, np.uint64(0), word >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)))
        by = np.lexsort((word, group[live]))
        order[live] = o[by]
        word, g = word[by], group[live]
        new = np.ones(len(live), bool)
        new[1:] = (word[1:] != word[:-1]) | (g[1:] != g[:-1])
        heads = np.flatnonzero(new)
        group[live] = live[heads][np.cumsum(new) - 1]
        size = np.diff(np.append(heads, len(live)))
        code = whole[order[live]]
        same = np.minimum.reduceat(code, heads) == np.maximum.reduceat(code, heads)
        done[live] = np.repeat((size == 1) | same, size)
    return at[order]


def suffix_order(data: np.ndarray, member: np.ndarray, small: np.ndarray, seeds: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """The places of `member` in suffix order. seeds: its places with `small` (the suffix is smaller
    than its successor), in order. lasts: its places that are a fragment's last byte, which come
    first in their buckets. Every other member's successor is a member too."""
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c in np.unique(data[lasts]):
        pending[c].append(lasts[data[lasts] == c])
    first = data[seeds]
    bounds = np.searchsorted(first, np.arange(257))
    out = []
    for c in range(256):
        mine = seeds[bounds[c] : bounds[c + 1]]
        queue, scanned = pending[c], []
        while queue:  # larger suffixes of this bucket, also those that it induces itself
            wave = np.concatenate(queue)
            scanned.append(wave)
            before = wave[wave > 0] - 1
            before = before[member[before] & ~small[before] & (data[before] == c)]
            queue = [before] if len(before) else []
        pending[c] = []
        scanned.append(mine)
        done = np.concatenate(scanned)
        out.append(done)
        before = done[done > 0] - 1
        before = before[member[before] & ~small[before] & (data[before] > c)]
        if len(before):
            to = data[before]
            by = np.argsort(to, kind="stable")
            before, to = before[by], to[by]
            heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for h, t in zip(heads, np.append(heads[1:], len(to)), strict=True):
                pending[to[h]].append(before[h:t])
    return np.concatenate(out) if out else seeds


def repeated_windows(frags: list[bytes], windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each window of the fragments (one after the other) starts at another window too."""
    total = int(windows.sum())
    data, start, end = joined(frags, b"\0")
    n = len(data)
    step = np.zeros(n, np.int16)  # successor's byte minus this one; before an end the suffix is the larger one
    step[:-1] = data[1:].astype(np.int16) - data[:-1]
    step[end - 1] = -1
    step[end] = -1
    turn = np.where(step != 0, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = step[np.minimum(turn, n - 1)] > 0
    begins = np.zeros(n + 1, np.int64)
    np.add.at(begins, start, 1)
    np.add.at(begins, start + windows, -1)
    begin = np.cumsum(begins[:-1]) > 0
    # beyond the last window, up to the first smaller suffix or the fragment's end, for the induction
    next_small = np.where(small, np.arange(n), n)
    next_small = np.minimum.accumulate(next_small[::-1])[::-1]
    stop = np.minimum(next_small[start + windows - 1], end - 1)
    begins[:] = 0
    np.add.at(begins, start, 1)
    np.add.at(begins, stop + 1, -1)
    member = np.cumsum(begins[:-1]) > 0
    last = end[member[end - 1]] - 1
    owner = np.repeat(np.arange(len(frags)), np.diff(np.append(start, n)))
    two = prefix_hash(data, 1)
    at = np.flatnonzero(member & small)
    room = end[owner[at]] - at
    whole = span_hash(two, at, at + np.minimum(room, length), 1)
    eight = _words8(data)
    seeds = _direct_sort(at, room, eight, whole, length)
    order = suffix_order(data, member, small, seeds, last)
    order = order[begin[order]]
    # adjacent common prefixes of at least `length`
    a, b = order[:-1], order[1:]
    equal = np.arange(len(a))
    for k in range(0, length - 7, 8):
        equal = equal[eight[a[equal] + k] == eight[b[equal] + k]]
    if length % 8:
        k = length - 8
        equal = equal[eight[a[equal] + k] == eight[b[equal] + k]] if k >= 0 else equal
    mark = np.zeros(n, bool)
    mark[a[equal]] = True
    mark[b[equal]] = True
    out = mark[np.flatnonzero(begin)]
    assert len(out) == total
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = "array<struct<lo:int,hi:int>>"
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _sorted_groups(frags: DataFrame, length: int) -> DataFrame:
    """(key, code, spans): repeated windows of the fragments (key, code, n, data), key by key."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(rows: list[tuple]) -> pa.RecordBatch:
            n = np.array([r[2] for r in rows], np.int64)
            marks = repeated_windows([r[3] for r in rows], n, length)
            spans, at = [], 0
            for k in n.tolist():
                lo, hi = runs(marks[at : at + k])
                spans.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                at += k
            keep = [i for i, s in enumerate(spans) if s]
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([spans[i] for i in keep], _SPANS)], ["key", "code", "spans"])

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= SORT_BYTES and r[0] != rows[-1][0]:
                    yield sort(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield sort(rows)

    return frags.select("key", "code", "n", "data").repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key bigint, code bigint, spans {SPANS}")


def _every() -> Column:
    return F.array(F.struct(F.lit(0).cast("int").alias("lo"), F.col("n").cast("int").alias("hi")))


def _groups(classes: DataFrame) -> DataFrame:
    """classes (key, code, many, repeats, ...) with `kinds`, the different fragments of the key,
    for keys that can hold a repeated window."""
    keys = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("many").alias("total"), F.max("repeats").alias("again")).where("total > 1 or again")
    return classes.hint("merge").join(written(keys.select("key", "kinds", "again"), "keys").hint("merge"), "key")


def _refined(hot: DataFrame, length: int, level: int) -> DataFrame:
    """(key, code, spans) of hot fragments (key, code, n, many, data), dealt anew by longer grams."""
    gram = GRAMS[level] if level < len(GRAMS) - 1 else length

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", 1 << 20):
            parts = batch.column(4).to_pylist()
            text, lo, n, key, code, again = fragments(parts, length, gram)
            data = [parts[t][a : a + k + length - 1] for t, a, k in zip(text.tolist(), lo.tolist(), n.tolist(), strict=True)]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take), pa.array(lo.astype(np.int32)), pa.array(key), pa.array(code), pa.array(n.astype(np.int32)), pa.array(again), pa.array(data, pa.binary())], ["key0", "code0", "many", "lo", "key", "code", "n", "repeats", "data"])

    pieces = written(hot.select("key", "code", "n", "many", "data").mapInArrow(run, "key0 bigint, code0 bigint, many bigint, lo int, key bigint, code bigint, n int, repeats boolean, data binary"), "pieces")
    if level >= len(GRAMS) - 1:  # a piece is n equal windows: its windows count, in runs of whatever length
        pieces = pieces.withColumn("code", F.xxhash64(F.substring("data", 1, length)))
        again = pieces.groupBy("key", "code").agg(F.sum(F.col("many") * F.col("n")).alias("windows")).where("windows > 1")
        whole = F.struct(F.col("lo"), (F.col("lo") + F.col("n")).alias("hi"))
        return pieces.join(again, ["key", "code"]).groupBy(F.col("key0").alias("key"), F.col("code0").alias("code")).agg(F.collect_list(whole).alias("spans"))
    classes = pieces.groupBy("key", "code").agg(F.sum("many").alias("many"), F.max("repeats").alias("repeats"), F.first("n").alias("n"), F.first("data").alias("data"))
    grouped = written(_groups(written(classes, "refined")), "refined")
    spans = _spans(grouped, grouped, length, level)
    back = pieces.select("key0", "code0", "lo", "key", "code").join(spans, ["key", "code"])
    back = back.select(F.col("key0").alias("key"), F.col("code0").alias("code"), F.transform("spans", lambda s: F.struct((s["lo"] + F.col("lo")).alias("lo"), (s["hi"] + F.col("lo")).alias("hi"))).alias("spans"))
    return back.groupBy("key", "code").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _spans(grouped: DataFrame, with_data: DataFrame, length: int, level: int) -> DataFrame:
    """(key, code, spans) of repeated windows, from classes and from those that need sorting, with data."""
    copies = grouped.where("many > 1").select("key", "code", _every().alias("spans"))
    single = with_data.where("many = 1 and (kinds > 1 or again)")
    others = with_data.where("many > 1 and kinds > 1")
    need = single.unionByName(others)
    out = copies.unionByName(_sorted_groups(need.where(F.col("kinds") <= HOT), length))
    hot = need.where(F.col("kinds") > HOT)
    if not hot.isEmpty():
        out = out.unionByName(_refined(hot, length, level + 1))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, rid, spans): for each row of docs (doc_id, rid, text) the ranges of window starts
    that repeat, as an array; only rows that have any."""
    gram = min(GRAMS[0], length)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(batches):
            parts = texts(batch)
            if len(parts) > 1 or len(parts[0]) <= SLICE_BYTES:
                text, *rest = fragments(parts, length, gram)
                yield batch, text, rest
            else:  # a cut may part a fragment, never a window; parts of one key meet like any others
                for at in range(0, len(parts[0]) - length + 1, SLICE_BYTES):
                    text, lo, *rest = fragments([parts[0][at : at + SLICE_BYTES + length - 1]], length, gram)
                    yield batch, text, (lo + at, *rest)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, (lo, n, key, code, again) in blocks(batches):
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(code), pa.array(again)], ["doc_id", "rid", "lo", "n", "key", "code", "repeats"])

    every = written(docs.select("doc_id", "rid", "text").mapInArrow(run, "doc_id bigint, rid bigint, lo int, n int, key bigint, code bigint, repeats boolean"), "fragments")
    # Most keys stand once: only the others go on. The join by key stands alone in its stage, where Spark splits hot keys.
    live = written(every.groupBy("key").agg(F.count("*").alias("total"), F.max("repeats").alias("again")).where("total > 1 or again").select("key"), "live")
    found = written(every.hint("merge").join(live.hint("merge"), "key"), "fragments")
    forget(every)
    forget(live)
    classes = written(found.groupBy("key", "code").agg(F.count("*").alias("many"), F.max("repeats").alias("repeats"), F.min(F.struct("doc_id", "rid", "lo", "n")).alias("at")), "classes")
    grouped = written(_groups(classes).select("key", "code", "many", "kinds", "again", F.col("at.n").alias("n"), "at"), "classes")
    forget(classes)

    # bytes of one copy of each fragment that is to be sorted
    need = grouped.where("kinds > 1 or again")
    by_doc = need.groupBy("at.doc_id", "at.rid").agg(F.collect_list(F.struct("key", "code", "many", "kinds", "again", F.col("at.lo").alias("lo"), "n")).alias("want"))
    both = by_doc.join(docs.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "text"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")))

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "code", "many", "kinds", "again", "n", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
        for batch in slices(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in names]
            for text, want in zip(texts(batch), batch.column(0).to_pylist(), strict=True):
                for w in want:
                    for column, x in zip(out, (w["key"], w["code"], w["many"], w["kinds"], w["again"], w["n"], text[w["lo"] : w["lo"] + w["n"] + length - 1]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    data = written(both.select("want", "text").mapInArrow(cut, "key bigint, code bigint, many bigint, kinds bigint, again boolean, n int, data binary"), "bytes")
    spans = _spans(grouped, data, length, 0)
    hits = found.select("doc_id", "rid", "lo", "key", "code").join(spans, ["key", "code"])
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("lo")).alias("lo"), (s["hi"] + F.col("lo")).alias("hi")))
    return hits.select("doc_id", "rid", moved.alias("spans")).groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, n_bytes, n_removed, n_spans, kept_sha256, kept): what stays of each text. `kept` is
    null where nothing goes; where a cut parts a character, its remaining bytes are not in `kept`."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    plain = plain.withColumn("rid", F.xxhash64("text"))
    spans = repeated_spans(plain, length).select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "spans")
    both = plain.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left").select("doc_id", "rid", "text", "spans")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(texts(batch), batch.column(3).to_pylist(), strict=True):
                kept, removed, count = text, 0, 0
                if spans:
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, [s["lo"] for s in spans], 1)
                    np.add.at(edge, [s["hi"] - 1 + length for s in spans], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, count = int(gone.sum()), len(runs(gone)[0])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for column, x in zip(out, (len(text), removed, count, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if removed else None), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id bigint, rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
