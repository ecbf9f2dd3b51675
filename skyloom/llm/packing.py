"""Best-fit packing of tokenised documents by the linear grouping scheme.

Only the histogram of piece lengths, which has at most `capacity` entries, reaches the driver.
Large lengths are sorted, cut into groups of equal cardinality and rounded up to their group's
largest length; configurations of the few sizes are optimised (a pattern is filled by a bounded
knapsack and used as often as its sizes last); actual lengths then take the places of their group,
longest first; small lengths go best-fit into what is left. Of the few plans of PLANS that with the
fewest sequences counts. It is a list of runs
"pieces of length L with rank a ... b go to sequences s, s + 1, ... at offset o"; documents find
their place by their rank among the pieces of their length. Ranks come from counts by
(length, salt) and a window over each, and salts grow with a length's count, so no hot length meets
in one task.

Nulls: a null text is empty and packs as the separator alone; null ids pack as any other. Repeated
rows are packed each; pieces of one length and id are exchangeable. A very long text is tokenised
whole, in one task's memory. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc, id_text, joined, prefix_hash, released, slices, span_hash, written

CAPACITY = 2048
PLANS = ((1024, 3), (1024, 8))  # (groups of equal cardinality, pieces up to capacity / that are small): the best plan counts
RANKED, SHARES = 256, 8192  # one window ranks about RANKED pieces of a length, or 1 / SHARES of all pieces
CACHE = 1_000_000  # parts of text whose ids a worker remembers

_ENCODERS: dict[str, WordEncoder] = {}  # a worker's, by path: tasks share what it has learnt
# Classes of bytes of lower-case ASCII and Latin-1 text in UTF-8: white space, letter, number, sign.
_BLANK, _LETTER, _NUMBER, _SIGN = range(4)
_ASCII = np.full(256, _SIGN, np.uint8)
_ASCII[[9, 10, 11, 12, 13, 32]] = _BLANK
_ASCII[97:123], _ASCII[48:58] = _LETTER, _NUMBER
_LATIN = {lead: np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(bytes([lead, b]).decode())[0], _SIGN) if 0x80 <= b < 0xC0 else _SIGN for b in range(256)], np.uint8) for lead in (0xC2, 0xC3)}
# ASCII without most control characters, and Latin-1 letters and signs: all in composed form
_PLAIN = re.compile("[ -~\t\n\x0b\x0c\r\xa1-\xff]*")


def text_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts that this vocabulary's pattern cuts lower-case text into: runs of
    letters, single numbers, runs of signs, and English contractions ('s 't 're 've 'm 'll 'd)."""
    n = len(data)
    kind = _ASCII[data]
    begins = np.ones(n, bool)  # a part may begin at this byte
    for lead, table in _LATIN.items():
        at = np.flatnonzero(data == lead)
        kind[at] = kind[at + 1] = table[data[at + 1]]
        begins[at + 1] = False
    start = begins & (kind != _BLANK)
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    wide = np.concatenate([data, np.zeros(4, np.uint8)])
    mark = np.flatnonzero(start & (data == 39) & (np.append(kind[1:], _BLANK) == _LETTER))
    one, two = wide[mark + 1], wide[mark + 2]
    short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    start[mark[short | long] + 1] = False
    for at in (mark[short] + 2, mark[long] + 3):
        at = at[at < n]
        start[at[kind[at] == _LETTER]] = True
    end = np.zeros(n + 1, bool)
    end[1:n] = (kind[:-1] != _BLANK) & (start[1:] | (kind[1:] == _BLANK))
    if n:
        end[n] = kind[-1] != _BLANK
    return np.flatnonzero(start), np.flatnonzero(end)


class WordEncoder:
    """Texts to their ids as little-endian 32-bit numbers.

    This vocabulary's tokenizer drops white space and lets no token cross the parts that its pattern
    cuts, so the ids of a text are those of its parts, which repeat. Parts of ordinary texts are cut
    and hashed for a batch at once; a bounded table by 64-bit hash holds their ids, and the
    tokenizer gets only those not in it. Texts with characters whose normalisation depends on others,
    or with what may be a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tool, self.parts_tool = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parts_tool.normalizer = None  # lower case and the cut into parts are done here
        self.parts_tool.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of parts; their ids are pool[at : at + size]
        self.at, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.clock = np.zeros(0, np.uint16 if self.tool.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def learn(self, keys: np.ndarray, parts: list[str]) -> None:
        sizes, ids = [], []
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            got = self.parts_tool.encode(some, is_pretokenized=True, add_special_tokens=False)
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
            ids.append(np.array(got.ids, self.pool.dtype))
        size = np.concatenate(sizes)
        if len(self.keys) + len(keys) > CACHE:  # the more lately used half stays
            keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE // 2])
            where = np.repeat(self.at[keep] - (np.cumsum(self.size[keep]) - self.size[keep]), self.size[keep]) + np.arange(self.size[keep].sum())
            self.pool = self.pool[where]
            self.keys, self.size, self.used = self.keys[keep], self.size[keep], self.used[keep]
            self.at = np.cumsum(self.size) - self.size
        at = len(self.pool) + np.cumsum(size) - size
        place = np.searchsorted(self.keys, keys)
        self.pool = np.concatenate([self.pool, *ids])
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.used = np.insert(self.used, place, self.clock)

    def plain_ids(self, batch: list[str]) -> list[bytes]:
        self.clock += 1
        data, start, end = joined([x.lower().encode() for x in batch], b" ")
        begin, stop = text_parts(data)
        keys, one, which = np.unique(span_hash(prefix_hash(data), begin, stop), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        have = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        have[inside] = self.keys[place[inside]] == keys[inside]
        self.used[place[have]] = self.clock
        new = np.flatnonzero(~have)
        if len(new):
            text = data.tobytes()
            self.learn(keys[new], [text[a:b].decode() for a, b in zip(begin[one[new]].tolist(), stop[one[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        size, at = self.size[place][which], self.at[place][which]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
        ends = np.append(0, ends)
        first, last = np.searchsorted(begin, start), np.searchsorted(begin, end)
        return [ids[a:b].tobytes() for a, b in zip(ends[first].tolist(), ends[last].tolist(), strict=True)]

    def __call__(self, batch: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(batch)
        simple = [_PLAIN.fullmatch(x) is not None and "<|" not in x for x in batch]
        mine = [i for i, ok in enumerate(simple) if ok]
        rest = [i for i, ok in enumerate(simple) if not ok]
        for i, x in zip(mine, self.plain_ids([batch[i] for i in mine]) if mine else [], strict=True):
            out[i] = x
        whole = self.tool.encode_batch_fast([batch[i] for i in rest], add_special_tokens=False) if rest else []
        for i, x in zip(rest, whole, strict=True):
            out[i] = array("I", x.ids).tobytes()
        return out


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the ids of each text and end_id, cut after
    `capacity`; with keep_ids=False there is no column ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, most=2 << 20):
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (doc, piece, at // 4, len(part) // 4, crc(part), part if keep_ids else None), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k, _ in zip(out, kinds, names)], names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Plan:
    """Runs of pieces; open space by what is left, as [first sequence, how many, used]."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.copy()
        self.taken = np.zeros_like(counts)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.next = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.taken[length]), count, sequence, offset))
        self.taken[length] += count
        self.left[length] -= count


def _pattern(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Counts of each size (descending, with what is left) that fill a sequence best, with the
    largest size left at least once: a bounded knapsack over bit sets."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    used = [0] * len(sizes)
    used[first] = 1
    kept = []
    have = 1  # bit r: room r can be filled exactly by the sizes so far
    mask = (1 << (room + 1)) - 1
    for i in range(first, len(sizes)):
        if have >> room:  # full already
            break
        n = min(left[i] - used[i], room // sizes[i])
        kept.append(have)
        part, k = 1, n
        while k > 0:  # binary splitting of the count
            step = min(part, k)
            have |= (have << (step * sizes[i])) & mask
            k -= step
            part *= 2
    at = have.bit_length() - 1
    for i in range(first + len(kept) - 1, first - 1, -1):
        before = kept[i - first]
        while not before >> at & 1:
            at -= sizes[i]
            used[i] += 1
    return used


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The plan of fewest sequences among those of PLANS; the first that meets the lower bound will do."""
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    best = None
    for groups, small in PLANS:
        plan = pack_plan(counts, capacity, small, groups)
        if best is None or plan[1] < best[1]:
            best = plan
        if best[1] <= least:
            break
    return best


def pack_plan(counts: np.ndarray, capacity: int, small: int, groups: int) -> tuple[np.ndarray, int]:
    """(runs, sequences) for the number of pieces of each length 0 ... capacity; runs are rows
    (length, first rank, count, first sequence, offset)."""
    plan = _Plan(counts.astype(np.int64))
    cut = max(1, capacity // small)
    if counts[capacity]:
        plan.put(capacity, int(counts[capacity]), 0, 0)
        plan.next = int(counts[capacity])
    # Linear grouping: the large pieces, longest first, in groups of equal cardinality.
    big = np.arange(capacity - 1, cut, -1)
    big = big[plan.left[big] > 0]
    total = int(plan.left[big].sum())
    each = max(1, -(-total // groups))
    group_of: list[list[list[int]]] = []  # per group [length, count] longest first
    room_in_group = 0
    for length in big.tolist():
        n = int(plan.left[length])
        while n:
            if not room_in_group:
                group_of.append([])
                room_in_group = each
            k = min(n, room_in_group)
            group_of[-1].append([length, k])
            n -= k
            room_in_group -= k
    sizes = [g[0][0] for g in group_of]
    left = [sum(k for _, k in g) for g in group_of]
    while any(left):
        used = _pattern(sizes, left, capacity)
        times = min(left[i] // u for i, u in enumerate(used) if u)
        # Substitution: actual lengths take the places of their group, longest first. Sequences of the
        # pattern that get the same lengths are one run of plan.
        slots = [i for i, u in enumerate(used) for _ in range(u)]
        offset_runs = [(plan.next, times, 0)]
        for i in slots:
            left[i] -= times
            after = []
            for first, many, offset in offset_runs:
                while many:
                    length, have = group_of[i][0]
                    k = min(many, have)
                    plan.put(length, k, first, offset)
                    after.append((first, k, offset + length))
                    group_of[i][0][1] -= k
                    if not group_of[i][0][1]:
                        group_of[i].pop(0)
                    first, many = first + k, many - k
            offset_runs = after
        for first, many, offset in offset_runs:
            if offset < capacity:
                plan.open.setdefault(capacity - offset, []).append((first, many))
        plan.next += times
    # Small pieces, longest first, into the fullest sequence that has room.
    for length in range(min(cut, capacity - 1), 0, -1):
        while plan.left[length]:
            room = min((r for r in plan.open if r >= length), default=None)
            if room is None:
                # as many new sequences as these pieces fill
                fit = capacity // length
                n = -(-int(plan.left[length]) // fit)
                plan.open.setdefault(capacity, []).append((plan.next, n))
                plan.next += n
                continue
            first, many = plan.open[room].pop()
            if not plan.open[room]:
                del plan.open[room]
            k = min(many, int(plan.left[length]))
            plan.put(length, k, first, capacity - room)
            if k < many:
                plan.open.setdefault(room, []).append((first + k, many - k))
            if room > length:
                plan.open.setdefault(room - length, []).append((first, k))
    return np.array(plan.runs, np.int64).reshape(-1, 5), plan.next


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) for every piece. With
    keep_ids=False there is no column ids, and no shuffle carries any."""
    return placed(written(token_pieces(id_text(docs, id_col, text_col), path, capacity, end_id, keep_ids), "pieces"), capacity)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)  # all that the plan needs, whatever the number of pieces
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    runs, _ = best_plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    code = runs[:, 0] << 44 | runs[:, 1]
    # A length's pieces are ranked in `salts` windows, at most SHARES beyond one for each length; their
    # counts give the bases.
    salts = np.maximum(1, -(-counts // max(RANKED, int(counts.sum()) // SHARES)))
    first = np.cumsum(salts) - salts
    spark = pieces.sparkSession
    n_salts = F.element_at(F.array(*[F.lit(int(n)) for n in salts]), F.col("length").cast("int") + 1) if salts.max() > 1 else F.lit(1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n_salts).cast("int"))
    many = np.zeros(int(salts.sum()), np.int64)
    if salts.max() > 1:
        for r in salted.groupBy("length", "salt").count().collect():
            many[first[r["length"]] + r["salt"]] = r["count"]
    else:
        many = counts
    base = np.cumsum(many) - many
    base -= np.repeat(base[first], salts)
    share = spark.sparkContext.broadcast((base, first, runs, code))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    names = [c for c in pieces.columns]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, first, runs, code = share.value
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank + base[first[length] + salt]
            at = np.searchsorted(code, length << 44 | rank, "right") - 1
            row = runs[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*names, "sequence_id", "offset"])

    schema = pieces.schema.simpleString()[7:-1].replace(",", ", ")
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")
