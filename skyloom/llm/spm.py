"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a public model span a lattice over each chunk of a text (a word with the spaces before
it; one of over CHUNK bytes is cut, for memory's sake). Forward filtering sums the weights of all paths to each place, backward
sampling draws an edge at a time from the end, in proportion. Random numbers are hashes of the row
key, the chunk and the step, so a row is segmented alike in any run, partition or retry. The model's
merge ranks r give the weights (r + 1) ** -theta; a large theta comes near the best path. Lattices are
built once for the distinct chunks of a batch, and all chunks of a batch are sampled together.

Spaces are the meta symbol U+2581; a character that no piece holds, and U+2581 itself, are byte
pieces, so decoding returns every text exactly. There is no normalisation and no added prefix.
Nulls: a null text is empty: no ids; null ids are one key. Repeated rows with one key get equal ids. A
very long text is one batch of its own, at some 200 times its distinct words' bytes of memory. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, crc, joined, mix, powers, prefix_hash, released, slices, texts

CHUNK = 1 << 20
THETA = 1.5
META = "▁".encode()
_ODD = b"\xff\xfe\xfd"  # stands for a U+2581 of the text, which no piece matches
BATCH_BYTES = 4 << 20
ONE = 1 << 53  # probabilities are summed as integers, so that they hang on no other text of the batch
_VALUE = BYTE_VALUE[0]
_SIZE = np.ones(256, np.uint8)  # bytes of the character that begins so
_SIZE[0xC0:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:0xF8] = 2, 3, 4


def _keys(names: list[bytes]) -> np.ndarray:
    """Polynomial hashes: a byte more adds its value times the next power."""
    data, start, end = joined(names, b"\0")
    prefix = prefix_hash(data)
    return (prefix[end] - prefix[start]) * powers(0, len(prefix), True)[start]


class Lattice:
    def __init__(self, path: str, theta: float = THETA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = [b""] * model.vocab_size()
        self.byte_id = np.zeros(256, np.int32)
        names, ids, score = [], [], []
        for i in range(model.vocab_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or "\0" in name):
                self.bytes_of[i] = name.replace("▁", " ").encode()
                names.append(name.encode())
                ids.append(i)
                score.append(model.get_score(i))
        rank = np.argsort(np.argsort(-np.array(score), kind="stable"), kind="stable")
        key = _keys(names)
        by = np.argsort(key)
        self.keys, self.ids, self.weight = key[by], np.array(ids, np.int32)[by], (-theta * np.log1p(rank))[by]
        # by the first 20 bits of a hash: 2 * (the first such piece's place in keys, plus 1), and 1 more
        # if some longer piece may begin so
        self.lengths = np.unique([len(x) for x in names])
        self.longest = int(self.lengths[-1])
        bits = (self.keys >> np.uint64(44)).astype(np.int64)
        some, first, many = np.unique(bits, return_index=True, return_counts=True)
        self.table, self.alike = np.zeros(1 << 20, np.int32), int(many.max())
        self.table[some] = 2 * (first + 1)
        self.table[(_keys(sorted({x[:k] for x in names for k in range(1, len(x))}) or [b""]) >> np.uint64(44)).astype(np.int64)] |= 1
        self.byte_weight = -theta * np.log1p(len(names))

    def chunks(self, text: bytes) -> bytes:
        return text.replace(META, _ODD).replace(b" ", META)

    @staticmethod
    def cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Starts of chunks: of a text, of a run of meta symbols after something else, and every CHUNK
        bytes or so at a character."""
        meta = np.zeros(len(data), bool)
        if len(data) > 2:
            meta[:-2] = (data[:-2] == META[0]) & (data[1:-1] == META[1]) & (data[2:] == META[2])
        head = meta.copy()
        head[3:] &= ~meta[:-3]
        head[start[end > start]] = True
        head[end] = False
        at = np.flatnonzero(head)
        stop = np.append(at[1:], len(data))
        long = np.flatnonzero(stop - at > CHUNK)
        more = []
        for k in long.tolist():
            place, last = int(at[k]) + CHUNK, int(stop[k])
            while place < last:
                while place < last and (data[place] & 0xC0 == 0x80 or _ODD[0] > data[place] >= _ODD[2]):
                    place += 1
                if place < last:
                    more.append(place)
                place += CHUNK
        return np.sort(np.concatenate([at, np.array(more, np.int64)])) if more else at

    def encode(self, parts: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each text; keys: a 64-bit number for each."""
        data, start, end = joined([self.chunks(x) for x in parts], b"\0")
        at = self.cuts(data, start, end)
        if not len(at):
            return [np.zeros(0, np.int32) for _ in parts]
        owner = np.searchsorted(start, at, "right") - 1
        stop = np.minimum(np.append(at[1:], len(data)), end[owner])
        whole = np.diff(np.append(at, len(data)))
        value = _VALUE[data[at[0] :]] * powers(0, int(whole.max()))[np.arange(len(data) - at[0]) - np.repeat(at - at[0], whole)]
        value[end[end >= at[0]] - at[0]] = 0
        code = mix(np.add.reduceat(value, at - at[0]) + (stop - at).astype(np.uint64))
        _, one, which = np.unique(code, return_index=True, return_inverse=True)
        size = (stop - at)[one]
        to = np.cumsum(size + 1) - size - 1
        place = np.arange(int(size.sum()) + len(size)) - np.repeat(to, size + 1)
        distinct = data[np.repeat(at[one], size + 1) + place]
        distinct[to + size] = 0
        final, base, cum, edge_from, edge_id, first_edge = self.lattice(distinct, to, to + size)
        # backward sampling of all chunks at once
        first = np.searchsorted(owner, np.arange(len(parts)))
        seed = mix(keys.view(np.uint64)[owner] + (np.arange(len(at)) - first[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place, bottom = final[which], base[which]
        live = np.arange(len(at))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(at), np.int64)
        while len(live):
            u = (mix(seed[live] + np.uint64(len(steps) + 1)) >> np.uint64(11)).view(np.int64)
            e = first_edge[place]
            on = np.flatnonzero(u >= cum[e])
            while len(on):  # a place has few edges
                e[on] += 1
                on = on[u[on] >= cum[e[on]]]
            steps.append((live, edge_id[e]))
            count[live] += 1
            place = edge_from[e]
            go = place > bottom
            live, place, bottom = live[go], place[go], bottom[go]
        offset = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for k, (who, ids) in enumerate(steps):
            out[offset[who] + count[who] - 1 - k] = ids
        ends = np.append(offset, len(out))
        last = np.searchsorted(owner, np.arange(len(parts)), "right")
        return [out[ends[a] : ends[b]] for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def lattice(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(end place of each chunk, its first place, edge probabilities in units of 1 / ONE, cumulated
        among those of one end place, the edges' start places and ids, each place's first edge). data:
        the chunks, a zero after each, which no piece holds. A chunk's places are its bytes' and the one
        after them. Edges are in the order of their end places' distance from the chunk's start."""
        n = len(data)
        kind = np.int32 if n < 1 << 31 else np.int64
        count = np.zeros(n, np.uint16)  # edges that end at a place
        covered = np.zeros(n, bool)  # by a piece of one character
        covered[end] = True
        edges = []
        starts, key, power = np.arange(n), _VALUE[data], powers(0, self.longest)
        for length in range(1, self.longest + 1):
            if length > 1:  # of the starts that a longer piece may have
                starts, key = starts[longer], key[longer]
                inside = starts + (length - 1) < n
                if not inside.all():
                    starts, key = starts[inside], key[inside]
                key += _VALUE[data[starts + (length - 1)]] * power[length - 1]
            slot = self.table[(key >> np.uint64(44)).view(np.int64)]
            hit = np.flatnonzero(slot > 1)
            piece, hash_ = (slot[hit] >> 1) - 1, key[hit]
            true = self.keys[piece] == hash_
            for _ in range(self.alike - 1):
                other = np.flatnonzero(~true)
                piece[other] = np.minimum(piece[other] + 1, len(self.keys) - 1)
                true[other] = self.keys[piece[other]] == hash_[other]
            begin, piece = starts[hit[true]], piece[true]
            edges.append((begin.astype(kind), length, count[begin + length], piece))
            count[begin + length] += 1
            if length <= 4:
                single = begin[_SIZE[data[begin]] == length]
                for k in range(length):
                    covered[single + k] = True
            longer = np.flatnonzero(slot & 1)
            if not len(longer):
                break
        # byte pieces where no piece of one character covers a byte
        bare = np.flatnonzero(~covered)
        byte = data[bare].copy()
        odd = (byte >= _ODD[2]) & (byte <= _ODD[0])
        byte[odd] = np.frombuffer(META, np.uint8)[_ODD[0] - byte[odd]]
        last = count[bare + 1]
        count[bare + 1] += 1
        # places by their distance from their chunk's start, and edges by their end places
        depth = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        deepest = int(depth.max())
        order = np.argsort(depth.astype(np.uint16) if deepest < 1 << 16 else depth, kind="stable")
        many = count[order].astype(np.int64)
        ends = np.append(0, np.cumsum(many))
        first_edge = np.empty(n, kind)
        first_edge[order] = ends[:-1]
        begins, ids, weight = np.empty(ends[-1], kind), np.empty(ends[-1], np.int32), np.empty(ends[-1])
        for begin, length, rank, piece in edges:
            at = first_edge[begin + length] + rank
            begins[at], ids[at], weight[at] = begin, self.ids[piece], self.weight[piece]
        at = first_edge[bare + 1] + last
        begins[at], ids[at], weight[at] = bare, self.byte_id[byte], self.byte_weight
        del edges
        # forward filtering
        alpha = np.full(n, -np.inf)
        alpha[start] = 0
        cum = np.empty(len(begins), np.int64)
        level = np.append(0, np.cumsum(np.bincount(depth, minlength=deepest + 1))).tolist()
        for i, j in zip(level[1:-1], level[2:], strict=True):
            a, b = int(ends[i]), int(ends[j])
            if a == b:
                continue
            some = i + np.flatnonzero(many[i:j])
            heads, spread = ends[some] - a, many[some]
            value = alpha[begins[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, heads)
            p = np.exp(value - np.repeat(np.where(np.isfinite(top), top, 0), spread))
            total = np.add.reduceat(p, heads)
            with np.errstate(divide="ignore"):
                alpha[order[some]] = top + np.log(total)
            share = (p * np.repeat(ONE / np.maximum(total, 1e-300), spread)).astype(np.int64)
            total = np.cumsum(share)
            total -= np.repeat(total[heads] - share[heads], spread)
            total[heads + spread - 1] = ONE
            cum[a:b] = total
        return end, start, cum, begins, ids, first_edge

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_LATTICES: dict[tuple[str, float], Lattice] = {}  # a worker's


def _lattice(path: str, theta: float = THETA) -> Lattice:
    if (path, theta) not in _LATTICES:
        _LATTICES[path, theta] = Lattice(path, theta)
    return _LATTICES[path, theta]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", theta: float = THETA, seed: int = 0, ids: bool = True) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, lossless, ids): sampled ids, keyed by the id column and seed; with
    ids=False that column is null, which saves its transport."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.xxhash64(F.col(id_col).cast("bigint"), F.lit(seed)).alias("key"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _lattice(path, theta)
        for batch in slices(batches, most=BATCH_BYTES):
            parts = texts(batch)
            rows = tool.encode(parts, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array([crc(x.astype("<u4").tobytes()) for x in rows], pa.int64()), pa.array([tool.decode(x) == t for x, t in zip(rows, parts, strict=True)]), pa.array(rows if ids else [None] * len(rows), pa.list_(pa.int32()))],
                ["doc_id", "n_ids", "ids_crc32", "lossless", "ids"],
            )

    return plain.mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, lossless boolean, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of id lists; null lists give empty texts."""
    plain = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _lattice(path)
        for batch in batches:
            out = [b"".join(tool.bytes_of[i] for i in x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return plain.mapInArrow(run, "doc_id bigint, text string")
