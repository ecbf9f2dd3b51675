"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from skyloom.llm import knn, langid, license, media, neardup, packing, quality, queries, spm, sufdedup, toxicity
from skyloom.llm.common import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))  # a very long text


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "one two three four five six seven", "en", "s", 1.0), (2, "one two three four five six seven", "en", "s", 1.0),
        (3, None, None, None, None), (4, "", "en", None, 2.0), (5, LONG, "en", "s", 3.0), (5, LONG, "en", "s", 3.0),
        (None, "one two three four five six seven", None, None, None), (6, "ab", "fr", "s", 0.0), (7, "  \n\t ", "fr", "s", 0.0),
        (8, LONG[1000:], "en", "s", 3.0), (9, "é▁漢字 <|endoftext|> \x85 x", "fr", "s", 0.0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double").selectExpr("*", "lang as lang_pred", "1 as key", "'x' as spans")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def brute_sets(texts, k=5):
    out = []
    for t in texts:
        w = WORD.findall(lower((t or "").encode()))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_near(ids, texts):
    sets = brute_sets(texts)
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in inverted[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def brute_repeats(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_near_duplicates(spark, docs):
    for d in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        p = d.toPandas()
        want = brute_near(p.doc_id.tolist(), p.text.tolist())
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d).collect()}
        assert got == want


def test_near_duplicates_chain(spark):
    """Variants that are linked with one another but not all with the leader; a hot bucket."""
    random.seed(4)
    base = [f"t{i}" for i in range(120)]
    rows, n = [], 0
    for g in range(3):
        text = [f"g{g}{x}" for x in base]
        for _ in range(40):
            k = random.randrange(len(text))
            text = [*text[:k], f"v{n}", *text[k + 1 :]]
            rows.append((n, " ".join(text)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_near([r[0] for r in rows], [r[1] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == want


def test_near_duplicates_odd(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert got[2].component_id == 1 and not got[2].kept and got[1].kept
    assert got[3].n_shingles == got[4].n_shingles == got[7].n_shingles == 0 and got[4].component_id == 4 and got[3].kept
    assert got[6].n_shingles == 1 and got[8].component_id == 5 and got[None].component_id is None and got[None].kept
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (101, 102), (103, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100, 102: 100, 103: 100}


def test_suffix_dedup(docs):
    p = docs.toPandas()
    want = dict(zip(p.doc_id, brute_repeats([t.encode() for t in p.text], 200), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sufdedup.remove_repeats(docs).collect()}
    assert got == want


def test_suffix_dedup_hot(spark, monkeypatch):
    """More different fragments of a key than one task sorts."""
    monkeypatch.setattr(sufdedup, "HOT", 4)
    random.seed(2)
    passage = "".join(random.choice("abcdefghij ") for _ in range(330))
    rows = [(i, "".join(random.choice("klmnop ") for _ in range(random.randint(0, 260))) + passage[random.randint(0, 90) :] + "".join(random.choice("qrstuv ") for _ in range(random.randint(0, 200)))) for i in range(60)]
    rows += [(60, "z" * 700), (61, "é" * 300), (62, None), (63, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = dict(zip([r[0] for r in rows], brute_repeats([(r[1] or "").encode() for r in rows], 200), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sufdedup.remove_repeats(df).collect()}
    assert got == want


def test_suffix_dedup_hot_runs(spark, monkeypatch):
    """Hot at all levels: one-byte runs, each of its own length."""
    monkeypatch.setattr(sufdedup, "HOT", 4)
    random.seed(5)
    noise = lambda: "".join(random.choice("klmnop ") for _ in range(random.randint(1, 90)))
    rows = [(i, noise() + "-" * (200 + i) + noise()) for i in range(30)] + [(30, "=" * 200 + noise()), (31, noise() + "-" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = dict(zip([r[0] for r in rows], brute_repeats([r[1].encode() for r in rows], 200), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sufdedup.remove_repeats(df).collect()}
    assert got == want


def test_suffix_dedup_odd(spark, odd, empty):
    rows = sufdedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r for r in rows}
    assert got[5].n_removed == got[5].n_bytes and got[3].n_bytes == got[4].n_bytes == 0 and got[1].n_removed == 0
    assert sufdedup.remove_repeats(empty).count() == 0


def test_two_stage_sort():
    random.seed(1)
    for _ in range(150):
        length = random.choice([8, 16, 24, 40])
        alphabet = random.choice([b"ab", b"abcdefgh", bytes(range(256))])
        texts = [bytes(random.choice(alphabet) for _ in range(random.randint(length, 120))) for _ in range(random.randint(1, 6))] + [b"z" * 60]
        texts.append(texts[0][3:] + b"q" * length)
        want = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        got = sufdedup.repeated_windows(texts, np.array([len(t) - length + 1 for t in texts]), length)
        assert got.tolist() == [want[t[i : i + length]] > 1 for t in texts for i in range(len(t) - length + 1)]


def check_packing(pieces, capacity=2048):
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary(queries.TOKENIZER)
    tool = Tokenizer.from_file(path)
    for df in (docs, odd):
        out = packing.pack(df, path).collect()
        used, total = check_packing(out), sum(r.length for r in out)
        # first-fit decreasing, as a yardstick
        bins = []
        for length in sorted((r.length for r in out), reverse=True):
            k = next((i for i, room in enumerate(bins) if room >= length), None)
            if k is None:
                bins.append(2048)
                k = len(bins) - 1
            bins[k] -= length
        assert -(-total // 2048) <= used <= len(bins) + 1
        have = defaultdict(list)
        for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id, r.piece)):
            have[r.doc_id].append(r)
        for r in df.dropDuplicates(["doc_id"]).collect():
            ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            assert sorted({p.ids_crc32 for p in have[r.doc_id]}) == sorted({zlib.crc32(ids[i : i + 2048].tobytes()) for i in range(0, len(ids), 2048)})
    assert packing.pack(empty, path).count() == 0


def test_language(spark, docs, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(big.toPandas(), on="doc_id")
    out = out[out.held_out & out.lang.notna()]
    assert (out.lang_pred == out.lang).mean() > 0.97 and out.score.between(0, 1).all()
    model = langid.train(big)
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[3].score == 0 and got[6].lang_pred != "und"
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    out = queries.op3_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = out[out.held_out]
    rank = out.score.rank()
    pos, neg = (out.toxic == 1).sum(), (out.toxic == 0).sum()
    assert (rank[out.toxic == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) > 0.9
    model = toxicity.train(odd.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 1, 0) as toxic"))
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(odd, None).where("score = 0").count() == odd.count()
    assert toxicity.score(empty, toxicity.train(empty.selectExpr("doc_id", "text", "1 as toxic"))).count() == 0


def test_toxicity_phrases():
    """Half of the toxic texts hold a marked word, the others only a phrase of short words."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    plain = lambda: rng.choices(words, k=120)

    def toxic(mark):
        x = plain()
        for i in (20, 50, 80):
            x[i] = mark
        return " ".join(x).encode()

    word, phrase = "vrakulent", "go up to my ox we do it so be at an ax"
    parts = [" ".join(plain()).encode() for _ in range(300)] + [toxic(m) for _ in range(150) for m in (word, phrase)]
    model = toxicity.fit(parts, np.array([0] * 300 + [1] * 300))
    model.open()
    clean = model.scores([" ".join(plain()).encode() for _ in range(100)])
    for mark in (word, phrase):
        found = model.scores([toxic(mark) for _ in range(100)])
        assert (found >= 0.5).mean() > 0.9 and (clean < 0.5).mean() > 0.9


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    out = queries.op6_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = out[out.held_out]
    assert (out.predicted == out.quality).mean() > 0.95
    model = quality.train(odd.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 1, 0) as quality"))
    assert quality.score(odd, model).where("score between 0 and 1").count() == odd.count()
    assert quality.train(odd.selectExpr("doc_id", "text", "cast(null as int) as quality")) is None
    assert quality.score(empty, model).count() == 0


def test_media(docs, odd, empty):
    for df in (docs, odd):
        text = {r.doc_id: (r.text or "").encode() for r in df.collect()}
        for r in media.media_columns(df).collect():
            b = text[r.doc_id]
            data = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
            assert media.from_wav(r.media) == data and r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.n_bytes == len(b)
            assert r.tail_crc32 == zlib.crc32(data[-32:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
            assert r.fingerprints == sorted(r.fingerprints)
    assert media.media_columns(empty).count() == 0
    # a sine's peaks are at its frequency
    t = np.arange(576 * 4)
    marks = media.fingerprints((128 + 100 * np.sin(2 * np.pi * 50 * t / 576)).astype(np.uint8))
    assert {int(m) >> 28 & 0xFFF for m in marks} == {50}


def test_media_one_block(spark):
    """Texts of one block have fingerprints, and different ones."""
    random.seed(4)
    rows = [(i, " ".join("".join(random.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))) for i, n in enumerate((1, 5, 20, 50, 80, 95))]
    out = media.media_columns(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.payload_bytes == 576 and r.fingerprints for r in out)
    assert len({r.feature for r in out}) > 3


def test_license(docs, odd, empty):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for df in (docs, odd):
        got = {r.doc_id: r for r in license.scan(df).collect()}
        for r in df.collect():
            w = word.findall(lower((r.text or "").encode()))
            places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
            g = got[r.doc_id]
            assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
            assert g.base_labels == ",".join(sorted({x for _, x in places}))
            assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    assert license.scan(odd).count() == odd.count() and license.scan(empty).count() == 0


def test_license_spans(spark):
    mit = license.TEMPLATES["mit"].replace("person", "natural person").upper()
    rows = spark.createDataFrame([(1, f"x y {mit}, z"), (2, "permission is hereby granted"), (3, "cc-by cc by CC  BY")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license.scan(rows).collect()}
    assert got[1].labels == "mit" and got[1].spans[0].first == 2 and got[2].labels == ""
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (3, 0, 4)


def test_license_repeated_grams(spark):
    """Repeats of a few words of a template are no span of it, however many votes their diagonals add up to."""
    mit = license.TEMPLATES["mit"].split()
    rows = [(1, "permission is " * 20), (2, "software without " * 20), (3, "the software " * 30), (4, "version 2 0 " * 3), (5, " ".join(mit[:14] + ["x", "y"] + mit[14:])), (6, " ".join(reversed(mit))), (7, "the software " * 30 + " ".join(mit))]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4, 6)] == [""] * 5 and [got[i].score for i in (1, 2, 3, 4, 6)] == [0.0] * 5
    assert got[5].labels == got[7].labels == "mit" and got[5].score > 0.9 and got[7].spans[0].last == 60 + len(mit) - 1


def brute_chain(pos, at):
    """Longest chain by trying every predecessor."""
    rows = sorted(zip(pos, at, strict=True))
    best = [1] * len(rows)
    for i, (p, t) in enumerate(rows):
        for j, (q, u) in enumerate(rows[:i]):
            if q < p and u < t and abs((p - t) - (q - u)) <= license.GAP:
                best[i] = max(best[i], best[j] + 1)
    return max(best)


def test_license_chain():
    rng = random.Random(8)
    for _ in range(200):
        size = rng.randint(3, 12)
        hits = sorted({(p, rng.randrange(size)) for p in range(rng.randint(1, 14))})
        pos, at = (np.array(x) for x in zip(*hits, strict=True))
        n, first, last = license.longest_chain(pos, at, size)
        assert 1 <= n <= brute_chain(pos.tolist(), at.tolist()) and first <= last
    exact = np.arange(9)
    assert license.longest_chain(exact + 5, exact, 9) == (9, 5, 13)


def test_pieces(spark, docs, odd, empty):
    path = queries.vocabulary(queries.PIECES)
    for df in (docs, odd):
        one = spm.encode(df, path)
        two = {(r.doc_id, tuple(r.ids)) for r in spm.encode(df.repartition(5), path).collect()}
        assert two == {(r.doc_id, tuple(r.ids)) for r in one.collect()}
        text = {r.doc_id: r.text or "" for r in df.collect()}
        assert all(r.text == text[r.doc_id] for r in spm.decode(one, path).collect())
        assert one.where("not lossless").count() == 0
    assert spm.encode(empty, path).count() == 0


def test_pieces_distribution():
    """Sampled segmentations of a word follow the lattice's weights."""
    tool = spm.Lattice(queries.vocabulary(queries.PIECES), 1.0)
    weight = {tool.bytes_of[i]: w for i, w in zip(tool.ids.tolist(), tool.weight.tolist(), strict=True)}
    word = b"tion"
    paths = {}

    def walk(at, parts, w):
        if at == len(word):
            paths[tuple(parts)] = np.exp(w)
        for j in range(at + 1, len(word) + 1):
            if word[at:j] in weight:
                walk(j, [*parts, word[at:j]], w + weight[word[at:j]])

    walk(0, [], 0.0)
    n = 20_000
    got = Counter(tuple(tool.bytes_of[i] for i in ids) for ids in tool.encode([word] * n, np.arange(n)))
    total = sum(paths.values())
    assert set(got) <= set(paths)
    assert all(abs(got[p] / n - w / total) < 0.015 for p, w in paths.items())


def test_pieces_longest():
    """Every piece of the model is in the lattice, also those of over 32 bytes."""
    import sentencepiece

    path = queries.vocabulary(queries.PIECES)
    model, lattice = sentencepiece.SentencePieceProcessor(model_file=path), spm.Lattice(path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    assert set(lattice.ids.tolist()) == set(plain) and max(lattice.lengths) == max(len(model.id_to_piece(i).encode()) for i in plain) > 32


def test_pieces_work_and_batches():
    """A place is looked up for as many bytes as a piece may still begin so, not for every length of a
    piece; a word's probabilities are equal to the last bit whatever stands in its batch."""
    tool = spm.Lattice(queries.vocabulary(queries.PIECES))
    looked = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            looked.append(np.size(at))
            return np.asarray(self)[at]

    words = [f"▁zygo{k}w{k * 7919 % 1000003}tional".encode() for k in range(3000)] + ["▁extraordinary".encode()]
    tool.table = tool.table.view(Seen)

    def last(chunks):
        data = np.frombuffer(b"".join(x + b"\0" for x in chunks), np.uint8)
        end = np.flatnonzero(data == 0)
        _, _, cum, begins, ids, first = tool.lattice(data, end - [len(x) for x in chunks], end)
        place, out = int(end[-1]) - len(chunks[-1]), []
        for k in np.flatnonzero(begins >= place):
            out.append((int(begins[k]) - place, int(ids[k]), int(cum[k])))
        return len(data), sorted(out)

    n, many = last(words)
    assert 0 < sum(looked) < 12 * n < len(tool.lengths) * n
    assert many == last(words[-1:])[1]


def test_pieces_gaps():
    """Texts with zero bytes, empty ones and U+2581 come back whole, first and last in a batch too."""
    tool = spm.Lattice(queries.vocabulary(queries.PIECES))
    parts = [b"", b"", b"a\0b \0", b"\0", "▁ ▁x".encode(), b"the same", b"", b"the same", b" ", b""]
    alone = [tool.encode([x], np.array([k]))[0].tolist() for k, x in enumerate(parts)]
    both = [x.tolist() for x in tool.encode(parts, np.arange(len(parts)))]
    assert alone == both and [tool.decode(np.array(x, int)) for x in both] == parts


def test_top_k(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.floor(64 * np.array([r.embedding for r in rows], np.float32).astype(np.float64)).astype(int)
    got = defaultdict(list)
    for r in sorted(queries.op9_exact_top_k(spark, "/root/testdata/sf0.01").collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        assert got[ids[q]] == [(ids[i], s[i]) for i in order]


def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (20, [nan, 1.0]), (40, [inf, 1.0]), (60, [-0.5, 0.25]), (None, [1.0, 1.0]), (61, [1e7, 1e7]), (62, [])]
    t = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as score", "'x' as cell")
    got = [(r.query_id, r["rank"], r.vec_id) for r in knn.search(t, lambda i: i % 20 == 0, 3).collect()]
    assert sorted(got) == [(0, 1, 61), (0, 2, 1), (0, 3, 2), (60, 1, 0), (60, 2, 1), (60, 3, 2)]
    assert knn.search(t.where("false"), lambda i: i % 20 == 0).count() == 0


def test_top_k_large(spark):
    """Components whose products leave doubles and 64 bits, and repeated query ids."""
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e30, 1.0]), (3, [-1e200, 0.5]), (4, [3.0, -1.0]), (20, [1e305, 1e305]), (40, [1.0, 1.0]), (40, [1.0, 1.0])]
    got = defaultdict(list)
    for r in sorted(knn.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), lambda i: i % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    whole = [(i, [int(np.floor(64 * x)) if abs(x) < 1e15 else 64 * int(x) for x in v]) for i, v in rows]
    for q in (0, 20, 40):
        mine = next(v for i, v in whole if i == q)
        want = sorted(((i, max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, mine, strict=True))))) for i, v in whole if i != q), key=lambda x: (-x[1], x[0]))
        assert got[q] == want


def test_near_duplicates_repeated_ids(spark):
    """Rows of one id with different texts are one document: their classes are linked."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (7, b), (8, a + " x"), (9, b + " y"), (10, b), (11, "other words that nothing else here has at all")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(7, 7), (8, 7), (9, 7), (10, 7), (11, 11)}


def test_suffix_dedup_long(spark, monkeypatch):
    """Texts of several blocks."""
    monkeypatch.setattr(sufdedup, "SLICE_BYTES", 700)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(420)
    rows = [(0, noise(2500) + passage + noise(1800)), (1, passage[30:]), (2, noise(690) + passage[100:400]), (3, noise(5000)), (4, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = dict(zip([r[0] for r in rows], brute_repeats([r[1].encode() for r in rows], 200), strict=True))
    plain = df.selectExpr("doc_id", "xxhash64(text) as rid", "text")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sufdedup.remove_repeats(df).collect()}
    assert got == want and sufdedup.repeated_spans(plain).count() == 4


def test_parts_like_the_tokenizer():
    """The parts' ids are the tokenizer's, whatever the signs, cases and contractions."""
    from tokenizers import Tokenizer

    path = queries.vocabulary(queries.TOKENIZER)
    tool, mine = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(3)
    signs = "abcdefgXYZ '.,!019-_\t\n\xe9\xc9\xdf\xb5\xaa\xba\xb2\xbc\xd7<|>srtvemld'"
    rows = ["".join(rng.choice(signs + extra) for _ in range(rng.randint(0, 50))) for extra in ("", "\u6f22\u0301\x85") for _ in range(2000)]
    rows += ["a<|endoftext|>b", "don't DON'T 's x'sy l'll we'Re", "''s &'s 'sx 'll", "'", ""]
    assert mine(rows) == [np.array(x.ids, "<u4").tobytes() for x in tool.encode_batch_fast(rows, add_special_tokens=False)]


def test_packing_plans():
    """Few more sequences than the lower bound, on small and on large counts."""
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6, 1.1, 40_000).astype(int) + 1, 2048)
    for times in (1, 1000):
        counts = np.bincount(lengths, minlength=2049) * times
        runs, used = packing.best_plan(counts)
        assert (np.bincount(runs[:, 0], runs[:, 2], minlength=2049) == counts).all()
        least = -(-int((counts * np.arange(2049)).sum()) // 2048)
        assert least <= used <= least * 1.002 + 1


def test_class_prior():
    """The prior of a mixture is found from positives and unlabelled alone."""
    rng = np.random.default_rng(1)
    p, n = rng.normal(0, 1, (6000, 5)), rng.normal(0, 1, (2000, 5)) + 4
    for share in (0.3, 0.8):
        k = int(share * 2000)
        assert abs(quality.class_prior(p[:3000], np.concatenate([p[3000 : 3000 + k], n[: 2000 - k]])) - share) < 0.06


def test_bounded_sample(spark, odd):
    from skyloom.llm.common import draw

    rows = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text", "id % 3 = 0 as y").union(spark.createDataFrame([(1, "again", True), (None, "x", True), (9, None, True)], "doc_id bigint, text string, y boolean"))
    got = draw(rows, rows, 200, 1 << 20, "doc_id", "y", "text").collect()
    assert Counter(r.y for r in got) == {True: 200, False: 200} and len({r.doc_id for r in got}) == 400
    few = draw(rows, rows, 200, 100, "doc_id", "y", "text").collect()
    assert all(sum(len(r.text) for r in few if r.y == y) <= 100 for y in (True, False))
    assert draw(rows.where("false"), rows, 200, 100, "doc_id", "y", "text") is None


def test_pipeline_odd(spark, odd, tmp_path):
    """Every stage takes nulls, repeated ids and rows, clashing columns and empty tables."""
    import corpus_pipeline as c

    two = odd.unionByName(spark.createDataFrame([(1, "another text of the same id, quite unlike the other one", "en", "s", 9.0)], "doc_id bigint, text string, lang string, source string, score double").selectExpr("*", "lang as lang_pred", "1 as key", "'x' as spans"))
    once = c.drop_near_duplicates(spark, two, SF)
    ids = Counter(r.doc_id for r in once.collect())
    assert once.columns == two.columns and ids[1] == 2 and ids[5] == 1 and ids[2] == ids[8] == 0 and ids[None] == 1
    for df in (two, two.where("false")):
        for _, stage in c.STAGES[:4]:
            assert stage(spark, df, SF).columns == df.columns
        cut = c.cut_repeats(spark, df, SF)
        assert cut.count() == df.count()
        assert c.pack(spark, df, SF).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as c

    now = docs
    for name, stage in c.STAGES[:4]:
        after = stage(spark, now, SF)
        after.write.parquet(f"file://{tmp_path}/{name}")
        after = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert after.columns == docs.columns
        if name == "near_duplicates":
            p = now.toPandas()
            want = brute_near(p.doc_id.tolist(), p.text.tolist())
            assert {r.doc_id for r in after.select("doc_id").collect()} == {d for d, (_, c) in want.items() if c == d}
        if name == "suffix_dedup":
            p = now.toPandas().sort_values("doc_id")
            want = brute_repeats([t.encode() for t in p.text], 200)
            have = after.toPandas().sort_values("doc_id")
            assert have.doc_id.tolist() == p.doc_id.tolist()
            assert all(n or x == y for (_, n, _, _), x, y in zip(want, p.text, have.text, strict=True))
            assert have.text.map(len).tolist() == have.n_chars.tolist()
        now = after
    out = c.run(spark, SF).collect()
    check_packing(out)
    assert len({r.doc_id for r in out}) == now.count()
