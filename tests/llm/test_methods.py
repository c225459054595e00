"""The methods by themselves: against published loops, all paths of a lattice, plain merging, and files written bit by bit."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import dropout_bpe, quality, sharding, toxicity, webp

SCHEMA = "doc_id long, text string, score double, label string, shard int"  # clashing names beside


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA)


# Sharding


def jump(key, shards):
    """The published loop."""
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_by_the_published_loop(spark):
    rng = random.Random(1)
    rows = [(k, "é" * (k % 5)) for k in [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(400)), *range(300)]] + [(7, None), (7, ""), (None, "n")]
    for shards in (1, 2, 40):
        got = sharding.shard_documents(frame(spark, rows), shards).collect()
        assert len(got) == len(rows) - 1
        assert all((r.shard, r.grown_shard) == (jump(r.doc_id, shards), jump(r.doc_id, shards + 1)) for r in got)
    text = {d: (t or "").encode() for d, t in rows}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got if r.doc_id != 7)
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark, rows), 0)


# Toxicity


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_reading_of_a_lattice(seed):
    rng = np.random.default_rng(seed)
    restorer = toxicity.Restorer.of(rng.integers(0, 50, (27, 27, 27)).astype(float))
    for token in ("h3ll0", "s p a m", "1d10t", "loooove", "a$$", "vv!", "b@@d", "x", "aaa111"):
        lattice = restorer.lattice(token)
        costs = []
        for path in itertools.product(*lattice):
            a = b = 0
            total = 0.0
            for letter, extra in path:
                total += extra
                if letter:
                    c = ord(letter) - 96 if "a" <= letter <= "z" else 0
                    total += restorer.cost[a, b, c]
                    a, b = b, c
            costs.append((total + restorer.cost[a, b, 0], "".join(x for x, _ in path)))
        cost, text = restorer.cheapest(lattice)
        assert cost == pytest.approx(min(costs)[0])
        assert any(t == text and c == pytest.approx(cost) for c, t in costs)


@pytest.mark.parametrize(("module", "label", "column"), [(toxicity, "toxic", "toxic"), (quality, "quality", "quality")])
def test_scores_of_odd_rows(spark, module, label, column):
    words = {1: "gromp flarn wexit", 0: "water stone light green"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words[i % 2].split() if i % 2 else words[0].split(), k=12)) + f" t{i % 7}") for i in range(400)]
    odd = [(900, None), (901, ""), (902, rows[1][1]), (902, rows[1][1]), (903, rows[0][1] * 2000), (904, "\t\n "), (None, rows[1][1])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, 0), (None, 1), (900, None)], f"doc_id long, {column} int")
    learn = F.col("doc_id") % 3 != 0
    got = module.score(frame(spark, rows + odd), labels, learn).collect()
    assert len(got) == len(rows + odd) - 1 and all(0 <= r.score <= 1 for r in got)
    held = [(r.score, r.doc_id % 2) for r in got if r.doc_id < 400 and r.doc_id % 3 == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]) > 0.95
    assert len({r.score for r in got if r.doc_id == 902}) == 1 and len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    kept = module.keep(frame(spark, rows + odd), labels, learn)
    assert kept.columns == frame(spark, []).columns and 0 < kept.count() < len(rows + odd)
    one = module.score(frame(spark, rows[:20]), labels.where(f"{column} = 1"), F.lit(True)).collect()
    none = module.score(frame(spark, rows[:20]), labels.limit(0), F.lit(True)).collect()
    assert len({round(r.score, 9) for r in one}) == 1 and {round(r.score, 9) for r in none} == {0.5}
    assert module.score(frame(spark, []), labels, F.lit(True)).count() == module.keep(frame(spark, []), labels, F.lit(True)).count() == 0


# Merge-dropout


def merged(v, base, key, dropout):
    """The leftmost of the best candidates that aren't skipped, again and again."""
    spans = [(p, i, i + 1) for i, p in enumerate(base)]
    one = lambda x: np.array([x])
    while True:
        found = []
        for i in range(len(spans) - 1):
            (p, a, b), (q, _, c) = spans[i : i + 2]
            m = v.table.get(p << 32 | q) if p >= 0 and q >= 0 else None
            if m is not None and not (dropout and dropout_bpe._skipped(np.array([key], np.uint64), one(a), one(b), one(c), dropout)[0]):
                found.append((int(v.rank[m]), i, m))
        if not found:
            return [p for p, _, _ in spans]
        _, i, m = min(found)
        spans[i : i + 2] = [(m, spans[i][1], spans[i + 1][2])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_merging_at_once_by_agenda_and_plainly(dropout):
    v = dropout_bpe.vocabulary(dropout_bpe._path("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = ["▁international", "▁the", "▁", "▁banana" * 3, "▁日本🙂", "▁xxxxxxxxxxxx"] + ["▁" + "".join(rng.choices("etaoinshr", k=rng.randint(1, 14))) for _ in range(60)]
    bases = [[int(v.single[ord(c)]) if v.single[ord(c)] >= 0 else -2 - ord(c) for c in w] for w in words]
    keys = np.array([rng.randrange(2**64) for _ in words], np.uint64)
    pieces, counts = dropout_bpe._merge(v, np.array([x for b in bases for x in b]), np.array([len(b) for b in bases]), keys, dropout)
    got = np.split(pieces, np.cumsum(counts)[:-1])
    for base, key, own in zip(bases, keys, got, strict=True):
        wanted = merged(v, base, int(key), dropout)
        assert own.tolist() == wanted == dropout_bpe._agenda(v, base, int(key), dropout)
        assert dropout < 1 or wanted == base


def test_decoding_odd_rows(spark):
    ids = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (None, [], "z")], "doc_id long, ids array<int>, text string")
    assert sorted((str(r.doc_id), r.text) for r in dropout_bpe.decode_documents(ids).collect() if r.text is not None) == [("2", ""), ("None", "")]
    assert dropout_bpe.decode_documents(ids.limit(0)).count() == 0


# WebP, with streams put together from the published format, bit by bit


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, *pairs):
        for value, n in pairs:
            self.bits += [value >> i & 1 for i in range(n)]
        return self

    def simple(self, *symbols):
        """A code of one or two symbols below 256, the smaller one first."""
        self.put((1, 1), (len(symbols) - 1, 1), (1, 1), (symbols[0], 8))
        return self.put((symbols[1], 8)) if len(symbols) > 1 else self

    def image(self, channels, main):
        """Pixels of at most two values a channel (green, red, blue, alpha); no cache, one group of codes, no distance in use."""
        self.put((0, 1), *[(0, 1)] * main)
        codes = [sorted(set(c)) for c in channels]
        for code in codes:
            self.simple(*code)
        self.simple(0)
        for pixel in zip(*channels, strict=True):
            for value, code in zip(pixel, codes, strict=True):
                if len(code) > 1:
                    self.put((code.index(value), 1))
        return self

    def file(self):
        data = bytes(sum(b << i for i, b in enumerate(self.bits[k : k + 8])) for k in range(0, len(self.bits), 8))
        body = b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
        return b"RIFF" + len(body).to_bytes(4, "little") + body


def head(width, height):
    return Bits().put((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))


def two_valued(rng, n):
    """Channels green, red, blue, alpha of n pixels."""
    return [rng.choice(rng.choice(256, 2, replace=False), n).tolist() for _ in range(4)]


def as_rgba(channels, width):
    g, r, b, a = (np.array(c) for c in channels)
    return np.stack((r, g, b, a), -1).reshape(-1, width, 4)


def test_webp_plain_and_green():
    rng = np.random.default_rng(1)
    channels = two_valued(rng, 15)
    assert (webp.decode(head(5, 3).put((0, 1)).image(channels, True).file()) == as_rgba(channels, 5)).all()
    wanted = as_rgba(channels, 5)
    wanted[..., [0, 2]] = (wanted[..., [0, 2]] + wanted[..., 1:2]) % 256
    assert (webp.decode(head(5, 3).put((1, 1), (2, 2), (0, 1)).image(channels, True).file()) == wanted).all()


def predicted(mode, left, top, right, corner):
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: max(0, min(255, x))
    plain = {0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right), 10: half(half(left, corner), half(top, right))}
    if mode in plain:
        return plain[mode]
    if mode == 11:
        near_left, near_top = (sum(abs(x + y - z - w) for x, y, z, w in zip(left, top, corner, own, strict=True)) for own in (left, top))
        return left if near_left < near_top else top
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(left, top, corner, strict=True)]
    return [clamp(m + int((m - z) / 2)) for m, z in zip(half(left, top), corner, strict=True)]


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    rng = np.random.default_rng(mode)
    width, height = 7, 6
    channels = two_valued(rng, width * height)
    stream = head(width, height).put((1, 1), (0, 2), (1, 3)).image([[mode], [0], [0], [255]], False).put((0, 1))  # blocks of 8 x 8
    got = webp.decode(stream.image(channels, True).file())
    off, out = as_rgba(channels, width).tolist(), []
    for y in range(height):
        out.append([])
        for x in range(width):
            if not y:
                base = out[y][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                base = out[y - 1][0]
            else:
                base = predicted(mode, out[y][x - 1], out[y - 1][x], out[y - 1][x + 1] if x + 1 < width else out[y][0], out[y - 1][x - 1])
            out[y].append([(a + b) % 256 for a, b in zip(base, off[y][x], strict=True)])
    assert got.tolist() == out


def test_webp_cross_colour():
    rng = np.random.default_rng(5)
    channels = two_valued(rng, 12)
    to_blue, red_to_blue, to_red = 200, 77, 130  # green to blue, red to blue, green to red
    stream = head(4, 3).put((1, 1), (1, 2), (0, 3)).image([[to_blue], [red_to_blue], [to_red], [255]], False).put((0, 1))
    got = webp.decode(stream.image(channels, True).file())
    signed = lambda x: x - 256 if x > 127 else x
    delta = lambda t, c: signed(t) * signed(c) >> 5
    for (r, g, b, a), (red, green, blue, alpha) in zip(as_rgba(channels, 4).reshape(-1, 4).tolist(), got.reshape(-1, 4).tolist(), strict=True):
        r = (r + delta(to_red, g)) % 256
        assert (red, green, blue, alpha) == (r, g, (b + delta(to_blue, g) + delta(red_to_blue, r)) % 256, a)


def test_webp_palette_of_bundled_pixels():
    colours = [[10, 20, 30, 255], [10, 40, 30, 255]]  # red, green, blue, alpha; stored as differences
    stream = head(5, 2).put((1, 1), (3, 2), (1, 8)).image([[20, 20], [10, 0], [30, 0], [255, 0]], False).put((0, 1))
    rows = [0b10110, 0b00101]  # bit x of a row is the pixel's index; two colours bundle 8 pixels
    got = webp.decode(stream.image([rows, [0, 0], [0, 0], [255, 255]], True).file())
    assert got.tolist() == [[colours[row >> x & 1] for x in range(5)] for row in rows]


def test_webp_colour_cache_and_copies():
    # A pixel goes into the cache under the top bits of its product; a second one is read from there, the others are copied.
    green, red, blue, alpha = 11, 5, 7, 255
    argb = alpha << 24 | red << 16 | green << 8 | blue
    while (argb * 0x1E35A7BD & 0xFFFFFFFF) >> 31 != 1:
        red += 1
        argb = alpha << 24 | red << 16 | green << 8 | blue
    stream = head(6, 1).put((0, 1), (1, 1), (1, 4), (0, 1))  # a cache of two colours, one group of codes
    stream.put((0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1))  # code lengths by two symbols: 1 (bit 0) and 18, a run of zeros (bit 1)
    zeros = lambda n: stream.put((1, 1), (n - 11, 7))
    zeros(11)
    stream.put((0, 1))  # green 11
    zeros(138), zeros(131)
    stream.put((0, 1))  # 281, the second colour of the cache
    for value in (red, blue, alpha, 0):
        stream.simple(value)
    stream.put((0, 1), (1, 1), (0, 1), (1, 1), (1, 1), (0, 1))
    assert webp.decode(stream.file()).reshape(-1, 4).tolist() == [[red, green, blue, alpha]] * 6


def test_webp_column(spark):
    good = webp.encode_grey(np.arange(12, dtype=np.uint8).reshape(3, 4))
    rows = [(1, bytearray(good), 9), (2, None, 9), (3, bytearray(b"RIFF"), 9), (4, bytearray(good[:30]), 9), (None, bytearray(good), 9), (1, bytearray(good), 9)]
    files = spark.createDataFrame(rows, "key long, file binary, width int")
    got = webp.decode_column(files, "key", "file").collect()
    assert sorted((str(r.id), r.width, r.height) for r in got if r.width) == [("1", 4, 3), ("1", 4, 3), ("None", 4, 3)] and len(got) == 6
    assert next(r for r in got if r.id == 1).pixels == bytes(x for i in range(12) for x in (i, i, i, 255))
    assert webp.decode_column(files.limit(0), "key", "file").count() == 0


def test_webp_long_payload():
    payload = bytes(range(256)) * (9 * 20_000)
    images = webp.store(payload)
    assert len(images) > 1 and webp.load(images).tobytes() == payload


def test_webp_copies_are_what_stands_earlier():
    rng = np.random.default_rng(5)
    passage = rng.integers(32, 127, 300).astype(np.uint8)
    parts = [x for i in range(12) for x in (rng.integers(32, 127, int(rng.integers(1, 900))).astype(np.uint8), passage[: 300 - 20 * i])]
    for samples in (np.concatenate(parts), np.zeros(5000, np.uint8), np.tile(passage[:9], 400), passage, passage[:5], rng.integers(0, 2, 6000).astype(np.uint8)):
        found, last = webp.copies_of(samples), 0
        for at, n, distance in found:
            assert at >= max(last, distance) and n >= webp.SHORTEST and at + n <= len(samples)
            assert all(samples[i] == samples[i - distance] for i in range(at, at + n))
            last = at + n
        whole = samples.tobytes() + b"\xff" * (-len(samples) % webp.SIDE)
        assert webp.load(webp.store(whole)).tobytes() == whole
    found = webp.copies_of(np.concatenate(parts))
    assert sum(n for _, n, d in found if d > 1) > 0.9 * sum(300 - 20 * i for i in range(1, 12))


def test_webp_copies_stay_in_a_block(monkeypatch):
    monkeypatch.setattr(webp, "BLOCK", 1000)
    samples = np.tile(np.random.default_rng(6).integers(0, 256, 700).astype(np.uint8), 6)
    found = webp.copies_of(samples)
    assert found and all(at // 1000 == (at - d) // 1000 for at, _, d in found)
    whole = samples.tobytes() + b"\xff" * (-len(samples) % webp.SIDE)
    assert webp.load(webp.store(whole)).tobytes() == whole


def test_webp_streams_use_what_shrinks_them():
    """Each way of a stored stream: transforms from its head, copies from the decoder."""
    rng = np.random.default_rng(7)

    def transforms(file):
        r, found = webp.Reader(file[20:]), []
        r.read(8 + 14 + 14 + 4)
        while r.read(1):
            found.append(r.read(2))
            if found[-1] != webp.SUBTRACT_GREEN:
                break
        return found

    noise = rng.integers(0, 256, (40, webp.SIDE)).astype(np.uint8)
    ramp = np.cumsum(rng.integers(0, 3, (40, webp.SIDE)), 1).astype(np.uint8)
    down = np.cumsum(rng.integers(0, 3, (400, webp.SIDE)), 0).astype(np.uint8)
    few = rng.integers(0, 2, (40, webp.SIDE)).astype(np.uint8) * 200
    wanted = ((noise, [webp.SUBTRACT_GREEN]), (ramp, [webp.SUBTRACT_GREEN, webp.PREDICTOR]), (down, [webp.SUBTRACT_GREEN, webp.PREDICTOR]), (few, [webp.PALETTE]))
    for image, kinds in wanted:
        file = webp.encode_grey(image)
        assert transforms(file) == kinds and (webp.decode(file)[..., 1] == image).all()
    assert len(webp.encode_grey(ramp)) < 0.5 * ramp.size and len(webp.encode_grey(np.concatenate((noise, noise)))) < 1.1 * len(webp.encode_grey(noise))


def test_webp_documents_hold_copies():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    found = [webp.copies_of(np.frombuffer((t or "").encode(), np.uint8)) for t in texts]
    assert sum(any(d > 1 for _, _, d in copies) for copies in found) > len(texts) // 10
