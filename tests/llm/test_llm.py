"""The llm operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from barline.llm import dropout_bpe, lsh_forest, maxscore, packing, queries, rlz, sharding, suffix_array, webp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, spans string"  # further columns with clashing names


def texts(seed=2, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(120)]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(5, 40)))]
        if i % 3:
            parts.append(rng.choice(shared)[: rng.randrange(50, 400)])
        parts.append(" ".join(rng.choices(words, k=rng.randrange(1, 30))))
        rows.append((i * 7, " ".join(parts)))
    rows += [(5, None), (6, ""), (8, "ab" * 300), (9, "x y " * 200), (10, rows[1][1]), (11, rows[1][1]), (None, "gone")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)


def brute(rows, units, length):
    """{id: (units, removed, kept units)} by a dictionary of all windows."""
    first, split = {}, {d: units(t or "") for d, t in rows if d is not None}
    key = lambda s, i: s[i : i + length] if isinstance(s, bytes) else tuple(s[i : i + length])
    for d in sorted(split):
        for i in range(len(split[d]) - length + 1):
            first.setdefault(key(split[d], i), (d, i))
    out = {}
    for d, s in split.items():
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if first[key(s, i)] != (d, i):
                gone[i : i + length] = [True] * length
        out[d] = len(s), sum(gone), [u for u, g in zip(s, gone, strict=True) if not g]
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_byte_repeats(spark, hot):
    rows = texts()
    got = {r.doc_id: r for r in suffix_array.dedup_bytes(frame(spark, rows), hot=hot).collect()}
    expected = brute(rows, str.encode, 100)
    assert sum(v[1] for v in expected.values()) > 1000
    assert {d: (r.n, r.n_removed, list(bytes(r.kept))) for d, r in got.items()} == expected
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())


@pytest.mark.parametrize("hot", [512, 1])
def test_word_repeats(spark, hot):
    rows = texts(3)
    got = {r.doc_id: r for r in rlz.dedup_words(frame(spark, rows), hot=hot).collect()}
    expected = brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 20)
    assert {d: (r.n, r.n_removed, bytes(r.kept).decode()) for d, r in got.items()} == {d: (n, g, " ".join(k)) for d, (n, g, k) in expected.items()}


def test_repeats_of_rows_that_share_an_id(spark):
    a, b = "q" * 3 + "".join(map(chr, range(97, 123))) * 6, "z" + "".join(map(chr, range(65, 91))) * 6
    got = suffix_array.dedup_bytes(frame(spark, [(1, a), (1, a), (1, b), (2, a)])).collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(1, len(b)), (1, len(a)), (1, len(a)), (2, len(a))]
    assert next(r for r in got if r.doc_id == 2).n_removed == len(a)
    assert len({r.n_removed for r in got if r.doc_id == 1 and r.n == len(a)}) == 1


def test_dedup_texts_keeps_columns(spark):
    rows = [(1, "é" * 90 + "x"), (2, "é" * 90 + "y"), (3, None), (None, "n")]
    got = {r.doc_id: r for r in suffix_array.dedup_texts(frame(spark, rows)).collect()}
    assert got[3].text is None and got[None].text == "n" and got[1].spans == "s"
    assert got[2].text == "y"


def test_suffix_order():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 99, 400).astype(np.uint8)] * 3)
    places = np.arange(len(data) - 60)
    order, group = suffix_array.sort_suffixes(data, places, 60, 16)
    strings = [data[p : p + 60].tobytes() for p in places]
    assert [strings[i] for i in order] == sorted(strings)
    assert all((group[i] == group[i - 1]) == (strings[order[i]] == strings[order[i - 1]]) for i in range(1, len(order)))


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(9999)}" for _ in range(120)] for _ in range(8)]
    rows, i = [], 0
    for words in base:
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randrange(0, 8)):
                own[rng.randrange(120)] = f"e{rng.randrange(9999)}"
            rows.append((i := i + 1, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, rows[0][1]), (None, "x")]
    df = frame(spark, rows)
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())
    del sets[None]
    parent = {d: d for d in sets}
    root = lambda d: d if parent[d] == d else root(parent[d])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = lsh_forest.components(df, 3, (85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), root(d)) for d in sets}


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*texts(5), (500, "a <|endoftext|> b\n\n  c"), (501, "long words " * 3000)]
    got = packing.pack(frame(spark, rows)).collect()
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for d, t in rows:
        if d is None:
            continue
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_sharding_moves_only_into_the_new_shard(spark):
    got = sharding.shard_documents(frame(spark, texts(6, 300)), 10).collect()
    again = {r.doc_id: r for r in sharding.shard_documents(frame(spark, texts(6, 300)), 11).collect()}
    assert all(r.grown_shard == again[r.doc_id].shard and r.grown_shard in (r.shard, 10) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_webp_round_trips():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (13, 17, 4)).astype(np.uint8)
    image[:, :, 3] = 255
    modes = rng.integers(0, 14, (4, 5))
    table = rng.integers(0, 256, (4, 5, 4))
    table[..., 3] = 255
    for transforms in ((), ((webp.SUBTRACT_GREEN,),), ((webp.PREDICTOR, 2, modes),), ((webp.CROSS_COLOUR, 2, table),), ((webp.PREDICTOR, 2, modes), (webp.SUBTRACT_GREEN,))):
        for cache in (0, 4):
            assert (webp.decode(webp.encode(image, transforms, cache)) == image).all()
    few = image // 128 * 200
    few[..., 3] = 255
    assert (webp.decode(webp.encode(few, ((webp.PALETTE,),))) == few).all()


def test_webp_payloads(spark):
    got = {r.doc_id: r for r in webp.text_media(frame(spark, texts(7, 20))).collect()}
    for d, t in texts(7, 20):
        if d is not None:
            raw = (t or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
            assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_merge_dropout(spark):
    import public_tokenizers
    import sentencepiece

    rows = [*texts(8, 20), (700, "a▁b  c\n"), (701, "日本🙂 " + "x" * 300), (702, " ")]
    df = frame(spark, rows)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {r.doc_id: r.ids for r in dropout_bpe.encode_documents(df, dropout=0.0).collect()}
    varied = dropout_bpe.encode_documents(df, dropout=0.2)
    back = {r.doc_id: r.text for r in dropout_bpe.decode_documents(varied).collect()}
    other = {r.doc_id: r.ids for r in dropout_bpe.encode_documents(df, seed=2, dropout=0.2).collect()}
    for d, t in rows:
        if d is None:
            continue
        assert back[d] == (t or "")
        if d != 700:
            assert plain[d] == model.encode(t or "")
    assert any(other[r.doc_id] != r.ids for r in varied.collect())
    v = dropout_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    long = ["some words and others" * 20]
    for text in long:
        whole = dropout_bpe.encode(v, [text], np.array([1]), 1, 0.1, 8)[0]
        assert dropout_bpe.decode(v, whole, np.array([len(whole)]))[0] == text.encode()


def test_merge_dropout_draws_anew_for_each_occurrence(spark):
    got = dropout_bpe.encode_documents(frame(spark, [(d, "international " * 200) for d in range(3)]), dropout=0.2).collect()
    v = dropout_bpe.vocabulary(dropout_bpe._path("piece_bpe_32k.model"))
    seen = set()
    for r in got:
        word = []
        for i in r.ids:
            raw = v.text[v.ends[i] - v.sizes[i] : v.ends[i]].tobytes()
            if raw.startswith(b" ") and word:
                seen.add(tuple(word))
                word = []
            word.append(i)
    assert len(seen) > 30


def test_maxscore(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8)]
    df = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = maxscore.top_k(df.where("vec_id % 50 = 0"), df, shard=64, block=2).collect()
    whole = {i: [math.floor(float(np.float32(x)) * 256) for x in e] for i, e in rows[:300]}
    for q in range(0, 300, 50):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q))[:5]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(-s, i) for s, i in best]


@pytest.mark.parametrize(("name", "label"), [("op8_quality", "quality"), ("op3_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"  # smaller tables hold out a dozen toxic documents or fewer
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES[name](spark, sf).where("held_out").join(labels, "doc_id").select("score", label).collect()
    one, none = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in one for b in none]) > 0.8


def test_restores_stretched_words_and_closing_signs(spark):
    from barline.llm import toxicity

    rows = [(i, "what an ass he is and a stupid bass player, boss of the glass class! you all passed. the idiots") for i in range(50)]
    restorer = toxicity.Restorer.of(toxicity.trigram_counts(frame(spark, rows)))
    for token, word in (("stup" + "i" * 30 + "d", "stupid"), ("".join(c * 6 for c in "stupid"), "stupid"), ("a$$", "ass"), ("idiot$", "idiots"), ("class!", "class!"), ("100$", "100$")):
        assert restorer.restore(pa.array([f"you {token} there"]))[0].as_py() == f"you {word} there".encode()
    assert len(restorer.restore(pa.array(["a1b2" * 50_000]))) == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (suffix_array.dedup_bytes, rlz.dedup_words, lsh_forest.components, packing.pack, sharding.shard_documents, webp.text_media, dropout_bpe.encode_documents):
        assert f(empty).count() == 0


def test_pipeline_removes_repeats_only(spark):
    import corpus_pipeline

    rows = texts()
    expected = brute(rows, str.encode, 100)
    copy = bytes(expected[rows[0][0]][2]).decode()  # of a document that loses nothing
    assert not expected[rows[0][0]][1] and len(copy) >= 100
    rows += [(1000, copy), (1001, "")]
    expected = brute(rows, str.encode, 100)
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows if d is not None], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs, SF).collect()}
    whole = {d: t for d, t in rows if d is not None}
    stays = {d for d, (n, gone, _) in expected.items() if gone < n or not n}
    assert set(got) == stays and {6, 1001} <= stays and 1000 not in stays
    for d in stays:
        assert got[d].text == (None if whole[d] is None else bytes(expected[d][2]).decode(errors="ignore"))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= known
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "near-duplicates", "suffix-array dedup", "packing"]
