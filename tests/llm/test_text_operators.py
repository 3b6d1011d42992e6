"""Operators on whole texts: round trips, brute force, defined cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from wayline.llm import bpe_chunks, png_media, pretokens, token_counts, wavelet, wu_manber

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = "doc_id long, text string, ids int, block int, n int, part int, image string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names."""
    texts = [(1, "the cat, it's  here"), (1, "the cat, it's  here"), (2, None), (3, ""), (4, "word " * 30_000), (5, "é中\n\n 12"), (None, "no id"), (6, "q" * 40_000), (6, "x<|endoftext|>y")]
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "z") for i, t in texts], ODD)


@given(st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_pretokens_follow_the_pattern(text):
    assert pretokens.pretokens(text) == regex.findall(public_tokenizers.PATTERN, text)


@given(st.text(alphabet=" \n\t'slé7,ab中\u3000\x1c\xa0", max_size=60), st.integers(0, 60))
@settings(max_examples=600, deadline=None)
def test_sure_boundaries_hold_whatever_stands_before(text, at):
    if 0 < at < len(text) and bpe_chunks.sure(text, at):
        assert all(at - k in pretokens.boundaries(text[k:]) for k in range(at))


@pytest.mark.parametrize(("chunk", "overlap"), [(12, 4), (25, 7), (40, 20)])
def test_stitching_gives_the_whole_text(spark, chunk, overlap):
    import tiktoken

    rng = random.Random(chunk)
    alphabets = [" \n'slé7,ab中", "ab ", "abc", ",.7a", " \n\t", "中文，é"]
    rows = [(i // 2, "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 300)))) for i in range(160)] + [(None, "x y" * 50), (7, "q" * 400 + " z" * 80)]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.read_ranks(RANKS), special_tokens={})
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), sorted((str(i), encoding.encode_ordinary(t)) for i, t in rows)
    for sizes in ({"dealt": chunk, "dealt_overlap": overlap}, {"chunk": chunk, "overlap": overlap}, {"dealt": 4 * chunk, "dealt_overlap": 2 * overlap, "chunk": chunk, "overlap": overlap}):
        assert sorted((str(r.doc_id), r.ids) for r in bpe_chunks.encode(docs, RANKS, **sizes).collect()) == want


@given(st.text(alphabet=" \n\t'slé7,ab中\u3000\x1c\xa0", max_size=200), st.integers(4, 40), st.integers(1, 20))
@settings(max_examples=400, deadline=None)
def test_stitched_chunks_have_the_pretokens_of_the_text(text, chunk, overlap):
    assert bpe_chunks.chunk_pretokens(text, chunk, min(overlap, chunk // 2)) == pretokens.pretokens(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(512, 64), (96, 24)])
def test_the_whole_table_in_small_chunks(spark, sf_dir, chunk, overlap):
    """Nearly every text of the table is many chunks here, and the result that of the library."""
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.read_ranks(RANKS), special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe_chunks.encode(docs, RANKS, chunk=chunk, overlap=overlap, dealt=8 * chunk, dealt_overlap=2 * overlap).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sum(len(t) > chunk for t in texts.values()) > len(texts) / 2
    assert got == {i: encoding.encode_ordinary(t) for i, t in texts.items()}


def test_bpe_as_the_library_does(spark, odd):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.read_ranks(RANKS), special_tokens={})
    got = bpe_chunks.decode(bpe_chunks.encode(odd, RANKS), RANKS).collect()
    want = sorted((str(r.doc_id), encoding.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    assert bpe_chunks.encode(odd.limit(0), RANKS).count() == 0


def test_op9_digests(spark, sf_dir):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.read_ranks(RANKS), special_tokens={})
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe_chunks.op9(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = encoding.encode_ordinary(text)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_op5_limit(spark, sf_dir):
    library = pretokens.library_tokenizer(JSON)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in token_counts.op5(spark, sf_dir).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_op6_digests_and_direct_cosine_sums(spark, sf_dir):
    import math

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in png_media.op6(spark, sf_dir).collect():
        data = docs[r.doc_id].encode()
        payload = data + b"\xff" * (max(1, math.ceil(len(data) / 576)) * 576 - len(data))
        image = png_media.write_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest())
    grid = np.arange(32 * 576, dtype=np.uint8).reshape(32, 576)
    means = [[grid[y, 18 * x : 18 * x + 18].mean() for x in range(32)] for y in range(32)]
    cos = [[math.cos(math.pi * (2 * x + 1) * u / 64) for x in range(32)] for u in range(8)]
    sums = [sum(means[y][x] * cos[v][y] * cos[u][x] for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
    middle = float(np.median(np.round(sums[1:], 6)))
    want = "".join("1" if round(s, 6) > middle else "0" for s in sums)
    assert "".join(f"{b:08b}" for b in png_media.cosine_hash(grid)) == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 200, n).astype(np.uint32)
    matrix, keys, lengths = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes([7, None], [n, 0]))
    assert (matrix.ids() == ids).all() and keys == [7, None] and lengths.tolist() == [n, 0]
    for i in range(0, n, 37):
        s = int(ids[i])
        assert matrix.access(i) == s and matrix.rank(s, i) == (ids[:i] == s).sum() and matrix.select(s, matrix.rank(s, i)) == i
    if n:
        assert matrix.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist()
    assert matrix.count(10**6) == 0


def test_damaged_shard_is_refused():
    data = bytearray(wavelet.WaveletMatrix.build(np.arange(50, dtype=np.uint32)).to_bytes([1], [50]))
    data[40] ^= 1
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(bytes(data))


@pytest.mark.parametrize("shard", [5, 1 << 20])
def test_token_store_in_id_order(spark, odd, shard):
    library = pretokens.library_tokenizer(JSON)
    store = wavelet.write_store(odd, JSON, 2, shard_tokens=shard)
    before = {(r.part, r.seq): r.before for r in wavelet.offsets(store).collect()}
    got = sorted((before[(r.part, r.seq)] + r.at, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in wavelet.read_store(store).collect())
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    start = 0
    for (at, key, ids), (known, doc, text) in zip(got, want, strict=True):
        assert at == start and key == (doc if known else None) and ids == [*library.encode(text, add_special_tokens=False).ids, 2]
        start += len(ids)
    assert wavelet.read_store(wavelet.write_store(odd.limit(0), JSON, 2)).count() == 0


def test_op3_checksums(spark, sf_dir):
    library = pretokens.library_tokenizer(JSON)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got, start = {r.doc_id: r for r in wavelet.op3(spark, sf_dir).collect()}, 0
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("block", [20, 10**7])
def test_token_counts_as_the_library(spark, odd, block):
    library = pretokens.library_tokenizer(JSON)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, JSON, block_chars=block).collect())
    assert got == sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert token_counts.count_tokens(odd.limit(0), JSON).count() == 0


def test_png_round_trip_and_features(spark, odd):
    media = png_media.features(png_media.store(odd)).collect()
    assert len(media) == odd.count()
    texts = sorted((str(r.doc_id), png_media.pad((r.text or "").encode())) for r in odd.collect())
    assert sorted((str(r.doc_id), bytes(r.payload)) for r in media) == texts
    by_payload = {}
    for r in media:
        assert by_payload.setdefault(bytes(r.payload), (bytes(r.image), bytes(r.dct_hash))) == (bytes(r.image), bytes(r.dct_hash))


def test_png_filters_and_checksums():
    rng, kinds = np.random.default_rng(2), [4, 3, 2, 1, 0, 4, 3, 2, 2, 1]
    rows = rng.integers(0, 256, (10, 9)).tolist()
    lines = []
    for y, r in enumerate(rows):
        up, line = rows[y - 1] if y else [0] * 9, []
        for x, v in enumerate(r):
            a, b, c = r[x - 1] if x else 0, up[x], up[x - 1] if x else 0
            paeth = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
            line.append((v - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        lines.append([kinds[y], *line])
    assert png_media._unfilter(np.array(lines, np.uint8)).tolist() == rows
    image = bytearray(png_media.write_png(b"a" * 576))
    image[45] ^= 1
    with pytest.raises(ValueError):
        png_media.read_png(bytes(image))


def brute_windows(text, items):
    w, hit, found = wu_manber.words(text), set(), set()
    for key, item in items:
        iw = wu_manber.words(item)
        m = min(10, len(iw))
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("chars", [40, 10**6])
def test_wu_manber_against_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(wu_manber, "BLOCK_CHARS", chars)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(["a", "B", "c,", "é", "7"], k=n))
    items = [(k, text(rng.choice([0, 1, 2, 4, 9, 10, 11, 14]))) for k in range(12)] + [(3, None), (None, "a")]
    docs = [(k, text(rng.randint(0, 60)), "x") for k in range(40)] + [(1, None, "y"), (1, None, "y")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, sum(r.hits[1::2]) - sum(r.hits[::2]), r["items"]) for r in wu_manber.find(d, b).collect())
    real = [(k, t) for k, t in items if k is not None and t]
    assert got == sorted((k, *brute_windows(t or "", real)) for k, t, _ in docs)
    assert wu_manber.clean(d, b.limit(0)).count() == len(docs) and wu_manber.find(d.limit(0), b).count() == 0


def test_clean_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "a b", "h", 5), (2, "c d", None, 6)], "doc_id long, text string, wl_hits string, Wl_items int")
    bench = spark.createDataFrame([(1, "C D")], "item_id long, text string")
    assert [tuple(r) for r in wu_manber.clean(docs, bench).collect()] == [(1, "a b", "h", 5)]


def test_op7_matches_sql(spark, sf_dir, same_rows):
    same_rows(wu_manber.op7(spark, sf_dir), wu_manber.OP7_SQL)
