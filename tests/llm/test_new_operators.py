"""Vector codes, archives and token alignment: brute force, libraries, round trips, defined cases."""

import hashlib
import math
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import zstandard

from wayline.llm import token_align, vector_codes, warc_zstd

VECTORS = "vec_id long, embedding array<float>, label int, id int, ints string, error int"


def slow_codes(rows):
    """Codes in plain Python integers: id, code, error, label's error, digest."""
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    kept = [(i, v + [0] * (width - len(v)), g) for i, v, g in kept]
    size = width // 8
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:16]
    books = [[v[p * size : (p + 1) * size] for _, v, _ in first] for p in range(8)]

    def at(p, part):
        apart = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return apart.index(min(apart)), min(apart)

    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                part = v[p * size : (p + 1) * size]
                groups.setdefault(at(p, part)[0], []).append(part)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = [[at(p, v[p * size : (p + 1) * size]) for p in range(8)] for _, v, _ in kept]
    errors = [sum(d for _, d in f) for f in found]
    sums = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        sums[g] = sums.get(g, 0) + e
    flat = ",".join(str(c) for b in books for e in b for c in e)
    sha = hashlib.sha256(flat.encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for k, _ in f), e, sums[g], sha) for (i, _, g), f, e in zip(kept, found, errors, strict=True))


def as_rows(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("bits", [3, 20, 30, 45, 58])
@pytest.mark.parametrize("inner", [1, 8, 300])
def test_exact_products_of_any_width(bits, inner):
    rng = np.random.default_rng(bits + inner)
    a = rng.integers(-(1 << bits), 1 << bits, (7, inner))
    b = rng.integers(-(1 << max(1, 60 - bits - 9)), 1 << max(1, 60 - bits - 9), (inner, 5))
    assert vector_codes.exact_dot(a, b).tolist() == (a.astype(object) @ b.astype(object)).tolist()


def test_limb_products_stay_below_the_exact_range():
    for inner in (1, 2, 3, 8, 9, 100, 4096):
        bits = (53 - (inner - 1).bit_length()) // 2
        assert inner * (1 << bits) ** 2 <= 1 << 53
        worst = np.full((1, inner), (1 << bits) - 1), np.full((inner, 1), (1 << bits) - 1)
        assert int(vector_codes.exact_dot(*worst)[0, 0]) == inner * ((1 << bits) - 1) ** 2


def test_far_values_raise_and_equal_distances_take_the_first():
    with pytest.raises(OverflowError):
        vector_codes.nearest(np.array([[1 << 31] * 8]), np.array([[-(1 << 31)] * 8]))
    best, apart = vector_codes.nearest(np.array([[1, 0]]), np.array([[3, 0], [0, 0], [2, 0], [0, 0]]))
    assert (best.tolist(), apart.tolist()) == ([1], [1])


def test_op11_as_plain_integers(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert as_rows(vector_codes.op11(spark, sf_dir)) == slow_codes(rows)


def test_op11_defined_cases(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(16)], i % 3) for i in range(60)]
    rows += [(7, rows[7][1], None), (None, [0.5] * 16, None), (3, None, 1), (4, [1.0, None] * 8, 1), (5, [float("nan")] * 16, 1), (6, [float("inf")] * 16, 2)]
    rows += [(100, [0.25] * 11, 1), (101, [], 2), (102, [-0.0001] * 16, 9), (103, [60000.0] * 16, 9)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    kept = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    for k, some in enumerate((table, table.filter("vec_id < 5"), table.limit(0))):
        folder = f"{tmp_path}/{k}"
        some.write.parquet(f"{folder}/embeddings.parquet")
        wanted = [kept, [r for r in kept if r[0] is not None and r[0] < 5], []][k]
        assert as_rows(vector_codes.op11(spark, folder)) == slow_codes(wanted)


def test_codes_stand_for_their_entries(spark, sf_dir):
    ints = vector_codes.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4096, "vec_id", "embedding", "label")
    books = vector_codes.fit(ints, rounds=1)
    coded = vector_codes.decode(vector_codes.encode(ints, books), books).join(ints.select("id", "ints"), "id")
    for r in coded.collect():
        assert sum((a - int(b)) ** 2 for a, b in zip(r.approximation, np.frombuffer(r.ints, "<i4"), strict=True)) == r.error


PAGES = "page_id long, url string, html string, id int, digest string, first_id int, payload string, key int"


@pytest.fixture
def odd_pages(spark):
    body = "<p>xé中 " * 20
    rows = [(5, "http://a/1", body), (3, "http://a/ 2\r\nX: y", body), (3, "http://a/3", body), (None, None, body), (9, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", "")]
    rows += [(None, "u", "<b>" * 40), (None, "v", "<b>" * 40), (20, "u", "a" * 100), (21, "u", "a" * 100), (22, "u", "b" * 99), (23, "u", "b" * 99), (30, "u", "long " * 400_000)]
    return spark.createDataFrame([(*r, 1, "d", 2, "p", 3) for r in rows], PAGES)


def slow_archive(rows):
    kept = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in kept:
        same = [j for j, q in kept if q == p and j is not None]
        again = len(p) >= 100 and bool(same) and i != min(same)
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def test_op12_matches_sql_and_plain_python(spark, sf_dir, same_rows):
    same_rows(warc_zstd.op12(spark, sf_dir), warc_zstd.OP12_SQL)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zstd.op12(spark, sf_dir).collect()]
    assert sorted(got, key=str) == slow_archive(rows)


@pytest.mark.parametrize("size", [1, 400, 1 << 25])
def test_archives_of_odd_pages(spark, odd_pages, size):
    store = warc_zstd.write_archives(warc_zstd.planned(odd_pages), archive_bytes=size)
    found = warc_zstd.read_archives(store).collect()
    rows = [(r.page_id, r.url, r.html) for r in odd_pages.collect()]
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == slow_archive(rows)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in found)
    assert sorted(bytes(r.payload) for r in found if r.payload is not None and len(r.payload) < 100) == sorted((h or "").encode() for _, _, h in rows if len((h or "").encode()) < 100)
    names = [f["warc-record-id"] for r in store.collect() for f, _ in warc_zstd.records(bytes(r.archive))]
    assert len(names) == len(set(names)) == len(rows) + store.count()
    assert warc_zstd.write_archives(warc_zstd.planned(odd_pages.limit(0))).count() == 0


def test_archive_layout(spark, sf_dir, tmp_path):
    """The leading frame is a dictionary that plain Zstandard skips; records are frames that open one by one."""
    store = warc_zstd.write_archives(warc_zstd.planned(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    files = warc_zstd.export(store, f"{tmp_path}/warc").collect()
    assert sorted(r.n_records for r in files) == sorted(r.n_records for r in store.collect())
    smaller = plainer = 0
    for r in files:
        data = open(r.file, "rb").read()
        magic, size = struct.unpack_from("<II", data)
        trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        assert magic == 0x184D2A5D and struct.unpack_from("<I", trained)[0] == 0xEC30A437
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        whole = opened.stream_reader(data, read_across_frames=True).read()
        found = [warc_zstd.record(f["warc-type"], f["warc-record-id"][10:-1], {}, b, f["content-type"], f["warc-date"]) for f, b in warc_zstd.records(data)]
        assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(found) == r.n_records and found[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        again, places = warc_zstd.pack(found, trained)
        for k in (len(found) - 1, 0, len(found) // 2):
            assert warc_zstd.record_at(again, places[k])[0] == found[k]
        smaller += len(data)
        plainer += len(warc_zstd.pack(found, None)[0])
    assert smaller < 0.9 * plainer  # dictionary and all its records


def test_damaged_archives_are_refused():
    made = [warc_zstd.record("response", "x", {"A": "b"}, b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + k]) * 500, "t", "d") for k in range(40)]
    data, places = warc_zstd.pack(made, warc_zstd.dictionary(made))
    assert [b for _, b in warc_zstd.records(data)] == [warc_zstd.parse(m)[1] for m in made]
    for broken in (data[:-3], data[: places[0]] + b"\0" * 40, data[:6], data[: places[1] - 5] + bytes([data[places[1] - 5] ^ 255]) + data[places[1] - 4 :]):
        with pytest.raises(ValueError):
            list(warc_zstd.records(broken))


JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slow_alignments(texts):
    """Per text: ids, groups and links from the libraries' ids of the whole text and the tokens' places."""
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    plain = sorted(pre_tokenizers.ByteLevel.alphabet())
    of = {}
    printable = {chr(i) for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = iter(sorted(set(plain) - printable))
    for i in range(256):
        of[chr(i) if chr(i) in printable else next(rest)] = i
    out = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append(([], [], "", []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups, links, lo = [], [], 0
        for end in both:
            groups.append((",".join(str(i) for i, e in zip(ids_a, ends_a) if lo < e <= end), ",".join(str(i) for i, e in zip(ids_b, ends_b) if lo < e <= end)) if len(text) < 400 else None)
            lo = end
        if len(text) >= 400:  # the same by one walk over the tokens
            ends, x, y = set(both), 0, 0
            groups = []
            while x < len(ids_a):
                i, j = x, y
                while ends_a[x] not in ends:
                    x += 1
                while ends_b[y] not in ends:
                    y += 1
                x, y = x + 1, y + 1
                groups.append((",".join(map(str, ids_a[i:x])), ",".join(map(str, ids_b[j:y]))))
        starts_b, first = [0, *ends_b[:-1]], 0
        for i, (s, e) in enumerate(zip([0, *ends_a[:-1]], ends_a)):
            while ends_b[first] <= s:
                first += 1
            j = first
            while j < len(ids_b) and starts_b[j] < e:
                links.append((i, j))
                j += 1
        out.append((ids_a, ids_b, ";".join(f"{x}|{y}" for x, y in groups), links))
    return out


def slow_summaries(rows):
    from collections import Counter

    found = slow_alignments([t for _, t in rows])
    counts = Counter((a[i], b[j]) for a, b, _, links in found for i, j in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (key, _), (a, b, groups, links) in zip(rows, found, strict=True):
        per = [(counts[a[i], b[j]], most[b[j]]) for i, j in links]
        out.append((str(key), len(a), len(b), groups.count("|"), len(links), sum(c == m for c, m in per), sum(c for c, _ in per), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    return sorted(out)


def summary_rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "  ", "a", "the cat, it's  here", "x<|endoftext|>y <s> </s> <unk> <0x0A>", "q" * 3000, "word " * 4000, "\u2581", "a\u2581 b", "é中\n\n 12", "中文，没有空格" * 400, "\x00 \x1c a\x85b\xa0c", "tail  ", "\t x\r\n", "\ud7ff\ufeff\U0001f600 ﬁ①"]
    for alphabet in (" ab\n", " \t\u3000x中", "é'sll 7,", " a\x1c\x85\u2028", "the of and ", "\U0001f600e\u0301 "):
        texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(25)]
        texts.append("".join(rng.choices(alphabet, k=5000)))
    return texts


ALIGN = "doc_id long, text string, n int, block int, place int, pair int, n_a int"


def test_op13_as_the_libraries_do(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert summary_rows(token_align.op13(spark, sf_dir)) == slow_summaries(rows)


@pytest.mark.parametrize("block", [1, 3000, 1 << 25])
def test_alignment_of_odd_texts(spark, block):
    rows = [(k // 2 if k % 7 else None, t) for k, t in enumerate(odd_texts() + ["the cat, it's  here", "tail  "])]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], ALIGN)
    assert summary_rows(token_align.summaries(docs, JSON, MODEL, block_chars=block)) == slow_summaries(rows)
    assert token_align.summaries(docs.limit(0), JSON, MODEL).count() == 0


@pytest.mark.parametrize("lane", [1, 7, 1 << 20])
def test_lanes_do_not_change_an_alignment(lane):
    a, b = token_align.sides(JSON, MODEL)
    texts = [t or "" for t in odd_texts()]
    found = token_align.Aligned(texts, a, b, lane_chars=lane)
    links = sorted(zip(found.owner_a[found.link_a].tolist(), found.link_a.tolist(), found.link_b.tolist()))
    want = []
    for k, (_, _, _, some) in enumerate(slow_alignments(texts)):
        want += [(k, int(found.bounds_a[k]) + i, int(found.bounds_b[k]) + j) for i, j in some]
    assert links == want
    assert [g.decode() for g in found.groups(a, b)] == [g for _, _, g, _ in slow_alignments(texts)]


def test_align_returns_tokens_links_and_cuts(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts())]
    got = {r.doc_id: r for r in token_align.align(spark.createDataFrame(rows, "doc_id long, text string"), JSON, MODEL).collect()}
    for k, (a, b, groups, links) in enumerate(slow_alignments([t for _, t in rows])):
        r = got[k]
        assert (r.a_ids, r.b_ids, list(zip(r.link_a, r.link_b))) == (a, b, links)
        at = [(0, 0), *((x + 1, y + 1) for x, y in zip(r.cut_a, r.cut_b))]
        assert groups == ";".join(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])) for (i, j), (x, y) in zip(at, at[1:]))
