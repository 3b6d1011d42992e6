"""Names that differ by typing errors: words, values, employers; brute force and cases with known answers."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayline.operators import company as N
from wayline.operators import spelling as S
from wayline.plans import registry


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_alike(a, b):
    return a == b or (min(len(a), len(b)) >= 4 and 2 * plain_common(a, b) / (len(a) + len(b)) >= 0.85 - 1e-9)


def brute_clusters(vocab):
    """(value, words, n) rows: all pairs, union, the most frequent value."""
    words = [sorted(w.split()) for _, w, _ in vocab]
    codes = [(len(w), sorted(S.metaphone(t) or t for t in w)) for w in words]
    root = list(range(len(vocab)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(vocab)), 2):
        if words[i] and codes[i] == codes[j] and any(all(plain_alike(x, y) for x, y in zip(words[i], p)) for p in itertools.permutations(words[j])):
            root[top(j)] = top(i)
    best = {}
    for i, (v, _, n) in enumerate(vocab):
        best[top(i)] = min(best.get(top(i), (0, v)), (-n, v))
    return sorted((v, best[top(i)][1]) for i, (v, _, _) in enumerate(vocab))


def misspelt(rng, word):
    for _ in range(rng.randint(0, 2)):
        k = rng.randrange(len(word))
        word = rng.choice([word[:k] + word[k] + word[k:], word[:k] + rng.choice("aeiou") + word[k:], word[:k] + word[k + 1 :] or word, word[:k] + rng.choice("aeiou") + word[k + 1 :]])
    return word


@pytest.mark.parametrize("seed", range(3))
def test_words_that_count_as_the_same_share_a_key(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        a = "".join(rng.choices("abcde", k=rng.randint(3, 24)))
        b = a
        for _ in range(rng.randint(1, 6)):
            k = rng.randint(0, len(b))
            b = b[:k] + rng.choice("abcde") + b[k:] if rng.random() < 0.5 else b[:k] + b[k + 1 :]
        assert S.common_letters(a, b) == plain_common(a, b) and S.alike(a, b) == plain_alike(a, b)
        if a != b and S.alike(a, b):
            assert set(S.meeting_keys(a)) & set(S.meeting_keys(b))


def test_metaphone_of_known_words():
    known = {"thumb": "0m", "knight": "nt", "phone": "fn", "school": "skl", "church": "xrx", "xerox": "srks", "bridge": "brj", "corporation": "krprxn", "what": "wt", "judge": "jj", "": "", "é": ""}
    assert {w: S.metaphone(w) for w in known} == known


@pytest.mark.parametrize("block", [3, 1024])
def test_clusters_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_VALUES", block)
    rng = random.Random(block)
    base = ["marketing manager of sales", "software engineer", "citizens bank", "senior accountant", "international development coordinator", "data analyst"]
    vocab = {}
    for _ in range(260):
        words = [misspelt(rng, w) for w in rng.choice(base).split()]
        rng.shuffle(words)
        vocab[" ".join(words)] = rng.randint(1, 9)
    rows = [(v, v, n) for v, n in vocab.items()] + [("프리랜서", "", 3), ("Sales / Marketing", "sales marketing", 2), ("", "", 1)]
    got = S.token_typo_clusters(spark.createDataFrame(rows, "value string, words string, n long"), "value", "n", "words").collect()
    assert sorted(map(tuple, got)) == brute_clusters(rows)


def test_word_order_two_errors_and_what_must_stay_apart(spark):
    rows = [("marketing manager of sales", 9), ("Marketng Maneger of Sals".lower(), 1), ("sales manager of marketing", 2), ("senior marketing manager of sales", 5), ("software engineer", 4), ("senior software engineer", 3), ("citizens bank", 4), ("first citizens bank", 3), (None, 1)]
    df = spark.createDataFrame(rows, "v string, n long")
    got = {r.v: r.representative for r in S.token_typo_clusters(df, "v", "n").collect()}
    assert got["marketng maneger of sals"] == got["sales manager of marketing"] == "marketing manager of sales"
    assert all(got[v] == v for v in ("senior marketing manager of sales", "software engineer", "senior software engineer", "citizens bank", "first citizens bank", None))
    assert S.token_typo_clusters(df.limit(0), "v", "n").count() == 0
    assert {r.representative for r in S.token_typo_clusters(spark.createDataFrame([("the acme", 5), ("acme", 2)], "v string, n long"), "v", "n", stop=("the",)).collect()} == {"the acme"}


def test_misspelt_words_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = sorted(r.w for r in docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).distinct().collect() if r.w)
    have = {}
    for w in words:
        for k in {w[i : i + 2] for i in range(len(w) - 1)}:
            have.setdefault(k, set()).add(w)
    rng, got = random.Random(1), {(r.a, r.b) for r in registry.QUERIES["misspelt_words"](spark, sf_dir).collect()}
    assert got and all(plain_alike(a, b) and a < b for a, b in got)
    for a in rng.sample(words, min(150, len(words))):  # of each, against every word that shares two letters in a row with it, and so all it can match
        near = set().union(*(have[a[i : i + 2]] for i in range(len(a) - 1))) if len(a) > 1 else set()
        assert {b for b in near if b != a and plain_alike(a, b)} == {y if x == a else x for x, y in got if a in (x, y)}


def companies(spark, rows, placeholders=(("^(freelance|independent)$", "self_employed"),)):
    vocab = spark.createDataFrame(rows, "value string, freq long, modal_id string")
    return {r.value: (r.company, r.method, r.confidence) for r in N.company_values(vocab, list(placeholders)).collect()}


def test_employers_inherit_ids_and_other_scripts_and_short_names_stay_apart(spark):
    got = companies(spark, [
        ("Acme Corporation", 100, "acme"), ("Acme Corporetion", 1, None), ("ACME  corporation.", 2, None), ("프리랜서", 5, None), ("美國加州大學柏克萊分校", 2, None),
        ("Предприниматель", 2, None), ("AB", 3, None), ("BA", 9, "ba"), ("--", 4, "stray"), ("Independent", 7, "stray"), ("Globex Trading", 6, None), ("Globbex Trading", 2, None),
    ])
    assert got["Acme Corporation"] == ("id:acme", "company_id", 0.9) and got["Acme Corporetion"] == ("id:acme", "typo_to_id", 0.9)
    assert got["ACME  corporation."] == ("id:acme", "name_crosswalk", 0.97)
    assert got["--"] == ("nonorg:none", "placeholder", 1.0) and got["Independent"] == ("nonorg:self_employed", "placeholder", 1.0)
    assert got["Globbex Trading"] == ("raw:globex trading", "typo", 0.85) and got["Globex Trading"] == ("raw:globex trading", "raw", 0.5)
    for v in ("프리랜서", "美國加州大學柏克萊分校", "Предприниматель", "AB"):
        assert got[v] == (f"raw:{v.lower()}", "raw", 0.5)


def test_modal_ids_need_support(spark):
    rows = [("Half", "h")] * 3 + [("Half", None)] * 3 + [("Few", "f")] * 2 + [("Minor", "m")] * 5 + [("Minor", " ")] * 6 + [("Split", "a"), ("Split", "b"), ("Split", "b")] + [(" ", "x"), (None, "x")]
    got = {r.value: (r.freq, r.id_rows, r.modal_id) for r in N.company_vocabulary(spark.createDataFrame(rows, "name string, id string"), "name", "id").collect()}
    assert got == {"Half": (6, 3, "h"), "Few": (2, 2, None), "Minor": (11, 5, None), "Split": (3, 3, "b")}


def test_rows_take_their_own_id_first_but_for_placeholders(spark):
    values = spark.createDataFrame([("Acme", "id:acme", "company_id", 0.9), ("Me", "nonorg:self", "placeholder", 1.0)], "value string, company string, method string, confidence double")
    aliases = spark.createDataFrame([("77", "acme")], "id string, canonical_id string")
    rows = spark.createDataFrame([(1, "Acme", None, None), (2, "Acme", "77", None), (3, "Acme", "9", "x"), (4, "Me", "9", None), (5, "Acme", " ", "Some-School"), (6, None, None, None), (7, "Other", None, None)], "k int, name string, id string, slug string")
    got = {r.k: (r.company, r.company_method, r.company_confidence) for r in N.company_rows(rows, "name", "id", values, F.col("slug"), aliases).collect()}
    assert got == {1: ("id:acme", "company_id", 0.9), 2: ("id:acme", "company_id", 1.0), 3: ("id:9", "company_id", 1.0), 4: ("nonorg:self", "placeholder", 1.0), 5: ("id:some-school", "school_url", 0.98), 6: (None, None, None), 7: (None, None, None)}


def test_words_share_a_key_at_every_number_of_edits():
    rng = random.Random(7)
    for _ in range(2000):
        a = b = "".join(rng.choices("abcdefghij", k=rng.randint(4, 30)))
        for _ in range(rng.randint(1, 8)):
            k = rng.randint(0, len(b))
            b = b[:k] + rng.choice("abcdefghij") + b[k:] if rng.random() < 0.5 else b[:k] + b[k + 1 :]
        if a != b and S.alike(a, b):
            assert set(S.meeting_keys(a)) & set(S.meeting_keys(b)), (a, b)


def test_key_counts_stay_small():
    assert max(Counter(len(w) and len(S.meeting_keys(w)) for w in ("abcdefghijklmn", "abcdefghijklmno", "abcdefghijklmnopqrstuvwxyz"))) < 3000


def test_words_of_up_to_twenty_letters_meet_by_letters_left_out_alone():
    assert not any(k.startswith("p") for n in range(4, 16) for k in S.meeting_keys("abcdefghijklmno"[:n]))  # pieces of two letters, which many words share, before
    longer = {k for w in ("abcdefghijklmnopq", "abcdefghijklmnopqrst") for k in S.meeting_keys(w) if k.startswith("p")}
    assert all(int(k.split(":")[1]) > 20 for k in longer)
    for n, m in itertools.combinations_with_replacement(range(4, 21), 2):  # words meet by just the letters that their lengths ask for
        kept = S.rest(n, m)
        assert (m in S.partners(n, kept)) == (n in S.partners(m, kept)) == (kept <= n) and 2 * kept >= 0.85 * (n + m) - 1e-9 > 2 * (kept - 1)


def test_word_pairs_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_KEYS", 5_000)  # many buckets
    monkeypatch.setattr(S, "MEETINGS", 7)
    rng = random.Random(5)
    syllables = ["tion", "the", "an", "er", "and", "ss", "ou", "é", "ñu", "日本", "😀a"]
    words = {"", "abc", "abcd", "a" * 19, "a" * 20, "a" * 21, "a" * 25, "x\0yzw\0", "x\0yzw", "x\0yzwv\0"}
    for _ in range(90):
        word = "".join(rng.choices(syllables, k=rng.randint(2, 7)))[:24]
        words |= {word, misspelt(rng, word), misspelt(rng, word)}
    df = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,)], "w string")
    got = sorted(map(tuple, S.word_pairs(df, "w").collect()))
    assert got == sorted(p for p in itertools.combinations(sorted(words), 2) if plain_alike(*p)) and len(got) > 100
    assert S.word_pairs(df.filter("w is null"), "w").count() == 0
