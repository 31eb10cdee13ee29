"""MinHash, substrings and lines against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from factloom.llm import lines, minhash, substrings
from factloom.operators.staging import Staging
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("k", [8, 64])
def test_minhash_equals_brute_force(docs, corpus, k):
    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    got = minhash.near_duplicates(docs, k=k, miss=1e-12).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["id"] is None:
            assert r["component"] is None and r["kept"]
        else:
            assert (r["n"], r["component"], r["kept"]) == (len(sets[r["id"]]), want[r["id"]], want[r["id"]] == r["id"])


def test_minhash_empty(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_minhash_chain_of_near_copies(spark):
    """Neighbours link, ends don't; lists stay undecided after the first round."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[i * 3 : i * 3 + 60])) for i in range(12)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component"] for r in got} == smallest(sets, links)


def cut(corpus, length):
    texts = [(r[0], WORD.findall(r[1] or "")) for r in corpus]
    first = {}
    for i, w in sorted((t for t in texts if t[0] is not None), key=lambda t: t[0]):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "base"), [(50, 25), (20, 5), (8, 4)])
def test_substrings_equal_brute_force(docs, corpus, length, base):
    got = [tuple(r) for r in substrings.cut_repeats(docs, length, base).collect()]
    assert sorted(got, key=str) == cut(corpus, length)


def test_substrings_edges(empty, docs):
    assert substrings.cut_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        substrings.cut_repeats(docs, 50, 20)


def test_window_hashes_are_polynomials():
    ids = np.arange(1, 40, dtype=np.uint64)
    for n in (1, 2, 3, 7, 25):
        want = [sum(int(ids[i + j]) * pow(substrings.FACTOR, n - 1 - j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(40 - n)]
        assert substrings.Windows.rolled(ids, n).tolist() == want


def normal(line):
    return tuple(re.sub(r"\d", "0", w) for w in re.findall(r"[^\W_]+", line.lower()))


def similar(a, b, least=0.8):
    """2 LCS / (words of both) >= least, by the whole table."""
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)) - 1e-9:
        return False
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return 2 * row[-1] >= least * (len(a) + len(b)) - 1e-9


def like_lines(rows, min_words=4):
    """The lines that go, by edit similarity of all pairs of lines that share a word; rows are (id, text)."""
    places = {}
    for i, text in rows:
        if i is not None:
            for n, line in enumerate((text or "").split("\n")):
                if len(normal(line)) >= min_words:
                    places.setdefault(normal(line), []).append((i, n))
    forms = list(places)
    bags = [Counter(f) for f in forms]
    links = [(i, j) for i, j in combinations(range(len(forms)), 2) if 2 * (bags[i] & bags[j]).total() >= 0.8 * (len(forms[i]) + len(forms[j])) - 1e-9 and similar(forms[i], forms[j])]
    groups, head = smallest(range(len(forms)), links), {}
    for i, g in groups.items():
        head[g] = min([head.get(g, (10**9, 0)), *places[forms[i]]])
    return {p for i, g in groups.items() for p in places[forms[i]] if p != head[g]}


def test_lines_equal_brute_force(docs, corpus, spark):
    """All pairs, whatever their length; ids of rows that repeat one hold equal texts here."""
    gone = like_lines({(r[0], r[1]) for r in corpus})
    assert len(gone) > 10
    found = lines.repeated_lines(docs, Staging(spark, "test")).collect()
    assert {(r["id"], n) for r in found for n in r["lines"]} == gone
    texts = {r[0]: r[1] for r in corpus}
    for r in lines.dedup_lines(docs).collect():
        text = texts[r["doc_id"]] if r["doc_id"] is not None else r["text"]
        want = text if not text else "\n".join(x for n, x in enumerate(text.split("\n")) if (r["doc_id"], n) not in gone)
        assert r["text"] == want and r["h"] is not None


def letters(rng):
    """The k-th of many words, low ones often; digits would all be 0 in normal form."""
    k, word = int(20_000 ** rng.random()), ""
    while k:
        k, word = k // 20, word + "bcdfghjklmnpqrstvwxz"[k % 20] + "aeiou"[k % 5]
    return word


def edited(rng, words, changes):
    w = list(words)
    for p in rng.sample(range(len(w)), changes):
        w[p] = letters(rng)
    return w


@pytest.mark.parametrize(("low", "high"), [(5, 9), (10, 14), (15, 31), (32, 60), (61, 200)])
@pytest.mark.parametrize("share", [0.01, 0.2])
def test_lines_recall_by_length(spark, low, high, share):
    """Pairs with one changed word, and with as many as edit similarity 0.8 allows; over 0.9 of them are found."""
    rng, rows = random.Random(low), []
    for i in range(300):
        words = [letters(rng) for _ in range(rng.randrange(low, high + 1))]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(edited(rng, words, max(1, int(share * len(words))))))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1 and doc_id >= 1000").count()
    assert got >= 0.9 * 300


def test_lines_of_repeated_ids(spark):
    """Rows that share an id keep what only they hold."""
    a, b, c = (sentence(random.Random(i), 12) for i in range(3))
    rows = [(1, a), (2, a), (2, b), (3, f"{c}\n{b}\n{c}"), (3, f"{c}\n{b}\n{c}"), (None, a), (None, None), (4, ""), (5, None)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == Counter([(1, a, 1, 0), (2, "", 1, 1), (2, b, 1, 0), (3, c, 3, 2), (3, c, 3, 2), (None, a, 1, 0), (None, None, 0, 0), (4, "", 0, 0), (5, None, 0, 0)])


def test_lines_keep_clashing_columns(spark):
    names = ["n_lines", "n_removed", "_line_id", "_line_numbers", "g_id", "g_t", "g_lines", "c0", "lines", "t"]
    df = spark.createDataFrame([(1, "a b c d e\na b c d e", *range(10))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert tuple(lines.dedup_lines(df, counts=False).first()) == (1, "a b c d e", *range(10))
    assert lines.dedup_lines(df).first().asDict() == {"doc_id": 1, "text": "a b c d e", "n_lines": 2, "n_removed": 1} | {n: i for i, n in enumerate(names) if i > 1}


def test_normaliser_equals_the_pattern():
    texts = ["", "\n", "A b_c 12\nx\n", "İstanbul ẞtraße ٣٤ ²½ 汉字 e\u0301 a", "x", "Z" * 50 + " z"]
    words, sizes, counts = lines.Normaliser().words(texts)
    split = [line for t in texts for line in t.split("\n")]
    want = [normal(line) for line in split]
    assert counts.tolist() == [t.count("\n") + 1 for t in texts] and sizes.tolist() == [len(w) for w in want]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip((x for f in want for x in f), words.tolist())) and len(set(seen.values())) == len(seen)


def test_simhash_is_the_majority():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 20, 50)
    words = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    got = lines.simhashes(words, starts, sizes)
    for a, n, h in zip(starts, sizes, got):
        votes = [sum(int(w) >> b & 1 for w in words[a : a + n]) for b in range(64)]
        assert int(h) == sum(1 << b for b, v in enumerate(votes) if 2 * v > n)


def test_line_simhash_of_every_length():
    rng = np.random.default_rng(6)
    sizes = np.array([3, 400, 1, 256, 257, 30, 2000])
    words = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    assert lines.line_simhashes(words, starts, sizes).view(np.uint64).tolist() == lines.simhashes(words, starts, sizes).tolist()


def test_rarest_common_word_bounds_what_differs():
    """Parities of suffixes are those of the words themselves, and keep every pair of bags that may be alike at its first common word."""
    rng, rank = np.random.default_rng(8), np.zeros(lines.BUCKETS, np.uint64)
    for n in [4, 5, 9, 30, 64, 65, 100, 300] * 5:
        a = rng.integers(0, 2**40, n).astype(np.uint64)
        b = a[: n - int(0.2 * n)]
        b = np.concatenate([b, rng.integers(0, 2**40, rng.integers(0, n - len(b) + 1)).astype(np.uint64)])
        sizes = np.array([len(a), len(b)])
        token, held, parity, width = lines.prefixes(*lines.tokens(np.concatenate([a, b]), sizes), sizes, rank, 0.8)
        shown, rests = np.split(token, [held[0]]), []
        for own, wide in zip(shown, np.split(parity, [width[0]])):
            rest = lines.suffix_parities(own, np.zeros(len(own), int), wide[None])
            for k in range(len(own)):
                slot, bit = lines.parity_bits(own[:k], len(wide))
                want = wide.copy()
                np.bitwise_xor.at(want, slot, bit)
                assert rest[k].tolist() == want.tolist()
            rests.append(rest)
        i, j = next((i, j) for i, x in enumerate(shown[0]) for j, y in enumerate(shown[1]) if x == y)
        v = int(width.min())
        apart = np.bitwise_count(lines.folded(rests[0][i : i + 1], v) ^ lines.folded(rests[1][j : j + 1], v)).sum()
        both = len(a) + len(b)
        assert 2 * np.isin(a, b).sum() < 0.8 * both - 1e-9 or i + j + apart <= 0.2 * both + 1e-9


def test_lines_empty(empty):
    assert lines.dedup_lines(empty).collect() == []


def test_edit_similarity_is_lcs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert lines.edit_similarity(a, b, 0.0) == pytest.approx(2 * table[-1, -1] / (len(a) + len(b)))


def test_kept_digest(docs):
    from pyspark.sql import functions as F

    r = substrings.cut_repeats(docs).withColumn("d", F.sha2("kept", 256)).first()
    assert r["d"] == hashlib.sha256(r["kept"].encode()).hexdigest()


def test_lines_alike_without_a_common_block(spark):
    """Insertions into short lines, alone or beside a replaced word, and long lines at the very threshold."""
    rng = random.Random(5)
    rows, word = [], (f"w{a}q{b}".translate(str.maketrans("0123456789", "abcdefghij")) for a in range(100) for b in range(1000))

    def pair(n, replaced, inserted):
        one = [next(word) for _ in range(n)]
        two = list(one)
        for at in rng.sample(range(n), replaced):
            two[at] = next(word)
        for _ in range(inserted):
            two.insert(rng.randrange(len(two) + 1), next(word))
        rows.extend([(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))])

    for n, replaced, inserted in ((4, 0, 2), (5, 0, 2), (6, 0, 2), (6, 0, 3), (7, 1, 1), (8, 1, 1), (10, 2, 0), (15, 3, 0), (30, 6, 0), (60, 12, 0), (150, 30, 0), (300, 60, 0)):
        for _ in range(4):
            pair(n, replaced, inserted)
    gone = like_lines(rows)
    assert len(gone) == len(rows) // 2
    found = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), Staging(spark, "test")).collect()
    assert {(r["id"], n) for r in found for n in r["lines"]} == gone


@pytest.fixture
def verified(monkeypatch):
    """How many pairs each verification was given."""
    seen, alike = [], lines._alike
    monkeypatch.setattr(lines, "_alike", lambda pairs, *rest: (seen.append(pairs.count()), alike(pairs, *rest))[1])
    return seen


def test_long_like_lines_meet_around_hubs(spark, verified):
    """Lines of one repeated passage of 600 words with at most 59 of their own: all alike, though keys of common words say too little to hold them together."""
    rows = []
    for i in range(60):
        rng = random.Random(i)
        rows.append((i, " ".join([letters(rng) + "q" for _ in range(rng.randrange(20, 60))] + ["is onhe"] * 300)))
    found = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), Staging(spark, "test")).collect()
    assert {(r["id"], n) for r in found for n in r["lines"]} == {(i, 0) for i in range(1, 60)}
    assert sum(verified) < 60 * 59 // 2 // 3
