"""Phrases, periodic runs and MinHash near-duplicates against brute force, with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from binwright.llm import minhash, phrases, runs

# Columns whose names the operators also use inside.
SCHEMA = "doc_id long, text string, lang string, n string, key string, phrase string, words string, part string, comp string, id string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, *"nkpwzci") for i, t, lang in rows], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# Periodic runs


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, times * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng):
    n = rng.choice([0, 5, 23, 24, 25, 60, 200, 700])
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 40])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n >= 30 else 0):
        a, p, m = rng.randrange(n), rng.randint(1, n // 4), rng.randint(1, n)
        for i in range(a + p, min(n, a + m)):
            words[i] = words[i - p]
    return [b"%d" % w for w in words]


@pytest.mark.parametrize("portion", [1, 7, 64, 1000, 1 << 16])
def test_runs_are_brute_force_for_any_portions(portion):
    rng = random.Random(portion)
    for _ in range(12 if portion < 64 else 60):
        texts = [periodic(rng) for _ in range(rng.randint(1, 6))]
        got = [list(map(tuple, r.tolist())) for r in runs.document_runs(texts, portion)]
        assert got == [brute_runs(t) for t in texts]


def test_runs_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(runs, "_mixed", lambda x: np.zeros_like(x))  # every window equals every other by hash
    texts = [periodic(random.Random(i)) for i in range(6)]
    assert [list(map(tuple, r.tolist())) for r in runs.document_runs([t[:120] for t in texts])] == [brute_runs(t[:120]) for t in texts]


def test_long_runs_of_one_word_take_linear_work():
    got = runs.document_runs([[b"a"] * 300_000, [b"a", b"b", b"c"] * 50_000 + [b"x"]])
    assert [r.tolist() for r in got] == [[[0, 300_000, 1]], [[0, 150_000, 3]]]


def test_runs_report_is_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(w.decode() for w in periodic(rng)) for _ in range(150)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(151, None, None), (152, "", "en"), (153, " \t\n", "en"), (None, "a " * 30, "en"), (7, "b\x0bb " * 40, "x")]
    rows += [rows[3], rows[3]]
    want = []
    for i, text, _ in rows:
        words = [w for w in SPACE.split(text or "") if w]
        h, n = (zlib.crc32(str(i).encode()) if i is not None else 1), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute_runs(words)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        want.append((
            i, len(found), *top, 1000 * top[1] // top[2] if found else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
        ))
    assert any(w[1] > 1 for w in want)
    assert sorted(map(tuple, runs.runs_report(docs(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_collapsed_text_and_runs(spark):
    text = "x " + "a b " * 12 + "y"
    row = runs.periodic_runs(docs(spark, [(1, text, "en")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 24, 2)] and row.collapsed == "x a b y"


# Phrases


def brute_phrases(rows, least, inside=80, top=2000):
    count, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, 5):
                count.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    candidates = {k: v for k, v in count.items() if v >= least and len(k) > 2}
    gone = set()
    for (lang, *words), v in candidates.items():
        for m in range(2, len(words)):
            gone |= {s for i in range(len(words) - m + 1) if 100 * v >= inside * count[s := (lang, *words[i : i + m])]}
    found = []
    for key in candidates.keys() - gone:
        lang, words, a = key[0], key[1:], candidates[key]
        cuts = [(2_000_000 * a // (l + r), k, l, r) for k in range(1, len(words)) for l, r in [(count[lang, *words[:k]], count[lang, *words[k:]])]]
        score, _, l, r = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out, rank = [], collections.Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def prose(rng):
    words = []
    for _ in range(rng.randint(0, 120)):
        words += rng.choice([["New", "york", "city"], ["new", "york"], ["the"], ["of", "the"], ["é\x01"], ["é"], ["x\x00y"], [str(rng.randrange(30))], ["a,"], ["b.\n"], ["c\t"]])
    return " ".join(words)


PHRASE_ROWS = [(i, prose(random.Random(i)), "en" if i % 3 else random.Random(i).choice(["fr", None, "und"])) for i in range(240)]
PHRASE_ROWS += [(None, None, "en"), (1, "", None), (2, " . \n", "de"), (3, "one two " * 3000, "hot"), (3, "one two " * 3000, "hot")]


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_phrases_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    got = sorted(map(tuple, phrases.top_phrases(docs(spark, PHRASE_ROWS).repartition(5)).collect()))
    want = sorted(brute_phrases(PHRASE_ROWS, 30))
    assert {r[0] for r in want} == {"en", "und", "fr", "hot"} and any(len(r[2].split()) == 4 for r in want)
    assert got == want


def test_phrases_when_the_table_is_full(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TABLE_BITS", 64)  # lets nearly everything through
    got = sorted(map(tuple, phrases.top_phrases(docs(spark, PHRASE_ROWS), top=3).collect()))
    assert got == sorted(brute_phrases(PHRASE_ROWS, 30, top=3))


def test_phrase_counts_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # ranges of few phrases, so that stacks are carried over
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, phrases.top_phrases(docs(spark, PHRASE_ROWS)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(brute_phrases(PHRASE_ROWS, 30))


# MinHash


def brute_components(rows, shingle=2, percent=80):
    sets = []
    for i, text, _ in rows:
        words = [w for w in SPACE.split(lowered(text)) if w]
        width = min(shingle, len(words))
        sets.append((i, frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else frozenset()))
    boss = list(range(len(sets)))

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for (x, (_, a)), (y, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            boss[find(y)] = find(x)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s), least.get(find(x)), i == least.get(find(x))) for x, (i, s) in enumerate(sets)), key=str)


def near_rows():
    rng, out = random.Random(9), []
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 30, 90]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(words)
            for _ in range(rng.randrange(len(words) // 9 + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            out.append((len(out), " ".join(copy), "en"))
    return out + [(900, None, "en"), (901, "", "en"), (902, "one", "en"), (903, "ONE", "en"), (904, out[0][1].upper(), None), (5, out[5][1], "en"), (None, None, "en"), (None, out[40][1] + " new", "en")]


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)

    rows = near_rows()
    got = sorted(map(tuple, minhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    want = brute_components(rows)
    assert got == want and len({w[2] for w in want}) < len(rows) - 30


def test_a_repeated_id_names_two_components(spark):
    rows = [(1, "a b c d e f", "en"), (1, "u v w x y z", "en"), (2, "u v w x y z", "en"), (3, "k l m", "en")]
    got = sorted(map(tuple, minhash.near_duplicates(docs(spark, rows)).collect()))
    assert got == [(1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False), (3, 2, 3, True)]


def test_sequential_bound_is_the_posterior():
    # P(similarity >= 0.8) by numeric integration of s^m (1 - s)^(n - m)
    s = (np.arange(200_000) + 0.5) / 200_000
    for n in (40, 120, 200):
        m = minhash.least_matches(n, 80, 1e-6)
        tail = [(d := s**k * (1 - s) ** (n - k))[s >= 0.8].sum() / d.sum() for k in (m - 1, m)]
        assert tail[0] < 1e-6 <= tail[1]


def test_empty_tables(spark):
    none = docs(spark, [])
    for frame in (minhash.near_duplicates(none), phrases.top_phrases(none), runs.runs_report(none)):
        assert frame.count() == 0
