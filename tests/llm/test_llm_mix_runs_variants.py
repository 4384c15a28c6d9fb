"""Source mixing, periodic runs and spelling variants against restatements."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import mixing, periodic, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


# ---- operator 11 -----------------------------------------------------------------

def shared(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets as the contract words them: cut off, share the excess again, repeat."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    budget, full = share * sum(sizes), set()
    while True:
        left = budget - sum(most * sizes[k] for k in full)
        over = sum(w for k, w in enumerate(weight) if k not in full)
        aim = [most * s if k in full else left * weight[k] / over for k, s in enumerate(sizes)]
        above = {k for k, s in enumerate(sizes) if k not in full and aim[k] > most * s}
        if not above:
            return aim
        full |= above


@pytest.mark.parametrize("sizes", [[100] * 7, [1, 1000, 10, 5, 800], [0, 0, 50], [0, 0], [1000, 1, 1, 1], [7]])
def test_targets_share_the_excess(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(shared(sizes), abs=1e-6)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mix_of_the_table(spark, rows):
    got = {r.doc_id: r for r in mixing.op11_source_mix(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows}
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    assert {k: r["size"] for k, r in got.items()} == words
    names = sorted({r.source for r in rows})
    own = {s: sum(words[r.doc_id] for r in rows if r.source == s) for s in names}
    aim = dict(zip(names, shared([own[s] for s in names])))
    for r in rows:
        g = got[r.doc_id]
        assert (g.source_size, g.target) == (own[r.source], pytest.approx(aim[r.source]))
        assert 0 <= g.taken <= 2 * g["size"]
    for s in names:
        of = [got[r.doc_id] for r in rows if r.source == s]
        assert -1e-3 <= aim[s] - sum(g.taken for g in of) < 1
        assert sum(g.taken % max(g["size"], 1) != 0 for g in of) <= 1     # one document is cut


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = mixing.mix(docs).select("doc_id", "taken")
    b = mixing.mix(docs.orderBy(F.desc("n_chars")).repartition(7)).select("doc_id", "taken")
    assert sorted(a.collect()) == sorted(b.collect())


def test_inclusion_follows_the_expected_copies(spark):
    """Over many seeds a document is taken about as often as expected, and the
    remaining words of a source are met in every single draw."""
    docs = spark.createDataFrame([(k, "a" if k % 4 else "b", 10 + k % 7, float(1 + k % 3)) for k in range(240)],
                                 "doc_id long, source string, size long, grade double")
    total = collections.Counter()
    seeds = range(12)
    for seed in seeds:
        got = mixing.mix(docs, size=F.col("size"), favour=F.col("grade"), share=0.9, seed=seed).collect()
        for r in got:
            total[r.source, round(r.expected, 6)] += r.taken / r["size"]
            assert r.whole == int(r.expected) and 0 <= r.extra <= r["size"]
        for s in ("a", "b"):
            assert -1e-3 <= next(r.target for r in got if r.source == s) - sum(r.taken for r in got if r.source == s) < 1
    n = collections.Counter((r.source, round(r.expected, 6)) for r in got)
    assert len(n) >= 4
    for key, copies in total.items():
        mean = copies / (n[key] * len(seeds))
        assert abs(mean - key[1]) < 0.08, (key, mean)


def test_mix_of_ties_nulls_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)       # many ranges of one source
    docs = [(None, None, "a b c")] * 40 + [(1, "s", "x y")] * 30 + [(k, "hot", "w " * (k % 9)) for k in range(900)] + [(5, "z", None), (6, "z", "")]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    assert len(got) == len(docs)
    for s in {d[1] for d in docs}:
        of = [r for r in got if r.source == s]
        assert -1e-3 <= of[0].target - sum(r.taken for r in of) < 1
        assert all(r.taken <= 2 * r["size"] for r in of)
    assert {(r.target, r.taken) for r in got if r.source == "z"} == {(0.0, 0)}
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


# ---- operator 12 -----------------------------------------------------------------

def all_runs(w, least=24, periods=3):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(least, periods * q):
                found.setdefault((start, size), q)
            i += 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_text(rng):
    w = [rng.choice("abcdefgh"[:rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([0, 1, 23, 24, 40, 200, 500]))]
    for _ in range(rng.randrange(4)):
        if len(w) > 30:
            a, p = rng.randrange(len(w)), rng.randrange(1, len(w) // 4)
            for i in range(a + p, min(len(w), a + p * rng.randrange(2, 7) + rng.randrange(p))):
                w[i] = w[i - p]
    return w


def test_the_cover_gives_every_remainder():
    cover = periodic.COVER.tolist()
    assert {(a - b) % periodic.PERIOD for a in cover for b in cover} == set(range(periodic.PERIOD))


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 3), (4, 2)])
def test_runs_are_those_of_all_offsets(least, periods):
    rng = random.Random(least)
    for _ in range(25):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 9))]
        got = periodic.runs_of([[c.encode() for c in w] for w in texts], least, periods)
        assert got == [all_runs(w, least, periods) for w in texts]


def test_common_extensions_word_by_word():
    rng = random.Random(2)
    words = [rng.choice("ab") for _ in range(700)]
    words[300:600] = words[:300]
    code = np.concatenate([[9] * 0, np.array([ord(c) for c in words]), 1000 + np.arange(31 * 25 - 700 + 31)])
    ext = periodic.Extensions(code.astype(np.int64), np.zeros(len(code), dtype=np.int32))
    i = np.array([rng.randrange(0, 650) for _ in range(500)] + [0, 0])
    j = np.array([rng.randrange(a + 1, 699) for a in i[:-2].tolist()] + [300, 699])
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        n = 0
        while code[a + n] == code[b + n]:
            n += 1
        want.append(n)
    assert ext.lce(i, j).tolist() == want and max(want) >= 300


def test_runs_in_slices_of_the_grid(monkeypatch):
    w = [b"%d" % (k % 37) for k in range(3000)] + [b"x", b"y"] * 900
    whole = periodic.runs_of([w, w[5:]])
    monkeypatch.setattr(periodic, "GRID_POINTS", 101)
    assert periodic.runs_of([w, w[5:]]) == whole
    assert whole[0] == [(0, 3000, 37), (3000, 1800, 2)]


def test_periodic_query_on_the_table(spark, rows):
    got = {r.doc_id: r for r in periodic.op12_periodic_runs(spark, SF).collect()}
    some = 0
    for r in rows:
        w = planted(r.doc_id, WORD.findall(r.text or ""))
        runs, g = all_runs(w) if len(w) < 4000 else None, got[r.doc_id]
        if runs is None:
            continue
        some += bool(runs)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (g.n_runs, g.start, g.length, g.period) == (len(runs), *top)
        assert g.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert g.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert some > 10


def test_periodic_rows_that_are_odd(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 30), (None, "a b " * 20), (5, "x " * 100_000), (6, "é ü\x1c " * 12)]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    runs = {k: [tuple(x) for x in r.runs] for k, r in got.items()}
    assert runs == {1: [], 2: [], 3: [], 4: [(0, 30, 1)], None: [(0, 40, 2)], 5: [(0, 100_000, 1)], 6: [(0, 24, 2)]}
    assert got[4].collapsed == "a b" and got[6].collapsed == "é ü\x1c" and got[1].collapsed == got[3].collapsed == ""


# ---- operator 13 -----------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else (a[k:] == b[k + 1:] if len(a) < len(b) else a[k + 1:] == b[k:])


def grouped(counts, ratio=2):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("hot", [10_000, 3])
def test_variants_of_random_words(spark, monkeypatch, hot):
    rng = random.Random(hot)
    counts = {}
    while len(counts) < 260:
        w = "".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 7, 12])))
        counts[w] = rng.choice([3, 4, 6, 9, 18, 40, 81])
        if rng.random() < 0.5:
            k = rng.randrange(len(w) + 1)
            other = rng.choice([w[:k] + "c" + w[k:], w[:k] + w[k + 1:], w[:k] + "d" + w[k + 1:]])
            if len(other) >= 5:
                counts[other] = rng.randrange(3, 50)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {(a, b) for a in counts for b in counts if one_edit(a, b) and (len(a), a) < (len(b), b)}
    pairs = spelling.near_pairs(df, hot_rows=hot).collect()
    assert {(r.short, r.long) for r in pairs} == want and len(pairs) == len(want)
    assert as_rows(spelling.variants(df)) == grouped(counts)


def test_counts_and_lost_letters(spark, rows):
    words = collections.Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            words[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    want = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = spelling.word_counts(docs, alter=spelling.without_letter)
    assert {r.word: r.n for r in got.collect()} == want


def test_counts_emitted_when_the_table_is_full(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{'abcdefghij'[k % 10]}xyz Ärger×÷ 漢字letters ퟿") for k in range(60)], "doc_id long, text string")
    want = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert want["Ärger×÷".replace("A", "a")] == 60 and want["letters"] == 60 and want["wordaxyz"] == 6


def test_variants_that_are_odd(spark):
    docs = [(1, None), (2, ""), (None, "colour colour colour COLOUR colour colour"), (3, "color color color"), (3, "color"), (4, "x" * 50_000 + " "),
            (5, ("y" * 30_000 + " ") * 3), (6, ("y" * 30_001 + " ") * 6), (7, "12345 !!!! abcd abcd abcd")]
    got = as_rows(spelling.variants(spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"))))
    y, z = "y" * 30_000, "y" * 30_001
    assert got == {"colour": (None, "colour", 6, 1, None), "color": (None, "color", 4, 1, None), y: (z, z, 3, 1, 6), z: (None, z, 6, 1, None)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).count() == 0


def test_chains_of_forms_end_in_one_root(spark):
    counts = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 25)}
    got = as_rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == grouped(counts) and {v[1] for v in got.values()} == {"a" * 24}
