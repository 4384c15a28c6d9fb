"""Operators on documents against brute-force restatements."""
import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from kestrel.llm import (decontaminate, fingerprints, jaccard_join, language_id, licenses, packing, sharding,
                         token_counts, words)
from kestrel.llm.encode import Encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: r.doc_id)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# ---- words ----------------------------------------------------------------------

def split_words(text):
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def shingles(text, n=5):
    w = split_words(text)
    if not w:
        return set()
    n = min(n, len(w))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}


def test_word_hashes_are_those_of_the_words(rows):
    texts = [r.text for r in rows[:60]] + [None, "", "A b-c", "ÉCOLE école İx ΑΣ", "x" * 50, "a b c d e f"]
    seen = {}
    for a, b, hashes, per in words.word_hashes(texts):
        stop = np.cumsum(per)
        for k in range(a, b):
            own = hashes[stop[k - a] - per[k - a]:stop[k - a]].tolist()
            spelled = split_words(texts[k])
            assert len(own) == len(spelled)
            for h, w in zip(own, spelled):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for text, got in zip(texts, words.shingle_sets(texts)):
        assert len(got) == len(shingles(text))


def test_a_long_text_hashes_like_its_words(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(40_000))
    whole = np.concatenate([h for _, _, h, _ in words.word_hashes([text])])
    monkeypatch.setattr(words, "GROUP", 1 << 12)
    pieces = np.concatenate([h for _, _, h, _ in words.word_hashes(["a", text, "b"])])
    assert (pieces[1:-1] == whole).all() and len(whole) == 40_000


# ---- 1 language ID ----------------------------------------------------------------

def plain_grams(text):
    s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    s = f" {s.strip()} "
    out = collections.Counter(c for c in s if c != " ")
    for n in (2, 3):
        out.update(s[k:k + n] for k in range(len(s) - n + 1))
    return out


def plain_profile(counts):
    packed = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], packed(x[0])))][:language_id.PROFILE_SIZE]


def test_language_profiles_and_distances(spark, docs, rows):
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if not held_out(r.doc_id):
            counts[r.lang].update(plain_grams(r.text))
    profiles = {lang: {g: k for k, g in enumerate(plain_profile(c))} for lang, c in sorted(counts.items())}
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    right = 0
    for r in rows:
        own = plain_profile(plain_grams(r.text))
        far = {lang: sum(abs(p[g] - k) if g in p else language_id.PROFILE_SIZE for k, g in enumerate(own))
               for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (best, held_out(r.doc_id))
        assert got[r.doc_id].score == pytest.approx(1 - far[best] / (language_id.PROFILE_SIZE * len(own)))
        right += best == r.lang and held_out(r.doc_id)
    assert right >= 0.95 * sum(held_out(r.doc_id) for r in rows)


def test_long_texts_are_counted_whole(monkeypatch):
    text = "der die das " * 5000 + "the of and " * 9000
    monkeypatch.setattr(language_id, "CHUNK", 12 * 100)
    keys, counts = language_id.gram_counts(text)
    assert dict(zip(keys.tolist(), counts.tolist()))[ord("f")] == 9000


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_all_n_grams_of_a_text_in_chunks_are_those_of_the_uncut_text(monkeypatch, chunk):
    rnd = random.Random(chunk)
    texts = ["", "...", "a", " a", "a ", "ab.", "ab..", "ÀB ΣΑΣ  x", "x" * 20, "a b c d e f g", "İi ǅ\n\nß"]
    texts += ["".join(rnd.choices("ab é.ß 1İ", k=rnd.randrange(1, 200))) for _ in range(60)]
    whole = [language_id.gram_counts(t) for t in texts]
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    for text, (keys, counts) in zip(texts, whole):
        k, c = language_id.gram_counts(text)
        assert k.tolist() == keys.tolist() and c.tolist() == counts.tolist()
        assert sum(c) == (sum(plain_grams(text).values()) if any(map(str.isalpha, text)) else 0)


# ---- 3 sharding -------------------------------------------------------------------

def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rnd = random.Random(3)
    texts = [f"text {k}" for k in range(500)] + ["hot"] * 400 + [f"group {k // 4}" for k in range(400)] + [None, "", ""]
    rnd.shuffle(texts)
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    from pyspark.sql import functions as F
    rows = table.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("link")).cache()
    got = sharding.assign(rows, shards=13).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(13)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    where = collections.defaultdict(collections.Counter)
    for r in got:
        where[texts[r.doc_id] or ""][r.shard] += 1
    groups = [c for t, c in where.items() if t.startswith("group")]
    together = sum(max(c.values()) for c in groups)
    assert together >= 0.9 * 400                       # a random placement would leave about a third
    assert len(where["hot"]) <= 9                      # 400 documents need at least 4 shards of about 100


def test_full_shards_still_bring_copies_together(spark):
    # every document has copies, so no shard ever has room of its own
    texts = [f"group {k // 4}" for k in range(1600)] + ["hot"] * 400
    random.Random(5).shuffle(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, link string")
    where = collections.defaultdict(collections.Counter)
    sizes = collections.Counter()
    for r in sharding.assign(table, shards=10).collect():
        where[r.link][r.shard] += 1
        sizes[r.shard] += 1
    assert sorted(sizes.values()) == [200] * 10
    assert all(len(c) == 1 for link, c in where.items() if link != "hot")
    assert len(where["hot"]) == 2


@pytest.mark.parametrize("sizes", [(4,), (50,), (50, 3, 7)])
def test_parts_settle_with_their_neighbours_where_every_document_has_copies(spark, sizes):
    links = [f"{size}-{k // size}" for size in sizes for k in range(8000 // len(sizes) // size * size)]
    rows = spark.createDataFrame(list(enumerate(links)), "doc_id long, link string").repartition(4)
    quota = [len(links) // 40 + (s < len(links) % 40) for s in range(40)]
    state = sharding.labelled(rows, len(links), 40).cache()
    at = collections.defaultdict(dict)
    for r in state.collect():
        at[r.link, r.part][r.shard] = r.n
    homes, homeless = (df.collect() for df in sharding.settle(state, quota))
    load = collections.Counter()
    for r in homes:
        load[r.shard] += r.n
        assert r.n == sum(at[r.link, r.part].values()) and r.shard in at[r.link, r.part]     # whole, and where neighbours were
    assert all(load[s] <= quota[s] for s in load) and len(homes) + len(homeless) == len(at)
    assert len(homes) >= 0.9 * len(at)      # before anything is laid out


def test_parts_are_laid_out_whole_and_within_the_rooms():
    rnd = random.Random(7)
    for _ in range(50):
        room = [rnd.randrange(0, 60) for _ in range(7)]
        counts, left = collections.Counter(), sum(room)
        while (n := rnd.randrange(2, 30)) <= left:
            counts[n] += 1
            left -= n
        used, rank = [0] * 7, collections.Counter()
        for size, upto, pieces in sharding.lay_out(counts, room):
            assert upto > rank[size] and sum(n for _, n in pieces) == size
            for s, n in pieces:
                used[s] += n * (upto - rank[size])
            rank[size] = upto
        assert rank == counts and all(u <= r for u, r in zip(used, room))
    assert sharding.lay_out({5: 1, 2: 2}, [4, 5]) == [(5, 1, [(1, 5)]), (2, 2, [(0, 2)])]
    assert sharding.lay_out({5: 1}, [3, 4]) == [(5, 1, [(1, 4), (0, 1)])]


# ---- 4 decontamination ------------------------------------------------------------

def naive_longest(equal, share):
    best = (0, 0)
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            if equal[a] and equal[b - 1] and sum(equal[a:b]) >= share * (b - a) - 1e-9 and b - a > best[1] - best[0]:
                best = (a, b)
    return best


def test_longest_similar_stretch():
    rnd = random.Random(5)
    for _ in range(300):
        equal = np.array([rnd.random() < 0.7 for _ in range(rnd.randrange(1, 40))])
        a, b = decontaminate.longest_similar(equal, 0.8)
        want = naive_longest(equal.tolist(), 0.8)
        assert b - a == want[1] - want[0] and (a == b or equal[a:b].mean() >= 0.8)


def test_planted_passages_are_found_and_others_left_alone():
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(14, 50))) for _ in range(30)]
    texts, want = [], set()
    for k in range(120):
        w = rnd.choices(vocabulary, k=80)
        if k % 2:
            item = k % 30
            part = [x if rnd.random() > 0.08 else "other" for x in items[item].split()]
            w[20:20] = part
            want.add((k, item))
        texts.append(" ".join(w))
    found = list(decontaminate.Finder(items).find([None, "", *texts]))
    got = {(o.row - 2, o.item) for o in found}
    assert got <= want and len(got) >= 0.97 * len(want)
    for o in found:
        doc, item = split_words(texts[o.row - 2]), split_words(items[o.item])
        pairs = list(zip(doc[o.doc_start:o.doc_start + o.n_words], item[o.item_start:o.item_start + o.n_words]))
        assert len(pairs) == o.n_words and sum(x == y for x, y in pairs) == o.n_equal >= 0.8 * o.n_words


def test_short_items_are_found_whole():
    f = decontaminate.Finder(["a b c d e f", "x y", "one two three four five six seven"])
    got = {(o.row, o.item): o.n_equal for o in f.find(["z a b c d e f z", "x y", "a b c d q f", "one two three four five six seven", "x y z", "a q c d q f"])}
    assert got == {(0, 0): 6, (3, 2): 7, (2, 0): 5, (1, 1): 2}     # fewer than five words: only as a whole text


def test_one_substitution_anywhere_in_an_item_of_five_to_nine_words():
    for n in range(decontaminate.LEAST_ITEM, decontaminate.LEAST_WORDS):
        item = [f"i{k}" for k in range(n)]
        texts = ["p " + " ".join("other" if k == odd else w for k, w in enumerate(item)) + " q" for odd in range(n)]
        f = decontaminate.Finder([" ".join(item)])
        assert {o.row: (o.doc_start, o.n_words, o.n_equal) for o in f.find(texts)} == {k: (1, n, n - 1) for k in range(n)}
        assert not list(f.find(["p other " + " ".join(item[1:-1]) + " other q", " ".join(item[:n - 2])]))


def test_masks_ignore_positions_and_hit_every_overlap_of_the_stated_length_and_share():
    kept = [[k for k, bit in enumerate(mask) if bit == "1"] for mask in decontaminate.MASKS]
    assert all("0" in mask for mask in decontaminate.MASKS)
    for n in range(decontaminate.LEAST_WORDS, 20):
        for odd in itertools.combinations(range(n), n // 5):     # fewer unequal words leave more places
            assert any(not any(a + k in odd for k in mask) for mask in kept for a in range(n - mask[-1])), (n, odd)
    for n in range(20, 400):    # windows of 10 to 19 words make up every longer overlap
        assert n // 10 * 10 <= n < n // 10 * 10 + 10


def plain_overlap(text, item, least=10, share=0.8):
    """(words, equal) of the best overlap, by every alignment and every stretch."""
    t, w, best = text.split(), item.split(), (0, 0)
    if 0 < len(w) < decontaminate.LEAST_ITEM:
        return (len(w), len(w)) if t == w else best
    for s in range(-len(w) + 1, len(t)):
        equal = [w[k] == t[k + s] for k in range(max(0, -s), min(len(w), len(t) - s))]
        if len(w) <= least:
            if len(equal) == len(w) and sum(equal) >= share * len(w) - 1e-9:
                best = max(best, (len(w), sum(equal)))
            continue
        a, b = naive_longest(equal, share)
        if b - a >= least:
            best = max(best, (b - a, sum(equal[a:b])))
    return best


@pytest.mark.parametrize("heavy", [decontaminate.HEAVY, 0, 10 ** 9])
def test_overlaps_are_those_of_all_alignments(heavy):
    rnd = random.Random(31)
    for _ in range(60):
        words_ = [f"w{k}" for k in range(rnd.choice([2, 3, 8, 60]))]
        items = [" ".join(rnd.choices(words_, k=rnd.choice([1, 3, 5, 6, 9, 10, 11, 14, 24]))) for _ in range(3)]
        texts = []
        for _ in range(4):
            w = rnd.choices(words_, k=rnd.choice([0, 2, 5, 12, 30]))
            part = [x if rnd.random() > 0.12 else "zz" for x in rnd.choice(items).split()]
            at = rnd.randrange(len(w) + 1)
            texts.append(" ".join(w[:at] + part + w[at:]))
        got = {(o.row, o.item): (o.n_words, o.n_equal) for o in decontaminate.Finder(items, heavy=heavy).find(texts)}
        want = {(r, i): plain_overlap(t, x) for r, t in enumerate(texts) for i, x in enumerate(items)}
        assert got == {k: v for k, v in want.items() if v[0]}


def test_repeated_words_cost_neither_time_nor_memory():
    import time
    import tracemalloc
    item = " ".join(["yes", "no"] * 1000)
    odd = " ".join(w if k % 7 else "maybe" for k, w in enumerate(item.split()))
    f = decontaminate.Finder([item, odd])
    text = " ".join(["yes", "no"] * 10_000)
    list(f.find(["warm up " * 20]))
    tracemalloc.start()
    start = time.time()
    got = {o.item: (o.doc_start, o.n_words, o.n_equal) for o in f.find([text])}
    assert time.time() - start < 20 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert got[0] == (0, 2000, 2000) and got[1][1:] == (1999, 1714)


def test_every_short_overlap_is_found():
    item = [f"i{k}" for k in range(24)]
    f = decontaminate.Finder([" ".join(item)])
    texts, want = [], []
    for n, u in ((10, 2), (11, 2), (12, 2), (15, 3)):
        for odd in itertools.combinations(range(1, n - 1), u):
            w = ["other" if k in odd else item[k + 4] for k in range(n)]
            texts.append(" ".join(["x", "y", *w, "z"]))
            want.append((n, n - u))
    assert {o.row: (o.n_words, o.n_equal) for o in f.find(texts)} == dict(enumerate(want))


def test_an_unequal_end_counts_towards_a_short_item():
    for n in range(5, 11):
        item = [f"i{k}" for k in range(n)]
        texts = ["p " + " ".join(item) + " q", "p other " + " ".join(item[1:]) + " q", "p " + " ".join(item[:-1]) + " other q"]
        got = {o.row: (o.item_start, o.n_words, o.n_equal) for o in decontaminate.Finder([" ".join(item)]).find(texts)}
        assert got == {0: (0, n, n), 1: (0, n, n - 1), 2: (0, n, n - 1)}


def test_benchmark_in_several_blocks(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.overlaps(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert whole and sorted(map(tuple, decontaminate.overlaps(docs, benchmark).collect())) == whole
    left = {r.doc_id for r in decontaminate.without_benchmark(docs, benchmark).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {w[0] for w in whole}


# ---- 5 n-gram Jaccard join --------------------------------------------------------

def plain_classes(texts):
    sets = [shingles(t) for t in texts]
    near = collections.defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                near[a].add(b), near[b].add(a)
    label = list(range(len(sets)))
    for k in range(len(sets)):
        stack = [k] if label[k] == k else []
        while stack:
            for m in near[stack.pop()]:
                if label[m] > k:
                    label[m] = k
                    stack.append(m)
    return label, [len(near[k]) for k in range(len(sets))]


def test_banding_reaches_its_recall():
    bands, rows = jaccard_join.choose_bands()
    assert 1 - (1 - 0.8 ** rows) ** bands >= jaccard_join.RECALL and bands * rows <= jaccard_join.MOST_HASHES


@pytest.mark.parametrize("block", [1024, 5])
def test_classes_and_links(spark, rows, block, monkeypatch):
    rnd = random.Random(11)
    base = [f"b{rnd.randrange(400)}" for _ in range(60)]
    texts = [r.text for r in rows[:40]] + [rows[0].text.upper(), None, "", "!!", "one two", "One, two!"]
    for _ in range(30):   # a chain of near copies
        w = list(base)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(60)] = "changed%d" % rnd.randrange(3)
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(table).collect()}
    label, links = plain_classes(texts)
    assert got == {k: (label[k], links[k]) for k in range(len(texts))}
    kept = {r.doc_id for r in jaccard_join.first_of_each_class(table).collect()}
    assert kept == set(label)


def test_overlaps_in_sparse_and_dense_columns():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 300, rnd.integers(1, 120))).astype(np.uint64) for _ in range(60)]
    full = jaccard_join.overlaps(sets, 0)
    part = jaccard_join.overlaps(sets, 25)
    for a in range(60):
        for b in range(60):
            n = len(np.intersect1d(sets[a], sets[b]))
            if a != b:
                assert full[a, b] == n
            if a < 25 <= b:
                assert part[a, b - 25] == n


# ---- 7 fingerprints ---------------------------------------------------------------

def test_fingerprints_of_edits(docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs, range_rows=23).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)].text, len(r.text)
        edited = r.text[:n - n // 2] + after[:n // 2]
        own, other, nxt = fingerprints.sketches_of([r.text, edited, after])
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (str(own), str(other))
        assert (g.near_edited, g.near_next) == (own.likeness(other), own.likeness(nxt))


def test_sketches_estimate_containment():
    rnd = random.Random(2)
    big = [f"w{rnd.randrange(5000)}" for _ in range(30_000)]
    small, half = " ".join(big[1000:4000]), " ".join(big[5000:7000] + [f"o{k}" for k in range(2000)])
    a, b, c = fingerprints.sketches_of([" ".join(big), small, half])
    assert a.likeness(b) > 0.98 and abs(a.likeness(c) - 0.5) < 0.1


def test_kept_hashes_are_the_share_below_the_fraction(rows):
    """The sketch against plain shingle sets: what it keeps, how often nothing, and how far its likeness is off."""
    limit = (1 << 64) // fingerprints.SCALE - 1
    assert fingerprints.SCALE > 1
    texts = [r.text for r in rows]
    for text, s in zip(texts, fingerprints.sketches_of(texts)):
        every = np.unique(next(iter(words.shingle_sets([text]))))
        assert s.kept.tolist() == [h for h in every.tolist() if h <= limit]
        assert len(every) == len(shingles(text))
    rnd = random.Random(8)
    for n, most_empty, most_off in ((6, 0.3, 1.0), (20, 0.001, 0.25), (100, 0.0, 0.08)):
        empty, off = 0, []
        for _ in range(300):
            w = rnd.choices([f"w{k}" for k in range(5000)], k=n)
            other = [*w[:-(n // 4) or None], *[f"o{k}" for k in range(n // 4)]]
            a, b = fingerprints.sketches_of([" ".join(w), " ".join(other)])
            empty += not len(a.kept)
            one, two = shingles(" ".join(w)), shingles(" ".join(other))
            off.append(abs(a.likeness(b) - len(one & two) / min(len(one), len(two))))
        assert empty <= most_empty * 300 and sum(off) / len(off) <= most_off


# ---- 8 licences -------------------------------------------------------------------

def test_cosines_are_those_of_the_definition():
    freq = np.zeros(licenses.TERMS, dtype=np.int64)
    rnd = random.Random(4)
    freq[:] = [rnd.randrange(50) for _ in range(licenses.TERMS)]
    matcher = licenses.Matcher(freq, 1000, least=0.3)
    lines = [t for _, t in licenses.TEMPLATES] + ["Licensed under the license license", "nothing here", "", "MIT",
                                                  "some words. Released under the MIT License. and more"]

    def vector(line):
        out = collections.Counter()
        for _, _, h, _ in words.word_hashes([line]):
            for t in licenses._terms(h).tolist():
                out[t] += math.log(1001 / (1 + freq[t])) + 1
        return out

    def cosine(x, y):
        dot = sum(x[t] * y[t] for t in x)
        return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if dot else 0.0

    got = {k: (t, c) for k, t, c in matcher.scores(lines)}
    for k, line in enumerate(lines):
        own = [round(cosine(vector(line), vector(t)), 6) for _, t in licenses.TEMPLATES]
        best = max(range(len(own)), key=lambda t: (own[t], -t))
        assert (k in got) == (own[best] >= 0.3)
        if k in got:
            assert got[k][1] == pytest.approx(own[best], abs=2e-6)


def test_nearest_licensed_directory_is_inherited(spark):
    from pyspark.sql import functions as F
    files = spark.createDataFrame([
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/x.txt", "text"),
        (3, "a/b/c/y.txt", "text"), (4, "a/b/COPYING", "intro\nReleased under the MIT License.\n"), (5, "a/b/z.txt", None),
        (6, "q/z.txt", "text"), (7, "q/own.txt", "top\nLicensed under CC BY-NC 4.0.\nend"), (8, None, "text"),
        (9, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.")],
        "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.basis, r.inherited_from)
           for r in licenses.inherit(licenses.own_licenses(files, "doc_id", F.col("path"))).collect()}
    assert got[1][:2] == ("Apache-2.0", "license file") and got[2] == ("Apache-2.0", "inherited", "a")
    assert got[3][0] == got[5][0] and got[3][2] == "a/b" and got[5][2] == "a/b"
    assert got[6] == (None, None, None) and got[7] == ("CC-BY-NC-4.0", "header", None) and got[8] == (None, None, None)


def test_licence_texts_and_headers_are_recognised(spark):
    from pyspark.sql import functions as F
    full = {f: open(f"{licenses.TEXTS}/{f}", encoding="utf-8").read() for f in os.listdir(licenses.TEXTS)}

    def wrapped(text, mark, per=7):
        w = text.split()
        return "\n".join(f"{mark} " + " ".join(w[k:k + per]) for k in range(0, len(w), per))

    rnd = random.Random(6)
    prose = [" ".join(rnd.choices([f"w{k}" for k in range(400)] + ["the", "of", "and", "to", "license", "under"], k=150))
             for _ in range(40)]
    want, texts = [], []
    for file, text in sorted(full.items()):
        name = file.removesuffix(".txt").removesuffix(".header")
        texts.append("Copyright (c) 2019 A. Nobody\n\n" + text)
        want.append((name, "LICENSE"))
        if file.endswith(".header.txt") or len(text.split()) < 250:
            texts.append(wrapped(text, "#") + "\n" + prose[0])
            want.append((name, "x.py"))
        else:
            texts.append(" ".join(text.split()[:120]))
            want.append((name, "LICENSE"))
    for text, name in (("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-only\n" + prose[1], "GPL-2.0"),
                       (prose[2][:200] + " Released under the MIT License. " + prose[2][200:], "MIT"),
                       ("# Licensed under the Apache License,\n# Version 2.0.\n" + prose[3], "Apache-2.0")):
        texts.append(text)
        want.append((name, "x.py"))
    texts += prose
    want += [(None, "x.py")] * len(prose)
    files = spark.createDataFrame([(k, f"d{k}/{file}", text) for k, ((_, file), text) in enumerate(zip(want, texts))],
                                  "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.own_licenses(files, "doc_id", F.col("path")).collect()}
    assert [(k, got[k], texts[k][:40]) for k in range(len(texts)) if got[k] != want[k][0]] == []


def test_a_licence_text_is_a_licence_file_of_the_tree(spark):
    texts = [open(f"{licenses.TEXTS}/{n}.txt", encoding="utf-8").read()
             for n in ("MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "Unlicense")]
    texts += ["MIT License\n\nCopyright (c) 2020 X\n\n" + texts[0], "Copyright 2020 X\n" + texts[2]]
    plain = ["the mit license is short", "words about the apache license", "", "MIT License"]
    rows = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts + plain)], "doc_id long, text string, source string")
    got = [r.path.split("/")[-1].startswith("LICENSE") for r in rows.select("doc_id", licenses.tree_path().alias("path"))
           .orderBy("doc_id").collect()]
    assert got == [True] * len(texts) + [False] * len(plain)


# ---- 9 token counts ---------------------------------------------------------------

def test_trie_counts_against_each_run_and_the_public_unigram_model(rows):
    from tokenizers.models import Unigram
    scores = token_counts.pieces(token_counts.vocabulary())
    counter = token_counts.Counter(scores)
    odd = ["中文字 x☃y é ÿ 🎈🎈a ▁▁a", None, "", "  \n", "z" * 300]
    texts = [r.text for r in rows[:50]] + odd
    got = counter.totals(texts)
    model = Unigram([("<unk>", min(scores.values())), *scores.items(), *((f"<0x{b:02X}>", -1e9) for b in range(256))], 0, True)
    for text, (pre, n, score) in zip(texts, got):
        runs = (text or "").split()
        each = [counter.one(r) for r in runs]
        assert (pre, n) == (len(runs), sum(e[0] for e in each)) and score == pytest.approx(sum(e[1] for e in each))
        assert n == sum(len(model.tokenize("▁" + r)) for r in runs)


def test_long_runs_share_the_trie(monkeypatch):
    """Runs without white space, longer than any piece: levels of the trie far down, and chains at its end."""
    scores = token_counts.pieces(token_counts.vocabulary())
    rnd = random.Random(12)
    head = "".join(rnd.choices("的一是不了人我在有他这为之大来以个中上们", k=150))
    texts = [head + "".join(rnd.choices("的一是abc不了人我在有", k=rnd.randrange(400))) for _ in range(80)] + ["thequickbrownfox" * 30]
    want = [token_counts.Counter(scores).one(t) for t in texts]
    for few in (1, 24, 10 ** 6):
        monkeypatch.setattr(token_counts, "FEW", few)
        got = token_counts.Counter(scores).totals(texts)
        assert [g[1] for g in got] == [w[0] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[1] for w in want])


def test_the_store_may_be_begun_anew(rows, monkeypatch):
    scores = token_counts.pieces(token_counts.vocabulary())
    texts = [r.text for r in rows[:30]]
    want = token_counts.Counter(scores).totals(texts)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    small = token_counts.Counter(scores)
    assert [small.totals([t])[0][:2] for t in texts] == [w[:2] for w in want]


# ---- 10 packing -------------------------------------------------------------------

def test_ids_are_the_tokenizers_own(rows):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.vocabulary())
    own = Encoder(packing.vocabulary())
    odd = ["İstanbul ΣΑΣ. é é İx", "a\x1cb c\x00d <|endoftext|> x<|startoftext|>y", "don't DON'T we'LL 12ab3½² ²",
           "中文 字 ТЕКСТ ﬁ ŉ ǅ ß ẞ K Å", " a b​ć ́d", "", "  ", "x" * 200 + " " + "É" * 70, "it's 'S o'dd"]
    for text in [r.text for r in rows] + odd:
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_make_up_the_documents(spark, docs, rows):
    got = packing.pack_documents(docs, packing.vocabulary()).collect()
    own, capacity = Encoder(packing.vocabulary()), packing.CAPACITY
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        by_doc[g.doc_id].append(g)
        by_sequence[g.sequence_id].append((g.offset, g.length))
    for r in rows:
        ids, at = np.append(own.ids(r.text), packing.END_ID).astype("<u4"), 0
        for g in sorted(by_doc[r.doc_id], key=lambda g: g.start):
            assert (g.start, g.doc_tokens) == (at, len(ids))
            assert g.ids_crc32 == zlib.crc32(ids[at:at + g.length].tobytes())
            at += g.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(g.length for g in got) >= 0.95 * capacity * len(by_sequence)


def test_windows_are_filled_as_full_as_the_lengths_allow():
    rnd = random.Random(9)
    for _ in range(200):
        lengths = sorted(rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 12)))
        windows = packing.fill_windows(lengths, 30)
        assert sorted(k for w in windows for k in w) == list(range(len(lengths)))
        left = list(range(len(lengths)))
        for w in windows:
            longest = max(left, key=lambda k: lengths[k])
            sums = {lengths[longest]}
            for k in left:
                if k != longest:
                    sums |= {s + lengths[k] for s in sums if s + lengths[k] <= 30}
            assert sum(lengths[k] for k in w) == max(sums)
            left = [k for k in left if k not in w]
