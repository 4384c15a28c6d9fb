"""Operators on pages against brute-force restatements and round trips."""
import base64
import collections
import hashlib
import math
import zlib

import pytest

from kestrel.llm import url_filter, warc

SF = "/root/testdata/sf0.001"


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (3, None, "same"), (4, "u\r\nx: y", None),
        (5, "u", ""), (None, "n", "same"), (6, "b", "é" * 200_000 + "x"), (7, "c", "é" * 200_000 + "x"),
        (8, "d", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, None, "only")]


def test_archives_read_back(spark, scratch):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, scratch, archive_bytes=300)
    assert manifest.count() > 2
    got = warc.read_records(manifest, scratch).collect()
    largest = {}
    for page, _, html in ROWS:
        if page is not None:
            largest[html or ""] = max(largest.get(html or "", page), page)
    want = [(None if p is None else str(p), len((h or "").encode()), digest(h),
             "response" if largest.get(h or "", p) == p else "revisit",
             None if largest.get(h or "", p) == p else str(largest[h or ""])) for p, _, h in ROWS]
    have = [(r.page_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    chunks = warc.read_chunks(manifest, scratch, 3).where("page_key = '7'").orderBy("chunk_no").collect()
    assert b"".join(c.data for c in chunks).decode() == ROWS[8][2] and len(chunks) == 7
    assert all(len(c.data) <= warc.CHUNK for c in chunks) and [c.last for c in chunks] == [False] * 6 + [True]
    so_far = hashlib.sha1()
    for c in chunks:
        so_far.update(c.data)
        assert c.sha1_so_far == base64.b32encode(so_far.digest()).decode()


def test_small_payloads_are_never_revisits(spark, scratch):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = warc.read_records(warc.write_archives(pages, scratch, least_bytes=5), scratch).collect()
    assert {r.payload_bytes for r in got if r.record_type == "revisit"} == {400_001}


def test_damaged_archives_are_noticed(spark, scratch):
    import gzip
    import os
    pages = spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, scratch)
    path = os.path.join(scratch, manifest.head().archive)
    raw = gzip.open(path).read()
    with gzip.open(path, "wb") as f:
        f.write(raw.replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_chunks(manifest, scratch, 1).collect()


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in warc.op2_warc(spark, SF).collect()}
    groups = collections.defaultdict(list)
    for p in pages:
        groups[p.html].append(p.page_id)
    assert len(got) == len(pages)
    for p in pages:
        top = max(groups[p.html])
        g = got[p.page_id]
        assert (g.payload_bytes, g.payload_digest) == (len(p.html.encode()), digest(p.html))
        assert (g.record_type, g.refers_to) == (("response", None) if top == p.page_id else ("revisit", top))
        assert g.target_uri == p.url


# ---- 6 url filter -----------------------------------------------------------------

def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    return best


def models(urls):
    """Witten-Bell models of the two classes, by definition."""
    k = url_filter.ORDER
    counts = {True: [collections.defaultdict(collections.Counter) for _ in range(k + 1)],
              False: [collections.defaultdict(collections.Counter) for _ in range(k + 1)]}
    alphabet = set()
    for text, label in urls:
        s = url_filter.START * k + text + url_filter.END
        alphabet |= set(text + url_filter.END)
        if label is None or zlib.crc32(text.encode()) % url_filter.FOLDS == 0:
            continue
        for i in range(k, len(s)):
            for n in range(k + 1):
                counts[label][n][s[i - n:i]][s[i]] += 1

    def p(label, s, i, n):
        seen = counts[label][n][s[i - n:i]]
        if n == 0:
            return (seen[s[i]] + 1) / (sum(seen.values()) + len(alphabet) + 1)
        if not seen:
            return p(label, s, i, n - 1)
        return (seen[s[i]] + len(seen) * p(label, s, i, n - 1)) / (sum(seen.values()) + len(seen))

    def score(text):
        s = url_filter.START * k + text + url_filter.END
        return sum(math.log(p(True, s, i, k) / p(False, s, i, k)) for i in range(k, len(s))) / (len(text) + 1)
    return score


def test_rules_scores_and_verdicts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in url_filter.op6_url_filter(spark, SF).collect()}
    parts = {p.page_id: split_url(p.url) for p in pages}
    fits = {k: rule_of(*v) for k, v in parts.items()}
    score = models([("".join(parts[k]), None if fits[k] is None else fits[k][0] == "allow") for k in parts])
    for k, (host, path) in parts.items():
        g = got[k]
        assert (g.host, g.path, g.rule) == (host, path, None if fits[k] is None else fits[k][1])
        assert g.score == pytest.approx(score(host + path), abs=2e-6)
        assert g.verdict == (fits[k][0] if fits[k] else "allow" if g.score >= g.threshold else "block")


def test_url_parts(spark):
    urls = ["HTTPS://Www.Example.ORG/Es/1?x#y", "x://host?q/a://b", "x://host#f", "nothing", None, "a://", "://h/p",
            "http://É.Org/fr/", "http://example.org", "http://notexample.org/es/", "http://m.example.org/en/17/x", "http://b.com/de/"]
    pages = spark.createDataFrame([(k, u, "extra") for k, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge(pages).collect():
        host, path = split_url(urls[r.page_id])
        want = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want[1] if want else None)
        assert r.verdict in ("allow", "block") and (want is None or r.verdict == want[0])


def test_threshold_has_the_best_balance(spark):
    rows = [(True, 0.5, 3), (True, -0.2, 1), (False, -0.5, 4), (False, 0.1, 1), (False, 0.2, 1)]
    threshold = url_filter.calibrate(spark.createDataFrame(rows, "label boolean, score double, n long"))

    def balance(t):
        good, bad = [(s, n) for y, s, n in rows if y], [(s, n) for y, s, n in rows if not y]
        return sum(n for s, n in good if s >= t) / sum(n for _, n in good) + \
            sum(n for s, n in bad if s < t) / sum(n for _, n in bad)
    assert balance(threshold) == pytest.approx(max(balance(k / 100) for k in range(-100, 100)))
    assert url_filter.calibrate(spark.createDataFrame(rows[:2], "label boolean, score double, n long")) == 0.0
