"""The corpus operators against SQL, brute force, round trips and held-out
labels, and on nulls, empty tables, repeated rows and clashing columns."""

import base64
import bisect
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arrears.llm import chat, components, decontam, jaccard, langid, licenses, mixing, quality, queries, simhash, urls, warc
from arrears.llm.store import Scratch
from tests.oracle_compare import compare, duck

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, score double, row bigint, key bigint"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 400


def odd_docs(spark):
    """Nulls, empty, tiny, long, repeated and tied rows; extra columns with names the operators use."""
    rows = [(1, None, "en", "a", 0.1, 1, 1), (2, "", None, None, 0.1, 1, 1), (3, "x", "en", "a", 0.1, 1, 1), (4, LONG, "en", "a", 0.1, 1, 1),
            (5, LONG, "fr", "b", 0.1, 1, 1), (5, LONG, "fr", "b", 0.1, 1, 1), (6, "  \n\t ", "en", "a", 0.1, 1, 1), (None, "one two three", "en", "a", 0.1, 1, 1),
            (7, "Under the MIT License, and CC BY-NC.", "en", "a", 0.1, 1, 1), (5, "another text under one id", "en", "a", 0.1, 1, 1)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    ok, msg = compare(spark, duck(SMALL), name, SMALL)
    assert ok, msg


# --- 1 -------------------------------------------------------------------

def test_archives_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, None), (3, "http://c", "<p>é</p>"), (3, "http://c", "<p>é</p>"), (None, "x", ""), (9, "y", "HTTP/ like\r\n\r\nbody" * 99)]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.payload_digest, r.payload_bytes), []).append(r)
    for _, url, html in rows:
        body = (html or "").encode()
        assert (base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)) in by
    for rs in by.values():
        assert [r.record_type for r in rs].count("response") == 1
        head = next(r for r in rs if r.record_type == "response")
        assert head.refers_to is None and head.page_id == max((r.page_id for r in rs), key=lambda x: -1 if x is None else x)
        assert all(r.refers_to == head.page_id and r.refers_to_id == head.record_id for r in rs if r.record_type == "revisit")
    assert warc.archive_pages(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_archive_versions(tmp_path):
    for version in (1, 2):
        block = f"{version} 0 org\n{warc.FIELDS[version]}\n".encode()
        body = b"HTTP/1.0 200 OK\r\nX-Record-Key: 4\r\n\r\n" + bytes(range(256))
        raw = warc.arc_line(version, "filedesc://f", "20010203040506", "text/plain", "f", 0, len(block)) + block + b"\n"
        raw += warc.arc_line(version, "http://u/?a=b", "20010203040506", "text/html", "f", 9, len(body)) + body + b"\n"
        for name, data in ((f"{version}.arc", raw), (f"{version}.arc.gz", gzip.compress(raw))):
            (tmp_path / name).write_bytes(data)
            uri, n = warc.convert_file(str(tmp_path / name), {}, str(tmp_path / "out"))
            (_, (fields, back)) = list(warc.parse_warc(warc.stream(uri), uri))
            assert n == 1 and back == body and fields["warc-date"] == "2001-02-03T04:05:06Z" and fields["warc-target-uri"] == "http://u/?a=b"
    (tmp_path / "bad.arc").write_bytes(raw[:-40])
    with pytest.raises(ValueError, match="declared"):
        warc.convert_file(str(tmp_path / "bad.arc"), {}, str(tmp_path / "out"))


# --- 2 -------------------------------------------------------------------

def test_url_rules_and_models(spark):
    pages = [r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()] + [None, "", "no scheme", "HTTP://X.Example.NET/en/1", "s://net", "ftp://a.org/fr/?x",
        "http://пример.рф/аб", "http://сайтик.бг/вг", "http://пример.рф/бб", "http://сайтик.бг/вг/", "http://a.com/p?1", "http://a.com/p&9",
        "http://b.com/" + "long/" * 20000, *[f"http://пример.net/аб/{i}" for i in range(6)], *[f"http://сайтик.org/fr/вг/{i}" for i in range(6)]]
    got = urls.filter_urls(spark, spark.createDataFrame(list(enumerate(pages)), "page_id bigint, url string")).orderBy("page_id").collect()
    train = []
    for url, r in zip(pages, got):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0])
        if best[0]:
            assert r.verdict == best[1]
            train.append((url, best[1] == "allow"))
        else:
            assert r.verdict == ("allow" if r.score >= r.threshold else "block")

    def codes(u):
        return list(u or "")
    start = [urls.START] * 3
    size = len({c for u in pages for c in codes(u)})
    counts = {True: {}, False: {}}
    for u, good in train:
        if zlib.crc32(u.encode()) % 5:
            c = [*start, *codes(u)]
            for i in range(3, len(c)):
                for k in range(4):
                    ctx = counts[good].setdefault(tuple(c[i - k:i]) + (k,), {})
                    ctx[c[i]] = ctx.get(c[i], 0) + 1

    def p(good, c, i):
        q = 1 / size
        for k in range(4):
            ctx = counts[good].get(tuple(c[i - k:i]) + (k,))
            if ctx:
                q = (ctx.get(c[i], 0) + len(ctx) * q) / (sum(ctx.values()) + len(ctx))
        return q
    for u, r in zip(pages, got):
        c = [*start, *codes(u)]
        want = np.mean([np.log(p(True, c, i)) - np.log(p(False, c, i)) for i in range(3, len(c))]) if len(c) > 3 else 0
        assert abs(r.score - want) < 1e-8
    # characters of any script are told apart, as the ruled URLs show them
    score = {u: r.score for u, r in zip(pages, got)}
    assert score["http://пример.рф/аб"] < score["http://сайтик.бг/вг"]
    assert score["http://a.com/p?1"] != score["http://a.com/p&9"]
    below = [(r.score, good) for (u, r) in zip(pages, got) if r.rule and zlib.crc32(u.encode()) % 5 == 0 for good in [r.verdict == "allow"]]
    steps = sorted({np.floor(x * urls.BINS) for x, _ in below}, key=lambda x: (abs(x), x))
    na, nr = sum(g for _, g in below), sum(not g for _, g in below)
    if na and nr:
        quality = [sum(g for x, g in below if np.floor(x * urls.BINS) >= step) / na + sum(not g for x, g in below if np.floor(x * urls.BINS) < step) / nr for step in steps]
        best = max(quality)
        assert got[0].threshold == next(step for step, q in zip(steps, quality) if q > best - 1e-12) / urls.BINS
    # the part of the model that is not broadcast gives the same rows
    forced = urls.filter_urls(spark, spark.createDataFrame(list(enumerate(pages)), "page_id bigint, url string"), broadcast_grams=40)
    assert forced.orderBy("page_id").collect() == got
    assert urls.filter_urls(spark, spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_odd_rows(spark):
    """Repeated, null and empty rows, clashing names; no ruled URL at all."""
    rows = [(1, "http://a.com/x", 1), (1, "http://a.com/x", 2), (1, None, 3), (None, None, 4), (None, "", 5), (2, "http://b.net/", 6), (2, "http://b.net/", 7)]
    schema = "page_id bigint, url string, {} int"
    for extra in ("gram", "copies", "score", "chars", "ratio", "a", "n", "ruled"):
        got = urls.filter_urls(spark, spark.createDataFrame(rows, schema.format(extra))).collect()
        assert sorted((r.page_id or 0, r.host) for r in got) == sorted([(1, "a.com"), (1, "a.com"), (1, ""), (0, ""), (0, ""), (2, "b.net"), (2, "b.net")])
        # one class only: nothing to tell apart, so the method allows
        assert {(r.rule, r.verdict, r.score, r.threshold) for r in got} == {(None, "allow", 0.0, 0.0), ("net/", "block", 0.0, 0.0)}


# --- 3 -------------------------------------------------------------------

def brute_components(sets, num, den):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_brute_force(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(200), 40) for _ in range(4)]
    sets = []
    for _ in range(60):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(6)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(200, 400))
        sets.append(frozenset(s) if rng.random() < 0.9 else frozenset(rng.sample(range(500), 3)))
    links = jaccard.trie_links([len(s) for s in sets], [np.array(sorted(s), np.uint64) for s in sets], 85, 100)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(sets))] == brute_components(sets, 85, 100)


@pytest.mark.parametrize("num", [80, 85])
@pytest.mark.parametrize("n", [1, 5, 7, 24, 60, 331])
def test_linked_sets_agree_in_parts(n, num):
    """Sets that link just so have as many equal parts as _parts says, under the smaller one's size range."""
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = n + int(rng.integers(0, 3))
        b = int(rng.integers(a, a * 100 // num + 1))
        both = -(-num * (a + b) // (num + 100))       # the least overlap that links
        if both > a:
            continue
        x = rng.integers(0, 1 << 63, a + b - both, dtype=np.uint64) * np.uint64(2)
        small, large = np.sort(x[:a]), np.sort(x[a - both:])
        first = jaccard._ranges(b, num, 100)
        i = bisect.bisect_right(first, a) - 1
        assert bisect.bisect_right(first, b) - 1 - i in (0, 1)
        (p, least), (q, _) = (jaccard._parts(s, first[i], first[i + 1], num, 100) for s in (small, large))
        assert len(p) == len(q) and (p == q).sum() >= least > 0


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_common_phrases_make_no_groups(spark, monkeypatch, k, num):
    """Texts that have a phrase in common and nothing else are not gathered in one group."""
    rng, seen = random.Random(3), []
    write = Scratch.write

    def noted(self, df, name, *more, **options):
        out = write(self, df, name, *more, **options)
        if name == "candidates":
            seen.extend(r["count"] for r in out.groupBy("grp").count().collect())
        return out
    monkeypatch.setattr(Scratch, "write", noted)
    phrase = " ".join(f"p{i}" for i in range(17))
    docs = [(i, " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(53)) + " " + phrase) for i in range(300)]
    docs += [(1000 + i, t + " more") for i, t in docs[:20]]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert all(r.component_id == r.doc_id % 1000 for r in jaccard.jaccard_components(spark, docs, k, num, 100).collect())
    assert sorted(r.doc_id for r in jaccard.one_per_group(spark, docs, k, num, 100).collect()) == list(range(300))
    assert max(seen) <= 30


@pytest.mark.parametrize("cells", [1, 3000, 8_000_000])
def test_trie_links_of_two_sides(monkeypatch, cells):
    """However many sets walk at once, and with sides only pairs of both."""
    monkeypatch.setattr(jaccard, "WALK_CELLS", cells)
    rng = random.Random(cells)
    base = [rng.sample(range(200), 40) for _ in range(4)]
    sets = []
    for i in range(60):
        s = set(base[i % 4])
        for _ in range(rng.randrange(5)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(200, 400))
        sets.append(s)
    sides = [rng.randrange(2) for _ in sets]
    args = [len(s) for s in sets], [np.array(sorted(s), np.uint64) for s in sets], 85, 100
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(a & b) >= 85 * len(a | b)}
    across = {(i, j) for i, j in linked if sides[i] != sides[j]}
    for want, of in ((linked, None), (across, sides)):
        assert sorted(tuple(sorted((i, x))) for i, others in jaccard.trie_pairs(*args, of) for x in others) == sorted(want)
        roots = []
        for edges in (want, jaccard.trie_links(*args, None, of)):
            forest = jaccard._Forest([None] * len(sets))
            for a, b in edges:
                forest.join(a, b)
            roots.append([min(x for x in range(len(sets)) if forest.find(x) == forest.find(i)) for i in range(len(sets))])
        assert roots[0] == roots[1]


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_jaccard_blocks(spark, block):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(3)]
    docs = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"v{rng.randrange(300)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), 4, 85, 100, block).collect()}
    sets = [frozenset(tuple(t.split()[i:i + 4]) for i in range(57)) for _, t in docs]
    assert [got[i] for i in range(150)] == brute_components(sets, 85, 100)


@pytest.mark.parametrize("block", [300, 3000, 1_000_000])
def test_jaccard_every_link(spark, block):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (60, 60, 64)]
    texts = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"v{rng.randrange(300)}"
        texts.append(" ".join(w))
    texts += texts[:9] + ["", "one two", "one two"]
    sets = [frozenset(tuple(t.split()[i:i + 4]) for i in range(max(1, len(t.split()) - 3))) if t else frozenset() for t in texts]
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 85 * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_join(spark, docs, 4, 85, 100, block).collect()}
    roots = brute_components(sets, 85, 100)
    assert got == {i: (roots[i], sum(a == i for a, _ in linked)) for i in range(len(texts))}
    rows, links = jaccard.jaccard_pairs(spark, docs, 4, 85, 100, block)
    cid = {r.doc_id: r.cid for r in rows.collect()}
    found = [tuple(sorted((r.a, r.b))) for r in links.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {tuple(sorted((cid[i], cid[j]))) for i, j in linked if sets[i] != sets[j]}


def test_jaccard_links_odd_rows(spark):
    got = sorted((r.doc_id or 0, r.n_shingles, r.n_links) for r in jaccard.jaccard_join(spark, odd_docs(spark)).collect())
    assert got == [(0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 12, 2), (5, 1, 0), (5, 12, 2), (5, 12, 2), (6, 0, 0), (7, 3, 0)]
    assert jaccard.jaccard_join(spark, empty_docs(spark)).count() == 0


def test_jaccard_odd_rows(spark):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_components(spark, odd_docs(spark)).collect())
    assert got == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 12, 4), (5, 1, 5), (5, 12, 4), (5, 12, 4), (6, 0, 6), (7, 3, 7)]
    kept = jaccard.one_per_group(spark, odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(0, 13), (1, 0), (2, 0), (3, 1), (4, len(LONG)), (5, 25), (6, 5), (7, 36)]
    assert jaccard.jaccard_components(spark, empty_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components.components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(root)}


# --- 4 -------------------------------------------------------------------

def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "a < b & c", 0.0), (1, 2, 1, "assistant", "</turn>\n&lt;", 1.0), (1, 3, 1, "assistant", None, 5.0), (1, 4, 2, "user", "x", 9.0),
            (2, 1, 7, 'odd "> role', "orphan", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, None, "n", 0.0)]
    # a leaf that hangs off a cycle, beside roots enough for its walk to be short of the limit
    rows += [(5, 1, 2, "user", "c", 1.0), (5, 2, 1, "user", "c", 1.0), (5, 3, 1, "user", "leaf", 1.0)] + [(5, i, None, "user", "root", 0.0) for i in range(4, 9)]
    rows += [(4, i, i - 1 if i > 1 else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(1, 38)]
    frame = spark.createDataFrame(rows, "conv_id bigint, msg bigint, parent bigint, role string, text string, score double")
    got = {(r.conv_id, r.leaf): r for r in chat.format_trees(spark, frame, best=None).collect()}
    assert set(got) == {(1, 3), (1, 4), (2, 1), (None, 1), (4, 37)} | {(5, i) for i in range(4, 9)}
    assert got[1, 4].place == 1 and got[1, 4].path_score == 10.0 and got[1, 3].place == 2 and got[4, 37].n_turns == 37
    for (c, leaf), r in got.items():
        texts = [r.formatted[s.start:s.start + s.size] for s in r.loss_spans]
        assert all("<" not in t for t in texts)
    best = chat.format_trees(spark, frame)
    back = {r.conv_id: r for r in chat.read_back(best).collect()}
    want = "".join(f"{a}\n{b}\n" for a, b in (("user", "a < b & c"), ("assistant", "</turn>\n&lt;"), ("user", "x")))
    assert back[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert back[1].loss_sha256 == hashlib.sha256(b"</turn>\n&lt;").hexdigest() and back[1].loss_chars == 12
    assert chat.format_trees(spark, frame.limit(0)).count() == 0


# --- 5 -------------------------------------------------------------------

def test_mixing_budgets(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "d" if i % 3 else None, "en" if i % 2 else "de", f"s{i % 5}") for i in range(600)],
                                 "doc_id bigint, text string, domain string, lang string, source string")
    for share in ((1, 3), (1, 1), (9, 1)):
        rows = mixing.mix(spark, docs, {"lang": {"en": 3}}, share, max_epochs=2).collect()
        budget = 6000 * share[0] // share[1]
        total = sum(r.take_tokens for r in rows)
        assert total <= min(budget, 12000) and total >= min(budget, 12000) - 20       # at most a token is lost to rounding at each leaf
        assert all(0 < r.take_tokens <= r.n_tokens and r.epoch < 2 for r in rows)
        assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    assert mixing.mix_documents(spark, empty_docs(spark)).count() == 0
    assert {r.doc_id for r in mixing.mix_documents(spark, odd_docs(spark)).collect()} <= {3, 4, 5, 7, None}


def test_mixing_zero_weight_child(spark):
    rows = [(f"{d}{i}", d, lang, "s") for d, lang, n in (("a", "en", 10), ("a", "de", 90), ("b", "en", 200)) for i in range(n)]
    docs = spark.createDataFrame([(i, "w", d, lang, src) for i, (_, d, lang, src) in enumerate(rows)],
                                 "doc_id bigint, text string, domain string, lang string, source string")
    got = mixing.mix(spark, docs, {"lang": {"de": 0}}, (1, 3), max_epochs=1).collect()
    assert sum(r.take_tokens for r in got) == 100                 # a can give 10 only, b the other 90
    assert {(r.domain, r.lang) for r in got} == {("a", "en"), ("b", "en")}
    assert sum(r.take_tokens for r in got if r.domain == "a") == 10


# --- 6 -------------------------------------------------------------------

def test_license_scan_odd_rows(spark):
    rows = [r for r in licenses.scan(spark, odd_docs(spark)).collect() if r.doc_id in (1, 2, 7)]
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows} == {
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (7, 8, 2, 0, 5, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)}
    assert licenses.scan(spark, empty_docs(spark)).count() == 0


def test_license_blocks(spark):
    """Notices over line ends and far into a text; other licenses and versions."""
    far = "filler words " * 5000
    texts = {
        1: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided", "bsd"),
        2: ("either version 3 of the License, or\n (at your option) any later version.", "gpl-3"),
        3: ("Released under the BSD License", "bsd"),
        4: ("This work is licensed under the GNU General Public License, version 2", "gpl-2"),
        5: (far + "Permission is hereby granted, free of\n# charge, to any person\n# obtaining a copy of this software" + far, "mit"),
        6: ("All of us have the right to reserve tables; rights of others are not. " + "x " * 20 + "reserved", ""),
        7: (far + "under the terms of the Mozilla Public\nLicense, v. 2.0", "mpl-2"),
        8: ("We met at MIT and hold no license for the released film of another studio", ""),
        9: ("mit " * 5000, ""),
    }
    for shift in (0, 3, 7, 15):
        docs = spark.createDataFrame([(i, "pad " * shift + text) for i, (text, _) in texts.items()], "doc_id bigint, text string")
        assert {r.doc_id: r.labels for r in licenses.scan(spark, docs).collect()} == {i: label for i, (_, label) in texts.items()}


# --- 7 and 10 ------------------------------------------------------------

def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(spark, docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    odd = quality.quality(spark, odd_docs(spark), labels.limit(0)).collect()
    assert len(odd) == 10 and all(r.score == 0.5 for r in odd)
    model = quality.train(spark, docs, labels)
    assert all(0 <= r.quality_score <= 1 for r in quality.score(spark, odd_docs(spark), model).collect())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(spark, docs)
    got = langid.predict(spark, docs, net).withColumn("held", langid.held_out()).where("held").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    odd = langid.predict(spark, odd_docs(spark).drop("score"), net).collect()
    assert [r.lang_pred == "und" and r.score == 0 for r in odd] == [r.text is None or not re.search("[a-z]", r.text) for r in odd]
    assert langid.language_id(spark, empty_docs(spark)).count() == 0
    assert {r.lang_pred for r in langid.language_id(spark, odd_docs(spark).where("false or doc_id = 6")).collect()} == {"und"}


# --- 8 -------------------------------------------------------------------

def test_proximity_and_chunks(spark):
    docs = spark.createDataFrame([(1, "zero one two and three four five"), (2, "one two three four five"), (3, None), (2, "five")], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, "One two three, four"), (11, "five"), (None, "zero"), (12, None)], "item_id bigint, text string")
    s = Scratch(spark, "test-decontam")
    index = decontam.build_index(s, docs)
    exact, near = (sorted((r.item_id or 0, r.start) for r in decontam.match(s, index, items, 4, slop).collect()) for slop in (0, 1))
    assert exact == [(0, 0), (10, 0), (11, 0), (11, 4), (11, 6)]
    assert set(exact) < set(near) and (10, 1) in near
    for chunk in (1, 10**6):
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.decontaminate(spark, docs, items, 4, chunk).collect())
        assert got == [(1, 7, 2, ("11",)), (2, 1, 1, ("11",)), (2, 5, 5, ("10", "11")), (3, 0, 0, ())]
    assert decontam.clean(spark, docs, items, 4).count() == 1
    named = sorted((r.doc_id, r.n_words, tuple(r["items"]), tuple(r.near_items)) for r in decontam.proximity(spark, docs, items, 1, 4).collect())
    assert named == [(1, 7, ("11",), ("10",)), (2, 1, ("11",), ()), (2, 5, ("10", "11"), ()), (3, 0, (), ())]
    assert decontam.decontaminate(spark, docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(spark, docs.limit(0), items).count() == 0


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_brute_force(spark, slop):
    """Also where a match's shifted start lies before its document's first word, or its end after the last."""
    rng = random.Random(slop)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(60)] + [["b", "c", "d"], ["a", "b", "c"]]
    items = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))] for _ in range(40)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    s = Scratch(spark, "test-near")
    index = decontam.build_index(s, frame)
    ids = {(r.block, r.ord): r.doc_id for r in decontam.documents_of(s, index).collect()}
    got = {(ids[r.block, r.ord], r.item_id, r.start, r.exact) for r in decontam.match(s, index, bench, 4, slop).collect()}
    count = {w: sum(d.count(w) for d in docs) for w in "abcdefgh"}
    want = set()
    for i, words in enumerate(items):
        size = min(4, len(words))
        for a in range(len(words) - size + 1):
            window = words[a:a + size]
            rare = min(range(size), key=lambda k: (count[window[k]], k))
            for d, doc in enumerate(docs):
                for p in [p for p, w in enumerate(doc) if w == window[rare]]:
                    start = p - rare
                    def has(k, off):
                        return any(0 <= q < len(doc) and doc[q] == window[k] for q in range(start + k - off, start + k + off + 1))
                    if all(has(k, 0 if k == rare else slop) for k in range(size)):
                        exact = start >= 0 and doc[start:start + size] == window
                        if exact or slop:
                            want.add((d, i, max(start, 0), exact))
    assert got == want and any(e for *_, e in got)
    assert not slop or any(not e for *_, e in got)


# --- 9 -------------------------------------------------------------------

def brute_fingerprint(text):
    votes, total = [0] * 64, 0
    for w in re.split(r"[\x20\x09-\x0D]+", text or ""):
        h, k = xxhash.xxh64(w.encode(), seed=42).intdigest(), min(len(w), 8)
        total += k
        for i in range(64):
            votes[i] += k * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


@pytest.mark.parametrize("chars", [40_000, 10**9])
def test_simhash_brute_force(spark, chars):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(-1, None), (-2, "é" * 7), (-3, LONG * 5)], "doc_id bigint, text string"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in simhash.fingerprints(spark, docs, chars).collect()}
    prints = {d: brute_fingerprint(t) for d, t in rows}
    for i, (d, t) in enumerate(rows):
        other = rows[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[:len(t) - half] + other[1][:half]
        e, r = brute_fingerprint(edited), got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[d]:016x}", f"{e:016x}")
        assert r.near_edited == 1 - (prints[d] ^ e).bit_count() / 64 and r.near_next == 1 - (prints[d] ^ prints[other[0]]).bit_count() / 64
        assert r.n_near == (sum((prints[d] ^ p).bit_count() <= 3 for p in prints.values()) - 1 if d % 100 == 0 else None)
    assert simhash.fingerprints(spark, empty_docs(spark)).count() == 0
    assert simhash.fingerprints(spark, odd_docs(spark)).count() == 10


def test_near_documents_are_named(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(100, "one text"), (100, "one text"), (5, "one text"), (None, "one text"), (300, None)], "doc_id bigint, text string"))
    rows = [(r.doc_id, brute_fingerprint(r.text or "")) for r in docs.collect()]
    want = {}
    for i, (d, p) in enumerate(rows):
        if d is None or d % 100 or (d, p) in {x for x in rows[:i]}:
            continue
        for j, (e, q) in enumerate(rows):
            k = (p ^ q).bit_count()
            if i != j and k <= simhash.NEAR_RADIUS:
                want[d, e, k] = want.get((d, e, k), 0) + 1
    got = {(r.doc_id, r.near_id, r.distance): r.n_rows for r in simhash.near_documents(spark, docs).collect()}
    assert got == want and (100, 5, 0) in got and got[100, 100, 0] == 1
    assert simhash.near_documents(spark, empty_docs(spark)).count() == 0


def test_block_tables_find_every_neighbour(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (1, 2, 3, 4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r.q: r.n_rows for r in simhash.neighbours(frame, frame).collect()}
    assert got == {x: sum((p ^ q).bit_count() <= 3 for q in prints) for x, p in zip(signed, prints)}
    wide = [p ^ sum(1 << i for i in rng.sample(range(64), k)) for p in base for k in (4, 5, 6)] + base
    signed = [p - (1 << 64) if p >> 63 else p for p in wide]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    pairs = simhash.near_pairs(frame, frame, simhash.NEAR_RADIUS, simhash.NEAR_BLOCKS).collect()
    assert len(pairs) == len({(r.q, r.fp) for r in pairs})
    assert {(r.q, r.fp) for r in pairs} == {(x, y) for x, p in zip(signed, wide) for y, q in zip(signed, wide) if (p ^ q).bit_count() <= 5}


def test_near_documents_recall(spark):
    """Of pairs with one word in 60 replaced at least 0.9 are found."""
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect()]
    texts, rng, rows, pairs = [w for w in texts if 60 <= len(w) <= 400], random.Random(5), [], 0
    for w in texts:
        edited = [rng.choice(rng.choice(texts)) if rng.random() < 1 / 60 else x for x in w]
        a, b = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (w, edited))
        if edited != w and len(a & b) >= 0.8 * len(a | b):
            rows += [(100 * pairs, " ".join(w)), (100 * pairs + 1, " ".join(edited))]
            pairs += 1
    got = {(r.doc_id, r.near_id) for r in simhash.near_documents(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert pairs > 100 and sum((100 * i, 100 * i + 1) in got for i in range(pairs)) >= 0.9 * pairs


# --- pipeline ------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = spark.createDataFrame([(9001, "12 34 -- 56", "en", "src1", 11), (9002, None, None, None, 0)], docs.schema)
    before = cur = docs.union(junk).union(docs.limit(5))
    for name, stage in cp.STAGES[:-1]:
        before = cur = stage(spark, before, SMALL)
        assert cur.columns == docs.columns, name
    ids = [r.doc_id for r in cur.collect()]
    assert len(ids) == len(set(ids)) and not {9001, 9002} & set(ids) and len(ids) > 100
    assert cp.STAGES[-1][1](spark, cur, SMALL).count() > 0
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
    # names that stages use for themselves stay the documents' own
    own = ["_key", "_bad", "_judged", "quality_score", "score", "lang_pred", "_KEY_"]
    named = docs.limit(60).select("*", *[F.lit(f"own {c}").alias(c) for c in own])
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, named, SMALL)
        assert kept.columns == named.columns, name
        assert kept.select(*own).distinct().count() == 1 and kept.first()["_key"] == "own _key", name
