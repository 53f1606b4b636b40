"""Packing, collocations and clustering against brute force, and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arrears.llm import collocations as CO
from arrears.llm import packing as PK
from arrears.llm import simplex as SX

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, uid bigint, item bigint, length int, score double"


# --- 11 ------------------------------------------------------------------

ODD_TEXTS = ["", None, " ", "\n\n a  b\t\tc \n", "a\n \nb", "a<|endoftext|> b <|endoftext|>", "x y　 z\x1cq r", "don't  stop\r\n\r\n", "é  ü k", " lead", "trail ",
             "日本語 テキスト\nあ", "a\x85 b", "one two\nthree\x01 four", "\x01", "\x02a b", "It's (a) b.c\n...x don't_a e-mail, x", "a" * 3000 + " b", "ab, cd " * 200_000, "no_space" * 200_000]


def test_chunks_have_the_texts_ids():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    with open(BPE, encoding="utf-8") as f:
        enc = PK.ChunkEncoder(f.read())
    for _ in range(2):                       # unseen, then remembered
        ids, at = enc.column(pa.array(ODD_TEXTS, pa.string()))
        for i, t in enumerate(ODD_TEXTS):
            want = tok.encode(t or "", add_special_tokens=False).ids
            assert ids[at[i]:at[i + 1]].tolist() == want, (t or "")[:40]
            assert enc.ids(t or "").tolist() == want
    assert len(enc.column(pa.array([], pa.string()))[0]) == 0


def plain_packing(sizes, capacity):
    """The rule by trying every place and counting all squares."""
    gaps, where = [], []
    for s in sizes:
        def after(g, new):
            left = Counter(x for x in gaps if x)
            if not new:
                left[g] -= 1
            if g > s:
                left[g - s] += 1
            return sum(v * v for v in left.values())
        places = sorted({g for g in gaps if g >= s and g})
        options = [(after(g, False), k, g, False) for k, g in enumerate(places)] + [(after(capacity, True), len(places), capacity, True)]
        _, _, g, new = min(options)
        if new:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(g)] -= s
        where.append(g - s)
    return where, sorted(gaps)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    for capacity in (7, 30):
        sizes = rng.integers(1, capacity + 1, 200).tolist()
        where, place, fill = PK.sum_of_squares(sizes, capacity)
        gaps, end = plain_packing(sizes, capacity)
        assert [capacity - p - s for p, s in zip(place.tolist(), sizes)] == gaps
        assert sorted(capacity - f for f in fill) == end
        for b in range(len(fill)):
            at = sorted((p, s) for w, p, s in zip(where.tolist(), place.tolist(), sizes) if w == b)
            assert [p for p, _ in at] == np.cumsum([0] + [s for _, s in at])[:-1].tolist() and sum(s for _, s in at) == fill[b]


def check_packing(docs, rows, capacity):
    """Every piece once, cut as asked, whole and gapless in its sequence."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    want = Counter()
    for doc, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % capacity + 1
        ends = list(range(first, len(ids) + 1, capacity))
        for k, end in enumerate(ends):
            part = ids[0 if k == 0 else ends[k - 1]:end]
            want[doc, k, end - len(part), len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for at in by.values():
        end = 0
        for offset, n in sorted(at):
            assert offset == end
            end += n
        assert end <= capacity
    return len(by)


def test_packed_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "no id"), (7, None), (7, "")]
    df = spark.createDataFrame([(*d, "en", 1, 1, 1, 0.5) for d in docs], DOCS)
    total = None
    for capacity, shard in ((2048, 1 << 15), (64, 100), (2048, 40)):
        got = PK.pack_documents(spark, df, BPE, capacity=capacity, shard=shard)
        n = check_packing(docs, got.collect(), capacity)
        total = total or got.agg(F.sum("length")).first()[0]
        assert n <= total / capacity * 1.02 + 2
        seqs = PK.sequences(got)
        assert seqs.where(F.size("ids") != F.col("length")).count() == 0 and seqs.count() == n
    assert PK.pack_documents(spark, df.limit(0), BPE).count() == 0


# --- 12 ------------------------------------------------------------------

def plain_collocations(rows, max_words, min_count, top, inside):
    import re
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= inside * a for q, b in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, n[lang], score))
    return out


def some_texts(seed, docs=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Über", "x-y", "a\x00b", "日本"]
    out = []
    for i in range(docs):
        w = rng.choice(vocabulary, rng.integers(0, 60), p=(p := 1.0 / np.arange(1, len(vocabulary) + 1)) / p.sum())
        marks = rng.choice([" ", "  ", "\t", ", ", ".\n", " The Big Deal "], len(w), p=[0.7, 0.05, 0.05, 0.1, 0.05, 0.05])
        out.append(("".join(a + b for a, b in zip(w, marks)), [None, "und", "en", "fr"][i % 4]))
    return out + [(None, "en"), ("", None), ("...", "fr"), (out[3][0], "en"), (out[3][0], "en")]


@pytest.mark.parametrize("shards,bits,max_words,top", [(2, 24, 3, 2000), (3, 16, 4, 20), (1, 16, 2, 5), (4, 16, 3, None)])
def test_collocations_are_exact(spark, shards, bits, max_words, top):
    """Also where slots are shared by many phrases (few bits) and cycles are long."""
    rows = some_texts(1)
    df = spark.createDataFrame([(i, t, g, 1, 1, 1, 0.5) for i, (t, g) in enumerate(rows)], DOCS).repartition(5)
    got = CO.collocations(spark, df, max_words=max_words, min_count=4, top=top, shards=shards, bits=bits).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, max_words, 4, top or 10**9, 50)
    assert len(got) == len(set(got)) > 10


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rows = [("alpha beta gamma, delta. " * 400, "en"), ("one two " * 3000, "en"), (" ,. " * 900, None)]
    raw, offsets = np.frombuffer(rows[0][0].encode(), np.uint8), np.array([0, len(rows[0][0])])
    parts = list(CO.stretches(raw, offsets, np.zeros(1, np.uint64), 100))
    assert len(parts) > 50 and b"".join(p.tobytes() for p, _, _ in parts) == raw.tobytes()
    assert all(p.tobytes()[-1:] in b",." for p, _, _ in parts[:-1])
    got = CO.collocations(spark, spark.createDataFrame(rows, "text string, lang string"), min_count=10).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, 3, 10, 2000, 50)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert CO.collocations(spark, none).count() == 0
    assert CO.collocations(spark, spark.createDataFrame([(None, None), ("a b c", "en")], none.schema)).count() == 0


def test_slots_agree(spark):
    rng = np.random.default_rng(2)
    w = rng.integers(-(1 << 63), 1 << 63, (50, 3))
    df = spark.createDataFrame(w.tolist(), "w1 long, w2 long, w3 long")
    for k in (1, 2, 3):
        cols = [f"w{i + 1}" for i in range(k)]
        got = [r.s for r in df.select(CO._slot([F.col(c) for c in cols], 20).alias("s")).collect()]
        assert got == CO.slots([w[:, i].view(np.uint64) for i in range(k)], 20).tolist()


# --- 13 ------------------------------------------------------------------

def plain_clusters(rows, clusters, rounds, size, scale=256, seed=2):
    kept = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    def mark(i):
        return (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cents = [list(v) for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:clusters]]
    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for k in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at) if a == k]
            if own:
                cents[k] = [sum(x) // len(own) for x in zip(*own)]
    final = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, d, k in final:
        per[k] += d
    return Counter((i, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in final)


def odd_vectors(size):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, size))
    rows = [(int(i), (centres[i % 6] + 0.2 * rng.normal(size=size)).tolist()) for i in range(150)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (200, None), (201, []), (202, [1.0] * (size + 1)), (203, [None] + [1.0] * (size - 1)),
             (204, [float("nan")] * size), (205, [float("inf")] * size), (206, [0.0] * size), (207, [0.0] * size)]
    return rows


@pytest.mark.parametrize("size,clusters,pivots", [(64, 40, 16), (3, 7, 8), (1, 4, 3), (5, 400, 4)])
def test_clusters_are_exact(spark, size, clusters, pivots):
    """Also with more clusters than vectors, equal starts, and fewer dimensions than pivots."""
    rows = odd_vectors(size)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, apex string").repartition(4)
    got = SX.cluster(spark, df, clusters=clusters, rounds=3, size=size, pivots=pivots)
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == plain_clusters(rows, clusters, 3, size)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 4)) * 400
    v = (centres[rng.integers(0, 30, 800)] + 20 * rng.normal(size=(800, 4))).astype(np.int64) @ rng.integers(-3, 4, (4, 64))
    cents = v[:30]
    s = SX.Simplex(cents, 16)
    a, h = s.apex(v), s.apex(cents)
    low, high = SX.bounds(a, h)
    exact = ((v[:, None].astype(float) - cents[None]) ** 2).sum(2)
    assert (low <= exact * (1 + 1e-6) + 1).all() and (high >= exact * (1 - 1e-6) - 1).all()
    at, best, asked = SX.nearest(v, a, cents, h)
    assert (best == exact.min(1)).all() and asked.mean() < 3      # four real dimensions: few candidates


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert SX.cluster(spark, none).count() == 0
    with pytest.raises(Exception, match="beyond"):
        SX.cluster(spark, spark.createDataFrame([(1, [1e9] * 64)], none.schema)).count()
