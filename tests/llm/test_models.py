"""The trained models of the corpus operators against plain computations:
convolution, gradients, log-count ratios, indicators, hinge loss and curve."""

import numpy as np
import pyarrow as pa

from arrears.llm import langid, quality
from arrears.llm.text import buffers

TEXTS = ["", "a", "The cat the cat sat 42 times.", "Ünïcode wörds wörds  x\ty", "ÄÖ", "same same same", "x" * 300 + " Y9", "  \n "]


def small_net(classes=3):
    net = langid.ByteNet([f"l{i}" for i in range(classes)], np.random.default_rng(3))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for w in langid.WIDTHS:
        net.p[f"b{w}"] = np.random.default_rng(w).standard_normal(langid.FILTERS) * 0.1
    return net


def windows(n, seed=5):
    x = np.random.default_rng(seed).integers(0, 256, (n, langid.WINDOW)).astype(np.uint8)
    x[0, 40:] = 0
    return x


def plain_logits(net, x):
    """One window, one filter, one place after the other."""
    out = []
    for row in x:
        h = []
        for w in langid.WIDTHS:
            z = [sum(net.p[f"t{w}"][j][row[at + j]] for j in range(w)) for at in range(langid.WINDOW - w + 1)]
            h.append(np.maximum(np.max(z, axis=0) + net.p[f"b{w}"], 0))
        out.append(np.concatenate(h) @ net.p["o"] + net.p["c"])
    return np.array(out)


def test_scorer_is_the_plain_convolution():
    net, x = small_net(), windows(4)
    want = plain_logits(net, x)
    assert np.allclose(langid.Scorer(net).logits(x), want, atol=1e-9)
    assert np.allclose(net.pooled(x)[0] @ net.p["o"] + net.p["c"], want, atol=1e-9)


def test_scores_of_whole_texts():
    """Windows one after the other, weighted by their bytes."""
    net = small_net()
    texts = [*TEXTS, "long text " * 200]
    got, score = langid.Scorer(net).texts(*buffers(pa.array(texts, pa.string())))
    for text, best, p in zip(texts, got, score):
        raw = text.encode()
        if not raw:
            assert best == -1 and p == 0
            continue
        total = np.zeros(3)
        for lo in range(0, len(raw), langid.WINDOW):
            part = bytes(c + 32 if 65 <= c <= 90 else c for c in raw[lo:lo + langid.WINDOW])
            x = np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[None, :]
            total += plain_logits(net, x)[0] * len(part)
        q = np.exp(total / len(raw))
        q /= q.sum()
        assert best == q.argmax() and abs(p - q.max()) < 1e-9


def test_gradients_against_differences():
    net, x, y = small_net(), windows(6), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        h, _ = net.pooled(x)
        z = h @ net.p["o"] + net.p["c"]
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))
    grads = net.step(x, y)
    rng, eps = np.random.default_rng(1), 1e-6
    for name, g in grads.items():
        # the entries with the largest slopes, and some others
        flat = [int(i) for i in np.argsort(-np.abs(g).ravel())[:4]] + rng.integers(0, g.size, 3).tolist()
        for i in flat:
            at = np.unravel_index(i, g.shape)
            was = net.p[name][at]
            net.p[name][at] = was + eps
            up = loss()
            net.p[name][at] = was - eps
            down = loss()
            net.p[name][at] = was
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-6, (name, at)


def test_fit_learns_and_repeats():
    """Windows told apart by one byte; the same seed gives the same net."""
    rng = np.random.default_rng(2)
    x = rng.integers(97, 123, (90, langid.WINDOW)).astype(np.uint8)
    y = np.arange(90) % 3
    x[np.arange(90), 11] = 200 + y
    nets = [langid.ByteNet(["a", "b", "c"], np.random.default_rng(7)).fit(x, y, np.random.default_rng(8)) for _ in range(2)]
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)
    assert (langid.Scorer(nets[0]).logits(x).argmax(axis=1) == y).mean() > 0.9


def plain_indicators(text):
    raw = text.encode()
    out = {a << 8 | b for a, b in zip(raw, raw[1:])}
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        out.add(int(quality._hashed(np.array([a << 16 | b << 8 | c]), quality.TRIPLES)[0]) + quality.PAIRS)

    def kind(c):
        return 3 if c > 127 else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4
    words = raw.split()
    shapes = [kind(w[0]) * 5 + kind(w[-1]) + 32 * (i > 0 and words[i - 1] == w) for i, w in enumerate(words)]
    out |= {a * 64 + b + quality.PAIRS + quality.TRIPLES for a, b in zip(shapes, shapes[1:])}
    for a, b, c in zip(shapes, shapes[1:], shapes[2:]):
        code = np.array([(a * 64 + b) * 64 + c])
        out.add(int(quality._hashed(code, quality.SHAPES3)[0]) + quality.PAIRS + quality.TRIPLES + quality.SHAPES)
    return sorted(out)


def test_indicators_against_plain_ones():
    got = quality.indicators(*buffers(pa.array(TEXTS, pa.string())))
    assert [g.tolist() for g in got] == [plain_indicators(t) for t in TEXTS]


def test_log_ratios_against_plain_counts(spark):
    rows = [(t, i % 2) for i, t in enumerate(TEXTS)] + [(None, 1), (TEXTS[2], 0)]
    ratio, bad, good = quality.log_ratios(spark.createDataFrame(rows, "text string, quality int").repartition(3))
    assert (bad, good) == (sum(1 - y for _, y in rows), sum(y for _, y in rows))
    counts = np.full((2, quality.SIZE), quality.SMOOTH)
    for text, y in rows:
        for f in plain_indicators(text or ""):
            counts[y, f] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    assert np.allclose(ratio, np.log(share[1] / share[0]), atol=1e-12)


def test_descent_reaches_the_optimum():
    """The gap between primal and dual objective of the hinge loss is small."""
    rng = np.random.default_rng(4)
    n, width = 120, 12
    dense = rng.standard_normal((n, width))
    y = np.where(dense[:, 0] + 0.5 * rng.standard_normal(n) > 0, 1.0, -1.0)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    cost = np.where(y > 0, 1.0, 1.7)
    w = quality.descend([np.arange(width)] * n, list(dense), y, cost, np.random.default_rng(0))
    x = np.hstack([dense, np.ones((n, 1))])
    kept = np.append(w[:width], w[-1])
    primal = 0.5 * kept @ kept + (cost * np.maximum(0, 1 - y * (x @ kept))).sum()
    # a plain, long projected gradient ascent on the dual
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    a, rate = np.zeros(n), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20000):
        a = np.clip(a + rate * (1 - gram @ a), 0, cost)
    dual = a.sum() - 0.5 * a @ gram @ a
    assert dual - 1e-6 <= primal <= dual * 1.01


def test_curve_fits_smoothed_targets():
    rng = np.random.default_rng(6)
    margin = rng.standard_normal(400)
    y = np.where(rng.random(400) < 1 / (1 + np.exp(-(2 * margin + 0.5))), 1.0, -1.0)
    a, b = quality._curve(margin, y)
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(p, q):
        z = p * margin + q
        return float(np.sum(np.logaddexp(0, z) - target * z))
    least = loss(a, b)
    assert a > 0 and all(least <= loss(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
