"""Kernels without Spark: the automata's phrases, the network's arithmetic, odd pages."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import decontamination, html_extract, quality_cnn, substring_dedup
from leafmill.llm.substring_dedup import WINDOW


def shard(seed):
    """Segments with passages that come again, overlap, and share common phrases."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(25)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    passages = [some(r.randint(13, 40)) for _ in range(6)]
    line = some(16)
    rows = []
    for doc in range(60):
        text = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            k = r.randrange(len(p))
            text += r.choice([p, p[k:], p[:k], line, line + p[:3], some(r.randint(0, 9)), ["same"] * r.randint(1, 40)])
        rows.append((r.choice([doc, doc // 2]), doc, r.randint(0, 50), " ".join(text), 3))
    r.shuffle(rows)
    ids, h, at, text, number = zip(*rows, strict=True)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "h": pa.array(h, pa.int64()), "at": pa.array(at, pa.int64()), "text": pa.array(text), "shard": pa.array(number, pa.int64())})


@pytest.mark.parametrize(("most_places", "patterns", "hits"), [(32, 50_000, 50_000), (1, 50_000, 7), (3, 5, 50_000)])
def test_located_windows(monkeypatch, most_places, patterns, hits):
    monkeypatch.setattr(substring_dedup, "MOST_PLACES", most_places)
    monkeypatch.setattr(substring_dedup, "PATTERNS", patterns)
    monkeypatch.setattr(substring_dedup, "HITS", hits)
    for seed in range(6):
        t = shard(seed)
        owner = {}
        for doc, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True):
            w = text.split()
            for k in range(len(w) - WINDOW + 1):
                key = tuple(w[k : k + WINDOW])
                owner.setdefault(key, set()).add(doc)
        seen = substring_dedup._windows(t)
        assert len(seen) == len(owner)
        known = seen.filter(seen["many"])
        assert len(known) == sum(len(v) > 1 for v in owner.values())
        phrases = known.select(["place", "least"]).rename_columns(["place", "owner"])
        found = substring_dedup._locate(t.take(np.random.default_rng(seed).permutation(len(t))), phrases)
        got = sorted((r["doc_id"], r["h"], r["lo"], r["hi"]) for r in found.to_pylist())
        want = []
        for r in t.to_pylist():
            w = r["text"].split()
            cut = np.zeros(len(w) + 2, bool)
            for k in range(len(w) - WINDOW + 1):
                if min(owner[tuple(w[k : k + WINDOW])]) < r["doc_id"]:
                    cut[k + 1 : k + 1 + WINDOW] = True
            edges = np.flatnonzero(cut[1:] != cut[:-1])
            want += [(r["doc_id"], r["h"], r["at"] + int(a), r["at"] + int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        assert got == sorted(want)


def slow_score(net, data):
    """The network's score by loops over positions."""
    p, n = net.p, len(data)
    seen = lambda i: any(i >= lag + 3 and data[i - 3 : i + 1] == data[i - 3 - lag : i + 1 - lag] for lag in quality_cnn.LAGS)
    s = [data[i] + 256 * seen(i) for i in range(n)] + [quality_cnn.PAD] * (quality_cnn.WIDTH - 1)
    act = [np.maximum(sum(p["conv"][j][s[i + j]] for j in range(quality_cnn.WIDTH)) + p["conv_bias"], 0) for i in range(n)]
    size, many = quality_cnn.SEGMENT, quality_cnn.SEGMENTS
    segments = -(-n // size)
    chunks = max(segments - many + 1, 1) if n else 0
    h = [np.tanh(np.mean(act[k * size : (k + many) * size], axis=0) * 8 @ p["hidden"] + p["hidden_bias"]) for k in range(chunks)]
    top, avg = (np.max(h, axis=0), np.mean(h, axis=0)) if h else (np.zeros(quality_cnn.HIDDEN),) * 2
    return 1 / (1 + np.exp(-(top @ p["max"] + avg @ p["mean"] + p["bias"][0])))


def texts():
    r = random.Random(4)
    return [b"", b"a", b"abcabcabcabcabc", bytes(r.choice(b"ab \n") for _ in range(700)), "é漢 ".encode() * 90, bytes(r.choice(range(32, 127)) for _ in range(300))]


def test_network_against_loops(monkeypatch):
    net, all_ = quality_cnn.Network(7), texts()
    at = np.append(0, np.cumsum([len(t) for t in all_]))
    want = [slow_score(net, t) for t in all_]
    assert np.allclose(net.score(np.frombuffer(b"".join(all_), np.uint8), at), want, atol=1e-5)
    monkeypatch.setattr(quality_cnn, "PIECE_BYTES", 130)  # long texts by pieces of two segments
    assert np.allclose([net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in all_], want, atol=1e-5)


def test_gradients_against_differences():
    net, exact, all_ = quality_cnn.Network(3), quality_cnn.Network(3), texts()
    exact.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y = np.array([0, 1, 0, 1, 1, 0], np.float32)
    at = np.append(0, np.cumsum([len(t) for t in all_]))
    buf = np.frombuffer(b"".join(all_), np.uint8)
    s, begin = quality_cnn.symbols(buf, at)
    g = net.gradients(s, quality_cnn.Layout(np.diff(at), begin), y)

    def loss():
        q = np.array([slow_score(exact, t) for t in all_])
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    r = np.random.default_rng(0)
    for name in ("bias", "max", "mean", "hidden", "hidden_bias", "conv_bias"):
        flat = exact.p[name].reshape(-1)
        k = int(r.integers(len(flat)))
        was, step = flat[k], 1e-4
        flat[k] = was + step
        up = loss()
        flat[k] = was - step
        down = loss()
        flat[k] = was
        assert g[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=1e-5)


def test_attributes_of_odd_pages():
    """No input can raise, and names are those of class, id and role alone."""
    model = html_extract.train()
    body = "<article><p>The first sentence of the story, at some length.</p><p>And the second one.</p></article>"
    plain = html_extract.extract([body], model)[0]
    for attrs in ('data-year="2024"', 'data-y="12px"', "data-y", "data-y=1", 'style="overflow:hidden"', "data-uid=menu", 'title="class=menu"', "data-class='footer'", "=", '"', "a=\"", "class", "class=", "CLASS=''"):
        assert html_extract.extract([body.replace("<article>", f"<article {attrs}>")], model)[0] == plain
    r = random.Random(6)
    bits = ["<", ">", "</", "/>", "=", '"', "'", " ", "div", "p", "class", "hidden", "data-y", "&amp", "&#x;", "&#99999999;", "<!--", "-->", "<![CDATA[", "script", "a", "\x00", "é", "<table><td>", "</p>", "<br>"]
    pages = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)]
    assert len(html_extract.extract(pages, model)) == 400


def test_deep_and_wide_pages_take_linear_time():
    model = html_extract.train()

    def took(page):
        began = time.perf_counter()
        html_extract.extract([page], model)
        return time.perf_counter() - began

    for one in ("<div>", "<div>x", "<p>x<button>", "<b>x", "<div class='a b'>x</div>"):
        took(one * 200)
        assert took(one * 16_000) < 24 * max(took(one * 2000), 0.05)
    assert html_extract.extract(["<div>" * 100_000 + "x"], model)


HAND_MADE = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Keeping bees</title><link rel=stylesheet href=a.css></head>
<body class="home single post-42"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" role="banner"><a href="/">The Hive</a><nav aria-label="Primary"><ul><li><a href="/a">Start</a></li><li><a href="/b">Shop</a></li></ul></nav></header>
<main id="content"><article class="post hentry"><h1 class="entry-title">Keeping bees in town</h1>
<div class="entry-content"><p>Bees do well on roofs, where few people walk and the flowers of a whole quarter are within reach.</p>
<blockquote><p>A hive needs sun in the morning and shade at noon.</p></blockquote><ul><li>Choose a quiet place.</li><li>Ask your neighbours first.</li></ul>
<p>In the second year you can harvest, <em>if</em> the winter was mild.</p></div></article></main>
<aside id="sidebar" class="widget-area" data-year="2024"><h2>Recent posts</h2><ul><li><a href="/1">Wax</a></li><li><a href="/2">Smoke</a></li></ul></aside>
<footer id="colophon"><p>Proudly made with care. <a href="/privacy">Privacy</a></p></footer><script>window.x = "<p>no</p>";</script></body></html>""",
        ["Keeping bees in town", "Bees do well on roofs, where few people walk and the flowers of a whole quarter are within reach.", "A hive needs sun in the morning and shade at noon.", "Choose a quiet place.", "Ask your neighbours first.", "In the second year you can harvest, if the winter was mild."],
    ),
    (
        """<html><body><div id=wrap><div id=nav><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><div class="cookie-notice">We use cookies. <button>Accept</button></div>
<div class="main article-body"><h2>Water levels fall</h2><p>The lake has lost a metre since spring, and the harbour master says that larger boats can no longer land.<p>Rain is expected late in the week, but the ground is so dry that little of it will reach the lake.
<table><tr><th>Month<th>Level<tr><td>May<td>4.1 m</table></div><div class=comments><h3>Comments</h3><p>So sad to see this happen again.</p></div><div class="advert">Buy a boat today!</div></div></body></html>""",
        ["Water levels fall", "The lake has lost a metre since spring, and the harbour master says that larger boats can no longer land.", "Rain is expected late in the week, but the ground is so dry that little of it will reach the lake."],
    ),
]


def test_pages_that_were_written_by_hand():
    """Pages of another make than the training pages: all prose of the article, and nothing of the rest."""
    model = html_extract.train()
    for page, want in HAND_MADE:
        got = html_extract.extract([page], model)[0].split("\n")
        assert [x for x in got if x in want] == want
        for other in ("Skip to content", "The Hive", "Start", "Recent posts", "Wax", "Privacy", "One", "Accept", "Comments", "So sad to see this happen again.", "Buy a boat today!", "Keeping bees"):
            assert other not in got


def test_windows_of_a_large_benchmark_are_small():
    r = random.Random(9)
    items = [(str(k), " ".join(str(r.randrange(10**6)) for _ in range(500))) for k in range(60)]
    w = decontamination.Windows(items)
    size = sum(x.nbytes for x in w.words.values()) + w.word_hash.nbytes + sum(a.nbytes + b.nbytes for a, b in w.of.values())
    assert size < 100 * sum(len(x) for x in w.words.values())
    assert w.items_of(13, 0) and len(w.words[13]) == 60 * 488
