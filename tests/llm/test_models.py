"""Token counts, language-model scores, the classifier, HTML extraction and chat formatting."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import chat_format, html_extract, lm_scoring, quality_cnn, token_counts
from leafmill.llm.html_pages import Pages

MODEL = public_tokenizers.path(token_counts.MODEL)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


PARTS = ["a", "the", " ", "  ", "    ", "▁", "\n", "\t", "é", "漢", "😀", "\x00", "***", "Hello", " world", "<s>", "<0x0A>", "　", "aaaa", "99"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=40))
def test_token_counts(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL) if not hasattr(test_token_counts, "sp") else test_token_counts.sp
    test_token_counts.sp = sp
    n_bytes, n = token_counts.count_tokens(pa.array([text, None, "x"]), MODEL)
    assert n.tolist() == [len(sp.encode(text)), 0, len(sp.encode("x"))]
    assert n_bytes.tolist() == [len(text.encode()), 0, 1]


def test_token_counts_of_odd_texts(pieces):
    texts = [" " * k for k in range(200)] + [" " * k + "x" for k in range(40)] + ["a" * 3000, "漢" * 1000, "ab" * 2000 + " " * 700]
    assert token_counts.count_tokens(pa.array(texts), MODEL)[1].tolist() == [len(pieces.encode(t)) for t in texts]


def test_token_count_rows(spark, pieces):
    df = spark.createDataFrame([(1, "hello world", 5), (1, "hello world", 5), (None, None, 5)], "doc_id long, text string, n_tokens int")
    got = token_counts.count_documents(df, MODEL, 1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in got) == [(0, 0, False), *[(1, len(pieces.encode("hello world")), True)] * 2]
    assert token_counts.count_documents(df.limit(0), MODEL).count() == 0


def weighted(counts, context, node):
    """ln of the weighted probability of a decision's node by the recursion itself."""
    n0, n1 = counts.get((context, node), (0, 0))
    own = math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)
    if len(context) == lm_scoring.DEPTH:
        return own, 1.0
    below = sum(weighted(counts, c, node)[0] for c in {k[0] for k in counts if len(k[0]) == len(context) + 1 and k[0][1:] == context and k[1] == node})
    both = np.logaddexp(own, below) - math.log(2)
    return both, math.exp(own - math.log(2) - both)


def test_context_tree(spark):
    texts = ["abab", "abba", "", "b"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][: len(texts)]
    counts = {}
    for t in texts:
        data = bytes(lm_scoring.DEPTH) + t.encode()
        for p in range(lm_scoring.DEPTH, len(data) + 1):
            steps = [(0, int(p == len(data)))]
            if p < len(data):
                steps += [((1 << k) | (data[p] >> (8 - k)), data[p] >> (7 - k) & 1) for k in range(8)]
            for node, bit in steps:
                for d in range(lm_scoring.DEPTH + 1):
                    c = counts.setdefault((data[p - d : p], node), [0, 0])
                    c[bit] += 1
    counts = {k: tuple(v) for k, v in counts.items()}

    def score(text):
        total, data = 0.0, bytes(lm_scoring.DEPTH) + text.encode()
        for p in range(lm_scoring.DEPTH, len(data) + 1):
            steps = [(0, int(p == len(data)))]
            if p < len(data):
                steps += [((1 << k) | (data[p] >> (8 - k)), data[p] >> (7 - k) & 1) for k in range(8)]
            for node, bit in steps:
                one = None
                for d in range(lm_scoring.DEPTH, -1, -1):
                    key = (data[p - d : p], node)
                    if key in counts:
                        n0, n1 = counts[key]
                        kt = (n1 + 0.5) / (n0 + n1 + 1)
                        w = weighted(counts, *key)[1]
                        one = kt if one is None else w * kt + (1 - w) * one
                one = 0.5 if one is None else one
                total += math.log10(one if bit else 1 - one)
        return total

    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score_documents(df).collect()}
    for i, t in zip(ids, texts, strict=True):
        assert got[i].score == pytest.approx(score(t), rel=1e-4)
        assert not got[i].held_out


def test_nodes_of_one_visit_count():
    gram = np.array([int.from_bytes(c, "big") << 9 | s for c, s in ((b"aawxy", ord("p")), (b"bbwxy", ord("q")))]).astype(np.uint64)
    one = np.ones(2, np.int64)
    odds = np.frombuffer(b"".join(x for x in lm_scoring._subtree(gram, one, one).column("odds").to_pylist() if x), np.float32).reshape(2, 9)
    # p and q differ in their last bit: depth three stops with 1/3 and has it even, below each was seen once
    assert np.allclose(odds[:, 8], 1 / 3 * 1 / 2 + 2 / 3 * 3 / 4)


def test_context_tree_is_whole_whatever_is_sent_out(spark, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("abc é") for _ in range(r.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    score = lambda: {x.doc_id: x.score for x in lm_scoring.score_documents(df).collect()}
    whole = score()
    sent = []
    kept, known = lm_scoring.frequent, lm_scoring.KNOWN_GRAMS
    monkeypatch.setattr(lm_scoring, "frequent", lambda *a: sent.append(kept(*a)) or sent[-1])
    for most in (0, 40, known):
        monkeypatch.setattr(lm_scoring, "KNOWN_GRAMS", most)
        got = score()
        assert got == {i: pytest.approx(x, rel=1e-9) for i, x in whole.items()}
        common, rare = sent[-2]  # grams, then words
        data = [(bytes(lm_scoring.DEPTH) + t.encode()) for t in texts]
        distinct = {(d[p - 5 : p], d[p : p + 1]) for d in data for p in range(5, len(d) + 1)}
        assert (common.count() if common else 0) <= most
        assert (common.count() if common else 0) + rare.count() == len(distinct)


def test_subtrees_do_not_depend_on_batches_and_slices(monkeypatch):
    r = np.random.default_rng(3)
    buf = r.choice(np.frombuffer(b"abcd", np.uint8), 4000)
    gram, n = np.unique(lm_scoring.grams(buf, np.array([0, 1500, 4000]))[0], return_counts=True)
    near = ((gram >> np.uint64(9)) & np.uint64(0xFFFFFF)).astype(np.int32)
    order = np.argsort(near, kind="stable")
    n = np.where(np.arange(len(n)) % 5, n, 0)
    rows = pa.record_batch([near[order], gram[order].view(np.int64), n[order], n[order] + 1], ["near", "gram", "n", "m"])
    want = {}
    for size, batch in ((10**6, 10**6), (1, 7), (50, 10**6), (300, 64)):
        monkeypatch.setattr(lm_scoring, "SLICE_GRAMS", size)
        out = pa.Table.from_batches(lm_scoring._subtrees(iter([rows.slice(i, batch) for i in range(0, len(gram), batch)])))
        got = {}
        for x in out.to_pylist():
            key = ("gram", x["gram"], x["m"]) if x["gram"] is not None else ("node", x["key"])
            assert key not in got
            got[key] = np.frombuffer(x["odds"], np.float32) if x["gram"] is not None else np.array([x["n0"], x["n1"], x["weighted"]])
        want = want or got
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-6, equal_nan=True) for k in want)


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KNOWN_WORDS", 2)  # the others are joined
    texts = ["The the a b", "a  c\td", None, "", "zz a"] * 3 + ["long " * 5000]
    df = spark.createDataFrame([(i, t, 1.0, "w") for i, t in enumerate(texts)], "doc_id long, text string, score double, word string")
    train = [(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    count, total = {}, 0
    for _, t in train:
        for w in [*(t or "").lower().split(), None]:
            count[w] = count.get(w, 0) + 1
            total += 1
    got = {r.doc_id: r for r in lm_scoring.score_documents(df).collect()}
    for i, t in enumerate(texts):
        words = [*(t or "").lower().split(), None]
        base = sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (len(count) + 1))) for w in words)
        assert got[i].base_score == pytest.approx(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(w in count for w in words), total)
    assert lm_scoring.score_documents(df.limit(0)).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 6.9, 7.1, 1e4])
    assert np.allclose(lm_scoring._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10)


def test_classifier_learns_and_is_batch_independent(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("aeiou" if k % 2 else "bcdfgt") for k in range(r.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["###", "$$$", "***"]) + r.choice(["a", "b"]) for _ in range(60))
    rows = [(i, good() if i % 3 else good() + bad() + good(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "a", "x"), (1002, "a", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None)], "doc_id long, quality int")
    out = quality_cnn.score_documents(docs, labels).collect()
    want = {i: q for i, _, q in rows}
    held = [x for x in out if x.held_out and x.doc_id in want]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    assert np.mean([x.predicted == want[x.doc_id] for x in held]) > 0.95
    assert len({x.score for x in out if x.doc_id == 1002}) == 1
    assert all(0 <= x.score <= 1 for x in out)
    net = quality_cnn.train_network([(t.encode(), q) for _, t, q in rows[:60]])
    both = [t.encode() for _, t, _ in rows[:10]]
    at = np.append(0, np.cumsum([len(t) for t in both]))
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in both]
    assert np.allclose(net.score(np.frombuffer(b"".join(both), np.uint8), at), alone, atol=1e-5)
    assert quality_cnn.score_documents(docs.limit(0), labels).count() == 0
    assert {x.score for x in quality_cnn.score_documents(docs, labels.limit(0)).collect()}


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small page."""
    model = html_extract.train()
    tree = html_extract.Tree()
    tree.parse("<body><div class=menu><a>x</a></div><article><p>Some text here.</p><p>b</p></article></body>", 0)
    n = len(tree.parent)
    score = [sum(model.weights.get(f, 0.0) for f in fs) for fs in tree.features]
    total, one = 0.0, np.zeros(n)
    for labels in np.ndindex(*([2] * n)):
        w = model.prior[labels[0]] + sum(s for s, y in zip(score, labels, strict=True) if y)
        w += sum(model.pairs[tree.kind[i]][labels[tree.parent[i]], labels[i]] for i in range(1, n))
        total += math.exp(w)
        one += math.exp(w) * np.array(labels)
    assert np.allclose(model.marginals(tree), one / total, atol=1e-9)


def test_extraction_of_labelled_pages():
    model, pages, tree = html_extract.train(), Pages(77), html_extract.Tree(training=True)
    for k in range(150):
        tree.parse(pages.page(), k)
    run = np.array([t is not None for t in tree.text])
    assert np.mean((model.marginals(tree) > 0.5)[run] == np.array(tree.label)[run]) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now.</div><article><h1>Head &amp;   line</h1><p><b>First  line of text,
more.<br><p>Second &lt;one&gt; &#233;.</p></article><div class="comments"><p>Me too, I think.</p></div><footer>&copy; us</footer></body></html>"""


def test_extraction_of_a_page(spark):
    rows = [(1, "u", PAGE, "e"), (2, None, None, "e"), (3, "u", "", "e"), (4, "u", PAGE[:-60] + "<p cla", "e"), (1, "u", PAGE, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(df).collect())
    want = "Head & line\nFirst line of text, more.\nSecond <one> é."
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, want, len(want))]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@given(st.text(alphabet="<|im_startend>\\ \nab", max_size=40) | st.sampled_from(["<|im_end|>", "<\\|im_start|>", "<\\\\|im_end|>"]))
def test_escapes_are_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text
    assert "<|im_end|>" not in chat_format.escape(text) and "\n" not in chat_format.escape_role(text)


def test_chat_round_trip(spark):
    path = public_tokenizers.path(chat_format.VOCABULARY)
    rows = [(1, 1, "assistant", "hi <|im_end|> é😀", 9), (1, 0, "user", None, 9), (1, 1, "assistant", "again", 9), (1, 1, "assistant", "again", 9), (2, None, None, "x" * 20000, 9), (None, 3, "a\nb\\n", "", 9), (3, 0, "system", "s", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens int")
    formatted = chat_format.format_turns(df, path)
    assert all(len(r.tokens) == len(r.loss_mask) for r in formatted.collect())
    got = {r.conv_id: r for r in chat_format.digest_conversations(formatted, path).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest_conversations(chat_format.format_turns(df.limit(0), path), path).count() == 0
