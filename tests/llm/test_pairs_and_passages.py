"""SimHash, substring dedup and decontamination against brute force."""

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
import xxhash

from leafmill.llm import decontamination, simhash, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, source string, n_chars long, n_words long, row string, fp string, kept boolean"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, None, len(t or ""), 7, "x", "y", None) for i, t in pairs], SCHEMA)


def corpus(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = some(40), some(20)
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "Two words"), (None, passage), (5, passage), (5, passage), (6, passage.upper())]
    for i in range(10, 60):
        t = some(r.randint(0, 80))
        if i % 3 == 0:
            t += "\n" + passage + "\t" + some(5)
        if i % 5 == 0:
            k = r.randint(0, 20)
            t += " " + " ".join(passage.split()[k : k + r.randint(5, 20)])
        if i % 4 == 0:
            t = line + " " + t + " " + line
        out.append((i, t))
    base = some(300)
    for i in range(100, 130):
        w = base.split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "zz"
        out.append((i, " ".join(w)))
    out.append((200, "long " * 30_000 + base))
    r.shuffle(out)
    return out


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("heavy", [(simhash.HEAVY, simhash.HEAVIER), (1, 8)])
def test_simhash_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash.links, "__defaults__", heavy)
    pairs = corpus()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs_of(spark, pairs)).collect())
    prints = [fingerprint(t) for _, t in pairs]
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for (i, _), p in zip(pairs, prints, strict=True):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    want = sorted((-1 if i is None else i, p, least.get(root(p))) for (i, _), p in zip(pairs, prints, strict=True))
    assert got == want


def test_links_of_close_fingerprints(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(6)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for heavy in ((256, 1000), (2, 1000), (1, 1), (2, 4)):
        got = {tuple(sorted((a & (2**64 - 1), b & (2**64 - 1)))) for a, b in simhash.links(spark.createDataFrame(signed, "fp long"), *heavy).collect()}
        assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


def test_long_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    df = docs_of(spark, corpus())
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == want - {None}


def test_near_dedup_keeps_a_row_of_groups_without_ids(spark):
    r = random.Random(12)
    alone, twice, shared, other, same = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(5))
    pairs = [(None, alone), (None, twice), (None, twice), (1, shared), (None, shared), (2, shared), (2, other), (3, same), (3, same), (None, None), (None, "")]
    kept = [(x.doc_id, x.text or "") for x in simhash.drop_near_duplicates(docs_of(spark, pairs)).collect()]
    assert sorted(kept, key=str) == sorted([(None, alone), (None, twice), (1, shared), (2, other), (3, same), (None, "")], key=str)


def removed(pairs):
    owner = {}
    for i, t in pairs:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - 12):
                owner[tuple(w[k : k + 13])] = min(i, owner.get(tuple(w[k : k + 13]), i))
    out = []
    for i, t in pairs:
        w = WORD.findall(t or "")
        cut = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and owner[tuple(w[k : k + 13])] < i:
                cut[k : k + 13] = [True] * 13
        out.append((i, t, w, cut))
    return out


def test_substring_dedup(spark, tmp_path):
    pairs = corpus(4)
    docs_of(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op3_substring_dedup(spark, str(tmp_path)).collect())
    want = sorted((-1 if i is None else i, len(w), sum(cut), hashlib.sha256(" ".join(x for x, c in zip(w, cut, strict=True) if not c).encode()).hexdigest()) for i, _, w, cut in removed(pairs))
    assert got == want


def test_substring_dedup_of_rows(spark):
    pairs = corpus(5)
    df = docs_of(spark, pairs)
    out = substring_dedup.dedup_substrings(df)
    assert out.columns == df.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.text is None) for r in out.collect())
    want = sorted((-1 if i is None else i, (" ".join(x for x, c in zip(w, cut, strict=True) if not c) if any(cut) else t) or "", t is None) for i, t, w, cut in removed(pairs))
    assert got == want
    assert out.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0


def test_small_shards_and_automata_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 3000)
    df = docs_of(spark, corpus(6))
    small = sorted(map(str, substring_dedup.dedup_substrings(df).collect()))
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 4_000_000)
    assert small == sorted(map(str, substring_dedup.dedup_substrings(df).collect()))


def hits(text, items):
    w = LETTERS.findall((text or "").translate(LOWER))
    cover, found = [False] * len(w), set()
    for item, t in items:
        iw = LETTERS.findall((t or "").translate(LOWER))
        n = min(13, len(iw))
        if not n:
            continue
        windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                cover[k : k + n] = [True] * n
                found.add("" if item is None else str(item))
    return len(w), sum(cover), sorted(found)


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 60])
def test_decontamination(spark, block_bytes):
    r = random.Random(2)
    pairs = corpus(7)
    texts = [t for _, t in pairs if t and 20 < len(t.split()) < 500]
    items = [(1, " ".join(texts[0].split()[3:25])), (2, texts[1].upper()), (2, texts[2]), (3, "one"), (4, "two, WORDS!"), (5, None), (6, ""), (None, texts[3]), (7, "never seen words " * 6), (10, "a b c"), (11, " ".join(texts[4].split()[:13]))]
    r.shuffle(items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, pairs)
    found = decontamination.annotate(df, bench, block_bytes)
    got = sorted((-1 if x.doc_id is None else x.doc_id, x["_found"].n_words, sum(x["_found"].spans[1::2]) - sum(x["_found"].spans[::2]), list(x["_found"]["items"])) for x in found.collect())
    want = sorted((-1 if i is None else i, *hits(t, items)) for i, t in pairs)
    assert got == want
    kept = decontamination.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    clean = sorted(-1 if i is None else i for i, t in pairs for n, h, _ in [hits(t, items)] if not (h > 0 and 20 * h >= n))
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in kept.collect()) == clean


def test_empty_tables(spark, tmp_path):
    df = docs_of(spark, [])
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0
    assert substring_dedup.dedup_substrings(df).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.annotate(df, bench).count() == 0
    assert decontamination.drop_contaminated(docs_of(spark, corpus()), bench).count() == len(corpus())
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert substring_dedup.op3_substring_dedup(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("heavy", "joins"), [((simhash.HEAVY, simhash.HEAVIER), 1), ((0, 8), 3)])
def test_variants_are_never_sent_out(spark, heavy, joins):
    """Spark takes 64 rows a fingerprint for one, and broadcast them where that looked small."""
    found = simhash.links(spark.range(40).selectExpr("xxhash64(id) AS fp"), *heavy)
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == joins


def test_fingerprints_in_little_memory():
    r = random.Random(4)
    texts = [" ".join(r.choice(["ab", "Cde", "fgh", "ij"]) + str(r.randrange(99)) for _ in range(200)) for _ in range(1500)] + [None, "", "x " * 90_000]
    col = pa.array(texts)
    tracemalloc.start()
    got = simhash.simhash(col)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    assert got[-4:].tolist() == [fingerprint(t) for t in texts[-4:]]
