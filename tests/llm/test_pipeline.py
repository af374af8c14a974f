"""All five stages by content, on rows with null ids, null texts, repeated ids and repeated rows."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from test_pairs_and_passages import fingerprint, hits, removed

from leafmill.llm import mixing, quality_rules


def odd_documents():
    r = random.Random(21)
    stop = "the and of to in is that it was for on with as at by".split()
    words = ["".join(r.choice("aeioubdglmnrst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    some = lambda n: " ".join(r.choice(stop) if k % 4 == 0 else r.choice(words) for k in range(n))
    passage, item = some(60), some(30)
    rows = [(None, None, "a"), (None, "", "a"), (5, None, None), (6, "### $$$ %%% ***", "b")]
    for i in range(40):
        text = some(r.randint(60, 160))
        if i % 4 == 0:
            text += " " + passage + " " + some(20)
        if i % 7 == 0:
            text = item + " " + text
        rows.append((None if i % 9 == 0 else i // 2 if i % 5 == 0 else i, text, r.choice(["a", "b", None])))
    base = some(500)
    for i in range(60, 70):
        w = base.split()
        w[i] = "changed" if i % 2 else w[i]
        rows.append((None if i % 3 == 0 else i, " ".join(w), "b"))
    rows += [rows[10], rows[10], (None, rows[12][1], "a"), (rows[14][0], rows[15][1] + " " + some(80), "a")]
    r.shuffle(rows)
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows], item


def test_stages_by_content(spark, tmp_path):
    rows, item = odd_documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    stages = iter(corpus_pipeline.STAGES)

    def run(df):
        name, stage = next(stages)
        out = corpus_pipeline.materialize(stage(spark, df, sf), "test-" + name.replace(" ", "-"))
        return out, [tuple(r) for r in out.collect()]

    # quality rules: a verdict on each text
    kept = Counter((r.doc_id, r.kept) for r in quality_rules.judge(docs).collect())
    docs, now = run(docs)
    assert Counter(r[0] for r in now) == Counter({i: n for (i, k), n in kept.items() if k}) and 0 < len(now) < len(rows)
    assert not Counter(now) - Counter(rows)

    # near-dedup: the least row of each component
    prints = {r[1]: fingerprint(r[1]) for r in now}
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    groups = {}
    for r in now:
        groups.setdefault(find(prints[r[1]]), []).append(r)
    want = Counter(rank(min(g, key=rank)) for g in groups.values())
    docs, now2 = run(docs)
    assert Counter(map(rank, now2)) == want and not Counter(now2) - Counter(now)
    assert any(r[0] is None for r in now2) and len(now2) < len(now)

    # substring dedup: words that a smaller id has are gone
    want = Counter()
    for (i, t, w, cut), r in zip(removed([(r[0], r[1]) for r in now2]), now2, strict=True):
        text = " ".join(x for x, c in zip(w, cut, strict=True) if not c) if any(cut) else t
        want[i, text, r[2], r[3], len(text) if any(cut) else r[4]] += 1
    docs, now3 = run(docs)
    assert Counter(now3) == want and Counter(now3) != Counter(now2)

    # decontamination
    clean = lambda t: not (lambda n, h, _: h > 0 and 20 * h >= n)(*hits(t, [(1, item)]))
    docs, now4 = run(docs)
    assert Counter(now4) == Counter(r for r in now3 if clean(r[1])) and len(now4) < len(now3)
    assert docs.columns == columns

    # mixing: what each source's budget takes
    plan = mixing.mix_plan(docs).collect()
    docs, now5 = run(docs)
    assert docs.columns == [*columns, "size", "epochs", "taken"]
    assert Counter((r[0], r[-1]) for r in now5) == Counter((r.doc_id, r.taken) for r in plan if r.taken)
    assert not Counter(r[:5] for r in now5) - Counter(now4)
    for s in {r.source for r in plan}:
        mine = [r for r in plan if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 and all(0 <= r.taken <= 2 * r.size for r in mine)
    assert corpus_pipeline.run(spark, sf).count() == len(now5)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
