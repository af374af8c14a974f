"""Quality rules, mixing and the pipeline; SQL of all operators against DuckDB."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import mixing, quality_rules, registry

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    rel = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, rel.fetchall())


TEXTS = [None, "", " \n\t", "a", "the " * 30, "x y z\n" * 5, "#*$%&|<> " * 4, "the cat of the house and a dog in it " * 2 + "end of text as it was here now for all of us to see", "the cat of the house saw that a dog was in it, and this is for all who are not here or at the door of his room", "é " * 25, "w%d " * 10, "one\n\none\n one\n two", " ".join(str(i) for i in range(3000)) + " 5 6 7 8 9 10 11 12 13"]


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    many, cover = Counter(windows), [False] * len(w)
    for k, x in enumerate(windows):
        if many[x] > 1:
            cover[k : k + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(cover)


def test_quality_measures(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None)], "doc_id long, text string, n_words string, kept int")
    got = quality_rules.judge(df.select("doc_id", "text")).collect()
    for r in got:
        m = measured(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept} and any(r.kept for r in got)
    assert quality_rules.keep_good(df.limit(0)).count() == 0


def water(sizes, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
    return target


def test_mixing(spark):
    data = [(i, " ".join(["w"] * (i * 7 % 23)) if i % 11 else None, ["b", "a", None, "ü", "Z", "empty"][i % 6] if i % 6 != 5 else "b", 1) for i in range(300)]
    data += [(999, "same text", "a", 1), (999, "same text", "a", 1), (None, "x y", "one", 1), (1000, "", "empty", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = mixing.mix_plan(df).collect()
    again = mixing.mix_plan(df.repartition(7)).collect()
    key = lambda rs: sorted(str((r.doc_id, r.source, r.size, r.taken)) for r in rs)
    assert key(got) == key(again)
    sizes = Counter()
    for _, t, s, _ in data:
        sizes[s] += len((t or "").split())
    target = water(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(data)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    kept = mixing.mix_rows(df)
    assert kept.columns == ["doc_id", "text", "source", "size", "epochs", "taken"]
    assert kept.count() == sum(r.taken > 0 for r in got)
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_mix_rows_of_repeated_rows(spark):
    data = [(7, "one two three", "a")] * 9 + [(None, "x y", s) for s in ("a", "b", "c") for _ in range(5)] + [(i, "w " * i, "b") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    total = lambda rows: Counter((r.source, r.taken) for r in rows if r.taken)
    assert total(mixing.mix_rows(df).collect()) == total(mixing.mix_plan(df).collect())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline(spark):
    """Each stage on what its predecessor kept, and the stages' decisions against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{k}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if k == 0:
            bad = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("NOT kept").select("doc_id").collect()}
            assert set(before) - set(after) == bad
        if k == 2:
            assert set(after) == set(before)
            owner = {}
            for i in sorted(before):
                w = WORD.findall(before[i])
                for j in range(len(w) - 12):
                    owner.setdefault(tuple(w[j : j + 13]), i)
            for i, t in before.items():
                w = WORD.findall(t)
                cut = [False] * len(w)
                for j in range(len(w) - 12):
                    if owner[tuple(w[j : j + 13])] < i:
                        cut[j : j + 13] = [True] * 13
                assert after[i] == (" ".join(x for x, c in zip(w, cut, strict=True) if not c) if any(cut) else t)
        if k < 4:
            assert docs.columns == columns
        before = after
    assert docs.columns == [*columns, "size", "epochs", "taken"]
    assert docs.filter(F.col("taken") > 2 * F.col("size")).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == len(before)
