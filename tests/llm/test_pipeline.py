"""The pipeline on a small corpus, against brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tessellate.llm import simhash  # noqa: E402


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_kept(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both and both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(texts))}


def corpus():
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("rn", "st", "lm", "ck", "nd", "mp")]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(90, 200))) for _ in range(60)]
    for t in texts[:40]:  # near copies, and some that are only related
        w = t.split()
        for _ in range(rnd.choice([1, 1, 2, 12])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    return texts + texts[:5] + [t.upper().replace(" ", "  ") for t in texts[5:8]]


def test_one_of_each_against_brute_force(spark):
    texts = corpus() + ["", None, " ", "two words", "Two  words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as node", "2 as first", "'y' as _fp", "'z' as _node", "'w' as _row", "3 as `_ROW_`")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == brute_kept(texts)


def kept_by(spark, texts):
    return {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_short_near_copies_link(spark):
    texts = []
    for n in (20, 25, 30, 40, 60):
        for k in range(20):
            w = [f"t{n}x{k}y{i}" for i in range(n)]
            texts += [" ".join(w), " ".join([*w[:-1], "changed"])]
    assert kept_by(spark, texts) == brute_kept(texts) == set(range(0, len(texts), 2))


def test_large_families_are_exact(spark, monkeypatch):
    rnd = random.Random(21)
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(120):  # some within reach of many, some of a few, some of none
            w = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3, 4])):
                w[rnd.randrange(len(w))] = f"r{rnd.randrange(10**9)}"
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    want = brute_kept(texts)
    assert kept_by(spark, texts) == want
    for name, value in (("HOT", 4), ("CHUNK", 16), ("LEADERS", 2)):
        monkeypatch.setattr(simhash, name, value)
    assert kept_by(spark, texts) == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, None), (None, "c")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()), key=str) == sorted([(3, "a b"), (4, None), (None, "c")], key=str)
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_clashing_columns_come_back(spark, tmp_path):
    rows = [(i, f"words that say nothing much number {i} of the lot", "en") for i in range(8)] + [(9, None, None), (None, "the last one of the words", "en"), (3, "words again", "en"), (3, "words again", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as _toxicity", "'b' as _speaks", "'c' as _fp", "'d' as _node", "'e' as _row", "'f' as score")
    spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:3]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        found = now.collect()
        assert all((r._toxicity, r._speaks, r._fp, r._node, r._row, r.score) == tuple("abcdef") for r in found)
        assert len(found) <= table.count() and (bool(found) == (table is docs))
        packed = corpus_pipeline.STAGES[3][1](spark, now, str(tmp_path))
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in found}


def test_stages(spark, tmp_path):
    texts = corpus()
    rnd = random.Random(12)
    toxic = [" ".join([*t.split()[:40], *rnd.choices(["vilest", "vileness", "vilely"], k=4), *t.split()[40:]]) for t in texts[:30]]
    rows = [(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)] + [(1000 + i, t, "xx", "s", len(t)) for i, t in enumerate(toxic)] + [(2000, "12 34 !!", "xx", "s", 8), (2001, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, int(1000 <= r[0] < 2000)) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 3:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids = {r[0] for r in now.select("doc_id").collect()}
        if k == 0:
            assert ids == {r[0] for r in rows if not 1000 <= r[0] < 2000}
        elif k == 1:
            assert ids == set(range(len(texts)))
        else:
            assert ids == brute_kept(texts)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(final.collect(), key=str) == sorted(now.collect(), key=str)
