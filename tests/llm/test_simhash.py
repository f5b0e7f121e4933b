import numpy as np
import pytest
import xxhash

from tessellate.llm import simhash as S


def brute(texts, k=3, t=3):
    fps = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= t:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return fps, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("width", [7, 8, 16, 21, 32])
def test_anchors_cover(width):
    rng = np.random.default_rng(width)
    x = rng.integers(0, 2**width, 300, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, width, 300).astype(np.uint64))
    a, b = ({}, {})
    for into, v in ((a, x), (b, y)):
        for r, k in zip(*S.anchors(v, width)):
            into.setdefault(int(r), set()).add(int(k))
            assert bin(int(k) ^ int(v[r])).count("1") <= 2
    assert all(a[i] & b[i] and a[i] & a[i] for i in range(300))


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(150)]
    for i in range(150):  # near copies
        w = texts[i].split()
        w[-1] = "changed"
        texts += [" ".join(w)]
    texts += [None, "", "  \n", "Ä b", "ä b", "A B C", "a b c", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id", "0 as key")
    fps, comp = brute(texts)
    got = {r.doc_id: r for r in S.near_duplicates(df, shingle=3).collect()}
    assert len(got) == len(texts)
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == comp


def test_hot_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    for x in [base] * 3:
        for _ in range(200):
            x = x ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    root = {int(v): int(v) for v in fps.view(np.int64)}

    def find(r, i):
        while r[i] != i:
            i = r[i]
        return i

    def groups(pairs):
        r = dict(root)
        for a, b in pairs:
            a, b = sorted((find(r, a), find(r, b)))
            r[b] = a
        return [find(r, int(v)) for v in fps.view(np.int64)]

    true = [(int(a), int(b)) for i, a in enumerate(fps.view(np.int64)) for b in fps.view(np.int64)[:i] if bin((int(a) ^ int(b)) % 2**64).count("1") <= 3]
    for bucket in (2, 4, 4096):
        assert groups([tuple(r) for r in S.links(df, 3, bucket).collect()]) == groups(true)


def test_hot_buckets_at_a_wider_distance(spark):
    rng = np.random.default_rng(5)
    fps = {int(rng.integers(0, 2**62))}
    for _ in range(3):
        x = min(fps)
        for _ in range(60):
            for bit in rng.integers(0, 64, 3):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in fps], "fp long")

    def groups(pairs):
        root = {v: v for v in fps}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(v) for v in fps]

    true = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % 2**64).bit_count() <= 5]
    for bucket in (2, 4, 4096):
        assert groups([tuple(r) for r in S.links(df, 5, bucket).collect()]) == groups(true)


def test_empty_nulls_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).collect() == []
    df = spark.createDataFrame([(None, None), (None, "x y z"), (5, ""), (5, ""), (7, "a" * 50000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp == 0, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, True, 5), (None, False, None), (5, True, 5), (5, True, 5), (7, False, 7)], key=str)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for n, m, both in ((10, 12, 5), (900, 1000, 850), (3000, 3100, 2900), (5000, 900, 300), (0, 5, 0)):
        x = rng.integers(0, 1 << 63, n + m - both).astype(np.int64)
        a, b = S.sketch(np.sort(x[:n])), S.sketch(np.sort(x[n - both :]))
        size = min(len(a), len(b))
        for s in {size, 128}:
            assert np.bitwise_count(S.folded(a, s) ^ S.folded(b, s)).sum() <= n + m - 2 * both
