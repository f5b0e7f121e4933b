"""Vector codes, shards of token ids and the source audit against brute force, libraries and SQL, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tessellate.llm import divergence, mpeg_audio, queries, re_pair, site_tree, token_files, vector_codes, word_bpe  # noqa: E402

from .test_operators import odd_texts, table  # noqa: E402

WORDS = "word_bpe_49k.json"


def lloyd(rows, parts=8, entries=16, rounds=6):
    """(code, error) of (vec_id, vector, label) rows by full scans in exact arithmetic."""
    rows = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    seeds = {}
    for i, v, _ in rows:
        if i is not None:
            seeds[i] = min(seeds.get(i, v), v)
    if not seeds:
        return [], []
    width = len(seeds[min(seeds)])
    rows = [r for r in rows if len(r[1]) == width]
    seeds = {i: min(v for j, v, _ in rows if j == i) for i in {r[0] for r in rows if r[0] is not None}}
    whole = lambda v: [math.floor(Fraction(x) * 4096) for x in v]
    cuts = [p * width // parts for p in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(cuts, cuts[1:])]
    data = [cut(whole(v)) for _, v, _ in rows]
    books = [[cut(whole(seeds[i]))[p] for i in sorted(seeds)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in data]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, c in zip(data, codes) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    return [(r[0], r[2], "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for r, c in zip(rows, assign())], books


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("codes", F.lit("x")).withColumn("vector", F.lit(1))


def f32(values):
    return [float(np.float32(x)) for x in values]


def vector_cases():
    rnd = random.Random(7)
    plain = [(i, f32(rnd.gauss(0, 0.2) for _ in range(16)), rnd.choice([None, 1, 2])) for i in range(120)]
    grid = [(i, f32(rnd.choice([0, 0.25, 0.5]) for _ in range(16)), 1) for i in range(90)]  # ties
    odd = [(None, plain[0][1], 1), (3, None, 1), (4, [1.0, None] * 8, 1), (5, [math.nan] * 16, 1), (6, [math.inf] * 16, None), (7, [], 1), (8, [1.0] * 9, 2), *plain[10:30], *plain[10:30], (10, plain[40][1], 5)]
    huge = [(i, f32(rnd.choice([3e38, -3e38, 1e-30, 7.5, 1e20]) for _ in range(16)), 1) for i in range(40)]
    return {"plain": plain, "grid": grid, "odd": odd, "same": [(i, plain[0][1], 1) for i in range(40)], "few": plain[:3], "uneven": [(i, v[:11], x) for i, v, x in plain[:50]], "short": [(i, v[:3], x) for i, v, x in plain[:50]], "huge": huge + plain[:30], "empty": [], "no ids": [(None, plain[0][1], 1)]}


@pytest.mark.parametrize("case", vector_cases())
def test_codes_are_those_of_full_scans(spark, case):
    rows = vector_cases()[case]
    want, books = lloyd(rows)
    got = vector_codes.digests(vectors(spark, rows)).collect()
    by_label = Counter()
    for _, label, _, error in want:
        by_label[label] += error
    most = 2**63 - 1
    if case != "huge":
        assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter((i, code, min(e, most), by_label[lab]) for i, lab, code, e in want)
    else:
        assert Counter((r.vec_id, r.code) for r in got) == Counter((i, code) for i, _, code, _ in want)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} <= {sha}


def test_bounds_save_scans_and_never_decide_a_tie():
    rnd = np.random.default_rng(3)
    rows = rnd.integers(0, 6, (4000, 4))
    books = vector_codes.Codebooks([rnd.integers(0, 6, (9, 4))], [0, 4])
    codes, upper, lower = np.zeros(len(rows), np.int64), np.full(len(rows), 2**60), np.zeros(len(rows), np.int64)
    scanned = []
    for _ in range(8):
        scanned.append(books.assign(0, rows, codes, upper, lower, books.halves()[0]))
        far = ((rows[:, None] - books.entries[0][None]) ** 2).sum(2)
        assert (codes == far.argmin(1)).all()
        best, second = far.min(1), np.sort(far, 1)[:, 1]
        assert (upper**2 >= best).all() and (lower**2 <= second).all()
        new = books.entries[0].copy()
        for k in range(9):
            if (codes == k).any():
                new[k] = rows[codes == k].sum(0) // (codes == k).sum()
        moved = vector_codes.Codebooks([new], [0, 4])
        own, others = moved.moves(books)
        upper, lower, books = upper + own[0][codes], np.maximum(lower - others[0][codes], 0), moved
    wide = np.concatenate([rnd.integers(-9, 9, (500, 4)) + 1000 * k for k in range(5)])
    books = vector_codes.Codebooks([wide[::500].copy()], [0, 4])
    codes, upper, lower = np.zeros(len(wide), np.int64), np.full(len(wide), 2**60), np.zeros(len(wide), np.int64)
    assert books.assign(0, wide, codes, upper, lower, books.halves()[0]) == 2000  # the first entry's own are nearer to it than half the way to any other
    assert books.assign(0, wide, codes, upper, lower, books.halves()[0]) == 0


def test_decoded_vectors_are_their_entries(spark):
    rows = vector_cases()["plain"]
    found = vector_codes.coded(vectors(spark, rows))
    for r in vector_codes.decoded(found.rows, found.books).collect():
        want = [x / 4096 for p, k in enumerate(r.codes) for x in found.books.entries[p][k].tolist()]
        assert r.vector_ == want


def test_grammars_are_lossless_and_leave_no_frequent_pair():
    rnd = np.random.default_rng(1)
    for _ in range(150):
        parts = [rnd.integers(0, rnd.integers(1, 5), rnd.integers(0, 60)) for _ in range(rnd.integers(0, 6))]
        ids = np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
        ends, least = np.cumsum([len(p) for p in parts]).astype(np.int64), int(rnd.integers(2, 6))
        shard = re_pair.Shard.from_bytes(re_pair.compressed(ids, ends, least).to_bytes())
        out, out_ends = shard.decoded()
        assert out.tolist() == ids.tolist() and out_ends.tolist() == ends.tolist()
        for k, p in enumerate(parts):
            a, b = sorted(rnd.integers(0, len(p) + 1, 2))
            assert shard.ids(k, a, b).tolist() == p[a:b].tolist() and shard.ids(k).tolist() == p.tolist()
        left, low = Counter(), 0
        for high in shard.ends:
            own, low = shard.symbols[low:high].tolist(), high
            seen = {}
            for i, pair in enumerate(zip(own, own[1:])):
                if pair[0] != pair[1] or seen.get(pair) != i - 1:
                    left[pair] += 1
                    seen[pair] = i
        assert all(n < least for n in left.values())


def test_repeats_become_rules():
    ids = np.tile(np.arange(50, dtype=np.uint32), 2000)
    shard = re_pair.compressed(ids, np.array([len(ids)]))
    assert len(shard.to_bytes()) < len(ids) // 100 and shard.lengths.max() >= 50
    assert shard.ids(0, 4321, 4330).tolist() == ids[4321:4330].tolist()
    with pytest.raises(ValueError):
        re_pair.Shard.from_bytes(b"x" * 64)


def check_files(spark, docs, texts_by_row, monkeypatch=None):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(WORDS))
    shards = token_files.written(docs, public_tokenizers.path(WORDS), end=1)
    got = token_files.read(shards, digest=True).collect()
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in texts_by_row for x in [lib.encode(t or "", add_special_tokens=False).ids + [1]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    whole = {r.start: r.ids for r in token_files.read(shards).collect()}
    assert all(zlib.crc32(np.array(whole[r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)
    return shards, got


def test_files_hold_the_librarys_ids(spark):
    texts = odd_texts(seed=12)
    shards, got = check_files(spark, table(spark, texts), list(enumerate(texts)))
    whole = {r.doc_id: r.ids for r in token_files.read(shards).collect()}
    wanted = spark.createDataFrame([(i, i % 7, i % 7 + i % 11) for i in range(0, 400, 3)], "doc_id long, first long, last long")
    spans = token_files.spans(shards, wanted).collect()
    assert {r.doc_id for r in spans} == {i for i in range(0, 400, 3) if i < len(texts)}
    assert all(r.ids == whole[r.doc_id][r.first : r.last] for r in spans)


def test_files_of_repeated_and_null_ids(spark):
    rows = [(5, "hello world")] * 40 + [(5, f"other {k}") for k in range(30)] + [(None, None), (None, "x"), (2, ""), (9, "word " * 30000)]
    check_files(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.written(empty, public_tokenizers.path(WORDS), end=1), digest=True).count() == 0


def test_many_shards_of_a_range(spark, monkeypatch):
    rnd = random.Random(5)
    words = [chr(97 + i % 26) * (1 + i % 4) for i in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 400)))) for i in range(200)]
    ids, ends = word_bpe.encoded(word_bpe.word_ids(public_tokenizers.path(WORDS)), __import__("pyarrow").array([t for _, t in rows]), 1)
    monkeypatch.setattr(token_files, "SHARD_IDS", 1000)
    cuts = token_files._cuts(ends)
    assert len(cuts) > 20 and cuts[0] == 0 and cuts[-1] == len(rows)
    assert all(b - a == 1 or ends[b - 1] - (ends[a - 1] if a else 0) <= 1000 for a, b in zip(cuts, cuts[1:]))


def audit_sql(docs, least):
    con = duckdb.connect()
    con.register("docs_", docs)
    con.sql("CREATE VIEW documents AS SELECT * FROM docs_")
    return con.sql(queries.ORACLE["op13_divergence"].replace(">= 30", f">= {least}")).fetchall()


def test_audit_matches_sql_and_hand_figures(spark):
    import pandas as pd

    rnd = random.Random(2)
    words = ["alpha", "BETA", "beta", "Élan", "élan", "x1y", "日本", "q", "zz", "-", "A_b"]
    rows = [(i, " ".join(rnd.choices(words, weights=range(1, 12), k=rnd.randint(0, 30))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "S2", "é", None, ""])) for i in range(300)]
    rows += [(0, None, "fr", "only"), (0, None, "it", "a"), (0, "", "it", "b"), (1, "lone words here", "nl", "x"), (1, "lone words here", "nl", "x")] + [(7, "same text again", "en", "s1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS term", "3 AS number", "4 AS kept", "5 AS a")
    got = [tuple(r) for r in divergence.audited(docs, least=5).select("lang", "source", "part", "item", "value", "rank").collect()]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    assert sorted(got) == sorted(audit_sql(frame, 5))
    assert [r for r in got if r[0] == "it"] and {r[4] for r in got if r[0] == "it"} == {0}
    assert not [r for r in got if r[0] == "fr"]
    assert divergence.audited(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "a a b", "l", "s"), (2, "a", "l", "t")], "doc_id long, text string, lang string, source string")
    found = {(r.source, r.part, r.item): r.value for r in divergence.audited(two, least=1).collect()}
    p = lambda c, n: 1 + 10**9 * (c + 5) // (n + 10)  # noqa: E731  two terms are kept
    assert found["s", "pair", "t"] == abs(p(2, 3) - p(1, 1)) + abs(p(1, 3) - p(0, 1)) == found["t", "pair", "s"]
    assert found["s", "term", "b"] == p(1, 3) - p(1, 4) and ("t", "term", "a") not in found


def test_tasks_hand_counts_on(spark, monkeypatch):
    rows = [(i, f"w{chr(97 + i % 26)} common " * (i % 5), "en", f"s{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = sorted(map(tuple, divergence.counted(docs).collect()), key=str)
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(map(tuple, divergence.counted(docs).collect()), key=str) == whole


def test_rates_are_exact(spark):
    cases = [(0, 0, 1), (5, 9, 3), (10**14, 10**15, 7), (123456789012, 987654321098765, 10**6), (9 * 10**14, 9 * 10**14, 1)]
    rows = spark.createDataFrame(cases, "n long, total long, kept long").select("*", divergence.rate(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 5) // (r.total + 5 * r.kept) for r in rows)


def pages_of_hosts(spark, hosts):
    rows = [(10 * h + k, f"https://h{h}.com/{k}", page) for h, pages in enumerate(hosts) for k, page in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


@pytest.mark.parametrize("page,text", [
    ("<div>" * 50 + "<article>text</article><nav>menu</nav><div class=comments>spam</div><p hidden>secret</p>", "text"),
    ("<div class=x>" * 300 + "<p>deep</p><div class=sidebar>side</div>", "deep"),
    ("<script src=/a/>var a=1;</script><p>body</p>", "body"), ("<nav data-x=/menu/>menu</nav><p>body</p>", "body"), ("<style media=/x/>p{}</style>y", "y"), ("<p>a</p><svg/><p>b</p>", "a b"),
    ("<article>teaser</article><p>long real story outside</p>", "teaser long real story outside"), ("<article>the long story itself</article><p>outside</p>", "the long story itself"),
])
def test_markup_of_a_page(page, text):
    assert site_tree.main_text(site_tree.Reader(), page) == text


def removal(rows):
    """(cut, turned, alike) of one host from its tree, in plain Python."""
    by = {r.node: r for r in rows}
    inside, outside = sum(r.chars for r in rows if r.main is not None), sum(r.chars for r in rows if not r.low and r.main is None and r.importance >= site_tree.VARIES)
    plain = sum(r.chars for r in rows if not r.low and (r.main is not None or r.importance >= site_tree.LEAST))
    lowly = sum(r.chars for r in rows if r.low and r.importance >= site_tree.VARIES)
    turned, cut, alike = plain < site_tree.ELSEWHERE * (plain + lowly), set(), set()
    for r in rows:
        if r.node == 0 or r.pages < site_tree.LEAST_PAGES:
            continue
        most = max(r.importance, r.best)
        if r.low:
            if turned and r.importance < site_tree.VARIES:
                alike.add(r.node)
        elif r.main is None:
            if most < site_tree.LEAST:
                cut.add(r.node)
        elif r.node == r.main:
            if most < site_tree.LEAST_MAIN and outside > inside:
                cut.add(r.node)
        elif most < site_tree.LEAST_MAIN and by[r.main].importance >= site_tree.VARIES:
            cut.add(r.node)
    return cut, turned, alike


def test_removed_branches_are_those_of_the_rules(spark):
    rnd, hosts = random.Random(11), []
    for h in range(7):
        fixed, parts = [f"same {k} words here" for k in range(4)], ["div", "section", "p", "ul", "article" if h % 2 else "main"]
        pages = []
        for k in range(8):
            body = "".join(f"<{t} class=c{rnd.randrange(3)}>{rnd.choice(fixed) if rnd.random() < 0.6 else f'own {k} {rnd.random()}'}<p>{rnd.choice(fixed)}</p></{t}>" for t in rnd.choices(parts, k=4))
            side = f"<div class=sidebar><p>{'side ' + str(rnd.random()) * (h > 3)}</p></div><footer>foot</footer>"
            pages.append(f"<html><body>{'' if h == 5 else body}{side}</body></html>")
        hosts.append(pages)
    pages, rows = pages_of_hosts(spark, hosts)
    tree = {}
    for r in site_tree.site_trees(pages).collect():
        tree.setdefault(r.host, []).append(r)
    said = {r.host: (set(r.cut), r.turned, set(r.alike)) for r in site_tree.verdicts(site_tree.site_trees(pages)).collect()}
    want = {h: removal(rs) for h, rs in tree.items()}
    assert {h: v for h, v in want.items() if v[0] or v[1]} == {h: v for h, v in said.items()}
    assert any(v[0] for v in want.values()) and any(v[1] for v in want.values())
    texts = {r.page_id: r.text for r in site_tree.extracted(pages).collect()}
    for i, url, html in rows:
        cut, turned, alike = want[url[8 : url.index("/", 8)]]
        kept = [b for b in site_tree.Reader().read(html)[1] if not any(n in cut for n in b.node.chain) and not (b.node.low and (not turned or any(n in alike for n in b.node.chain)))]
        part = [b for b in kept if b.node.main is not None]
        part = part if 2 * sum(len(b.text) for b in part) >= sum(len(b.text) for b in kept) else kept
        assert texts[i] == " ".join(b.text for b in part)


def test_a_column_of_the_name_stays(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    media = mpeg_audio.stored_texts(docs, "text", "doc_id").withColumn("index", F.lit("mine"))
    got = mpeg_audio.indexed(media).collect()
    assert [r["index"] for r in got] == ["mine", "mine"] and all(r["index_"].n_frames > 0 for r in got)
