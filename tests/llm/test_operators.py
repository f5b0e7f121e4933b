"""The corpus operators against libraries, brute force and exact round trips, and on odd tables."""

import gzip
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tessellate.llm import language_id, mpeg_audio, packing, piece_bpe, quality, queries, sharding, site_tree, token_count, toxicity, word_bpe  # noqa: E402

ODD = [None, "", " ", "\n\n", "a", "a", "  two  spaces\tand\ttabs \n", "ﬁ Å é 　x ▁y", "日本語🎉" * 50, "a\x00b\x1cc\x85d\xa0e", "<s>x</s><unk><|endoftext|> y \n<|endoftext|>", " " * 700 + "the", "x" * 3000, "the idiot " * 2000, "don't we'll ΣΑΣ 12 345"]


def table(spark, texts, extra="'x' AS ids, 1 AS score, 2 AS size, 3 AS shard, 4 AS n_bytes, 5 AS length, 6 AS media, 7 AS rank, 8 AS words"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", *(x.strip() for x in extra.split(",")))


def odd_texts(n=300, seed=0):
    rnd = random.Random(seed)
    parts = list("  \n\tabcdeh▁éüßΣ日🎉\x00\x1c\xa0'.,!") + ["hello", " world", " the", "ing", "<|endoftext|>", "<|startoftext|>", "12"]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pieces_are_the_librarys(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = SentencePieceProcessor(model_file=path), piece_bpe.codec(path)
    texts = odd_texts()
    for t in texts:
        ids = lib.encode(t or "")
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids)
    got = {r.doc_id: r for r in piece_bpe.digests(table(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    rows = {r.doc_id: r for r in piece_bpe.encoded(table(spark, texts[:20]), path).collect()}
    assert all(rows[i].ids == lib.encode(t or "") for i, t in enumerate(texts[:20]))


def test_broken_byte_pieces_decode_like_the_library():
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = SentencePieceProcessor(model_file=path), piece_bpe.codec(path)
    for ids in ([], [3 + 0x41], [3 + 0xE6, 3 + 0x97, 3 + 0xA5], [264, 264], [28705, 264], [1, 264, 2]):
        assert own.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path, texts = public_tokenizers.path(name), odd_texts(seed=1)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    else:
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        want = [len(lib.encode(t or "")) for t in texts]
    got = {r.doc_id: r for r in token_count.token_counts(table(spark, texts), path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]


def test_word_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(41)
    lib, own = Tokenizer.from_file(path), word_bpe.WordIds(path)
    letters = "aaeeinrstthoüéñÇßİĀſµª0129.,;!?<>|-_&''"
    entries = [t.removesuffix("</w>") for t in lib.get_vocab()]
    words = ["".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(3000)] + [rnd.choice(entries) + rnd.choice(entries) for _ in range(3000)]
    words += ["don't", "WE'LL", "'S", "x'Sy", "<|endoftext|>", "a<|endoftext|>b", "<|endof", "\x01", "a\x01b", "ΣΑΣ", "Å", "e\u0301", "long" * 40]
    assert own.encoded(words) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(words, add_special_tokens=False)]
    texts = [" ".join(rnd.choices(words, k=200)) for _ in range(40)] + odd_texts(100)
    for low in range(0, len(texts), 7):
        part = texts[low : low + 7]
        ids, ends = word_bpe.encoded(own, pa.array([t or "" for t in part]), 7)
        got = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert got == [[*lib.encode(t or "", add_special_tokens=False).ids, 7] for t in part] and ends[-1] == len(ids)
    assert not word_bpe.reached(["a", "b"], {}) and word_bpe.reached(["a", "b", "c"], {("b", "c"): 0, ("a", "bc"): 1})
    with pytest.raises(ValueError):
        word_bpe.PlainWords({"a": 0}, [])


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("word_bpe_49k.json"), odd_texts(seed=2) + ["word " * 9000, "word " * 4095, None, None]
    lib = Tokenizer.from_file(path)
    rows = packing.packed(table(spark, texts), path).collect()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by) == -(-total // 4096)


def test_fill_is_the_best_sum():
    rnd = random.Random(4)
    for _ in range(60):
        left = {rnd.randint(1, 60): rnd.randint(1, 4) for _ in range(rnd.randint(1, 7))}
        cap = rnd.randint(1, 150)
        sums = {0}
        for s, n in left.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        got = packing.fill(cap, left, sorted(left))
        assert sum(s * k for s, k in got.items()) == max(x for x in sums if x <= cap)
        assert all(k <= left[s] for s, k in got.items())


def test_plan_uses_every_piece_once():
    counts = {int(s): int(n) for s, n in zip(range(1, 4097, 7), np.random.default_rng(0).integers(1, 10**6, 600))}
    used = {}
    for _, times, chosen in packing.plan(counts):
        assert sum(s * k for s, k in chosen.items()) <= 4096
        for s, k in chosen.items():
            used[s] = used.get(s, 0) + k * times
    assert used == counts


def test_shards(spark):
    rnd = random.Random(5)
    texts = ["t" * rnd.randint(1, 400) + str(i) for i in range(400)] + ["same text " * 20] * 20 + [None, "", None]
    rows = sharding.sharded(table(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    by = {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        assert by.setdefault(t, r.shard) == r.shard
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
    assert max(sums) - min(sums) <= 0.02 * sum(sums) / 16


def test_differencing_is_tight_and_whole():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10**6, 3000).tolist()
    part = sharding.differencing(sizes, 16)
    sums = np.bincount(part, sizes, 16)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() < 1000
    assert sharding.differencing([], 16) == [] and sharding.differencing([5], 16) == [0] and set(sharding.differencing([3, 3], 1)) == {0}


def test_audio_round_trip(spark):
    texts = odd_texts(40) + ["long " * 30000]
    rows = {r.doc_id: r for r in mpeg_audio.digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = mpeg_audio.carry(padded)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        x = mpeg_audio.parse(media)
        assert x.skipped == 0 and x.broken == 0 and x.checked == len(x.frames) + 1 and x.table["frames"] == len(x.frames) and x.samples == 1152 * len(x.frames)
    media = mpeg_audio.stored_texts(table(spark, texts))
    index = {r.doc_id: r["index"] for r in mpeg_audio.indexed(media).collect()}
    assert all(list(index[i].seek) == mpeg_audio.parse(mpeg_audio.carry(mpeg_audio.padded(t))).frames for i, t in enumerate(texts))


def test_audio_resynchronises():
    media = mpeg_audio.carry(b"payload " * 1000)
    whole = mpeg_audio.parse(media)
    cut = media[: whole.frames[2]] + b"\xff\xfb junk \xff" + media[whole.frames[2] :] + b"TAG" + b"title".ljust(125, b"\0")
    x = mpeg_audio.parse(cut)
    assert len(x.frames) >= len(whole.frames) - 1 and x.skipped > 0 and x.tags["TAG"] == "title"
    spoiled = bytearray(media)
    spoiled[whole.frames[0] + 7] ^= 1
    assert mpeg_audio.parse(bytes(spoiled)).broken == 1
    for data in (None, b"", b"\xff" * 500, b"ID3", gzip.compress(b"x" * 999)):
        assert mpeg_audio.parse(data).frames == []
    vbri = bytearray(media)
    assert mpeg_audio._table(b"\xff\xfb\x90\xc0" + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">IIHHHH", 99, 7, 1, 1, 2, 5) + b"\0\3" + bytes(20), 0, mpeg_audio.header(b"\xff\xfb\x90\xc0"))["seek"] == [3]
    assert vbri == media


def brute_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_audio_tag_letters_in_the_payload():
    for n in range(129, 193):
        for k in range(0, n - 3):
            raw = mpeg_audio.padded("x" * k + "TAG" + "y" * (n - k - 3))
            media = mpeg_audio.carry(raw)
            x = mpeg_audio.parse(media)
            assert mpeg_audio.payload(media, x) == raw and x.skipped == 0 and "TAG" not in x.tags
    media = mpeg_audio.carry(b"payload " * 100)
    tagged = mpeg_audio.parse(media + b"TAG" + b"A title".ljust(125, b"\0"))
    assert tagged.tags["TAG"] == "A title" and tagged.frames == mpeg_audio.parse(media).frames
    cut = mpeg_audio.parse(media[:-9] + b"TAG" + b"A title".ljust(125, b"\0"))
    assert cut.tags["TAG"] == "A title" and cut.frames == tagged.frames[:-1]


def test_quality_ledger(spark):
    rnd = random.Random(6)
    texts = odd_texts(100) + [" ".join(rnd.choice("abc") for _ in range(n)) for n in range(0, 60, 2)] + ["x y\nx y\n \nx y\n"]
    book = quality.ledger(table(spark, texts))
    for r in book.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
        assert bool(r.failed & 3) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    rows = book.collect()
    for a in quality.ablations(book).collect():
        mask = next(p.mask for p in quality.POLICIES if (p.name, p.version) == (a.policy, a.version))
        bit = next(1 << r.bit for r in quality.RULES if r.name == a.rule)
        assert (a.n_docs, a.n_rejected, a.n_failing, a.n_by_this_alone) == (len(rows), sum(r.failed & mask != 0 for r in rows), sum(r.failed & bit != 0 for r in rows), sum(r.failed & mask == bit for r in rows))


def test_segments_are_all_maximal():
    rnd = random.Random(7)

    def brute(x):  # of the best segment, then of what lies left and right of it
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
        if best is None or best[0] <= 1e-9:
            return []
        i, j = best[3:]
        return brute(x[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in brute(x[j:])]

    for _ in range(150):
        x = [round(rnd.uniform(0.1, 3) if rnd.random() < 0.4 else -rnd.uniform(0.1, 2), 3) for _ in range(rnd.randint(0, 24))]
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == brute(x)
        assert all(s == pytest.approx(sum(x[a : b + 1])) for a, b, s in toxicity.segments(x))


def test_toxicity_learns_and_finds(spark):
    rnd = random.Random(8)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows = []
    for i in range(400):
        text = rnd.choices(words, k=60)
        if i % 4 == 0:
            text[20:20] = [f"vile{rnd.choice(['', 'ness', 'st', 'ly'])}" for _ in range(3)]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(None, None), (900, None), (901, ""), (902, "vilesome vilest vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all((got[a].score >= 0.5) == bool(c) for a, _, c in rows)
    assert got[902].score > 0.5 and got[901].score < 0.5 and got[900].score == got[901].score and got[None].n_segments == 0
    text = rows[0][1]
    assert all("vile" in text[p.begin : p.end] for p in got[0].passages)
    blank = toxicity.trained(docs, labels.filter("toxic = 0"), F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, blank).collect())
    assert toxicity.scored(docs.limit(0), blank).collect() == []


def common_toxicity(share, copies):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("bcdfgklmnprst", k=6)) for _ in range(200)]
    texts = [(" ".join([*rnd.choices(words, k=30), *(rnd.choices(["vilest", "vileness"], k=3) if k < share * 300 else []), *rnd.choices(words, k=30)]), int(k < share * 300)) for k in range(300)]
    return texts + [next(t for t in texts if t[1])] * copies


@pytest.mark.parametrize(("share", "copies"), [(0.4, 0), (0.6, 0), (0.1, 400)])
def test_toxicity_at_a_high_rate(spark, share, copies):
    rows = [(i, *r) for i, r in enumerate(common_toxicity(share, copies))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.trained(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    assert [int(model.probability(model.evidence(t)[0]) >= 0.5) for _, t, _ in rows] == [x for _, _, x in rows]
    assert abs(model.rate - share) < 0.03  # of the three quarters that the scores are counted on


def test_code_lengths_by_hand():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abc ") for _ in range(80)).encode() for _ in range(3)]
    key, n = np.unique(language_id.grams(texts)[1], return_counts=True)
    tree = language_id.Tree.of(key, n.astype(float))
    counts = [{} for _ in range(language_id.ORDER + 1)]
    for t in texts:
        padded = bytes(language_id.ORDER) + t
        for i in range(language_id.ORDER, len(padded)):
            for k in range(language_id.ORDER + 1):
                counts[k].setdefault(padded[i - k : i], {}).setdefault(padded[i], 0)
                counts[k][padded[i - k : i]][padded[i]] += 1

    def bits(context, byte):
        out = 0.0
        for k in range(language_id.ORDER, -1, -1):
            seen = counts[k].get(context[len(context) - k :])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                return out - np.log2(seen[byte] / total)
            out -= np.log2(len(seen) / total)
        return out + 8

    probe = [b"abcab zz ca", b"", b"qqq"]
    owner, key = language_id.grams(probe)
    got = np.bincount(owner, tree.bits(key), len(probe)) if len(key) else np.zeros(3)
    want = [sum(bits((bytes(4) + t)[i : i + 4], t[i]) for i in range(len(t))) for t in probe]
    assert got == pytest.approx(want)


def test_languages(spark):
    rnd = random.Random(10)
    stems = {"xx": ["lorem", "dolor", "amet"], "yy": ["quick", "brown", "zephyr"]}
    rows = [(i, " ".join(rnd.choice(stems[k]) for _ in range(30)), k) for i in range(80) for k in ("xx", "yy")]
    rows = [(n, t, k) for n, (_, t, k) in enumerate(rows)] + [(500, None, "xx"), (501, "", "yy"), (502, "123 !", None), (None, "lorem amet dolor", None), (503, "zephyr brown", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'q' AS lang_pred")
    got = {r.doc_id: r for r in language_id.predicted(docs, language_id.trained(docs)).collect()}
    assert all(got[a].lang_pred == c for a, _, c in rows[:160])
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[None].lang_pred == "xx" and got[503].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.trained(docs.filter("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predicted(docs, none).collect()} == {"und"}


def test_a_language_of_one_short_text_is_learned(spark):
    rows = [(i, f"some english words again {i}", "en") for i in range(30)] + [(50, "abcdefgh", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.trained(docs).languages == ["en", "zz"]
    assert language_id.trained(docs, bound=1, most=20).languages == ["en", "zz"]  # however small the bounds
    same = spark.createDataFrame([(1, "abc", "y"), (2, "abc", "x")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predicted(same, language_id.trained(same)).collect()] == ["x", "x"]  # a tie
    none = language_id.trained(docs.limit(0))
    assert none.languages == [] and language_id.predicted(docs.limit(0), none).collect() == []


def test_least_counts():
    rows = [("a", 1, 100), ("a", 2, 30), ("a", 5, 3), ("b", 1, 4), ("c", 7, 50)]
    assert language_id._least_counts(rows, 40) == {"a": 2, "b": 1, "c": 7}


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href='/x'>Menu %d</a></nav><div class=\"ad\">Buy %d</div><article><h1>Head %d &amp; <b>bold</b></h1><p>One&nbsp;%d<br>two<p>three</p><div class='comments'>spam</div></article><div class='box'>All rights here</div><footer>&copy; x</footer></body></html>"


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.com/{i}", PAGE % (i, i, i, i)) for i in range(20)] + [(50, None, None), (51, "nohost", ""), (52, "http://z.io", "plain <b>te</b>xt"), (53, "http://z.io/a", "<p>" * 3000 + "deep"), (54, "http://z.io/b", "<script>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS host", "'z' AS text")
    got = {r.page_id: r.text for r in site_tree.extracted(pages).collect()}
    assert all(got[i] == f"Head {i} & bold One {i} two three" for i in range(20))
    assert (got[50], got[51], got[52], got[53], got[54]) == ("", "", "plain text", "deep", "")


def test_hidden_blocks_go_alone(spark):
    for order in (1, -1):
        parts = ["<p hidden>secret {0}</p>", "<p>seen {0}</p>", "<p style='display:none'>dark {0}</p>", "<p>read {0}</p>"][::order]
        pages = spark.createDataFrame([(i, f"https://h.example/{i}", "<article>" + "".join(parts).format(i) + "</article>") for i in range(6)], "page_id long, url string, html string")
        got = {r.page_id: r.text for r in site_tree.extracted(pages).collect()}
        assert got == {i: " ".join([f"seen {i}", f"read {i}"][::order]) for i in range(6)}


def pages_of(spark, pages, host="h.example"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")


def texts_of(spark, pages):
    return [r.text for r in sorted(site_tree.extracted(pages_of(spark, pages)).collect(), key=lambda r: r.page_id)]


def test_branch_without_variety_goes(spark):
    page = "<html><body><div class='box'>Same on every page<p>and <b>this</b></p></div><div class='story'>Text %d here</div></body></html>"
    assert texts_of(spark, [page % i for i in range(12)]) == [f"Text {i} here" for i in range(12)]


def test_entropy_overturns_class_words(spark):
    rnd = random.Random(31)
    story = lambda i: "".join(f"<p>Words {i} {k} {rnd.random()}</p>" for k in range(rnd.randint(2, 6)))
    pages = [f"<body><div class='top'>Welcome to us<p>Menu of the house</p></div><div class='sidebar-note'>{story(i)}</div></body>" for i in range(10)]
    want = [" ".join(re.findall("<p>(Words.*?)</p>", p)) for p in pages]
    assert texts_of(spark, pages) == want  # the neutral branch is alike and goes, the marked one varies and stays
    aside = [p.replace("<div class='sidebar-note'>", "<article><h1>T %d</h1></article><aside>" % i).replace("</p></div></body>", "</p></aside></body>") for i, p in enumerate(pages)]
    long = [p.replace("<h1>", "<h1>" + " ".join(f"long{i}x{k}" for k in range(60))) for i, p in enumerate(aside)]
    assert all("Words" not in t and "long" in t for t in texts_of(spark, long))  # with an article of its own the aside is one


def test_repeated_branches_of_articles_go(spark):
    pages = [f"<article><h1>Head {i}</h1><p>Body {i} says</p><div class='box'>Follow us for more</div></article>" for i in range(8)]
    assert texts_of(spark, pages) == [f"Head {i} Body {i} says" for i in range(8)]
    copies = ["<nav>x</nav><article><h1>One</h1><p>and the same</p></article>"] * 6
    assert texts_of(spark, copies) == ["One and the same"] * 6
    shell = [f"<main><p>Loading, please wait</p></main><div class='story'><p>The story {i}</p><p>goes on and on {i}</p></div>" for i in range(6)]
    assert texts_of(spark, shell) == [f"The story {i} goes on and on {i}" for i in range(6)]


def test_layout_words_and_wrappers(spark):
    for wrap in ("<body class='has-sidebar'>{}</body>", "<body><div id='search-results'>{}</div></body>", "<div class='with-comments'>{}</div>", "<div class='notice'><main>{}</main></div>"):
        pages = [wrap.format(f"<article><p>Text {i}</p></article>") for i in range(4)]
        assert texts_of(spark, pages) == [f"Text {i}" for i in range(4)], wrap


def test_importances_by_hand(spark):
    rnd = random.Random(32)
    pages = ["<div class='a'>" + "".join(f"<{t}>{rnd.choice('xyz')}{'<a href=q>link</a>' * rnd.randint(0, 1)}</{t}>" for t in rnd.choices(["p", "h2"], k=rnd.randint(1, 3))) + "</div>" for _ in range(20)]
    got = {r.path: r for r in site_tree.site_trees(pages_of(spark, pages)).collect()}

    def entropy(pages_with):  # value -> number of pages, as the definition has it
        m = len(set().union(*pages_with.values())) if pages_with else 0
        n = [len(p) for p in pages_with.values()]
        return 1.0 if m <= 1 else -sum(x * (math.log(x) - math.log(m)) for x in n) / (sum(n) * math.log(m))

    styles, contents, chars = {}, {}, {}
    for k, p in enumerate(pages):
        inner = re.findall(r"<(p|h2)>(.*?)</\1>", p)
        if inner:
            styles.setdefault("/div.a", {}).setdefault(tuple(t for t, _ in inner), set()).add(k)
        for t, text in inner:
            plain = text.replace("<a href=q>", "").replace("</a>", "")
            contents.setdefault(f"/div.a/{t}", {}).setdefault(plain, set()).add(k)
            c = chars.setdefault(f"/div.a/{t}", [0, 0])
            c[0], c[1] = c[0] + len(plain), c[1] + len(plain) - 1
            styles.setdefault(f"/div.a/{t}", {}).setdefault("#", set()).add(k)
    presentation = {x: entropy(v) for x, v in styles.items()}
    content = {x: entropy(v) * (1 - chars[x][1] / chars[x][0]) for x, v in contents.items()}
    told = {x: 1 - site_tree.GAMMA ** len(v) for x, v in styles.items()}
    for x in styles:
        assert got[x].presentation == pytest.approx(presentation[x])
    for x in contents:
        assert got[x].content == pytest.approx(content[x])
        assert got[x].importance == pytest.approx((told[x] * presentation[x] + content[x]) / (told[x] + 1))
    n = {x: got[x].pages for x in got}
    top = [(n["/div.a"], told["/div.a"], told["/div.a"] * presentation["/div.a"])] + [(n[x] * site_tree.GAMMA, told[x] + 1, told[x] * presentation[x] + content[x]) for x in contents]
    assert got["/div.a"].importance == pytest.approx(sum(w * v for w, _, v in top) / sum(w * a for w, a, _ in top))


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two words"), (None, None), (5, "one two words"), (5, "one two words"), (5, ""), (7, "ünï code<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS rest", "3 AS n", "4 AS pretoken", "5 AS node", "6 AS host")
    ids = sorted((r[0] for r in rows), key=str)
    found = {
        "pieces": piece_bpe.digests(docs, public_tokenizers.path("piece_bpe_32k.model")), "shards": sharding.sharded(docs), "quality": quality.ledger(docs), "audio": mpeg_audio.digests(docs),
        "tokens": token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), frequent=1), "packed": packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")),
        "toxic": toxicity.scored(docs, toxicity.Model({}, {}, {}, 0.5, 1.0)), "languages": language_id.predicted(docs, language_id.trained(docs.withColumn("lang", F.lit("q")))),
    }
    for name, df in found.items():
        assert sorted((r.doc_id for r in df.collect()), key=str) == ids, name
    counts = {(r.doc_id, r.n_bytes): r.n_tokens for r in found["tokens"].collect()}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(counts[k, len((t or "").encode())] == len(lib.encode(t or "", add_special_tokens=False).ids) for k, t in rows)
    pages = spark.createDataFrame([(None, None, "<p>x</p>"), (None, None, "<p>x</p>"), (1, "https://a.b/", None)], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.text) for r in site_tree.extracted(pages).collect()), key=str) == sorted([(None, "x"), (None, "x"), (1, "")], key=str)


def test_queries_without_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "some text here", "en"), (1, "more text there", "en"), (2, None, None)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op5_toxicity", "op9_language_id"):
        found = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(found) == 3 and all(r.held_out is not None for r in found)


def test_empty_tables(spark):
    docs = table(spark, ["x"]).limit(0)
    assert piece_bpe.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    assert packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert sharding.sharded(docs).collect() == []
    assert mpeg_audio.digests(docs).collect() == []
    assert token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    model = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.scored(docs, model).collect() == [] and language_id.trained(docs.withColumn("lang", F.lit("q"))).languages == []
    assert quality.ledger(docs).collect() == [] and language_id.predicted(docs, language_id.Model([], [])).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert site_tree.extracted(pages).collect() == []
