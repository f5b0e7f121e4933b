"""Near-duplicate groups by SimHash fingerprints and anchor-point covering.

Two 64-bit fingerprints link when they differ in at most ``distance`` bits.  The bits
are cut into pieces so that a linked pair differs in at most one bit of some piece.
The anchors of a piece are the words of a covering code of radius 1 (a perfect Hamming
code, times all values of the bits left over).  A fingerprint is replicated to every
anchor within covering radius + 1 = 2 of its piece; a pair within one bit there then
meets at the anchor nearest to either, and is compared in full.  Nothing is missed.

Only distinct fingerprints are replicated, so any number of equal texts is one row.
An anchor emits the edges of spanning trees, not its pairs.  An anchor with more than
``bucket`` fingerprints is dealt again by anchors over the remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, edges_of
from .storage import appended, bound_batches, fresh, stored

SHINGLE, DISTANCE, BUCKET, PAIRWISE = 5, 3, 4096, 16
#: Of one_of_each: texts of SIMILARITY or more link. A shingle of over HOT texts is dealt out in chunks of about CHUNK, of LEADERS at most;
#: a text that FAN or more are compared with is sent to several tasks.
SIMILARITY, HOT, CHUNK, LEADERS, FAN, SEEN, BITMAP = 0.8, 48, 1024, 64, 512, 1 << 17, 1 << 17
#: Shingles that ORDER_LEAST of about ORDER_TEXTS sampled texts hold come last in the order, ORDER_MOST of them at most; any order is exact.
ORDER_TEXTS, ORDER_LEAST, ORDER_MOST = 5_000, 3, 1 << 18
_CHUNK = 1 << 18


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of fewer words the whole sequence; of none nothing."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[shingle - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; of none 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included; no word: 0."""
    return _majority(_hashes(_words(text), shingle, seed))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long. A null text counts as empty; a null id keeps its row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def anchors(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): every anchor within distance 2 of each value of ``width`` bits."""
    r = (width + 1).bit_length() - 1
    length = 2**r - 1  # the Hamming code's bits; the others are free
    u = values.astype(np.uint64)
    syndrome = np.zeros(len(u), np.int64)
    for j in range(r):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, length + 1) if i >> j & 1))
        syndrome |= (np.bitwise_count(u & mask) & 1).astype(np.int64) << j
    free = [1 << i for i in range(length, width)]
    one, two = [0, *free], [0, *free, *(a | b for k, a in enumerate(free) for b in free[:k])]
    rows, found = [], []
    at = np.flatnonzero(syndrome == 0)
    for flip in two:
        rows.append(at), found.append(u[at] ^ np.uint64(flip))
    at = np.flatnonzero(syndrome)
    s = syndrome[at]
    nearest = u[at] ^ (np.uint64(1) << (s - 1).astype(np.uint64))
    for flip in one:
        rows.append(at), found.append(nearest ^ np.uint64(flip))
    for i in range(1, length + 1):  # two flips i and j with i ^ j the syndrome
        j = i ^ s
        ok = j > i
        rows.append(at[ok])
        found.append(u[at[ok]] ^ np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (j[ok] - 1).astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(found)


def _rotated(fp: np.ndarray, start: int) -> np.ndarray:
    start %= 64  # a piece of a region that runs over the last bit
    return fp if start == 0 else (fp >> np.uint64(start)) | (fp << np.uint64(64 - start))


def _mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key; two buckets under one key only bring pairs that the comparison rejects."""
    with np.errstate(over="ignore"):
        x = (key ^ (more * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0x94D049BB133111EB)


def _replicas(distance: int):
    """Rows (key, start, width, fp) of a bucket -> its fingerprints at the anchors of the region's pieces."""
    pieces = (distance + 2) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 8192):
                part = b.slice(low, 8192)
                key, start, width, fp = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                key, fp = key.view(np.uint64), fp.view(np.uint64)
                out = []
                for s, w in sorted({*zip(start.tolist(), width.tolist())}):
                    at = np.flatnonzero((start == s) & (width == w))
                    cuts = [w * k // pieces for k in range(pieces + 1)]
                    for lo, hi in zip(cuts, cuts[1:]):
                        value = _rotated(fp[at], s + lo) & np.uint64((1 << (hi - lo)) - 1)
                        row, anchor = anchors(value, hi - lo)
                        own = _mixed(_mixed(key[at][row], anchor), np.full(len(row), s + lo + 1, np.uint64))
                        # what is left to tell apart: the region without this piece, if it is in one part
                        rest = (s + hi) % 64, (w - hi + lo if w == 64 or pieces == 2 and lo == 0 else 0)
                        if pieces == 2 and lo and w < 64:
                            rest = s, lo
                        out.append((own, np.full(len(row), rest[0]), np.full(len(row), rest[1]), fp[at][row]))
                if out:
                    k, s, w, f = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k.view(np.int64)), pa.array(s.astype(np.int16)), pa.array(w.astype(np.int16)), pa.array(f.view(np.int64))],
                        ["key", "start", "width", "fp"],
                    )

    return run


def spanning_edges(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of spanning forests of the graph in which fingerprints within ``distance`` bits link.

    Breadth first: each visited one is compared with all not yet reached.
    """
    left, right, rest = [], [], fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                hit = rest[near]
                left.append(np.full(len(hit), x, np.uint64)), right.append(hit)
                queue.extend(hit)
                rest = rest[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(key: np.ndarray, fp: np.ndarray, distance: int, pairwise: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the runs of equal keys."""
    if not len(key):
        return fp, fp
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    left, right = [fp[:0]], [fp[:0]]
    small = np.repeat(size <= pairwise, size) & np.repeat(size > 1, size)
    k, f = key[small], fp[small]
    for shift in range(1, pairwise):
        ok = (k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= distance)
        left.append(f[:-shift][ok]), right.append(f[shift:][ok])
        if len(k) <= shift + 1:
            break
    for at in np.flatnonzero(size > pairwise):
        a, b = spanning_edges(fp[first[at] : first[at] + size[at]], distance)
        left.append(a), right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _linked(distance: int, bucket: int, pairwise: int = PAIRWISE):
    """Rows sorted by key -> edges (a, b), and the rows of buckets over ``bucket`` for another round."""

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = (x.view(np.int64) for x in _compare(key, fp, distance, pairwise))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        none = pa.nulls(len(pair), pa.int64())
        short = pa.nulls(len(pair), pa.int16())
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, short, short], ["a", "b", "key", "start", "width"])

    def passed_on(key: np.ndarray, start: np.ndarray, width: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), none, pa.array(key.view(np.int64)), pa.array(start), pa.array(width)], ["a", "b", "key", "start", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        over = None  # the key of a bucket that is being passed on
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[0], cols[3] = cols[0].view(np.uint64), cols[3].view(np.uint64)
            cols = tuple(np.array(c) for c in cols)
            if over is not None:
                n = int((cols[0] == over).sum())  # equal keys stand together, these in front
                if n:
                    yield passed_on(*(c[:n] for c in cols))
                    cols = tuple(c[n:] for c in cols)
                if not len(cols[0]):
                    continue
                over = None
            if held:
                cols = tuple(np.concatenate(x) for x in zip(*held, cols))
            last = int(np.flatnonzero(cols[0] == cols[0][-1])[0])
            ready, held = tuple(c[:last] for c in cols), [tuple(c[last:] for c in cols)]
            if len(ready[0]):
                first = np.flatnonzero(np.r_[True, ready[0][1:] != ready[0][:-1]])
                size = np.diff(np.r_[first, len(ready[0])])
                many = np.repeat(size > bucket, size)
                if many.any():
                    yield passed_on(*(c[many] for c in ready))
                    ready = tuple(c[~many] for c in ready)
            if len(ready[0]):
                yield edges(ready[0], ready[3])
            if len(held[0][0]) > bucket:
                yield passed_on(*held[0])
                over, held = held[0][0][0], []
        if held:
            yield edges(held[0][0], held[0][3])

    return run


def _tiled(over: DataFrame, distance: int, bucket: int) -> DataFrame:
    """over(key, fp): anchors that no bits are left to part. Each is cut into chunks, and every two chunks meet in a task of their own.

    A linked pair lies in some tile, whose spanning forest connects it; so the forests together connect all that is linked.
    """
    chunks = over.groupBy("key").agg(F.ceil(F.count("*") / bucket).cast("int").alias("chunks"))
    dealt = over.join(chunks, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    placed = dealt.select(tile.alias("key"), F.lit(0).cast("smallint").alias("start"), F.lit(0).cast("smallint").alias("width"), "fp")
    kind = "a long, b long, key long, start smallint, width smallint"
    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(distance, 1 << 62), kind).select("a", "b")


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """distinct(fp) -> edges (a, b) that connect all fingerprints which links within ``distance`` bits connect.

    An anchor of at most PAIRWISE fingerprints gives all its links, a larger one spanning trees. One over ``bucket`` is
    dealt again over the bits that are left, twice at most, and then in tiles: no task compares more than two chunks.
    """
    todo = distinct.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("smallint").alias("start"), F.lit(64).cast("smallint").alias("width"), "fp")
    found = None
    for level in range(3):
        placed = todo.mapInArrow(_replicas(distance), "key long, start smallint, width smallint, fp long")
        sorted_ = placed.repartition("key").sortWithinPartitions("key")
        out = stored(sorted_.mapInArrow(_linked(distance, bucket), "a long, b long, key long, start smallint, width smallint"), "links")
        edges = out.filter("b is not null").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        over = out.filter("b is null").select("key", "start", "width", F.col("a").alias("fp")).distinct()
        if over.isEmpty():
            break
        left = over if level == 2 else over.filter("width = 0")
        found = found.unionByName(_tiled(left.select("key", "fp"), distance, bucket))
        todo = over.filter("width > 0")
    return found.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: (doc_id, fp, component_id), component_id the smallest id of the linked group.

    Null and empty texts have fingerprint 0 and link like any other; null ids keep their row,
    and a group of null ids alone has a null component. Repeated rows stay repeated. An empty
    table gives an empty result.
    """
    rows = stored(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    one = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    parts = components(links(one, distance, bucket)).withColumnRenamed("node", "fp")
    rooted = one.join(parts, "fp", "left").select("fp", "low", "root")
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    named = rooted.join(least, "root", "left").select("fp", F.expr("if(root is null, low, least)").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words the whole sequence; of none nothing."""
    return np.unique(_hashes(_words(text), shingle).view(np.int64))


def _described(shingle: int):
    """Texts -> the hash of their words (case of A-Z and white space aside), their fingerprints, shingles and sketches."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        node, fp, n, sketches = [], [], [], []
        for t in texts:
            words = _words(t)
            hashes = _hashes(words, shingle)
            distinct = np.unique(hashes)
            node.append(xxhash.xxh64_intdigest(b" ".join(words), 7)), fp.append(_majority(hashes)), n.append(len(distinct)), sketches.append(sketch(distinct))
        return [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)), pa.array(n, pa.int32()), pa.array(sketches, pa.binary())]

    return run


def _plausible(least: float):
    """Rows (a, b, na, nb, ka, kb) -> the edges that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
            most = _near(n, m, least)
            left, right = b.column(4).to_pylist(), b.column(5).to_pylist()
            for k in np.flatnonzero(ok):
                size = min(len(left[k]), len(right[k]))
                ok[k] = np.bitwise_count(folded(left[k], size) ^ folded(right[k], size)).sum() <= most[k]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok))

    return run


def _packed(shingle: int):
    """Rows (a, salt, hub, node, text) -> the same with the shingle set in place of the text, five bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packed = None, b""
        for b in batches:
            out = []
            for node, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if node != last:
                    last, packed = node, np.unique(_hashes(_words(text), shingle) & np.uint64(0xFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                out.append(packed)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], ["a", "salt", "hub", "node", "shingles"])

    return run


def _confirmed(least: float):
    """Rows sorted by (a, salt), the hub first -> edges (a, node) of the similarity or more."""

    def unpacked(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        return out.view(np.uint64).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            left, right = [], []
            for a, is_hub, node, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                x = unpacked(raw)
                if is_hub:
                    hub = x
                    continue
                both = len(np.intersect1d(hub, x, assume_unique=True))
                if both >= least * (len(hub) + len(x) - both):
                    left.append(a), right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _only(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """texts whose row may be one of asked(row): by a bitmap of BITMAP words of 64 bits, which is what is broadcast at any size."""
    word = lambda row: F.pmod(F.shiftright(F.xxhash64(row), 6), F.lit(BITMAP))
    bits = asked.groupBy(word("row").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(row), 64) as int)))").alias("bits"))
    held = texts.withColumn("word", word("row")).join(F.broadcast(bits), "word")
    return held.filter(F.expr("shiftright(bits, cast(pmod(xxhash64(row), 64) as int)) & 1 = 1")).drop("word", "bits")


def _similar(edges: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """edges(a, b) between nodes whose shingle sets have a Jaccard similarity of ``least`` or more.

    Sizes and sketches, some 130 bytes a node, reject most of the others. Of the rest each b travels to its a once, and
    a's with over FAN of them are dealt out; no other text moves. Shingles are compared by 40 bits of their hash, which
    for texts of under a million words is wrong by less than one shingle a comparison.
    """
    side = lambda key: nodes.select(F.col("node").alias(key), F.col("n").alias(f"n{key}"), F.col("sketch").alias(f"k{key}"))
    rough = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_plausible(least), "a long, b long")
    likely = stored(rough, "likely")
    fans = likely.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("salts"))
    dealt = likely.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(False).alias("hub"), F.col("b").alias("node"))
    hubs = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("hub"), F.col("a").alias("node"))
    asked = stored(dealt.unionByName(hubs).join(nodes.select("node", "row"), "node"), "asked")
    sent = _only(texts.select("row", "text"), asked).join(asked, "row").select("a", "salt", "hub", "node", "text")
    sets = sent.mapInArrow(_packed(shingle), "a long, salt int, hub boolean, node long, shingles binary")
    return sets.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("hub")).mapInArrow(_confirmed(least), "a long, b long")


def _apart(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct edges(a, b) whose ends are in different groups so far. parts(node, root)."""
    root = lambda key: parts.select(F.col("node").alias(key), F.col("root").alias(f"root_{key}"))
    joined = edges.distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    return joined.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def anchored(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """nodes(node, fp) -> candidates (a, b): trees over the texts whose fingerprints the anchors bring together."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    edges = links(heads.select("fp"), distance)
    head = lambda key: heads.select(F.col("fp").alias(key), F.col("head").alias(f"head_{key}"))
    across = edges.join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    same = nodes.select("node", "fp").join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return across.unionByName(same)


def _overlap(n, similarity: float):
    """The least overlap of a set of n with a similar one: of the union's shares both hold ``similarity``, and the union is n at least."""
    return np.ceil(similarity * n - 1e-9)


def _near(n: np.ndarray, other, similarity: float) -> np.ndarray:
    """How many shingles two similar sets of n and ``other`` may have apart, at most."""
    return (1 - similarity) / (1 + similarity) * (n + other) + 1e-9


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles in 1,024 classes, or as many as there are shingles, up to the next power of two.

    Two sketches differ in no more bits than the sets in shingles, after folding the longer one, too.
    """
    classes = max(1024, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount(shingles.view(np.uint64).astype(np.int64) & classes - 1, minlength=classes) & 1).tobytes()


def folded(raw: bytes, size: int = 128) -> np.ndarray:
    """A sketch over fewer classes, as words: each half onto the other."""
    x = np.frombuffer(raw, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _common(texts: DataFrame, nodes: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a hash sample of texts holds often, sorted, and their counts. They only order the others; any order is exact."""
    share = max(1, nodes.count() // ORDER_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            if found:
                value, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["token", "n"])

    counts = texts.filter(F.pmod("node", F.lit(share)) == 0).select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "token").limit(ORDER_MOST).collect()
    rows = sorted((r.token, r.n) for r in rows)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _prefixes(common, shingle: int, similarity: float):
    """(node, text) -> a row for each of the rarest n - overlap + 1 shingles: similar sets share one of these.

    A task gives those of equal texts once, as long as it remembers them; _met tells the rest from links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = common.value
        seen: set[int] = set()
        for b in batches:
            nodes, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for low in range(0, len(texts), 512):
                out = []
                for node, text in zip(nodes[low : low + 512].tolist(), texts[low : low + 512]):
                    if node in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(node)
                    h = shingle_set(text, shingle)
                    n = len(h)
                    if not n:
                        continue
                    rank = np.zeros(n, np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                        rank = np.where(often[at] == h, count[at], 0)
                    first = np.lexsort((h, rank))[: n - int(_overlap(n, similarity)) + 1]
                    k = len(first)
                    out.append((h[first], np.full(k, node), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), rank[first] > 0))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["token", "node", "n", "pos", "hot"])

    return run


def _met(similarity: float):
    """Rows sorted by (hot, token) -> candidates (a, b) of tokens with at most HOT rows; the rows of others as (node, null) with token, n."""

    def pairs(token, node, n, pos) -> pa.RecordBatch:
        left, right = [node[:0]], [node[:0]]
        for shift in range(1, min(HOT, len(token))):
            same = token[shift:] == token[:-shift]
            if not same.any():
                break
            # at the first shingle that they share, no more can be shared than stands behind it
            can = np.minimum(n[shift:] - pos[shift:], n[:-shift] - pos[:-shift]) >= similarity / (1 + similarity) * (n[shift:].astype(float) + n[:-shift]) - 1e-9
            ok = same & can
            left.append(node[:-shift][ok]), right.append(node[shift:][ok])
        a, b = np.concatenate(left), np.concatenate(right)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.int32())], ["a", "b", "token", "n"])

    def passed_on(token, node, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(token), pa.array(n)], ["a", "b", "token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over, last_row = None, None, None  # over: a token that is being passed on
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if len(cols[0]):  # equal texts from several tasks stand together
                again = np.r_[False, (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])]
                again[0] = (cols[0][0], cols[1][0]) == last_row
                last_row = cols[0][-1], cols[1][-1]
                cols = [c[~again] for c in cols]
            hot = cols.pop()
            if hot.any():
                yield passed_on(*(c[hot] for c in cols[:3]))
                cols = [c[~hot] for c in cols]
            if over is not None and len(cols[0]):
                same = cols[0] == over
                if same.any():
                    yield passed_on(*(c[same] for c in cols[:3]))
                    cols = [c[~same] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            first = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            size = np.diff(np.r_[first, len(cols[0])])
            many, some = np.repeat(size > HOT, size), np.repeat((size > 1) & (size <= HOT), size)
            over = cols[0][-1] if size[-1] > HOT else None
            last = np.arange(len(many)) >= first[-1]
            held = None if over is not None else [c[last] for c in cols]
            if many.any():
                yield passed_on(*(c[many] for c in cols[:3]))
            if (ready := some & ~last).any():
                yield pairs(*(c[ready] for c in cols))
        if held is not None and len(held[0]) > 1:
            yield pairs(*held)

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal (token, salt), the sketches as rows of words."""
    held: list[pa.RecordBatch] = []

    def one() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        out = {k: t[k].to_numpy() for k in names}
        out["whole"] = t["sketch"].to_pylist()
        out["sketch"] = np.stack([folded(x) for x in out["whole"]])
        return out

    now = None
    for b in batches:
        token, salt = b.column("token").to_numpy(), b.column("salt").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]) if len(token) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(token)]):
            if held and (token[lo], salt[lo]) != now:
                yield one()
                held.clear()
            now = token[lo], salt[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield one()


def _alike(g: dict, x: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of a group's rows ``others`` may be similar to its row x: by sizes, short sketches, and for long sets the whole ones."""
    n, m = g["n"][others], g["n"][x]
    most = _near(n, m, similarity)
    ok = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.bitwise_count(g["sketch"][others] ^ g["sketch"][x]).sum(axis=1) <= most)
    if len(mine := g["whole"][x]) > 128:
        for k in np.flatnonzero(ok):
            other = g["whole"][others[k]]
            size = min(len(mine), len(other))
            ok[k] = size == 128 or np.bitwise_count(folded(mine, size) ^ folded(other, size)).sum() <= most[k]
    return ok


def _led(similarity: float):
    """Rows of hot tokens -> candidates (a, b) of up to LEADERS leaders and the rows near them, and the leaders' rows with b null.

    These only bring the large groups together early; _crossed misses nothing that they leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["token", "node", "n", "comp"]):
            rest, lead, edges = np.arange(len(g["node"])), [], []
            while len(rest) and len(lead) < LEADERS:
                x, rest = rest[0], rest[1:]
                lead.append(x)
                same = g["comp"][rest] == g["comp"][x]
                near = _alike(g, x, rest, similarity)
                edges += [(g["node"][x], y) for y in g["node"][rest[near & ~same]]]
                rest = rest[~near & ~same]
            a = [g["node"][x] for x in lead] + [e[0] for e in edges]
            m, none = len(lead), [None] * len(edges)
            cols = [pa.array(a, pa.int64()), pa.array([None] * m + [e[1] for e in edges], pa.int64())]
            cols += [pa.array([*(int(g[k][x]) for x in lead), *none], kind) for k, kind in (("token", pa.int64()), ("n", pa.int32()), ("comp", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([*(g["whole"][x] for x in lead), *none], pa.binary())], ["a", "b", "token", "n", "comp", "sketch"])

    return run


def _crossed(similarity: float):
    """Rows of hot tokens with their groups so far, asking or asked -> all candidates of different groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["node", "n", "comp", "asks"]):
            asked, left, right = np.flatnonzero(g["asks"] == 0), [], []
            for x in np.flatnonzero(g["asks"] == 1):
                other = asked[g["comp"][asked] != g["comp"][x]]
                y = g["node"][other[_alike(g, x, other, similarity)]]
                left.append(np.minimum(y, g["node"][x])), right.append(np.maximum(y, g["node"][x]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def similar_links(texts: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """texts(row, node, text) and nodes(node, row, fp, n, sketch), a row a node with one of its rows -> (node, root) of the groups that pairs of the similarity link, exactly.

    Anchor-point covering comes first: texts whose fingerprints meet at an anchor are candidates, and the exact similarity
    decides. That links most of what is alike. What fingerprints cannot see (a similarity of 0.8 may lie ten bits apart) is
    completed by a prefix filter between the groups so far: of each set the rarest shingles, so many that similar sets share
    one. A shingle of few texts gives all its pairs of different groups. A hot one is dealt out in chunks: leaders first
    link its large groups, then all that is outside a shingle's largest group meets every text of another group.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    sure = stored(_similar(anchored(nodes), texts, nodes, shingle, similarity), "linked")
    parts = stored(components(sure), "parts")
    common = spark.sparkContext.broadcast(_common(texts, nodes, shingle))
    placed = texts.select("node", "text").mapInArrow(_prefixes(common, shingle, similarity), "token long, node long, n int, pos int, hot boolean")
    dealt = placed.repartition(F.when(F.col("hot"), F.col("node")).otherwise(F.col("token"))).sortWithinPartitions("hot", "token", "node")
    met = stored(dealt.mapInArrow(_met(similarity), "a long, b long, token long, n int"), "met")
    small = _apart(met.filter("b is not null").select("a", "b"), parts)
    counts = met.filter("b is null").groupBy("token").count().filter("count > 1").select("token", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    hot = met.filter("b is null").select(F.col("a").alias("node"), "token", "n").join(counts, "token")

    hot = hot.withColumn("salt", F.pmod(F.xxhash64("node"), "chunks").cast("int")).join(nodes.select("node", "sketch"), "node").join(parts, "node", "left")
    hot = stored(hot.withColumn("comp", F.coalesce("root", "node")).drop("root"), "hot")
    kind = "a long, b long, token long, n int, comp long, sketch binary"
    led = stored(hot.repartition("token", "salt").sortWithinPartitions("token", "salt").select("token", "salt", "node", "n", "comp", "sketch").mapInArrow(_led(similarity), kind), "led")
    leaders = led.filter("b is null").select("token", F.lit(0).alias("salt"), F.col("a").alias("node"), "n", "comp", "sketch")
    again = leaders.repartition("token").sortWithinPartitions("token").mapInArrow(_led(similarity), kind)
    early = small.unionByName(_apart(led.unionByName(again).filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), parts)).distinct()
    linked = stored(edges_of(parts).unionByName(_similar(early, texts, nodes, shingle, similarity)), "linked")
    now = stored(components(linked), "parts")
    grouped = stored(hot.drop("comp").join(now, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "grouped")
    largest = grouped.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    open_ = grouped.join(largest, "token")
    columns = ["token", "salt", "node", "n", "comp", "asks", "sketch"]
    asks = open_.filter("comp <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(1))
    both = open_.withColumn("asks", F.lit(0)).select(columns).unionByName(asks.select(columns))
    crossed = both.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(_crossed(similarity), "a long, b long").distinct()
    return components(edges_of(now).unionByName(_similar(crossed, texts, nodes, shingle, similarity)))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs less all but one row of each group of similar texts: the one with the smallest id (nulls last), one of them if it repeats.

    Texts of the same words (case of A-Z and white space aside) are one node. Nodes link if their
    shingle sets have the similarity. Texts without a word, null and empty ones, form one group.
    An empty table gives an empty table. All columns of docs come back, whatever their names.
    """
    own = {c: fresh(docs, f"_{c}") for c in ("node", "fp", "n", "sketch", "row")}
    node, row = own["node"], own["row"]
    new = {own["node"]: "long", own["fp"]: "long", own["n"]: "int", own["sketch"]: "binary"}
    rows = stored(appended(docs, text, new, _described(shingle)).withColumn(row, F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(row).alias("row"))).alias("first")
    nodes = rows.groupBy(F.col(node).alias("node")).agg(first, *(F.max(own[c]).alias(c) for c in ("fp", "n", "sketch")))
    nodes = stored(nodes.withColumn("row", F.col("first.row")), "nodes")
    texts = rows.select(F.col(row).alias("row"), F.col(node).alias("node"), F.col(text).alias("text"))
    parts = similar_links(texts, nodes, shingle, similarity)
    kept = nodes.join(parts, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
