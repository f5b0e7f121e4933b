"""Toxic passages by maximum-scoring segment search.

Training counts, in labelled documents, how many toxic and clean ones hold a token, its
first five and its first four letters.  A token's log-odds has a Dirichlet prior centred
on that of its five-letter prefix, whose prior is centred on that of the four-letter
prefix, and that on the base rate; so a form never seen is scored by its stem.  Log-odds
count from LEAST_SCORE on, negative ones if they are SURE standard deviations below zero;
a word that is neither is scored by its stem.  Less a drift, the scores are negative on average
over clean text, which is what the theory of high-scoring segments needs: lambda solves
E[exp(lambda s)] = 1 over clean tokens, and a text of n tokens has by chance an expected
K n exp(-lambda S) segments of score S or more.  K is the maximum-likelihood fit of the
extreme-value distribution to the best segments of clean documents.

A linear scan (one pass with a stack) finds all maximal-scoring segments of a text; those
whose expected number by chance is SIGNIFICANT or less are its toxic passages.  The
evidence of a text is ln(1 + sum exp(lambda S) / (K n)), each segment weighted by how
rare it is by chance; a logistic curve turns it into a probability.  K and the curve are
fitted on labelled documents that the token scores have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, stored

#: The classifier is fitted on a hash sample of about so many labelled rows, fewer if there are fewer.
TRAINING_ROWS = 40_000
#: One in FOLDS of them is kept for the calibration, unless that leaves it fewer than LEAST_FOLD of either label.
FOLDS, LEAST_FOLD = 4, 20
DRIFT, STRENGTH, LEAST_DOCS, LEAST_ODDS, LEAST_SCORE, SURE, SIGNIFICANT = 0.05, 4.0, 3, 3.0, 1.5, 2.0, 0.01
_TOKEN = re.compile(r"[^\W\d_]+")
_CACHED, _COUNTED = 1 << 16, 1 << 17


class Scores(dict):
    """Scores of tokens; those of forms never seen are worked out from their stems, and some of them kept."""

    def __init__(self, model: Model):
        super().__init__({w: s - DRIFT for w, s in model.words.items()})
        self.fives, self.fours, self.most = model.fives, model.fours, len(self) + _CACHED

    def __missing__(self, token: str) -> float:
        found = 0.0
        if len(token) > 3:
            found = self.fives.get(token[:5])
            if found is None:
                found = self.fours.get(token[:4], 0.0)
        if len(self) < self.most:
            self[token] = found - DRIFT
        return found - DRIFT


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    fives: dict[str, float]
    fours: dict[str, float]
    rate: float
    growth: float  # lambda
    chance: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 0.0
    held: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def scores(self) -> Scores:
        if "scores" not in self.held:
            self.held["scores"] = Scores(self)
        return self.held["scores"]

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int, str]:
        """All maximal-scoring segments as (first token, last token, score), the number of tokens, and the text in lower case."""
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        tokens = _TOKEN.findall(low)
        return segments(list(map(self.scores.__getitem__, tokens))), len(tokens), low

    def significant(self, n: int) -> float:
        """The least score of a segment that n tokens have by chance SIGNIFICANT times or less."""
        return math.log(max(self.chance * n / SIGNIFICANT, 1.0)) / self.growth

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The evidence of a text, and its toxic passages as (begin, end, score). Null and empty: 0 and none."""
        found, n, low = self.segments(text)
        if not found:
            return 0.0, []
        total = sum(math.exp(min(self.growth * s, 60.0)) for _, _, s in found)
        least = self.significant(n)
        found = [x for x in found if x[2] >= least]
        wanted = {k for a, b, _ in found for k in (a, b)}
        at = {k: m.span() for k, m in enumerate(_TOKEN.finditer(low)) if k in wanted} if found else {}
        return math.log1p(total / (self.chance * n)), [(at[a][0], at[b][1], s) for a, b, s in found]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.intercept + self.slope * evidence))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, as (first, last, score), in linear time.

    Each candidate keeps the running sum in front of it and at its end. A new one joins the candidates
    back to the nearest that began lower, if none in between ended higher than it does.
    """
    if not scores or max(scores) <= 0:
        return []
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum in front, sum at the end
    sums = [0.0, *accumulate(scores)]
    for k in [k for k, s in enumerate(scores) if s > 0]:
        first, left, right = k, sums[k], sums[k + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, _, left, _ = stack[j]
            del stack[j:]
        stack.append((first, k, left, right))
    return [(a, b, r - l) for a, b, l, r in stack]


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(training: DataFrame) -> Model:
    """training(text, toxic 0/1), a bounded sample -> model. Without both labels it knows no token and gives the base rate."""
    bound_batches(training.sparkSession)
    fold = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(FOLDS)) == 0
    sizes = {(r[0], r[1]): r[2] for r in training.groupBy(fold.alias("fold"), "toxic").count().collect()}
    apart = all(sizes.get((f, y), 0) >= LEAST_FOLD for f in (True, False) for y in (0, 1))
    model = _weighed(training.filter(~fold) if apart else training)
    return _calibrated(training.filter(fold) if apart else training, model) if model.words or model.fours else model


def _weighed(training: DataFrame) -> Model:
    """The scores of tokens and stems, and lambda."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}  # feature -> toxic documents, clean documents, tokens in clean ones

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), *(pa.array([c[k] for c in held.values()], pa.int64()) for k in range(3))], ["feature", "toxic", "clean", "tokens"])

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = Counter(_TOKEN.findall((text or "").lower()))
                features = {"w" + w: n for w, n in found.items()}
                features.update(dict.fromkeys((f"{k}{w[:k]}" for w in found if len(w) > 3 for k in (4, 5)), 0))
                features["#"] = found.total()
                for f, n in features.items():
                    c = held.setdefault(f, [0, 0, 0])
                    c[not label] += 1
                    c[2] += 0 if label else n
                if len(held) > _COUNTED:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    counted = training.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long, tokens long").groupBy("feature").agg(*(F.sum(x).alias(x) for x in ("toxic", "clean", "tokens")))
    counted = stored(counted, "features")
    whole = counted.filter("feature = '#'").first()
    yes, no, tokens = (whole.toxic, whole.clean, whole.tokens) if whole else (0, 0, 0)
    rate = (yes + 0.5) / (yes + no + 1)
    if not yes or not no:
        return Model({}, {}, {}, rate, 1.0, 1.0, _logit(rate), 0.0)
    # words of LEAST_DOCS documents or more, and the stems that speak for toxicity: the sample bounds both
    speaks = (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * no > LEAST_ODDS * F.col("clean") * yes)
    kept = counted.filter((F.col("feature") != "#") & (speaks | F.startswith("feature", F.lit("w")) & (F.col("toxic") + F.col("clean") >= LEAST_DOCS))).collect()
    theta: dict[str, float] = {}
    tables: dict[str, dict[str, float]] = {"4": {}, "5": {}, "w": {}}
    mass: list[tuple[float, float]] = []
    for r in sorted(kept, key=lambda r: r.feature):  # 4 before 5 before w
        kind, name = r.feature[0], r.feature[1:]
        prior = theta.get("5" + name[:5], theta.get("4" + name[:4], rate)) if kind == "w" else theta.get("4" + name[:4], rate) if kind == "5" else rate
        theta[r.feature] = p = (r.toxic + STRENGTH * prior) / (r.toxic + r.clean + STRENGTH)
        score = _logit(p) - _logit(rate)
        spread = math.sqrt(1 / (r.toxic + STRENGTH * prior) + 1 / (r.clean + STRENGTH * (1 - prior)))
        if score >= LEAST_SCORE or kind == "w" and score <= -SURE * spread:
            tables[kind][name] = score
            if kind == "w":
                mass.append(((r.tokens + 0.5) / (tokens + 1), score - DRIFT))
    low, high = 0.0, 8.0
    rest = max(0.0, 1 - sum(p for p, _ in mass))
    for _ in range(60):  # lambda, by halving
        mid = (low + high) / 2
        low, high = (low, mid) if rest * math.exp(-mid * DRIFT) + sum(p * math.exp(mid * s) for p, s in mass) > 1 else (mid, high)
    return Model(tables["w"], tables["5"], tables["4"], rate, max(low, 1e-3))


def _calibrated(training: DataFrame, model: Model) -> Model:
    """K from the best segments of the clean documents; the logistic curve over the evidence, by Newton's method on counts by label and evidence to a tenth."""
    growth = model.growth

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, mass = 0, 0.0
            for text in b.column(0).to_pylist():
                found, tokens, _ = model.segments(text)
                n, mass = n + bool(found), mass + tokens * math.exp(-growth * max((s for _, _, s in found), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mass], pa.float64())], ["n", "mass"])

    clean = training.filter("toxic = 0").select("text").mapInArrow(best, "n long, mass double").agg(F.sum("n"), F.sum("mass")).first()
    model = replace(model, chance=max(clean[0], 1) / max(clean[1], 1.0), held={})  # documents without a segment are censored at 0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[round(10 * model.evidence(text)[0]), int(bool(label))] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["bin", "label", "n"])

    rows = training.select("text", "toxic").mapInArrow(measure, "bin long, label long, n long").groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()  # evidence is below 80: some 1,600 rows
    a, b = _logit(model.rate), 1.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for r in rows:
            x = r.bin / 10
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x))))
            e, v = r.n * (r.label - p), r.n * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + e, g1 + e * x, h00 + v, h01 + v * x, h11 + v * x * x
        g0, g1, h00, h11 = g0 - 0.01 * a, g1 - 0.01 * b, h00 + 0.01, h11 + 0.01  # a weak pull to 0 keeps it finite
        d = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / d, (h00 * g1 - h01 * g0) / d
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return replace(model, intercept=a, slope=max(b, 0.0), held={})


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = TRAINING_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(text, toxic) of a hash sample of about ``bound`` labelled documents for which ``keep`` holds.

    The sample of ids is bounded, so it is broadcast, and the texts are not shuffled. Rows without an id or a label are left out.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(keep)
    total = usable.count()
    if total > bound:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / total))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")


def trained(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = TRAINING_ROWS, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The model of the sample; equal texts count once, with the label that most of them have."""
    once = training_rows(docs, labels, keep, bound, text, doc_id).groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    return fit(stored(once, "training"))


def scored(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, n_segments, passages array<struct<begin,end,score>>): a row for each row of docs.

    begin and end are code points of the text. Null and empty texts have no passage and the lowest score.
    """
    bound_batches(docs.sparkSession)
    shape = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found = [m.evidence(t) for t in b.column(1).to_pylist()]
            spans = pa.array([[{"begin": x, "end": y, "score": s} for x, y, s in f[1]] for f in found], shape)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.probability(f[0]) for f in found], pa.float64()), pa.array([len(f[1]) for f in found], pa.int32()), spans], ["doc_id", "score", "n_segments", "passages"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_segments int, passages array<struct<begin:long,end:long,score:double>>")
