"""Toxic passages by maximum-scoring segments over token log-odds.

1. Terms: words, and word beginnings of 4 to 6 letters (for inflected forms). Their document frequencies in toxic
   and clean training texts give log-odds with an informative Dirichlet prior (the corpus share of the term).
   A term counts if the root of its likelihood ratio (a z-score that needs no clean occurrence) and its log-odds are high enough; the toxic side is counted first, and only terms
   in at least `min_share` of its documents are counted on the clean side, so the model holds at most
   (mean terms per document) / min_share terms whatever the corpus size.
2. Scan: a term scores its log-odds, every other token the log of one minus the density of terms expected in a toxic
   passage. One linear pass finds all maximal scoring segments; each is a passage.
3. Calibration: under the clean class the best segment of n tokens follows an extreme-value law with
   E = K n exp(-lambda S). lambda solves sum p(s) exp(lambda s) = 1 over the clean token scores, K is the maximum-likelihood
   location. Significant passages add -ln P to the document's evidence, and the score is the monotone (pooled) share of
   toxic training documents at that evidence.

Labels come only from rows outside the held-out remainder, at most `max_labelled` of them (a documented bound; the scan
covers every text). doc_id picks that remainder and nothing else; lang, source
and labels are no inputs of a score.

Defined results: null and empty texts have no passage and score as documents without evidence. A null label is
none; of several labels of a document the highest counts. Equal training texts count once per label. With
no toxic or no clean training row every score is the share of toxic ones (0 without any). Repeated rows score alike.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import small_batches
from .common import stage, text_hashes

WORDS = regex.compile(r"\w+")
PREFIXES = (6, 5, 4)
HELD_OUT, THRESHOLD = 2, 0.3
#: Pseudo-documents of a term on each side at least, so that a term never seen on one has bounded log-odds.
LEAST_PRIOR = 0.5
SCORE_BINS, EVIDENCE_BINS, FLUSH, REMEMBERED = 32, 64, 200_000, 150_000


@dataclass(frozen=True)
class Options:
    min_share: float = 0.002  # of toxic training documents that hold a term
    min_documents: int = 3
    prior_share: float = 0.01  # weight of the prior against the corpus
    min_z: float = 4.0
    min_log_odds: float = 2.0
    density: float = 0.05  # of terms in a toxic passage
    significance: float = 0.05
    max_labelled: int = 200_000  # labelled rows to learn from


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    background: float = -0.05
    slope: float = 1.0  # lambda
    location: float = 1.0  # K
    shares: list[float] = field(default_factory=list)  # toxic share by evidence bin
    options: Options = field(default_factory=Options)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def terms_of(word: str) -> Iterator[str]:
    """The word, then its beginnings, the longest first."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


def _count_terms(known: frozenset[str] | None):
    """Document frequencies of terms (of `known` ones only, if given) in batches of (toxic, text)."""

    def rows(counts):
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["term", "toxic", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in small_batches(batches, "text"):
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                found = {t for w in set(WORDS.findall((text or "").lower())) for t in terms_of(w) if known is None or t in known}
                counts.update((t, toxic) for t in found)
                counts["", toxic] += 1  # the documents themselves
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    return run


def training_rows(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, toxic of the labelled documents to learn from: outside the held-out part, equal texts once per label,
    at most options.max_labelled of them (chosen by hash where there are more), so they may be broadcast."""
    own = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = stage(own.filter(~held_out(F.col("l_id"))), "tox-labels")
    share = min(1.0, 0.95 * options.max_labelled / max(1, own.count()))
    place = F.pmod(F.xxhash64(F.coalesce("l_id", F.lit(-1))), F.lit(1_000_000))
    own = F.broadcast(own.filter(place < share * 1_000_000).limit(options.max_labelled))
    hash_, hash2 = text_hashes(F.col("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hash_.alias("hash"), hash2.alias("hash2"))
    rows = slim.join(own, slim["doc_id"].eqNullSafe(own["l_id"]))
    return stage(rows.groupBy("hash", "hash2", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct(), "tox-train")


def signed_root(a: int, n_a: int, b: int, n_b: int) -> float:
    """z-score of a term in a of n_a toxic and b of n_b clean documents: the root of the likelihood ratio of one
    frequency against two, negative where the toxic one is lower. It stays finite and grows with a at b = 0."""
    part = lambda x, n, p: x * math.log(x / (n * p)) if x else 0.0
    p = (a + b) / (n_a + n_b)
    ratio = part(a, n_a, p) + part(b, n_b, p) + part(n_a - a, n_a, 1 - p) + part(n_b - b, n_b, 1 - p)
    return math.copysign(math.sqrt(max(2 * ratio, 0.0)), a / n_a - b / n_b)


def fit_terms(docs: DataFrame, training: DataFrame, options: Options = Options()) -> Model:
    own = F.broadcast(training.withColumnRenamed("doc_id", "l_id"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(own, texts["doc_id"].eqNullSafe(own["l_id"])).select("toxic", "text")
    rows = stage(rows, "tox-texts")
    schema = "term string, toxic int, n long"
    model = Model(background=math.log1p(-options.density), options=options)
    toxic = rows.filter("toxic = 1")
    n_toxic = toxic.count()
    least = max(options.min_documents, math.ceil(options.min_share * n_toxic))
    counted = toxic.select("toxic", "text").mapInArrow(_count_terms(None), schema).groupBy("term").agg(F.sum("n").alias("n"))
    in_toxic = {r.term: r.n for r in counted.filter((F.col("n") >= least) & (F.col("term") != "")).collect()}
    if not in_toxic:
        return model
    clean = rows.filter("toxic = 0").select("toxic", "text").mapInArrow(_count_terms(frozenset(in_toxic)), schema)
    in_clean = {r.term: r.n for r in clean.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_clean = in_clean.pop("", 0)
    if not n_clean:
        return model
    prior = options.prior_share * (n_toxic + n_clean)
    for term, a in in_toxic.items():
        b = in_clean.get(term, 0)
        own = max(prior * (a + b) / (n_toxic + n_clean), LEAST_PRIOR)
        odds = lambda x, n: (x + own) / (max(n - x, 0) + max(prior - own, LEAST_PRIOR))
        delta = math.log(odds(a, n_toxic)) - math.log(odds(b, n_clean))
        if delta >= options.min_log_odds and signed_root(a, n_toxic, b, n_clean) >= options.min_z:
            model.terms[term] = delta
    # a beginning must stand for more than one word: its documents exceed those of its most frequent word
    best: dict[str, int] = {}
    for term in in_toxic:
        if not term.endswith("*"):
            for p in [*terms_of(term)][1:]:
                best[p] = max(best.get(p, 0), in_toxic[term])
    model.terms = {t: s for t, s in model.terms.items() if not t.endswith("*") or in_toxic[t] >= 1.5 * best.get(t, 0)}
    return model


def segments(hits: list[int], scores: list[float], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in one pass over the scoring tokens:
    between two of them lie tokens of the background score, which enter as one negative item."""
    found: list[list] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for at, s in zip(hits, scores):
        total += background * (at - last - 1)
        last = at
        new = [at, at, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class _Scores(dict):
    """token -> score, 0 for tokens outside the model; bounded."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        value = next((self.terms[t] for t in terms_of(word) if t in self.terms), 0.0)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


SCAN = "doc_id long, hash long, hash2 long, n_tokens long, segments array<struct<first:long,last:long,score:double>>, hits array<int>"
_SEGMENT = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Passages of every whole text, and how many tokens fell in each score bin."""
    terms, background = model.terms, model.background

    def run(batches):
        score = _Scores(terms).__getitem__
        for b in small_batches(batches, "text"):
            n, found, hits = [], [], []
            for text in b.column("text").to_pylist():
                words = WORDS.findall((text or "").lower())
                values = np.fromiter(map(score, words), np.float64, len(words))
                at = np.flatnonzero(values)
                n.append(len(words))
                found.append([{"first": x, "last": y, "score": s} for x, y, s in segments(at.tolist(), values[at].tolist(), background)])
                hits.append(np.minimum(values[at] * 2, SCORE_BINS - 1).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("hash"), b.column("hash2"), pa.array(n, pa.int64()), pa.array(found, pa.list_(_SEGMENT)), pa.array(hits, pa.list_(pa.int32()))],
                ["doc_id", "hash", "hash2", "n_tokens", "segments", "hits"],
            )

    hash_, hash2 = text_hashes(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hash_.alias("hash"), hash2.alias("hash2"), "text").mapInArrow(run, SCAN)


def _best(model_segments: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(model_segments, lambda s: s["score"])), F.lit(0.0))


def p_value(n_tokens: Column, score: Column, model: Model) -> Column:
    return -F.expm1(-F.lit(model.location) * n_tokens * F.exp(-F.lit(model.slope) * score))


def evidence(model: Model) -> Column:
    """Sum of -ln P over the significant passages of a scanned row."""
    each = F.transform("segments", lambda s: p_value(F.col("n_tokens"), s["score"], model))
    return F.aggregate(each, F.lit(0.0), lambda acc, p: acc + F.when(p < model.options.significance, -F.ln(F.greatest(p, F.lit(1e-300)))).otherwise(0.0))


def evidence_bin(value: Column) -> Column:
    return F.least(F.lit(EVIDENCE_BINS - 1), F.floor(F.log1p(value) * 9)).cast("int")


def solve_slope(scores: list[float], shares: list[float]) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection; the mean score is negative."""
    total = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in zip(scores, shares)) - 1
    low, high = 1e-6, 1.0
    while total(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return high


def pooled(positive: list[float], all_: list[float]) -> list[float]:
    """Monotone shares by pooling adjacent violators, each bin smoothed by one row of the overall share."""
    base = (sum(positive) + 0.5) / (sum(all_) + 1) if sum(all_) else 0.0
    blocks: list[list[float]] = []
    for p, n in zip(positive, all_):
        blocks.append([p + base * 1e-3, n + 1e-3, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            p2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [min(1.0, p / n) for p, n, k in blocks for _ in range(k)]


def calibrate(scanned: DataFrame, training: DataFrame, model: Model) -> Model:
    """Fit the extreme-value law and the shares from the scanned training rows; only sums reach the driver."""
    own = F.broadcast(training.withColumnRenamed("doc_id", "l_id"))
    rows = stage(scanned.join(own, scanned["doc_id"].eqNullSafe(own["l_id"])).drop("l_id", "doc_id", "hash", "hash2"), "tox-scanned")
    clean = rows.filter("toxic = 0")
    tokens, docs = clean.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    bins = dict(clean.select(F.explode("hits").alias("bin")).groupBy("bin").count().collect())
    # half a token of smoothing, over the bins that a term can fall in: scores that never occur say nothing about the slope
    held = {min(int(s * 2), SCORE_BINS - 1) for s in model.terms.values()} or set(range(SCORE_BINS))
    counts = [bins.get(i, 0) + 0.5 / len(held) * (i in held) for i in range(SCORE_BINS)]
    rest = max(tokens - sum(bins.values()), 0) + 1.0
    whole = rest + sum(counts)
    scores = [i / 2 + 0.25 for i in range(SCORE_BINS)]
    mean = (model.background * rest + sum(s * c for s, c in zip(scores, counts))) / whole
    model.slope = solve_slope([model.background, *scores], [rest / whole, *(c / whole for c in counts)]) if mean < 0 else 0.1
    weight = clean.agg(F.sum(F.greatest(F.col("n_tokens"), F.lit(1)) * F.exp(-F.lit(model.slope) * _best(F.col("segments"))))).first()[0]
    model.location = docs / weight if weight else 1.0
    by_bin = rows.select(evidence_bin(evidence(model)).alias("bin"), "toxic").groupBy("bin").agg(F.sum("toxic"), F.count(F.lit(1))).collect()
    positive, all_ = [0.0] * EVIDENCE_BINS, [0.0] * EVIDENCE_BINS
    for b, p, n in by_bin:
        positive[b], all_[b] = float(p), float(n)
    model.shares = pooled(positive, all_)
    return model


def _scored(docs: DataFrame, labels: DataFrame, options: Options) -> DataFrame:
    """score_documents with the hashes of each text."""
    training = training_rows(docs, labels, options)
    model = fit_terms(docs, training, options)
    scanned = stage(scan(docs, model), "tox-scan")
    model = calibrate(scanned, training, model)
    share = F.element_at(F.array(*map(F.lit, model.shares)), evidence_bin(F.col("evidence")) + 1)
    # within a bin, more evidence ranks higher
    score = F.least(F.lit(1.0), share * 0.999 + 0.001 * (1 - F.exp(-F.col("evidence") / 100)))
    passages = F.filter(
        F.transform("segments", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["score"].alias("score"), p_value(F.col("n_tokens"), s["score"], model).alias("p_value"))),
        lambda s: s["p_value"] < options.significance,
    )
    out = scanned.withColumn("evidence", evidence(model)).withColumn("score", score)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), passages.alias("passages"), "hash", "hash2")


def score_documents(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (first and last token, score, p_value) of every document."""
    return _scored(docs, labels, options).drop("hash", "hash2")


def drop_toxic(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents below the threshold, with all their columns. A score depends on the text alone, so each row is
    decided by its own text; doc_id only deals the rows, and rows without one or that share one keep apart."""
    toxic = _scored(docs, labels, options).filter("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h"), F.col("hash2").alias("_h2"))
    toxic = stage(toxic.distinct(), "tox-dropped")
    hash_, hash2 = text_hashes(docs["text"])
    same = docs["doc_id"].cast("long").eqNullSafe(toxic["_id"]) & (hash_ == toxic["_h"]) & (hash2 == toxic["_h2"])
    return docs.join(toxic, same, "left_anti")
