"""Toxicity by maximum-scoring segments.

Token weights are log-odds between toxic and clean labelled documents under an informative Dirichlet prior (the counts of
both together); tokens whose weight is not significant share the weight of all that is left, a little below zero. One pass
over a document finds every maximal segment of tokens whose weights sum up highest, so a long clean text hides no toxic
passage. Segment scores of clean text follow an extreme-value law: E = K n exp(-lambda S) is the number of segments of a
score of S or more that chance puts into n tokens, with lambda from the weights and K from the clean documents that were fitted. A document's
evidence is the sum of what its segments exceed the chance level by, and a logistic curve turns it into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import materialise
from .common import id_and_text
from .words import hash_tokens, token_hashes

#: Bound of the fit: labelled documents per class. The model holds every token that is significant in them.
SAMPLE_DOCS = 12_000
#: The prior: so many tokens in the proportions of both classes together, and a flat share for every token, without which
#: a token that one class lacks has no finite weight; least significance of a weight, in standard deviations.
PRIOR = 500.0
FLAT = 0.5
SIGNIFICANT = 3.5
#: Least weight: a token that is significant only because it is frequent tells nothing about a passage.
LEAST_ODDS = 1.5
#: Words of unknown form are looked up by their first letters.
STEM = 5
#: Entries of a task's counts before they go to the shuffle.
COUNTED = 300_000
#: ASCII capitals become small letters, ASCII punctuation and control characters become blanks.
TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


_COUNTS = pa.schema([("stem", pa.bool_()), ("token", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])


@dataclass
class Toxicity:
    """A fitted model: hashes of tokens and stems with their weights, and the two calibrations."""

    tokens: np.ndarray
    weights: np.ndarray
    rest: float
    scale: float
    chance: float
    slope: float
    middle: float

    def hits(self, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the tokens that the model knows."""
        place, weight = np.zeros(0, np.int64), np.zeros(0)
        if len(self.tokens) and len(words):
            found = np.zeros(len(words))
            for names in (stems, words):
                at = np.minimum(np.searchsorted(self.tokens, names), len(self.tokens) - 1)
                known = self.tokens[at] == names
                found[known] = self.weights[at[known]]
            place = np.flatnonzero(found)
            weight = found[place]
        return place, weight

    def evidence(self, n: int, segments: list) -> float:
        level = math.log(self.chance * n) if n else 0.0
        return sum(max(0.0, self.scale * s - max(level, 0.0)) for _, _, s in segments)

    def score(self, n: int, segments: list) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * (self.evidence(n, segments) - self.middle)))))


def maximal_segments(place: np.ndarray, weight: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, behind the last, score); tokens between the given ones weigh ``rest`` <= 0.

    A segment enters the list with the sums before and behind it. It swallows an earlier one whose sum before is lower,
    as long as its own sum behind is higher; everything is looked at once as it enters and once as it is swallowed.
    """
    out: list = []
    total, passed = 0.0, 0
    for p, w in zip(place.tolist(), weight.tolist()):
        total += rest * (p - passed)
        passed = p + 1
        before, total = total, total + w
        if w <= 0:
            continue
        first, low, high = p, before, total
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= low:
                k = out[k][4]
            if k < 0 or out[k][3] >= high:
                out.append((first, passed, low, high, k))
                break
            first, low = out[k][0], out[k][2]
            del out[k:]
    return [(a, z, high - low) for a, z, low, high, _ in out]


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels nobody may learn from; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(batches):
    """Token and stem counts of a task's documents, handed on whenever they fill COUNTED entries."""
    held: dict = {}

    def flush():
        rows = [(stem, token, y, z) for (stem, token), (y, z) in held.items()]
        for low in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[low:low + 20_000]), _COUNTS)], schema=_COUNTS)
        held.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for token, n in Counter(text.encode("utf-8").translate(TABLE).split(b" ")).items():
                if token:
                    for key in ((False, token), (True, token[:STEM])) if len(token) > STEM else ((False, token),):
                        count = held.setdefault(key, [0, 0])
                        count[0 if toxic else 1] += n
            if len(held) > COUNTED:
                yield from flush()
    yield from flush()


def _token_counts(sample: DataFrame) -> DataFrame:
    """stem, token, toxic, clean: of the sample's words, and of the stems of its longer words."""
    parts = sample.select("text", "toxic").mapInArrow(_count, "stem boolean, token binary, toxic long, clean long")
    return parts.groupBy("stem", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _least_hashes(label: DataFrame) -> DataFrame:
    """Rows of every class below a hash that leaves somewhat more than SAMPLE_DOCS of them: all that can be in the sample."""
    label = materialise(label.withColumn("hash", F.xxhash64("labelled")))
    chosen = F.lit(False)
    for toxic, n in label.groupBy("toxic").count().collect():
        own, share = F.col("toxic") == toxic, 1.2 * SAMPLE_DOCS / n
        while share < 1:
            below = own & (F.col("hash") < F.lit(int(share * 2.0**64) - 2**63))
            if label.where(below).count() >= SAMPLE_DOCS:
                own = below
                break
            share *= 2
        chosen |= own
    return label.where(chosen)


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Fit on at most SAMPLE_DOCS labelled documents of each class, by the smallest hashes of their doc_ids.

    Rows that are held out are never read for it. Of rows that repeat a labelled doc_id one is read, the one with the least text, so
    the sample stays bounded however often an id is repeated. With labels of one class only, or none, the model knows no token and
    every score is near 0.
    """
    label = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("bigint").alias("labelled")).agg(F.max("toxic").alias("toxic")))
    order = Window.partitionBy("toxic").orderBy("hash", "labelled")
    label = _least_hashes(label).withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS)
    rows = id_and_text(docs)
    # The labels of the sample are at most 2 * SAMPLE_DOCS rows of two numbers: small enough for every task.
    sample = rows.join(F.broadcast(label), rows["doc_id"] == label["labelled"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = materialise(sample)
    counts = materialise(_token_counts(sample))
    sums = counts.groupBy("stem").agg(F.sum("toxic"), F.sum("clean")).collect()
    n_toxic, n_clean = next(((r[1], r[2]) for r in sums if not r["stem"]), (0, 0))
    nothing = Toxicity(np.zeros(0, np.uint64), np.zeros(0), -0.01, 1.0, 1.0, 1.0, 6.0)
    if not n_toxic or not n_clean:
        return nothing
    prior = FLAT + F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    y, z = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(y / (n_toxic + PRIOR - y)) - F.log(z / (n_clean + PRIOR - z))
    chosen = (counts.withColumn("weight", odds).withColumn("sure", odds / F.sqrt(1 / y + 1 / z)).where((F.col("sure") >= SIGNIFICANT) & (F.col("weight") >= LEAST_ODDS))
              .orderBy("token", "stem").collect())
    words = [r for r in chosen if not r["stem"]]
    if not chosen:
        return nothing
    in_toxic, in_clean = (sum(r[c] for r in words) for c in ("toxic", "clean"))
    rest = min(-0.005, math.log((n_toxic - in_toxic + 1) / (n_toxic + 2)) - math.log((n_clean - in_clean + 1) / (n_clean + 2)))
    whole, stems = hash_tokens([bytes(r["token"]) for r in chosen], STEM)
    names = np.array([s if r["stem"] else w for r, w, s in zip(chosen, whole, stems)], np.uint64)
    by = np.argsort(names)
    model = Toxicity(names[by], np.array([r["weight"] for r in chosen])[by], rest, _scale(words, rest, n_clean), 1.0, 1.0, 6.0)
    return _calibrated(model, sample)


def _scale(words: list, rest: float, n_clean: int) -> float:
    """The lambda at which the clean tokens' mean of exp(lambda * weight) is one, by halving."""
    share = [(max(r["clean"], 0.5) / n_clean, r["weight"]) for r in words]
    left = 1 - sum(p for p, _ in share)
    mean = lambda x: left * math.exp(x * rest) + sum(p * math.exp(min(x * w, 500)) for p, w in share)
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return max(low, 0.05)


def _calibrated(model: Toxicity, sample: DataFrame) -> Toxicity:
    """K from the segments of the clean sample, the curve from the evidence of the whole sample; both of bounded size."""
    found = scored(sample, model, keep=("toxic",)).select("toxic", "n_tokens", F.transform("passages", lambda p: p["score"]).alias("scores")).collect()
    found.sort(key=lambda r: (r["toxic"], r["n_tokens"], r["scores"]))  # sums must not depend on how the rows came
    if not found:
        return model
    clean = [r for r in found if not r["toxic"]]
    x = model.scale * float(model.weights.min())
    above = sum(model.scale * s >= x for r in clean for s in r["scores"])
    model.chance = (above + 1) * math.exp(x) / (sum(r["n_tokens"] for r in clean) + 1)
    evidence = np.array([model.evidence(r["n_tokens"], [(0, 0, s) for s in r["scores"]]) for r in found])
    toxic = np.array([r["toxic"] for r in found], float)
    # Logistic regression of two parameters, each class of equal weight, with a little shrinkage.
    weight = np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
    size = max(evidence.mean(), 1.0)
    design = np.c_[np.ones(len(evidence)), np.minimum(evidence, 4 * size) / size]
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (toxic - p)) - 1e-3 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta += np.linalg.solve(hess, grad)
    # The threshold is where most of the sample is told right; between two candidates, in their middle.
    order = np.argsort(evidence, kind="stable")
    ranked, marks = evidence[order], toxic[order]
    right = np.cumsum(1 - marks) + (marks.sum() - np.cumsum(marks))
    cut = np.flatnonzero(np.r_[ranked[1:] != ranked[:-1], False])
    if len(cut):
        at = cut[np.argmax(right[cut])]
        model.middle = float((ranked[at] + ranked[at + 1]) / 2)
    model.slope = max(float(beta[1]) / size, 1e-3)
    return model


def _score(batches, model: Toxicity, extra: int):
    for batch in batches:
        texts = [t.encode("utf-8").translate(TABLE) for t in batch.column(1).to_pylist()]
        n_tokens, score, passages = [], [], []
        for words, stems in token_hashes(texts, STEM):
            segments = maximal_segments(*model.hits(words, stems), model.rest)
            n_tokens.append(len(words))
            score.append(model.score(len(words), segments))
            passages.append([{"first": a, "behind": z, "score": s, "expected": model.chance * len(words) * math.exp(-min(model.scale * s, 700))} for a, z, s in segments])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(extra)], pa.array(n_tokens, pa.int64()), pa.array(score, pa.float64()), pa.array(passages, kind)],
                                         names=["doc_id", *batch.schema.names[2:], "n_tokens", "score", "passages"])


def scored(rows: DataFrame, model: Toxicity, keep: tuple = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_tokens, score, passages."""
    passage = StructType([StructField("first", IntegerType()), StructField("behind", IntegerType()), StructField("score", DoubleType()), StructField("expected", DoubleType())])
    schema = StructType([StructField("doc_id", LongType()), *[StructField(c, rows.schema[c].dataType) for c in keep],
                         StructField("n_tokens", LongType()), StructField("score", DoubleType()), StructField("passages", ArrayType(passage))])
    return rows.select("doc_id", "text", *keep).mapInArrow(lambda b: _score(b, model, len(keep)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (0 to 1), passages (tokens from first to behind, score, number expected by chance) for every row.

    * A null or empty text has no tokens and the score of no evidence. A null doc_id is scored like any other.
    * Labels of documents that are not there, null labels and values but 0 and 1 are ignored; of several labels of a document the larger counts.
    * Rows that repeat are scored one by one. An empty table gives an empty result. Other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    return scored(rows, fit(rows, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns."""
    model = fit(id_and_text(docs), labels)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return scored(rows, model, keep=("row",)).where("score < 0.5").select("row.*")
