"""Quality classifier from weak labels.

Heuristic labellers each vote for one class, or not, on each document that is
long enough for them. The numbers of
documents by pattern of votes, counted over the whole corpus, are all that
expectation-maximisation needs: it estimates each labeller's accuracies and the
share of good documents, and gives each pattern a posterior. The posteriors are
the labels of a hashed linear scorer (logistic regression over hashed words and
binned style measures), fitted on a bounded sample; every document is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import bound_batches, claim, some, utf8

#: Documents, about, that the scorer is fitted on; chosen by a hash of the text.
SAMPLE_ROWS = 10_000
#: Hash bins of the scorer.
BINS = 1 << 16
#: Scores from which a document is kept.
KEEP = 0.5
ROUNDS = 100
#: Weight of the labellers' starting rates, as a share of the documents.
PRIOR_SHARE = 0.02

MEASURES = ("symbols", "capitals", "marks", "pipes", "repeats", "word_size", "ends", "odd")
#: Name, vote, measure, least words to vote, and the range of the measure in which it votes.
LABELLERS = (
    ("symbols", 1, "symbols", 1, 0.5, 1e9),
    ("capitals", 1, "capitals", 5, 0.7, 1e9),
    ("shouting", 1, "marks", 5, 0.3, 1e9),
    ("cells", 1, "pipes", 5, 0.25, 1e9),
    ("repetitive", 1, "repeats", 50, 0.8, 1e9),
    ("long_words", 1, "word_size", 20, 20.0, 1e9),
    ("odd_signs", 1, "odd", 5, 0.1, 1e9),
    ("sentences", 0, "ends", 5, 0.02, 0.5),
    ("plain_signs", 0, "odd", 1, 0.0, 0.07),
    ("plain_case", 0, "capitals", 5, 0.0, 0.3),
    ("varied", 0, "repeats", 20, 0.0, 0.6),
)
SILENT, VOTED, SHORT = 0, 1, 2


def measures(text: bytes) -> tuple[int, np.ndarray]:
    """Words, and the measures: symbols, capital words, exclamation marks and pipes per word, the share of words seen before in the text, mean word size, words that end a sentence, and signs other than sentence marks per byte of words."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, np.zeros(len(MEASURES))
    symbols = sum(text.count(bytes([c])) for c in b"#*$%&<>")
    capitals = sum(map(bytes.isupper, words))
    size = sum(map(len, words))
    marks, pipes = text.count(b"!"), text.count(b"|")
    ends = sum(w.endswith((b".", b"?")) for w in words)
    values = (symbols, capitals, marks, pipes, n - len(set(words)), size, ends, (symbols + marks + pipes) * n / size)
    return n, np.array(values, float) / n


def votes(n: int, values: np.ndarray) -> int:
    """The pattern of votes as one number, a base-3 digit per labeller."""
    pattern = 0
    for _, _, measure, least, low, high in LABELLERS:
        says = SHORT if n < least else VOTED if low <= values[MEASURES.index(measure)] <= high else SILENT
        pattern = pattern * 3 + says
    return pattern


def digits(patterns: np.ndarray) -> np.ndarray:
    """Votes of each labeller by pattern."""
    k = len(LABELLERS)
    return patterns[:, None] // 3 ** np.arange(k - 1, -1, -1)[None, :] % 3


@dataclass
class LabelModel:
    """The share of bad documents, and how often each labeller votes on documents of each class (good, bad)."""

    bad: float
    rates: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """Expectation-maximisation; a labeller's rates start, and are smoothed, as one that is right more often than not.

        A document too short for a labeller says nothing about it.
        """
        seen = digits(patterns)
        prior = np.array([[0.02, 0.3] if vote else [0.9, 0.5] for _, vote, *_ in LABELLERS]).T
        weight = 1 + PRIOR_SHARE * counts.sum()
        model = cls(0.1, prior)
        p = model.posterior(patterns)
        for _ in range(ROUNDS):
            by_class = np.stack([counts * (1 - p), counts * p])
            voted = by_class @ (seen == VOTED)
            able = by_class @ (seen != SHORT)
            model = cls((float(by_class[1].sum()) + 1) / (float(counts.sum()) + 10), (voted + weight * prior) / (able + weight))
            new = model.posterior(patterns)
            if not len(p) or np.abs(new - p).max() < 1e-9:
                break
            p = new
        return model

    def accuracies(self) -> np.ndarray:
        """The probability that a vote of each labeller names the class of the document."""
        right = [self.bad * self.rates[1, j] if vote else (1 - self.bad) * self.rates[0, j] for j, (_, vote, *_) in enumerate(LABELLERS)]
        return np.array(right) / (self.bad * self.rates[1] + (1 - self.bad) * self.rates[0])

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of the bad class by pattern."""
        seen = digits(patterns)
        logs = (seen == VOTED) @ np.log(self.rates).T + (seen == SILENT) @ np.log(1 - self.rates).T
        z = logs[:, 1] - logs[:, 0] + np.log(self.bad / (1 - self.bad))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def features(text: bytes, measured: tuple[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bins and values of unit length: words in lower case, and each measure's step on a log scale (of ``measures``, where they are known)."""
    counts = Counter(zlib.crc32(w) % BINS for w in text.lower().split())
    size = sum(v * v for v in counts.values()) ** 0.5 or 1.0
    bins = {b: v / size for b, v in counts.items()}
    n, values = measured or measures(text)
    for name, x in zip(MEASURES, values.tolist()):
        key = zlib.crc32(f"{name} {int(np.log2(x + 1 / 64) * 2)}".encode()) % BINS if n else zlib.crc32(b"empty") % BINS
        bins[key] = bins.get(key, 0.0) + 1.0
    return np.fromiter(bins.keys(), np.int32, len(bins)), np.fromiter(bins.values(), np.float32, len(bins))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, rounds: int = 150, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights by bin (the last is the intercept) of a logistic regression on soft targets, by adaptive gradient steps."""
    weights = np.zeros(BINS + 1)
    if not rows:
        return weights
    at = np.concatenate([b for b, _ in rows])
    x = np.concatenate([v for _, v in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    past = np.full(BINS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, x * weights[at], len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - targets) / len(rows)
        grad = np.append(np.bincount(at, x * error[row], BINS), error.sum()) + l2 * np.append(weights[:-1], 0) / BINS
        past += grad * grad
        weights -= rate * grad / np.sqrt(past)
    return weights


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """The label model from the votes on every row, and the scorer from a sample of about ``sample_rows`` rows.

    The sample is all rows whose text hash is small enough, so that it does
    not depend on the order or partitions of the rows; copies of a text stand
    in it together, each with the weight one over its copies in the sample.
    """
    bound_batches(docs.sparkSession)
    text = utf8(F.col(f"`{text_col}`"))

    @F.arrow_udf("long")
    def vote(texts: pa.Array) -> pa.Array:
        claim("quality")
        return pa.array([votes(*measures(t)) for _, part in some(texts) for t in part.to_pylist()], pa.int64())

    counts = docs.select(vote(text).alias("p")).groupBy("p").count().collect()
    patterns, n = np.array([r.p for r in counts], np.int64), np.array([r["count"] for r in counts], float)
    labels = LabelModel.fit(patterns, n)
    total = int(n.sum())

    @F.arrow_udf("struct<pattern:long,bins:binary,values:binary>")
    def describe(texts: pa.Array) -> pa.Array:
        claim("quality")
        rows = []
        for t in (t for _, part in some(texts) for t in part.to_pylist()):
            measured = measures(t)
            bins, values = features(t, measured)
            rows.append({"pattern": votes(*measured), "bins": bins.tobytes(), "values": values.tobytes()})
        return pa.array(rows, pa.struct([("pattern", pa.int64()), ("bins", pa.binary()), ("values", pa.binary())]))

    share = min(1.0, sample_rows / max(total, 1))
    hashed = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    chosen = docs.select(text.alias("t")).where(hashed < F.lit(int(share * (1 << 30)))).dropDuplicates(["t"]).select(describe("t").alias("d")).select("d.*")
    rows = sorted(chosen.collect(), key=lambda r: (r.pattern, bytes(r.bins), bytes(r["values"])))
    found = [(np.frombuffer(r.bins, np.int32), np.frombuffer(r["values"], np.float32)) for r in rows]
    targets = labels.posterior(np.array([r.pattern for r in rows], np.int64)) if rows else np.zeros(0)
    return QualityModel(labels, fit_scorer(found, 1 - targets))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out`` of (score, label_posterior, kept).

    ``score`` is the scorer's probability that the document is good,
    ``label_posterior`` the label model's. Null and empty texts, and others
    without a word, have both 0 and are not kept. Rows are scored one by one,
    repeated ones alike. A column already named ``out`` is replaced; all others
    are kept, whatever their names.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,label_posterior:double,kept:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        claim("quality")
        model, z, patterns = sent.value, [], []
        words = []
        for t in (t for _, part in some(texts) for t in part.to_pylist()):
            n, found = measures(t)
            bins, values = features(t, (n, found))
            z.append(float(model.weights[bins] @ values) + model.weights[-1])
            words.append(n > 0)
            patterns.append(votes(n, found))
        there = np.array(words, bool)
        p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50)))
        good = 1 - model.labels.posterior(np.array(patterns, np.int64)) if patterns else p
        p, good = np.where(there, p, 0.0), np.where(there, good, 0.0)
        return pa.StructArray.from_arrays([pa.array(p), pa.array(good), pa.array(p >= KEEP)], ["score", "label_posterior", "kept"])

    return docs.withColumn(out, run.asNondeterministic()(utf8(F.col(f"`{text_col}`"))))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, score, label_posterior, kept."""
    rows = docs.select("doc_id", "text")
    return score(rows, train(rows)).select("doc_id", "quality.*")
