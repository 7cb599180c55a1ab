"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good beats one labelled bad) are drawn from a bounded sample
of labelled rows; logistic loss on the difference of their feature vectors learns a score whose
order is the preference order.  A one-variable logistic fit on the same sample turns scores into
probabilities, and a quantile of the sample's scores is the threshold below which documents go.

The model is fitted on at most ``max_labelled`` rows (a parameter, 20,000 by default, chosen by
hash of the id); it is a few hundred numbers, and every document is scored with it.

Defined results: a null or empty text has zero features and gets a score like any other; without
both labels in the sample every score is 0.5 and nothing is rejected; a ``doc_id`` labelled twice
takes the larger label; repeated rows each get a row; a null ``doc_id`` is never held out; an empty
table gives an empty result.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, run_hashes, BYTE_VALUE, slices, word_bounds

# Function words of the corpus languages.
FUNCTION_WORDS = (
    "the of and to in is was that it for on with as are be this by from at or an a not but have "
    "le la les de du des et un une en que qui dans pour par sur au aux est pas ne se "
    "der die das und ein eine zu den dem mit von nicht sich auf ist im auch "
    "el los las y con para no su al lo como por del más"
).split()
CLASSES = np.full(256, 9, np.uint8)  # other punctuation and control characters
CLASSES[0x61:0x7B] = 0
CLASSES[0x41:0x5B] = 1
CLASSES[0x30:0x3A] = 2
for _i, _chars in ((3, b" \t\x0b\x0c\r"), (4, b"\n"), (5, b"#*$%&<>^~_=@\\{}[]"), (6, b"|"), (7, b"!?"), (8, b".,;:'\"()-")):
    CLASSES[list(_chars)] = _i
CLASSES[0x80:] = 10
N_CLASSES = 11
N_FEATURES = N_CLASSES + 9
BINS = 8


def _function_hashes() -> np.ndarray:
    raw = [w.encode() for w in FUNCTION_WORDS]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return np.unique(run_hashes(BYTE_VALUE[data], ends - [len(w) for w in raw], ends))


def features(column: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers per text, from character classes and word statistics."""
    known = _function_hashes()
    out = []
    for _, _, data, offsets in slices(column):
        n = len(offsets) - 1
        size = np.diff(offsets)
        owner = np.repeat(np.arange(n), size)
        classes = np.bincount(owner * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        lower = LOWER[data]
        starts, ends, first = word_bounds(lower, offsets)
        words = np.diff(first)
        doc = np.repeat(np.arange(n), words)
        hashes = run_hashes(BYTE_VALUE[lower], starts, ends)
        length = ends - starts
        per_word = np.maximum(words, 1)
        ordered = np.lexsort((hashes, doc))
        h, d = hashes[ordered], doc[ordered]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d[new], minlength=n)
        runs = np.diff(np.flatnonzero(np.append(new, True))) if len(h) else np.zeros(0, int)
        top = np.zeros(n, int)
        np.maximum.at(top, d[new], runs)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        mean = np.bincount(doc, length, n) / per_word
        stats = np.stack([
            np.log1p(words),
            mean,
            np.bincount(doc, (length - mean[doc]) ** 2, n) / per_word,
            np.bincount(doc[np.isin(hashes, known)], minlength=n) / per_word,
            distinct / per_word,
            np.log1p(distinct),
            top / per_word,
            np.bincount(doc[again], minlength=n) / per_word,
            np.bincount(doc[length == 1], minlength=n) / per_word,
        ], axis=1)
        out.append(np.hstack([classes / np.maximum(size, 1)[:, None], stats]))
    return np.vstack(out) if out else np.zeros((0, N_FEATURES))


@dataclass(frozen=True)
class RankingModel:
    """Bin edges per feature, a weight per bin, the calibration line and the rejection threshold."""

    edges: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(x))
        return self.weights[_bins(x, self.edges)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.intercept, -40, 40)))


NO_MODEL = RankingModel(np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, -np.inf)


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Index of the active bin of each feature in the joint one-hot layout."""
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * BINS for j in range(len(edges))], axis=1)


def fit_pairs(x: np.ndarray, y: np.ndarray, steps: int = 400, pairs: int = 4096, seed: int = 7, spare: float = 0.005) -> RankingModel:
    """Learn from preference pairs by Adam on the Bradley-Terry log-likelihood.

    The threshold is the score quantile at the share of bad labels, but never above the quantile
    ``spare`` of the good ones, so that at most that share of good documents is rejected.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return NO_MODEL
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    # Rare kinds of bad documents live in the tails: half of the bins split what bad rows show.
    edges[:, ::2] = np.quantile(x[bad], np.linspace(0.1, 0.9, edges[:, ::2].shape[1]), axis=0).T
    edges.sort(axis=1)
    active = _bins(x, edges)
    w = np.zeros(len(edges) * BINS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        i, j = active[rng.choice(good, pairs)], active[rng.choice(bad, pairs)]
        lost = 1 / (1 + np.exp(np.clip(w[i].sum(axis=1) - w[j].sum(axis=1), -40, 40)))
        grad = 1e-4 * w
        grad -= np.bincount(i.ravel(), np.repeat(lost, i.shape[1]), len(w)) / pairs
        grad += np.bincount(j.ravel(), np.repeat(lost, j.shape[1]), len(w)) / pairs
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    s = w[active].sum(axis=1)
    slope, intercept = _calibrate(s, y)
    threshold = min(np.quantile(s, len(bad) / len(y)), np.quantile(s[good], spare))
    return RankingModel(edges, w, slope, intercept, float(threshold))


def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the score by Newton steps with a small ridge."""
    center, scale = s.mean(), s.std() + 1e-9
    z = np.stack([(s - center) / scale, np.ones_like(s)], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        beta += np.linalg.solve(h, z.T @ (y - p) - 1e-2 * beta)
    return float(max(beta[0], 0.0) / scale), float(beta[1] - max(beta[0], 0.0) * center / scale)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> RankingModel:
    """Fit on at most ``max_labelled`` labelled rows that are not held out."""
    key = labels["doc_id"].cast("long")
    rows = labels.select(key.alias("doc_id"), labels["quality"].cast("int").alias("quality")).filter(
        key.isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out(key)
    )
    sample = rows.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"])
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")  # at most max_labelled rows of 12 bytes

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], ["doc_id", "quality", "x"]
            )

    found = joined.mapInArrow(extract, "doc_id long, quality int, x binary").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return NO_MODEL
    x = np.frombuffer(b"".join(found["x"].to_pylist()), "<f4").reshape(-1, N_FEATURES).astype(float)
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))
    return fit_pairs(x[order], found["quality"].to_numpy()[order])


def score_quality(documents: DataFrame, model: RankingModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) and ``accepted`` (score at or above the threshold)."""
    fields = [documents.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            x = features(b.column("_scored_text")).astype("<f4").astype(float)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(model.score(x)), pa.array(model.raw(x) >= model.threshold)],
                [*keep, "score", "accepted"],
            )

    return documents.select(*[documents[c] for c in keep], documents["text"].alias("_scored_text")).mapInArrow(run, schema)


def quality_scores(documents: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """Score of every document, whether its label was held out, and the verdict at ``cut``."""
    base = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"])
    scored = score_quality(base, fit_quality(documents, labels))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "accepted"
    )


def filter_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, without those whose score lies below the quantile threshold.

    Nothing is added to the rows on the way, so columns may have any name.
    """
    model = fit_quality(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            x = features(b.column("text")).astype("<f4").astype(float)
            yield b.filter(pa.array(model.raw(x) >= model.threshold))

    return documents.mapInArrow(run, documents.schema)
