"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

A linear classifier is fitted with numpy from confirmed toxic texts and unlabelled ones. Its features are
the words of a text and the beginnings of its words: whether they occur, and whether they make up a
hundredth of its words and occur more than once. Its risk is prior * mean loss of the toxic as toxic, plus the
loss of the unlabelled as clean less prior * that of the toxic as clean; where that second part falls below
zero, the step climbs it back instead. Copies and near copies in the sample count once, so that a text that
was copied often doesn't teach its rare words.

Bounds: fitting takes at most ``max_positive`` toxic and ``max_unlabelled`` texts, those of the ids of the
least hashes, one for each id; scoring covers all rows and whole texts. The model has at most
``MAX_FEATURES`` weights.

A null, empty or wordless text gets the score of the bias alone. With no toxic row to learn from, all
scores are 0. Repeated rows get equal scores. Of rows with one id and several texts the least text may
teach. A very long text is scored whole. An empty table gives an empty result and teaches nothing. Result
columns of ``score`` replace input columns of the same name; ``clean`` adds none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batches_with, segment_sums, slices, split_words, text_place

#: Lengths of the beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6)
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 2000, 6000, 50_000
MIN_DOCS, MIN_SIGMA = 5, 6.0
#: The share of a text's words from which on a feature is dense.
DENSE = 0.01
STEPS, RATE, RIDGE = 1000, 0.1, 1e-4
THRESHOLD = 0.3
#: Minima that tell near copies in the sample: equal in all of one band.
BANDS, BAND_ROWS = 4, 4


def word_features(words: pa.Array) -> np.ndarray:
    """(words, 1 + prefixes) 32-bit feature hashes; 0 where a word is no longer than the prefix."""
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint32)
    if len(words):
        out[:, 0] = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.uint32, len(words))
        length = np.asarray(pc.utf8_length(words))
        for k, n in enumerate(PREFIXES, 1):
            begin = pc.utf8_slice_codeunits(words, 0, n).cast(pa.binary()).to_pylist()
            out[:, k] = np.where(length > n, np.fromiter((zlib.crc32(b, n) for b in begin), np.uint32, len(words)), 0)
    return out


def dense(features: np.ndarray) -> np.ndarray:
    """The features that stand for "not once, and in at least DENSE of the words"."""
    return (features.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(0x7F4A7C15)).astype(np.uint32)


def is_dense(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (count >= 2) & (count >= DENSE * words)


def row_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct features, row by row, first of each row and the end)."""
    words, codes, starts = split_words(texts, letters=True)
    if not len(words):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    per, times = np.unique(row * len(words) + codes, return_counts=True)
    features = word_features(words)[per % len(words)].astype(np.int64)
    use = features > 0
    both, at = np.unique(((per // len(words))[:, None] << 32 | features)[use], return_inverse=True)
    count = np.bincount(at, np.broadcast_to(times[:, None], use.shape)[use])
    often = both[is_dense(count, np.diff(starts)[both >> 32])]
    both = np.unique(np.concatenate([both, often >> 32 << 32 | dense(often & 0xFFFFFFFF).astype(np.int64)]))
    return (both & 0xFFFFFFFF).astype(np.uint32), np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.int64) << 32)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for a, b in slices(texts):
            words, codes, starts = split_words(texts.slice(a, b), letters=True)
            z = np.full(b, self.bias)
            if len(words) and len(self.features):
                hashed, n = word_features(words), len(self.features)
                row = np.repeat(np.arange(b), np.diff(starts))
                for wanted, many in ((hashed, False), (dense(hashed), True)):
                    at = np.minimum(np.searchsorted(self.features, wanted), n - 1)
                    hit = (self.features[at] == wanted) & (hashed > 0)
                    use = hit.any(axis=1)[codes]
                    key, count = np.unique((row[use][:, None] * n + at[codes[use]])[hit[codes[use]]], return_counts=True)
                    if many:
                        key = key[is_dense(count, np.diff(starts)[key // n])]
                    z += np.bincount(key // n, self.weights[key % n], b)
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def without_copies(docs: list[np.ndarray]) -> list[int]:
    """The places of the first of all feature sets that agree in the minima of a band."""
    places = [i for i, d in enumerate(docs) if len(d)]
    full = [docs[i] for i in places]
    if not full:
        return list(range(min(1, len(docs))))
    flat, starts = np.concatenate(full).astype(np.uint64), np.cumsum([0, *map(len, full)])[:-1]
    factors = np.random.default_rng(2).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    minima = np.stack([np.minimum.reduceat(flat * f >> np.uint64(32), starts) for f in factors], axis=1)
    seen: set = set()
    kept = []
    for i, m in zip(places, minima, strict=True):
        keys = {(k, m[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes()) for k in range(BANDS)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, marks: list[float | None] | None = None) -> Model:
    """Non-negative risk, full batches, Adam. Only features that tell the two sets apart get a weight.

    ``marks``: labels of texts of that set as far as known. They do not teach the classifier: their mean is
    the prior of what is left of the set without copies (where at least 200 are known), and they turn its
    margins into probabilities."""
    kept = without_copies(unlabelled)
    sets = [[positive[i] for i in without_copies(positive)], [unlabelled[i] for i in kept]]
    known = [marks[i] for i in kept if marks[i] is not None] if marks else []
    if len(known) >= 200 and 0 < sum(known) < len(known):
        prior = sum(known) / len(known)
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in sets]
    names, total = np.unique(np.concatenate(flat), return_counts=True)
    names = np.append(names[total >= MIN_DOCS], np.uint32(0))  # 0 stands for the rest
    names.sort()
    places = [np.searchsorted(names, f).astype(np.int32) for f in flat]
    places = [np.where(names[np.minimum(p, len(names) - 1)] == f, p, 0) for p, f in zip(places, flat, strict=True)]
    n = [max(1, len(x)) for x in sets]
    seen = [np.bincount(p, minlength=len(names)) for p in places]
    share = (seen[0] + seen[1]) / (n[0] + n[1])
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    sigma = np.abs(seen[0] / n[0] - seen[1] / n[1]) / spread
    sigma[0] = 0
    chosen = np.sort(np.argsort(-sigma, kind="stable")[: min(MAX_FEATURES, int((sigma >= MIN_SIGMA).sum()))])
    to = np.full(len(names), -1)
    to[chosen] = np.arange(len(chosen))
    data = []
    for docs, place in zip(sets, places, strict=True):
        row, col = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), to[place]
        row, col = row[col >= 0], col[col >= 0]
        data.append((col, np.searchsorted(row, np.arange(len(docs) + 1))))
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def margins(cols, starts):
        return segment_sums(theta[cols], starts) + theta[-1]

    def gradient(cols, starts, by_row):
        return np.append(np.bincount(cols, np.repeat(by_row, np.diff(starts)), len(chosen)), by_row.sum())

    for step in range(1, STEPS + 1):
        zp, zu = margins(*data[0]), margins(*data[1])
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        # sigmoid loss: the mean score of those that should score low, less what the toxic among them explain
        clean = su.sum() / n[1] - prior * sp.sum() / n[0]
        g_clean = gradient(*data[1], su * (1 - su) / n[1]) - prior * gradient(*data[0], sp * (1 - sp) / n[0])
        g = -prior * gradient(*data[0], sp * (1 - sp) / n[0]) + g_clean if clean >= 0 else -g_clean
        g[:-1] += RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    slope, shift = 1.0, 0.0
    if 0 < sum(known) < len(known):
        slope, shift = calibrated(margins(*data[1])[[k for k, i in enumerate(kept) if marks[i] is not None]], np.array(known))
    return Model(names[chosen], slope * theta[:-1], float(slope * theta[-1] + shift))


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve that turns margins into probabilities (Platt): Newton steps,
    halved until the loss falls."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    want, x, w = np.where(y > 0, high, low), np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        m = x @ w
        return float((np.logaddexp(0, m) - want * m).sum() + 5e-4 * w @ w)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - want) + 1e-3 * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) >= now:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
        now = loss(w)
    return (float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model | None:
    """``docs``: rows that may be learned from; ``labels``: (id, label) of rows that may be learned from.

    The prior is the share of toxic rows among those labelled in the sample, unless given."""
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_y")).filter("_y is not null and _id is not null")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).filter("_id is not null")
    estimate = prior is None
    if estimate:
        prior = known.agg(F.avg(F.col("_y").cast("double"))).first()[0]
    if not prior:
        return None
    prior = min(prior, 0.99)
    toxic = texts.select("_id").join(known.filter("_y = 1").select("_id").distinct(), "_id").distinct()
    by_hash = F.xxhash64("_id", F.lit(9))
    picked = toxic.orderBy(by_hash, "_id").limit(max_positive).withColumn("_set", F.lit(0))
    picked = picked.unionByName(texts.select("_id").distinct().orderBy(by_hash, "_id").limit(max_unlabelled).withColumn("_set", F.lit(1)))
    marks = known.groupBy("_id").agg(F.max("_y").cast("double").alias("_y"))
    picked = picked.join(marks, "_id", "left")
    # at most max_positive + max_unlabelled ids, and one text of each: an id that many rows share counts once
    chosen = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_set", "_y").agg(F.min("_text").alias("_text"))
    chosen = chosen.orderBy("_set", by_hash, "_id")  # of copies the first teaches: the same one in every run

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                features, starts = row_features(batch.column(0).slice(a, b))
                held = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(features.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b), batch.column(2).slice(a, b), held], names=["_set", "_y", "_cols"])

    found = chosen.select("_text", "_set", "_y").mapInArrow(run, "_set int, _y double, _cols array<int>").toArrow()
    sets: list[list[np.ndarray]] = [[], []]
    of_rest = []
    for k, y, cols in zip(found["_set"].to_pylist(), found["_y"].to_pylist(), found["_cols"].combine_chunks(), strict=True):
        sets[k].append(np.asarray(cols.values).view(np.uint32))
        if k:
            of_rest.append(y)
    return fit(sets[0], sets[1], prior, of_rest if estimate else None) if sets[0] else None


def score(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if the score is at least ``threshold``)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name.lower() not in ("score", "predicted")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"])
    place = text_place(df, text_col)

    def run(batches):
        for batch in batches:
            found = shared.value
            values = found.scores(batch.column(place)) if found else np.zeros(batch.num_rows)
            yield batches_with(batch, {"score": pa.array(values), "predicted": pa.array((values >= threshold).astype(np.int32))})

    return df.mapInArrow(run, schema)


def clean(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with its own columns only, whatever their names."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = text_place(df, text_col)

    def run(batches):
        for batch in batches:
            found = shared.value
            yield batch.filter(pa.array(found.scores(batch.column(place)) < threshold)) if found else batch

    return df.mapInArrow(run, df.schema)
