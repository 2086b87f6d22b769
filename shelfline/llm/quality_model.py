"""Quality classifier: naive Bayes support vectors.

A text becomes the set of its n-grams (words, word pairs, characters in runs
of four, and how much it repeats itself, hashed).  Each n-gram's indicator is scaled by its log-count
ratio between the classes, counted over all labelled training rows; the scaled
vectors are brought to unit length and a linear hinge-loss model is fitted by
dual coordinate descent on a bounded sample of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.texthash import mix, run_hashes, split_words, word_hashes
from shelfline.session import materialize

BITS = 18                        # n-grams hash to 2**BITS features
SLICE_BITS = 6                   # of a feature, that name the array it is counted in
SAMPLE_ROWS = 3_000              # bound on the labelled texts that the hinge loss is fitted on
MOST_COPIES = 16                 # rows of one text and label that count in the hinge loss


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a whole text; none for null and empty."""
    data = (text or "").encode()
    hashes = word_hashes(split_words(data))
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    chars = codes[:-3]
    for k in (1, 2, 3):
        chars = chars << np.uint64(8) | codes[k:len(codes) - 3 + k] if len(codes) > 3 else chars
    grams = np.concatenate([mix(hashes), run_hashes(hashes, 2), mix(_distinct(chars) + np.uint64(1)),
                            _repetition(hashes)])
    return _distinct((grams >> np.uint64(64 - BITS)).astype(np.int64))


def _repetition(hashes: np.ndarray) -> np.ndarray:
    """Two n-grams of shape instead of words: the share (in tenths, rounded
    up) of words that equal the word before, and of 3-word runs seen before."""
    runs = np.sort(run_hashes(hashes, 3))
    if not len(runs):
        return runs
    same = math.ceil(10 * float(np.mean(hashes[1:] == hashes[:-1])))
    seen = math.ceil(10 * float(np.sum(runs[1:] == runs[:-1])) / len(runs))
    return mix(np.array([1 << 40 | same, 1 << 41 | seen], dtype=np.uint64))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


@dataclass(frozen=True)
class Model:
    weights: np.ndarray          # per feature, with its log-count ratio multiplied in
    ratios: np.ndarray
    bias: float
    slope: float                 # of the score, a logistic function of the margin
    offset: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        length = float(np.sqrt(np.square(self.ratios[found]).sum()))
        return self.bias + (float(self.weights[found].sum()) / length if length else 0.0)

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -30, 30))))


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, costs: np.ndarray,
              n_features: int, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Dual coordinate descent for a linear model with hinge loss (each row's
    multiplier lies between 0 and its cost); rows are sparse."""
    w, alpha = np.zeros(n_features), np.zeros(len(rows))
    norms = [float(np.square(v).sum()) for v in values]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            if not norms[i]:
                continue
            slack = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), costs[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS, cost: float = 1.0, smoothing: float = 1.0) -> Model:
    """Fit on all rows of `labelled` with a label of 0 or 1 (others, null
    included, are left out).  The log-count ratios use every row; the hinge
    loss uses at most `sample_rows` distinct texts, drawn by a hash of the text
    within each class (half of them, or what the other class leaves).  A text
    weighs as many rows as it has, up to `MOST_COPIES`, and a class as many as
    its share of all rows.
    Without rows of both classes the model scores every text the same."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1)).withColumn("h", F.xxhash64("text", F.lit(11)))

    def count(frames):
        counts, docs = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for pdf in frames:
            for text, label in zip(pdf["text"], pdf["label"]):
                counts[label, features(text)] += 1
                docs[label] += 1
            drawn = pdf[["label", "h"]].drop_duplicates()
            yield pd.DataFrame({"label": drawn["label"], "feature": -2, "h": drawn["h"], "n": 1})
        for label in (0, 1):
            used = np.flatnonzero(counts[label])
            yield pd.DataFrame({"label": label, "feature": used, "h": 0, "n": counts[label, used]})
            yield pd.DataFrame({"label": [label], "feature": [-1], "h": [0], "n": [docs[label]]})

    def pack(table: pa.Table) -> pa.Table:
        slice_ = table["slice"][0].as_py()
        held = np.zeros((2, 1 << BITS - SLICE_BITS), dtype=np.int64)
        held[table["label"].to_numpy(), table["feature"].to_numpy() >> SLICE_BITS] = table["n"].to_numpy()
        return pa.table({"slice": pa.array([slice_], pa.int64()), "counts": pa.array([held.tobytes()], pa.binary())})

    # At most 2 * (2**BITS + 1) sums, however many rows there are; the driver
    # gets them as a few arrays (4 MB).  The hashes of the distinct texts
    # (feature -2) stay in the table.
    sums = (rows.mapInPandas(count, "label int, feature long, h long, n long")
            .groupBy("label", "feature", "h").agg(F.sum("n").alias("n")))
    sums = materialize(sums, "quality-counts")
    docs, texts = np.zeros(2), np.zeros(2, dtype=np.int64)
    for x in sums.where("feature = -1").collect():
        docs[x.label] = x.n
    for x in sums.where("feature = -2").groupBy("label").count().collect():
        texts[x.label] = x["count"]
    if not docs.all():
        only = float(np.argmax(docs)) if docs.any() else 0.5
        return Model(np.zeros(1 << BITS), np.ones(1 << BITS), 0.0, 0.0, (only - 0.5) * 20)
    counts = np.zeros((2, 1 << BITS))
    slices = sums.where("feature >= 0").withColumn("slice", F.col("feature") % (1 << SLICE_BITS))
    for x in slices.groupBy("slice").applyInArrow(pack, "slice long, counts binary").collect():
        counts[:, x.slice::1 << SLICE_BITS] = np.frombuffer(x.counts, np.int64).reshape(2, -1)
    smooth = counts + smoothing
    ratios = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())

    cuts = []
    for label in (0, 1):
        most = int(min(texts[label], max(sample_rows // 2, sample_rows - texts[1 - label])))
        part = min(1.0, (1.5 * most + 100) / texts[label])       # so that few hashes are sorted
        low = sums.where((F.col("feature") == -2) & (F.col("label") == label) & (
            F.col("h") <= min((1 << 63) - 1, int(part * (1 << 64)) - (1 << 63))))
        cuts.append(low.orderBy("h").limit(most).agg(F.max("h")).first()[0])

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype("<u4").tobytes())

    def fit(table: pa.Table) -> pa.Table:
        """The model of the bounded sample, fitted in one task."""
        table = table.sort_by([("h", "ascending"), ("label", "ascending")])
        bias_at = 1 << BITS
        y = np.where(table["label"].to_numpy() == 1, 1.0, -1.0)
        index, values = [], []
        for f in table["f"].to_pylist():
            f = np.frombuffer(f, "<u4")
            v = ratios[f]
            length = np.sqrt(np.square(v).sum())
            index.append(np.append(f, np.uint32(bias_at)))
            values.append(np.append(v / length if length else v, 1.0).astype(np.float32))
        copies = np.minimum(table["n"].to_numpy(), MOST_COPIES).astype(np.float64)
        share_of = docs / docs.sum()
        for side, share in ((y < 0, share_of[0]), (y > 0, share_of[1])):
            copies[side] *= len(y) * share / copies[side].sum()
        costs = cost * copies / np.where(y > 0, 2 * share_of[1], 2 * share_of[0])
        w = fit_hinge(index, values, y, costs, bias_at + 1)
        margins = np.array([w[i] @ v for i, v in zip(index, values)])
        slope, offset = calibrate(margins, y > 0, copies)
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "slope": [slope], "offset": [offset]})

    # Both filters read the text alone or with the label, so they come before the labels' join where they can.
    sample = (rows.where(F.col("h") <= max(cuts)).where(F.col("h") <= F.when(F.col("label") == 0, cuts[0]).otherwise(cuts[1]))
              .groupBy("label", "h").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))
              .select("label", "h", "n", packed("text").alias("f"), F.lit(0).alias("all")))
    found = sample.groupBy("all").applyInArrow(fit, "w binary, slope double, offset double").first()
    w = np.frombuffer(found.w, np.float64)
    return Model(w[:-1] * ratios, ratios, float(w[-1]), found.slope, found.offset)


def calibrate(margins: np.ndarray, positive: np.ndarray, weights: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic score of the margin (Newton steps, with
    a small pull to zero so that separable classes stay finite)."""
    a, b = 1.0, 0.0
    n = len(margins)
    ones, zeros = weights[positive].sum(), weights[~positive].sum()
    target = np.where(positive, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.column_stack([margins, np.ones(n)])
    theta = np.array([a, b])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weights * (p - target)) + 1e-3 * theta
        curve = (x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def scorer(model: Model):
    """A column function: text -> score between 0 and 1, over whole texts."""
    slim = Model(model.weights.astype(np.float32), model.ratios.astype(np.float32), model.bias,
                 model.slope, model.offset)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(slim.score, na_action=None).astype("float64")

    def column(text: Column) -> Column:
        return score(F.coalesce(text, F.lit("")))
    return column


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train_on_labels(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, **options) -> Model:
    """Fit on the documents that have a label, without those whose id falls
    into the held-out fold.  A document with several label rows counts once
    for each.  Labels grow with the corpus, so the join is a merge join at
    every size."""
    train_docs = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != held_out_fold)
    return train(train_docs.join(labels.select("doc_id", "quality").hint("merge"), "doc_id"), **options)
