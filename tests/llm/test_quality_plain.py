"""The quality classifier against a plain version: features, counts, ratios,
the fitted weights and the query's columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import quality_model
from shelfline.llm.quality_model import BITS, MOST_COPIES, features, fold, scorer, train, train_on_labels
from shelfline.llm.texthash import mix, run_hashes, word_hashes

from .data import awkward_texts, frame, prose


def one(value: int) -> int:
    return int(mix(np.array([value], dtype=np.uint64))[0]) >> (64 - BITS)


def plain_features(text):
    data = (text or "").encode()
    ws = data.split()
    out = {one(int(word_hashes([w])[0])) for w in ws}
    out |= {int(run_hashes(word_hashes([a, b]), 2)[0]) >> (64 - BITS) for a, b in zip(ws, ws[1:])}
    out |= {one(int.from_bytes(data[i:i + 4], "big") + 1) for i in range(len(data) - 3)}
    runs = list(zip(ws, ws[1:], ws[2:]))
    if runs:
        same = math.ceil(10 * float(np.mean([a == b for a, b in zip(ws, ws[1:])])))
        seen = math.ceil(10 * float(len(runs) - len(set(runs))) / len(runs))
        out |= {one(1 << 40 | same), one(1 << 41 | seen)}
    return out


def test_features():
    for _, text in awkward_texts():
        if text is None or len(text) < 5000:
            assert set(features(text).tolist()) == plain_features(text)


def labelled(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(5, 40), 60) if good else " ".join(rng.choice(["spam", "w1", "buy", "!!!"])
                                                                        for _ in range(rng.randint(3, 30)))
        rows += [(text, int(good))] * rng.choice([1, 1, 1, 30])
    return rows + [(None, 1), ("", 0), ("w1 w2", 7), ("w1 w2", None)]


def plain_model(rows, order, epochs=12, seed=5):
    """Ratios and weights from dictionaries and loops."""
    rows = [r for r in rows if r[1] in (0, 1)]
    counts = [Counter(), Counter()]
    for text, label in rows:
        counts[label].update(plain_features(text))
    total = [sum(c.values()) + (1 << BITS) for c in counts]

    def ratio(f):
        return math.log((counts[1][f] + 1) / total[1]) - math.log((counts[0][f] + 1) / total[0])
    copies = Counter(rows)
    drawn = sorted(copies, key=lambda r: (order[r[0]], r[1]))
    docs = [sum(label == k for _, label in rows) for k in (0, 1)]
    weight = {r: min(copies[r], MOST_COPIES) for r in drawn}
    held = [sum(weight[r] for r in drawn if r[1] == k) for k in (0, 1)]
    cost = {r: weight[r] * len(drawn) * docs[r[1]] / sum(docs) / held[r[1]] / (2 * docs[r[1]] / sum(docs)) for r in drawn}
    points = []
    for text, label in drawn:
        v = {f: ratio(f) for f in plain_features(text)}
        length = math.sqrt(sum(x * x for x in v.values()))
        points.append({**{f: float(np.float32(x / length)) if length else x for f, x in v.items()}, "bias": 1.0})
    w, alpha, rng = Counter(), [0.0] * len(drawn), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(drawn)).tolist():
            y, v = (1 if drawn[i][1] else -1), points[i]
            new = alpha[i] - (y * sum(w[f] * x for f, x in v.items()) - 1) / sum(x * x for x in v.values())
            new = min(max(new, 0.0), cost[drawn[i]])
            for f, x in v.items():
                w[f] += (new - alpha[i]) * y * x
            worst = max(worst, abs(new - alpha[i]))
            alpha[i] = new
        if worst < 1e-3:
            break
    return ratio, w


@pytest.mark.parametrize("seed", [1, 2])
def test_ratios_and_weights_equal_a_plain_fit(spark, seed):
    rows = labelled(seed)
    docs = spark.createDataFrame(rows, "text string, quality int").repartition(4)
    order = {r.text: r.h for r in docs.select("text", F.xxhash64("text", F.lit(11)).alias("h")).collect()}
    model = train(docs)
    ratio, w = plain_model(rows, order)
    used = sorted(set().union(*(plain_features(t) for t, _ in rows)))
    assert model.ratios[used] == pytest.approx([ratio(f) for f in used], abs=1e-9)
    unused = next(f for f in range(1 << BITS) if f not in set(used))
    assert model.ratios[unused] == pytest.approx(ratio(unused), abs=1e-9)
    assert model.bias == pytest.approx(w["bias"], abs=1e-4)
    assert model.weights[used] == pytest.approx([w[f] * ratio(f) for f in used], abs=1e-3)
    for text, label in set(rows):
        if label in (0, 1) and text:
            assert (model.margin(features(text)) > 0) == (label == 1)


def test_a_hot_text_and_ties_do_not_sway_the_draw(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "SAMPLE_ROWS", 20)
    rng = random.Random(3)
    rows = [(prose(rng, 20, 50), 1) for _ in range(60)] + [("buy spam now !!!", 0)] * 200
    rows += [("the same text in both classes", 0), ("the same text in both classes", 1)]
    model = train(spark.createDataFrame(rows, "text string, quality int"), sample_rows=20)
    assert model.score("buy spam now !!!") < 0.5 < model.score(rows[0][0])


def test_columns_of_the_query_on_awkward_rows(spark):
    docs = frame(spark)
    labels = docs.select("doc_id", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)).cast("int").alias("quality"))
    score = scorer(train_on_labels(docs, labels))
    got = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), score(F.col("text")).alias("score")
                      ).withColumn("predicted", (F.col("score") >= 0.7).cast("int")).collect()
    assert len(got) == len(awkward_texts())
    for r in got:
        assert r.held_out is (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
