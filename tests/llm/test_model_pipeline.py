"""The quality classifier and the pipeline's stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm.quality_model import features, fit_hinge, fold, scorer, train, train_on_labels
from shelfline.session import materialize

from ..conftest import SF_CHECK
from .data import awkward_texts, frame, prose, words
from .test_joins import expected_components
from .test_native import expected_dedup
from .test_tokens import check_packing


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(400) < 0.5, 1.0, -1.0)
    rows = [np.unique(np.append(rng.integers(2, 50, 8), 0 if v > 0 else 1)) for v in y]
    w = fit_hinge(rows, [np.ones(len(r)) for r in rows], y, np.ones(400), 50)
    assert all(y[i] * w[r].sum() > 0 for i, r in enumerate(rows))


def test_held_out_accuracy_and_scores_of_awkward_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    score = scorer(train_on_labels(docs, labels))
    rows = docs.join(labels, "doc_id").where(fold(docs["doc_id"]) == 2).select(
        "quality", score(docs["text"]).alias("score")).collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert right >= 0.9 * len(rows)
    odd = frame(spark)
    scores = odd.select(score(odd["text"]).alias("score")).collect()
    assert len(scores) == len(awkward_texts()) and all(0 <= r.score <= 1 for r in scores)
    assert odd.limit(0).select(score(odd["text"]).alias("score")).count() == 0


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = (lambda ids: ids.select("id", fold(ids["id"]).alias("f")).collect())(spark.range(50))
    assert [r.f for r in got] == [zlib.crc32(str(r.id).encode()) % 4 for r in got]


def test_held_out_rows_do_not_change_the_model(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", (1 - labels["quality"]) * (fold(labels["doc_id"]) == 2).cast("int")
                                + labels["quality"] * (fold(labels["doc_id"]) != 2).cast("int"))
    a, b = train_on_labels(docs, labels), train_on_labels(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


@pytest.mark.parametrize("labels", [[], [1, 1, None], [0, None, 7]])
def test_training_without_both_classes(spark, labels):
    rows = spark.createDataFrame([(f"some text {i}", v) for i, v in enumerate(labels)], "text string, quality int")
    s = train(rows).score("any text")
    assert s == pytest.approx(0.5) if not labels else s > 0.99 if 1 in labels else s < 0.01


def test_many_copies_of_a_labelled_text_do_not_crowd_out_the_sample(spark):
    rng = random.Random(4)
    good, bad = ([f"{k} " + " ".join(rng.choice(v) for _ in range(12)) for k in range(200)]
                 for v in (["oak", "elm", "ash", "fir", "yew"], ["zip", "zap", "zop", "zup", "zep"]))
    # The copied text's hashes are low, so a draw by text takes it first.
    pool = spark.createDataFrame([(f"copy {k} oak elm ash fir yew",) for k in range(20000)], "text string")
    copied = pool.where("pmod(xxhash64(text, 11), 1048576) < 150000").orderBy(F.xxhash64("text")).first().text
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad] + [(copied, 1)] * 200
    model = train(spark.createDataFrame(rows, "text string, quality int"), sample_rows=60)
    assert min(model.score(t) for t in good) > 0.7 > 0.3 > max(model.score(t) for t in bad)


def test_labels_on_copies_of_few_texts_give_a_model(spark):
    texts = [("oak elm ash", 1), ("fir yew oak", 1), ("zip zap zop", 0), ("zup zep zip", 0)]
    model = train(spark.createDataFrame(texts * 300, "text string, quality int"), sample_rows=4)
    assert all((model.score(t) > 0.5) == (v == 1) for t, v in texts)


def test_features_are_sets_of_the_whole_text():
    assert len(features(None)) == len(features("")) == 0
    long = prose(random.Random(1), 5000, 10 ** 6)
    assert set(features(long + " zebra1")) - set(features(long))
    assert (np.diff(features(long)) > 0).all()


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def staged(spark, rows, name, sources=("src0", "src1", None)):
    docs = materialize(frame(spark, rows, sources), "stage-input")
    out = stage(name)(spark, docs, SF_CHECK)
    if name != "pack_sequences":
        assert out.columns == docs.columns
    return out.collect()


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "near_duplicates", "mix_sources", "pack_sequences"]


def test_quality_stage_drops_junk_and_keeps_clean(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    kept = {r.doc_id for r in stage("quality_classifier")(spark, docs, SF_CHECK).collect()}
    good, bad = [i for i in labels if labels[i] == 1], [i for i in labels if labels[i] == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_exact_stage(spark):
    rows = awkward_texts()
    got = staged(spark, rows, "exact_dedup")
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in expected_dedup(rows) if x[3])


def test_near_stage_keeps_one_of_each_component(spark):
    rows = awkward_texts()
    got = staged(spark, rows, "near_duplicates")
    want = expected_components(rows)
    empty = [x for x in want if x[1] == 0]
    linked = {x[2] for x in want if x[1]}
    assert sorted(str(r.doc_id) for r in got) == sorted([str(x[0]) for x in empty] + [str(c) for c in linked])


def test_near_stage_links_five_word_runs_at_80_percent(spark):
    rng = random.Random(8)
    rows = []
    for cut in (3, 8, 11, 12, 13, 20) * 4:          # 45 and 44 of 56 runs are on both sides of the limit
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:60 - cut]))]
    runs = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(runs[i] & runs[j]) >= 80 * len(runs[i] | runs[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    got = staged(spark, rows, "near_duplicates")
    assert sorted(r.doc_id for r in got) == sorted(set(root))
    assert len(rows) - len(set(root)) == 12


def test_mix_stage_takes_whole_copies_and_one_cut(spark):
    rows = awkward_texts()
    got = staged(spark, rows, "mix_sources", ("s",))
    size = sum(len(words(t)) for _, t in rows)
    assert sum(len(words(r.text)) for r in got) == int(1.5 * size)
    whole = Counter(map(str, rows))
    cut = [r for r in got if str((r.doc_id, r.text)) not in whole]
    assert len(cut) <= 1 and all(r.n_chars == len(r.text) for r in got)
    assert all(any(words(t)[:len(words(r.text))] == words(r.text) for i, t in rows if i == r.doc_id) for r in cut)


def test_pack_stage(spark):
    rows = awkward_texts()
    check_packing(rows, staged(spark, rows, "pack_sequences"))


def test_run_equals_the_stages_and_takes_an_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, "/root/testdata/sf0.001"), "stage")
    columns = ["doc_id", "start", "length", "ids_crc32", "offset"]
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, docs.select(*columns).collect()))
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
