"""The LSH forest against comparison of all pairs, and row identities that do
not change with the number of cores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import jaccard_join
from shelfline.llm.common import with_row_id
from shelfline.llm.lsh_forest import _functions, forest_duplicates, forest_regions, signature
from shelfline.session import materialize

from .data import awkward_texts, frame, prose, table
from .test_joins import expected_components, near_rows


@pytest.mark.parametrize("case", ["awkward", 1, 2, 5])
def test_forest(spark, monkeypatch, case):
    rows = awkward_texts() if case == "awkward" else near_rows(case)
    if case == 2:
        monkeypatch.setattr(jaccard_join, "MOST_DOCS", 4)        # large groups in blocks
        monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    got = forest_duplicates(frame(spark, rows), words=3, percent=85, leaf=3 if case == 5 else 256)
    assert table(got.select("doc_id", "n_shingles", "component_id")) == expected_components(rows, 85)
    firsts = [r.component_id for r in got.where("first and n_shingles > 0").collect()]
    linked = {r.component_id for r in got.where("n_shingles > 0").collect()}
    assert set(firsts) == linked and (case == "awkward" or len(firsts) == len(set(firsts)))


def test_forest_of_nothing(spark):
    assert forest_duplicates(frame(spark).limit(0)).count() == 0


def test_equal_minima_are_as_frequent_as_the_similarity():
    rng = np.random.default_rng(3)
    offsets, factors = _functions(2000)
    pool = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    a, b = signature(pool[:100], offsets, factors), signature(pool[20:120], offsets, factors)
    assert abs((a == b).mean() - 80 / 120) < 0.04
    parts = [signature(pool[lo:lo + 50], offsets, factors) for lo in (0, 50, 100)]
    assert (np.minimum(np.minimum(*parts[:2]), parts[2]) == signature(pool, offsets, factors)).all()


def test_crowded_regions_get_deeper(spark):
    rng = random.Random(5)
    rows = [(i, bytes(rng.choice(b"ab") if k < 8 else rng.randrange(256) for k in range(24))) for i in range(60)]
    rows = [(i, s[:4] + s[4:8] + s[8:]) for i, s in rows]
    signed = spark.createDataFrame(rows, "row_id long, signature binary")
    shallow = {tuple(r) for r in forest_regions(signed, 1, 1, 6, 60).collect()}
    deep = {tuple(r) for r in forest_regions(signed, 1, 1, 6, 4).collect()}
    by_first = {s[:4] for _, s in rows}
    heads = {min(i for i, s in rows if s[:4] == p) for p in by_first if sum(x[:4] == p for _, x in rows) > 1}
    assert {h for h, _ in shallow} == heads
    for prefix in {s[:8] for _, s in rows}:
        own = [i for i, s in rows if s[:8] == prefix]
        whole = [i for i, s in rows if s[:4] == prefix[:4]]
        if len(whole) > 4 and 1 < len(own) <= 4:
            assert {(min(own), i) for i in own} <= deep
    assert len(deep) < len(shallow)


@pytest.mark.parametrize("form", ["scan", "filtered", "union"])
def test_row_ids_do_not_follow_the_cores(spark, form):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i % 50, prose(rng, 60, 10 ** 5)) for i in range(600)], "doc_id long, text string")
    docs = materialize(docs.repartition(5), "ids")
    docs = {"scan": docs, "filtered": docs.where("doc_id > 3").withColumnRenamed("text", "_metadata"),
            "union": docs.unionByName(docs)}[form]
    found = with_row_id(docs, "row")
    text = found.columns[1]
    one = found.groupBy("row").agg(F.min(text).alias("t")).collect()
    assert len(one) == docs.count() and all(r.row >= 0 for r in one)
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism",
                                                 "spark.sql.files.maxPartitionBytes",
                                                 "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(kept, ("3", "20000", "1")):
            spark.conf.set(k, v)
        again = found.select("*").groupBy("row").agg(F.min(text).alias("t")).collect()
        assert {tuple(r) for r in again} == {tuple(r) for r in one}
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
