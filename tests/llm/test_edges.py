"""Cases that every operator meets: other numbers of cores between two scans,
texts of a megabyte without spaces, large Arrow types, clashing columns."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm import common, exact_dedup, jaccard_join, lsh_forest, tokenize
from shelfline.llm.lsh_forest import forest_duplicates
from shelfline.llm.packing import pack_documents
from shelfline.llm.quality_rules import quality_rules
from shelfline.llm.spelling import corpus_words
from shelfline.llm.substring_dedup import remove_repeats
from shelfline.llm.token_counts import UnigramCounter
from shelfline.llm.token_files import read_tokens, write_tokens
from shelfline.llm.tokenize import Encoder
from shelfline.llm.vector_codes import compress
from shelfline.session import materialize

from .data import awkward_texts, frame, prose, table
from .test_joins import expected_components
from .test_native import expected_dedup

CONF = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def changing_cores(spark, monkeypatch):
    """Every written table is followed by scans that cut files differently."""
    kept, calls = {k: spark.conf.get(k, None) for k in CONF}, []

    def changed(df, name):
        out = materialize(df, name)
        calls.append(name)
        for k, v in zip(CONF, [("2", "3000", "1"), ("7", "100000", "1"), ("3", "128m", "4m")][len(calls) % 3]):
            spark.conf.set(k, v)
        return out
    for module in (common, exact_dedup, jaccard_join, lsh_forest, corpus_pipeline):
        monkeypatch.setattr(module, "materialize", changed)
    yield calls
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(spark, rows):
    return materialize(frame(spark, rows).repartition(6), "stored")


def test_results_do_not_follow_the_cores(spark, changing_cores):
    rows = awkward_texts()
    docs = stored(spark, rows)
    got = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert table(got) == expected_dedup(rows)
    for found, percent in ((jaccard_join.near_duplicates(docs), 90), (forest_duplicates(docs, words=3, percent=85), 85)):
        assert table(found.select("doc_id", "n_shingles", "component_id")) == expected_components(rows, percent)
    assert len(changing_cores) > 20


def test_stages_do_not_follow_the_cores(spark, changing_cores):
    rows = awkward_texts()
    docs = stored(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    got = stages["exact_dedup"](spark, docs, None).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in expected_dedup(rows) if x[3])
    one = sorted(str((r.doc_id, r.text)) for r in stages["mix_sources"](spark, docs, None).collect())
    assert one == sorted(str((r.doc_id, r.text)) for r in stages["mix_sources"](spark, docs, None).collect())
    near = sorted(str(r.doc_id) for r in stages["near_duplicates"](spark, docs, None).collect())
    assert near == sorted(str(r.doc_id) for r in stages["near_duplicates"](spark, docs, None).collect())
    texts = {str(t) for _, t in rows}
    assert len(near) > 40 and all(r.text in texts or r.text is None for r in got)


NAMES = ("_text", "_words", "_lines", "_row", "row", "doc", "copy", "left", "taken", "size", "_size", "_taken", "_left")


def clashing(spark, rows):
    docs = frame(spark, rows)
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES if n not in docs.columns))


def test_working_names_do_not_clash(spark):
    docs = clashing(spark, awkward_texts()[:60])
    own = {n: "s" if n == "size" else f"own {n}" for n in NAMES}
    for got in (quality_rules(docs), *(f(spark, docs, None) for name, f in corpus_pipeline.STAGES
                                       if name not in ("quality_classifier", "pack_sequences"))):
        rows = [r.asDict() for r in got.collect()]
        assert rows and all(r[n] == v for r in rows for n, v in own.items())
    assert table(got.select("doc_id")) and set(got.columns) == set(docs.columns)


def test_caches_do_not_keep_long_words(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc漢é") for _ in range(40_000)) for _ in range(5)] + [prose(rng, 50)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = Encoder(public_tokenizers.path(name), spaced)
        encoder.encode(pa.array(texts))
        assert max(map(len, encoder.words)) <= tokenize.LONG_WORD
        assert encoder.held_bytes == sum(len(w) + len(ids) for w, ids in encoder.words.items())
        monkeypatch.setattr(tokenize, "BYTES_HELD", 1000)
        for _ in range(5):
            encoder.encode(pa.array([prose(rng, 200, 10 ** 6)]))
            assert encoder.held_bytes < 20_000
    model = UnigramCounter({"a": -1.0, "abc": -1.5})
    monkeypatch.setattr("shelfline.llm.token_counts.BYTES_HELD", 1000)
    for _ in range(5):
        model.counts_of([[t.encode() for t in texts], [w.encode() for w in prose(rng, 200, 10 ** 6).split()]])
        assert model.held_bytes == sum(map(len, model.counts)) < 4000 and len(model.best) < 300


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.string_view()])
def test_the_encoder_takes_all_string_types(kind):
    texts = ["Hello there, World!", None, "", "one  two\nthree", "it's"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = Encoder(public_tokenizers.path(name), spaced)
        ids, counts = encoder.encode(pa.array(texts, kind))
        want = encoder.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()


def test_large_arrow_types_in_the_session(spark, tmp_path):
    rows = [*awkward_texts()[:70], (900, "漢字かな" * 90_000)]            # a megabyte without a space
    docs = stored(spark, rows)
    vectors = spark.createDataFrame([(i, [i / 7, -i / 3], 1) for i in range(40)],
                                    "vec_id long, embedding array<double>, label int")

    def results(name):
        out = f"{tmp_path}/{name}"
        write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
        return [table(x) for x in (
            read_tokens(spark, out), remove_repeats(docs), compress(vectors, entries=5)[0],
            pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "ids_crc32"),
            forest_duplicates(docs).drop("row_id"), jaccard_join.near_duplicates(docs).drop("row_id"), corpus_words(docs))]
    plain = results("plain")
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert results("large") == plain
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
