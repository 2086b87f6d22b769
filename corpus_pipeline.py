"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept, and returns a DataFrame that is written as Parquet and reread as
the next stage's input.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import fresh, stable, with_row_id, words_of
from shelfline.llm.exact_dedup import exact_dedup
from shelfline.llm.jaccard_join import near_duplicates
from shelfline.llm.mixing import mix_sources
from shelfline.llm.packing import pack_documents
from shelfline.llm.quality_model import scorer, train_on_labels
from shelfline.session import discard_since, ensure_checkpoint_dir, materialize, scratch_mark, ship_package

LEAST_SCORE = 0.7
NEAR_WORDS, NEAR_PERCENT = 5, 80     # the stage's own; op10_jaccard_join has 3 and 90
ORACLE_SQL = None       # the classifier is trained; the tests compare each stage with a plain version


def _prepared(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` as a struct `doc`, in which no column clashes with those that a
    stage adds, and its row identity `row`."""
    row = fresh(docs, "row")
    return with_row_id(docs, row).select(F.struct(*docs.columns).alias("doc"), F.col(row).alias("row"))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose row id is in `kept` (column `row_id`)."""
    return _numbered(docs).join(kept.select(F.col("row_id").alias("row")), "row", "left_semi").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least `LEAST_SCORE`."""
    _prepared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = scorer(train_on_labels(docs, labels))
    return docs.where(score(F.col("text")) >= LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    _prepared(spark)
    docs = stable(docs)
    return _only(docs, exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: texts whose sets of
    five-word runs have a Jaccard similarity of at least 0.8."""
    _prepared(spark)
    docs = stable(docs)
    return _only(docs, near_duplicates(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).where("first"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.  Where a source's target ends
    inside a document, that copy is cut to its first words, joined by one
    space.  Documents without words are not taken."""
    _prepared(spark)
    docs = stable(docs)
    taken = mix_sources(docs).where("taken > 0").select(F.col("row_id").alias("row"), "taken", "size")
    copies = (_numbered(docs).join(taken, "row")
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))))
              .withColumn("left", F.least("size", F.col("taken") - F.col("copy") * F.col("size"))))
    cut = F.col("left") < F.col("size")
    first_words = F.array_join(F.slice(words_of(F.col("doc.text")), F.lit(1), F.col("left").cast("int")), " ")
    text = F.when(cut, first_words).otherwise(F.col("doc.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return copies.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece, with its ids."""
    _prepared(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_duplicates", near),
          ("mix_sources", mix), ("pack_sequences", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the `documents` table of `sf_dir`.  Of each stage only
    its result is kept, until the next one is written."""
    _prepared(spark)
    start = scratch_mark()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(start, docs)
    return docs
