"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a rejecting predicate over a text and its base statistics.  On
a bounded sample each rule's cost (measured time) and the joint outcome of
all rules are taken; the cascade is then ordered greedily by rejections, among
the rows that the rules before it let through, per cost.  The order changes
only the work: a row is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import SPACE, let, words_of
from shelfline.session import materialize

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
SYMBOLS = r"[^#*$%&|<>]+"      # everything but the symbols that the base counts


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def count_chars(text: Column, others: str) -> Column:
    """Characters of `text` outside the runs that `others` matches."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text: windows are
    sorted by a 64-bit hash, those with an equal neighbour are sorted again by
    their words, and the positions that equal neighbours cover are counted."""
    def near(rows, same):
        return F.filter(rows, lambda x, k: F.coalesce(same(x, F.get(rows, k - 1)), F.lit(False))
                        | F.coalesce(same(x, F.get(rows, k + 1)), F.lit(False)))

    def word(i, k):
        return F.get(words, i + k)

    hashed = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), i.alias("i"))))
    alike = let(hashed, lambda s: near(s, lambda a, b: a["h"] == b["h"]))
    spelled = F.sort_array(F.transform(alike, lambda x: F.struct(
        word(x["i"], 0).alias("a"), word(x["i"], 1).alias("b"), word(x["i"], 2).alias("c"), x["i"].alias("i"))))
    equal = let(spelled, lambda s: near(
        s, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])))
    covered = F.flatten(F.transform(equal, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(F.size(words) > 3, F.size(F.array_distinct(covered))).otherwise(0).cast("long")


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of `docs` in a struct `_row`, its text in `_text` (null:
    empty), the arrays `_words` and `_lines` (lines with a word), and the base
    counts.  In the struct no column clashes with those."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text"))
            .withColumn("_words", words_of(F.col("_text")))
            .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    return (rows.withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
            .withColumn("n_symbols", count_chars(F.col("_text"), SYMBOLS))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_repeat_words", repeat_words(F.col("_words")))
            .withColumn("base_failed", (F.col("n_words") < 50)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def default_rules() -> list[Rule]:
    """Conservative limits: clean prose in any language stays far from them."""
    c = F.col
    lettered = F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long")
    marks = count_chars(c("_text"), r"[^!?]+")
    capitals = count_chars(c("_text"), r"[^A-Z]+")
    return [
        Rule("symbols", 100 * c("n_symbols") > 10 * c("word_chars")),
        Rule("repeated_lines", (c("n_dup_lines") >= 3) & (100 * c("n_dup_lines") > 30 * F.size("_lines"))),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        Rule("marks", 100 * marks > 15 * c("word_chars")),
        Rule("capitals", 100 * capitals > 50 * c("word_chars")),
        Rule("letters", 100 * lettered < 60 * c("n_words")),
    ]


def plan_cascade(docs: DataFrame, rules: list[Rule], text_col: str, sample_rows: int) -> list[str]:
    """Names of the rules in cascade order, from a sample of about
    `sample_rows` rows of `docs`.  Only the joint counts of the rule outcomes
    (at most 2**len(rules) rows) are collected."""
    total = docs.count()
    if not total:
        return [r.name for r in rules]
    sample = docs.select(text_col).sample(min(1.0, sample_rows / total), seed=17)
    sample = materialize(base_statistics(sample, text_col), "quality-sample")

    def seconds(*columns: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count(F.lit(1)), *(F.count(F.when(c, 1)) for c in columns)).collect()
        return time.perf_counter() - began

    seconds()
    idle = min(seconds() for _ in range(2))
    cost = {r.name: max(min(seconds(r.rejects) for _ in range(2)) - idle, 1e-3) for r in rules}
    outcomes = [x.asDict() for x in sample.where(~F.col("base_failed")).groupBy(
        *(F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in rules)).count().collect()]
    order, left = [], [r.name for r in rules]
    while left:
        def yield_of(name):
            return sum(x["count"] for x in outcomes if x[name]) / cost[name]
        best = max(left, key=yield_of)
        order.append(best)
        left.remove(best)
        outcomes = [x for x in outcomes if not x[best]]
    return order


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text",
                  sample_rows: int = 2000) -> DataFrame:
    """`docs` with the base counts (`n_words`, `word_chars`, `n_symbols`,
    `n_dup_lines`, `n_repeat_words`), `base_failed`, `rejected_by` (the first
    rule of the cascade that rejects the row, `base`, or null) and `kept`.

    Null and empty texts have no words, fail the base and are not kept.  All
    rows stay, repeated ones included; an empty table gives an empty result.
    Input columns of the same names as the results are replaced.  Later rules
    are not evaluated for a row that an earlier one rejects.  `kept` never
    depends on the order; `rejected_by` names the first rule of an order that
    follows measured times, so it may differ between runs for a row that
    several rules reject.  A text, however long, must fit one task.
    """
    rules = default_rules() if rules is None else rules
    docs = docs.select(*(c for c in docs.columns if c not in RESULTS))
    rows = base_statistics(docs, text_col)
    by_name = {r.name: r for r in rules}
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name in plan_cascade(docs, rules, text_col, sample_rows):
        verdict = verdict.when(by_name[name].rejects, F.lit(name))
    rows = rows.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
    return rows.select("_row.*", *RESULTS)
