"""Spelling variants: words that differ by one letter, grouped under a form
that is far more frequent.

Words are looked up in a bit-sliced position index: for a set of words, one
bitset per (position, letter) holds the words with that letter there.  A word
runs through its letters once; word-parallel recurrences keep the set of words
that agree so far and, with positions shifted by nothing or by one, the sets
of words that differ by one letter so far.

The vocabulary is dealt into regions that an index of bounded size covers.  Of
two words that differ by one letter, either the first or the last half of the
shorter one is found in both, so every word goes to the regions of its two
halves (as the shorter and as the longer word).  A region of too many words is
split again: of the part that is not fixed yet, the first or the last half
agrees.  With one letter left a region is bounded by the alphabet.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.session import materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST = 4096              # words of a region, and expected words of an index
SLICED = 64              # positions with bitsets; later letters are compared word by word

PAIRS = "u string, u_n long, v string, v_n long"


def slipped(doc_id: Column, run: Column, slip: int) -> Column:
    """`run` without one letter for one in `slip` of the (document, run)s, by
    the crc32 of both."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(slip)) == 0, cut).otherwise(run)


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 31,
                 least_letters: int = 7, least_count: int = 2) -> DataFrame:
    """(`word`, `n`) of all texts: runs of letters with A-Z in lower case, one
    in `slip` with a letter deleted (see `slipped`), of at least
    `least_letters` letters and `least_count` occurrences.  Null and empty
    texts have none; a null id counts as an empty one; each row of a repeated
    id counts.  Other columns are not read; the length of a text is bounded by
    a task's memory only."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.col(id_col).alias("_id"), run.alias("_run")).where(
        F.length("_run") >= least_letters)
    return (runs.select(slipped(F.col("_id"), F.col("_run"), slip).alias("word"))
            .where(F.length("word") >= least_letters)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


class PositionIndex:
    """Bitsets over a list of words, as whole numbers: bit i is word i."""

    def __init__(self, words: list[str]):
        self.words = words
        sliced, lengths = defaultdict(list), defaultdict(list)
        for i, w in enumerate(words):
            lengths[len(w)].append(i)
            for place in enumerate(w[:SLICED]):
                sliced[place].append(i)
        self.sliced = {k: self._bits(v) for k, v in sliced.items()}
        self.lengths = {k: self._bits(v) for k, v in lengths.items()}

    def _bits(self, members: list[int]) -> int:
        out = bytearray(len(self.words) // 8 + 1)
        for i in members:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    def _members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out

    def at(self, place: int, letter: str, among: int) -> int:
        """Of the words `among`, those with `letter` at `place`."""
        if place < SLICED:
            return self.sliced.get((place, letter), 0) & among
        return sum(1 << i for i in self._members(among) if self.words[i][place:place + 1] == letter)

    def near(self, i: int) -> list[int]:
        """Words before word `i` of its length that differ in one letter, and
        words that lack one of its letters."""
        q = self.words[i]
        same = self.lengths[len(q)] & ((1 << i) - 1)
        short = self.lengths.get(len(q) - 1, 0)
        agree, replaced, lacking = same | short, 0, 0
        for k, letter in enumerate(q):
            lacking = (self.at(k - 1, letter, lacking) if k else 0) | (agree & short)
            here = self.at(k, letter, agree | replaced)
            replaced = (replaced & here) | (agree & same & ~here)
            agree &= here
            if not agree | replaced | lacking:
                return []
        return self._members(replaced | lacking)


def _search(table: pa.Table) -> pa.Table:
    """All near pairs of a set of words.  Words are numbered in their order,
    so every set that holds a pair names it the same way round."""
    table = table.sort_by("word")
    words, n = table["word"].to_pylist(), table["n"].to_pylist()
    index = PositionIndex(words)
    found = [(i, j) for i in range(len(words)) for j in index.near(i)]
    return pa.table({"u": pa.array([words[i] for i, _ in found], pa.string()),
                     "u_n": pa.array([n[i] for i, _ in found], pa.int64()),
                     "v": pa.array([words[j] for _, j in found], pa.string()),
                     "v_n": pa.array([n[j] for _, j in found], pa.int64())})


def _split(regions: DataFrame) -> DataFrame:
    """Members of regions (`front` and `back` letters of the `shorter` length
    are fixed) to those of the two halves of what is left; one letter stays."""
    left = F.col("shorter") - F.col("front") - F.col("back")
    half = F.floor(left / 2).cast("int")
    halves = F.array(F.struct((F.col("front") + half).alias("front"), F.col("back")),
                     F.struct(F.col("front"), (F.col("back") + left - half).alias("back")))
    whole = F.array(F.struct("front", "back"))
    return regions.select("word", "n", "shorter", F.explode(F.when(left > 1, halves).otherwise(whole)).alias("_fixed")
                          ).select("word", "n", "shorter", "_fixed.front", "_fixed.back")


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """All pairs of different words (`u`, `u_n`, `v`, `v_n`) that differ by
    exactly one inserted, deleted or replaced letter, each pair once; from
    distinct non-empty words with their counts (`word`, `n`)."""
    size = F.length("word")
    lengths = F.when(size > 1, F.array(size, size - 1)).otherwise(F.array(size))
    zero = F.lit(0).cast("int")
    members = words.select("word", "n", F.explode(lengths).alias("shorter"), zero.alias("front"), zero.alias("back"))
    ready = []
    while True:
        key = F.xxhash64("shorter", "front", "back", F.substring(F.col("word"), F.lit(1), F.col("front")),
                         F.substring(F.col("word"), size - F.col("back") + 1, F.col("back")))
        members = materialize(_split(members).withColumn("key", key), "spelling-members")
        # Only words of the shorter length have partners that this region must find.
        regions = members.groupBy("key").agg(
            F.count(F.lit(1)).alias("held"), F.max((size == F.col("shorter")).cast("int")).alias("some"),
            F.max(F.col("shorter") - F.col("front") - F.col("back")).alias("left")).where("held > 1 and some = 1")
        regions = materialize(regions.select("key", ((F.col("held") > most) & (F.col("left") > 1)).alias("large")),
                              "spelling-regions")
        placed = members.join(regions, "key")
        ready.append(placed.where("not large").select("key", "word", "n"))
        if not regions.where("large").head(1):
            break
        members = placed.where("large").select("word", "n", "shorter", "front", "back")
    found = ready[0]
    for more in ready[1:]:
        found = found.unionByName(more)
    found = materialize(found, "spelling-regions")
    buckets = max(1, -(-found.count() // most))
    dealt = found.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "word", "n").distinct()
    return dealt.groupBy("bucket").applyInArrow(_search, PAIRS).dropDuplicates(["u", "v"])


def group_variants(words: DataFrame, ratio: int = 10, most: int = MOST) -> DataFrame:
    """One row per word: `word`, `n`, `n_near` (near words), `form` (its most
    frequent near word, ties by code points, if that is at least `ratio` times
    as frequent; else null), `form_n` and `root` (the last of the forms of the
    forms; the word itself without a form).

    `words` has distinct words and their counts; null and empty words are left
    out; an empty table gives an empty result.  Forms grow `ratio` fold at
    each step, so chains are short and pointer jumping needs few rounds.
    """
    words = materialize(words.where(F.length("word") > 0).select("word", "n"), "spelling-words")
    pairs = materialize(near_pairs(words, most), "spelling-pairs")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("v_n").alias("near_n")).unionByName(
        pairs.select(F.col("v").alias("word"), F.col("u").alias("near"), F.col("u_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = materialize(roots, "spelling-roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(further, "root", "left_semi").head(1):
            break
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
