"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from shelfline.llm.spelling import PositionIndex, corpus_words, group_variants

from .data import awkward_texts, frame

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, least=7):
    held = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            held[run] += len(run) >= least
    return {w: n for w, n in held.items() if n >= 2}


def plain_groups(held, ratio=10):
    near = {w: [v for v in held if one_edit(w, v)] for w in held}
    form = {w: min(vs, key=lambda v: (-held[v], v), default=None) for w, vs in near.items()}
    form = {w: v if v is not None and held[v] >= ratio * held[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, held[w], len(near[w]), form[w], held.get(form[w]), root(w)) for w in held)


def letters(rng, n, alphabet="abcdeé"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def variants(rng, words, n):
    out = list(words)
    while len(out) < n:
        w = rng.choice(out)
        i = rng.randrange(len(w) + 1)
        out.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abz") + w[i:], w[:i] + "q" + w[i + 1:]]))
    return sorted({w for w in out if w})


@pytest.mark.parametrize("most", [4096, 6])
def test_groups(spark, most):
    rng = random.Random(most)
    words = variants(rng, [letters(rng, rng.randint(1, 12)) for _ in range(40)] + ["a", "é", "aaaaaaaa", "x" * 3000,
                                                                                   "x" * 2999, "y" + "x" * 2999], 500)
    held = {w: rng.choice([2, 3, 25, 300, 4000]) for w in words}
    got = group_variants(spark.createDataFrame([*held.items(), (None, 5), ("", 4)], "word string, n long"), most=most)
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == plain_groups(held)


def test_words_of_documents(spark):
    rng = random.Random(8)
    vocabulary = ["Éclairage", "naïveté×abc", "ordinary", "extraordinary", "seventh", "Sevenths", "short"]
    rows = awkward_texts() + [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(60)]
    rows += [(2000, "longword" * 20_000), (2001, "longword" * 20_000)]
    got = corpus_words(frame(spark, rows))
    want = plain_words(rows)
    assert {r.word: r.n for r in got.collect()} == want and any("Éclairage"[1:] in w for w in want)
    grouped = group_variants(corpus_words(frame(spark, rows[:-2])))
    assert sorted(map(tuple, grouped.select("word", "n", "n_near", "form", "form_n", "root").collect())) == \
        plain_groups(plain_words(rows[:-2]))


def test_nothing(spark):
    assert group_variants(corpus_words(frame(spark).limit(0))).collect() == []
    assert corpus_words(frame(spark, [(1, None), (2, ""), (3, "one two")])).collect() == []


def test_the_index_finds_every_edit_once():
    rng = random.Random(2)
    words = variants(rng, ["aaaa", "abab", "ba" * 40, "c" * 70], 300)
    rng.shuffle(words)
    index = PositionIndex(words)
    got = sorted(tuple(sorted((words[i], words[j]))) for i in range(len(words)) for j in index.near(i))
    assert got == sorted({tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b)})
