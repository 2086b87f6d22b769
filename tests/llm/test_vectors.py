"""Vector codes against plain Lloyd rounds."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from shelfline.llm.vector_codes import assign, compress, squared

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, numbers string, part string"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, code, error, label_error) of every kept row, and the hash of the codebooks."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[math.floor(scale * float(np.float32(x))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    cut = [[tuple(w[p * width:(p + 1) * width]) for p in range(parts)] for w in whole]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for r in range(rounds + 1):
        got = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if r < rounds:
            for p in range(parts):
                held = defaultdict(list)
                for c, g in zip(cut, got):
                    held[g[p][1]].append(c[p])
                for j, xs in held.items():
                    books[p][j] = tuple(sum(col) // len(xs) for col in zip(*xs))
    errors = [sum(d for d, _ in g) for g in got]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] += e
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, "".join(f"{j:02x}" for _, j in g), e, by_label[lab])
                   for (i, _, lab), g, e in zip(kept, got, errors)), key=str), hashlib.sha256(text.encode()).hexdigest()


def vectors(seed, n, dim=16, centres=9):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    out = []
    for i in range(n):
        m = rng.choice(middle)
        out.append((i * 3 % (2 * n + 1), [x + rng.gauss(0, 0.05) for x in m], rng.choice([0, 1, None])))
    return out


AWKWARD = [(None, [0.5] * 16, 1), (7, None, 1), (8, [0.1] * 15 + [None], 0), (9, [float("nan")] + [0.0] * 15, 0),
           (10, [float("inf")] * 16, None), (11, [0.25] * 16, None), (11, [0.25] * 16, None), (11, [-0.25] * 16, 2),
           (12, [0.001, -0.001] * 8, 3), (13, [], 5), (14, [0.3] * 13, 5), (15, [5e4] * 16, 5), (16, [-5e4, 5e4] * 8, 5)]


@pytest.mark.parametrize("case", ["random", "awkward", "few", "same"])
def test_codes(spark, case):
    rows = {"random": vectors(1, 400), "awkward": AWKWARD + vectors(2, 120), "few": AWKWARD,
            "same": [(i, [0.125] * 16, 1) for i in range(300)] + vectors(3, 20)}[case]
    entries = 256 if case == "few" else 12
    frame = spark.createDataFrame([(*r, "c", "e", "n", "p") for r in rows], SCHEMA).repartition(4)
    got, books = compress(frame, entries=entries)
    want, sha = plain(rows, entries=entries)
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
    assert books.sha256() == sha


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert compress(frame)[0].count() == 0 and compress(frame.limit(0))[0].collect() == []


def test_only_moved_entries_are_compared_when_the_own_one_rests():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, entries = rng.integers(-6, 7, (40, 2)), rng.integers(-6, 7, (9, 2))
        code, far = assign(x, entries, np.ones(9, dtype=bool), None, None)
        new = entries.copy()
        moved = rng.random(9) < 0.4
        new[moved] = rng.integers(-6, 7, (int(moved.sum()), 2))
        moved = (new != entries).any(axis=1)
        got = assign(x, new, moved, code, far)
        d = ((x[:, None] - new[None]) ** 2).sum(axis=2)
        assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()


def test_distances_are_exact_for_large_numbers():
    x = np.array([[1 << 26, -(1 << 26)], [3, 4]])
    assert squared(x, np.array([[-(1 << 26), 1 << 26], [0, 0]])).tolist() == [
        [2 << 54, 2 << 52], [(3 + (1 << 26)) ** 2 + (4 - (1 << 26)) ** 2, 25]]
