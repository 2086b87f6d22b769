"""Substring dedup, the Jaccard join and mixing against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import jaccard_join
from shelfline.llm.components import components
from shelfline.llm.jaccard_join import Region, near_duplicates
from shelfline.llm.mixing import mix_sources, source_targets
from shelfline.llm.shared_hashes import distinct_counts, find_pairs
from shelfline.llm.substring_dedup import COVER, PERIOD, remove_repeats
from shelfline.session import materialize

from .data import awkward_texts, frame, prose, table, words


def test_the_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def expected_removal(rows, length):
    docs = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, docs):
        hit = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for k in range(length)}
        left = [x for i, x in enumerate(w) if i not in hit]
        out.append((doc_id, len(w), len(hit), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunks", [None, 7])
def test_substring_dedup(spark, monkeypatch, chunks):
    if chunks:
        monkeypatch.setattr("shelfline.llm.substring_dedup.chunk_count", lambda *a: chunks)
    rows = awkward_texts()
    got = remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert table(got) == expected_removal(rows, 35)


def test_substring_dedup_finds_matches_at_every_shift(spark):
    rng = random.Random(6)
    passage = prose(rng, 40, 10 ** 6).split()
    rows = [(k, " ".join([f"a{k}_{i}" for i in range(k)] + passage[:35 + k % 3] + [f"b{k}"])) for k in range(50)]
    rows += [(100, " ".join(passage[:34])), (101, "loop " * 100)]
    got = remove_repeats(frame(spark, rows), with_text=True)
    assert table(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == expected_removal(rows, 35)
    kept = {r.doc_id: r.kept_text for r in got.collect()}
    assert kept[2] == "a2_0 a2_1 b2" and kept[101] == "" and kept[100] == rows[50][1]


def test_substring_dedup_of_an_empty_table(spark):
    assert remove_repeats(frame(spark).limit(0)).count() == 0


def shingle_set(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()


def expected_components(rows, percent=90):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))),
                  key=str)


def near_rows(seed, n_base=15, copies=12):
    rng = random.Random(seed)
    rows = []
    for b in range(n_base):
        base = prose(rng, rng.choice([3, 12, 40, 120, 200]), 2000).split()
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            if rng.random() < 0.3:
                w += [f"t{rng.randrange(9)}" for _ in range(rng.randint(0, len(w) // 8))]
            rows.append((len(rows), " ".join(w).title() if rng.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("case", ["awkward", 1, 2, 5])
def test_jaccard_join(spark, monkeypatch, case):
    rows = awkward_texts() if case == "awkward" else near_rows(case)
    if case in (2, 5):
        monkeypatch.setattr(jaccard_join, "MOST_DOCS", 4)       # nearly every group in blocks
        monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    got = near_duplicates(frame(spark, rows))
    assert table(got.select("doc_id", "n_shingles", "component_id")) == expected_components(rows)
    firsts = [r.component_id for r in got.where("first and n_shingles > 0").collect()]
    linked = {r.component_id for r in got.where("n_shingles > 0").collect()}
    assert len(firsts) == len(set(map(str, firsts))) or case == "awkward"
    assert set(firsts) == linked


def test_large_groups_of_long_texts_stay_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_BYTES", 20_000)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rng = random.Random(9)
    passage = prose(rng, 20, 10 ** 6)
    rows = [(i, f"{passage} {prose(rng, 230, 10 ** 6)}") for i in range(150)]       # 1.7 KB each, unlinked
    rows += [(150 + i, rows[i * 40][1] + " end") for i in range(3)]
    total = sum(len(t) for _, t in rows)
    texts = spark.createDataFrame(
        [(0, i, t, len(rows), total, -(-total // 20_000)) for i, t in rows],
        "root long, row_id long, text string, n long, bytes long, blocks long")
    near, tasks = jaccard_join._large_groups(materialize(texts, "long-texts"), 3, 90)
    held = defaultdict(list)
    for r in tasks.collect():
        held[r.a, r.b].append(r)
    # Two blocks of 20 KB each in expectation, against 260 KB in one task.
    assert max(sum(len(r.text) for r in rs) for rs in held.values()) < 80_000
    met = {(r.row_id, x.row_id) for rs in held.values() for r in rs for x in rs}
    met |= {(r.u, r.v) for r in near.collect()} | {(r.v, r.u) for r in near.collect()}
    assert all((150 + i, i * 40) in met for i in range(3))
    rests = len({r.row_id for rs in held.values() for r in rs})
    assert rests == len(rows) and len(held) <= 16 * 17 // 2
    docs = near_duplicates(frame(spark, rows))
    assert table(docs.select("doc_id", "n_shingles", "component_id")) == expected_components(rows)


def test_a_document_of_several_large_groups_goes_to_each_block_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_DOCS", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rng = random.Random(31)
    rows = [(i, prose(rng, 40, 10 ** 6)) for i in range(60)]
    rows += [(60 + i, rows[i][1] + " end") for i in range(20)]
    groups = [(root, i, t) for root in (0, 1, 2) for i, t in rows if i % 3 != root]
    texts = materialize(spark.createDataFrame(groups, "root long, row_id long, text string"), "several")
    weights = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    _, tasks = jaccard_join._large_groups(texts.join(weights.withColumn("blocks", F.ceil(F.col("n") / 8)), "root"), 3, 90)
    held = [tuple(r) for r in tasks.select("root", "a", "b", "row_id").collect()]
    assert len(held) == len(set(held))
    found = {tuple(sorted((r.u, r.v))) for r in jaccard_join.join_groups(texts, 3, 90).collect()}
    assert found == {(i, 60 + i) for i in range(20)}


def test_overlapping_regions_do_not_chain(spark, monkeypatch):
    """5,000 texts, each sharing words with the next one only: no group holds
    more than a few of them."""
    rng = random.Random(12)
    parts = [prose(rng, 12, 10 ** 6) for _ in range(5001)]
    rows = [(i, f"{parts[i]} {parts[i + 1]}") for i in range(5000)] + [(5000, f"{parts[7]} {parts[8]} end")]
    largest = []
    whole = jaccard_join.join_groups

    def watched(texts, *args):
        largest.append(texts.groupBy("root").count().agg({"count": "max"}).first()[0])
        return whole(texts, *args)
    monkeypatch.setattr(jaccard_join, "join_groups", watched)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), percent=80).collect()}
    assert got == {i: 7 if i == 5000 else i for i in range(5001)}
    assert largest[0] <= 6


def test_jaccard_join_of_an_empty_table(spark):
    assert near_duplicates(frame(spark).limit(0)).count() == 0


def test_regions_split_by_pivots_lose_no_link(monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    for seed in range(4):
        rows = near_rows(seed, 30, 10)
        sets = [shingle_set(t) for _, t in rows]
        number = {}
        arrays = [np.array(sorted(number.setdefault(x, len(number)) for x in s), dtype=np.uint64) for s in sets]
        region = Region(arrays, 90)
        region.links()
        got = [rows[region.find(i)][0] for i in range(len(rows))]
        groups, want = defaultdict(set), defaultdict(set)
        for i, (doc, _, c) in enumerate(sorted(expected_components(rows), key=lambda x: x[0])):
            want[c].add(doc)
            groups[got[i]].add(doc)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 60)]
    links = chain + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300))
                                                                for _ in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {(r.node, r.root) for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(x, find(x)) for x in root if x not in loops}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_distinct_counts():
    a = np.array([5, 3, 5, 5, 3], dtype=np.uint64)
    b = np.array([1, 2, 1, 7, 2], dtype=np.uint64)
    u, _, n = distinct_counts(a)
    assert u.tolist() == [3, 5] and n.tolist() == [2, 3]
    u, v, n = distinct_counts(a, b)
    assert list(zip(u.tolist(), v.tolist(), n.tolist())) == [(3, 2, 2), (5, 1, 2), (5, 7, 1)]
    u, v, n = distinct_counts(a[:0], b[:0])
    assert len(u) == len(v) == len(n) == 0


def test_pairs_are_found_when_first_halves_collide():
    rng = np.random.default_rng(2)
    a, b, x, y = (rng.integers(0, 6, 40).astype(np.uint64) for _ in range(4))
    a.sort()
    known = set(zip(a.tolist(), b.tolist()))
    assert find_pairs(a, b, x, y).tolist() == [p in known for p in zip(x.tolist(), y.tolist())]
    assert not find_pairs(a[:0], b[:0], x, y).any()


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, budget = {}, set(names), share * sum(sizes.values())
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("sources", [("src0", "src1", None), ("a",), ("b", "B", "é", "Z", "z", None, "src10", "src9")])
def test_mixing(spark, sources):
    rows = awkward_texts()
    got = mix_sources(frame(spark, rows, sources)).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s, t in plain_targets(sizes).items():
        assert all(r.target == pytest.approx(t) and r.source_size == sizes[s] for r in got if r.source == s)
        assert abs(taken[s] - t) <= 1
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id) == sorted((i, len(words(t))) for i, t in rows if i)
    again = mix_sources(frame(spark, rows, sources)).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.taken) for r in got))) == sorted(
        map(str, ((r.doc_id, r.size, r.taken) for r in again)))


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 100, "d": 0, None: 5000}
    frame_ = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(frame_, [5, 2, 1], 1.5, 2).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mixing_nothing(spark):
    assert mix_sources(frame(spark).limit(0)).count() == 0
    empty = mix_sources(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 2
