"""Quality rules and exact dedup against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from shelfline.llm.exact_dedup import directory, exact_dedup
from shelfline.llm.quality_rules import default_rules, plan_cascade, quality_rules

from .data import awkward_texts, frame, prose, table, words

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_of(text):
    w = words(text)
    lines, seen, dup = [x for x in (text or "").split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, r in enumerate(zip(w, w[1:], w[2:])) if runs[r] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_base_statistics(spark):
    rows = awkward_texts()
    got = table(quality_rules(frame(spark, rows)).select(*BASE))
    assert got == sorted(((i, *base_of(t)) for i, t in rows), key=str)


def test_clean_prose_is_kept_and_junk_is_not(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, 120)) for i in range(30)]
    junk = [(50, " ".join(f"w{k}&&&" for k in range(100))), (51, " ".join(f"W{k}K!!" for k in range(100)).upper()),
            (52, "\n".join(["the same line again and again is here"] * 20)), (53, "short"), (54, None),
            (55, " ".join(str(k * 7919) for k in range(100))), (56, " ".join("x" * 30 + str(k) for k in range(99)))]
    got = {r.doc_id: (r.kept, r.rejected_by) for r in quality_rules(frame(spark, clean + junk)).collect()}
    assert all(got[i] == (True, None) for i, _ in clean)
    assert not any(got[i][0] for i, _ in junk)
    assert got[53][1] == got[54][1] == "base"


def test_cascade_orders_all_rules_and_the_verdict_does_not_depend_on_it(spark):
    docs = frame(spark)
    rules = default_rules()
    names = plan_cascade(docs, rules, "text", 50)
    assert sorted(names) == sorted(r.name for r in rules)
    a = table(quality_rules(docs, rules).select("doc_id", "text", "kept"))
    b = table(quality_rules(docs, rules[::-1], sample_rows=5).select("doc_id", "text", "kept"))
    assert a == b


def test_quality_rules_keep_extra_columns_and_take_an_empty_table(spark):
    docs = frame(spark)
    assert set(docs.columns) <= set(quality_rules(docs).columns)
    assert quality_rules(docs.limit(0)).count() == 0


def expected_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(words(t))].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort()
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=str)


def test_exact_dedup(spark):
    rows = awkward_texts()
    got = exact_dedup(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert table(got) == expected_dedup(rows)


def test_exact_dedup_with_tiny_buckets_and_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 5, 40)) for i in range(300)] + [(1000 + i, "hot text") for i in range(200)]
    got = exact_dedup(frame(spark, rows), capacity=2, max_depth=6)
    assert table(got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == expected_dedup(rows)
    assert exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(i << 60,) for i in range(-8, 8)] + [(k,) for k in range(1, 6)], "h long")
    slots, depth = directory(keys, 2, 10)
    held = Counter()
    by_slot = {r.slot: r for r in slots.collect()}
    for (h,) in keys.collect():
        held[by_slot[(h & (1 << 64) - 1) >> 64 - depth].bucket] += 1
    full = [b for b, n in held.items() if n > 2]
    assert depth >= 3 and len(held) > 4
    assert all(by_slot[s].depth == depth for s in by_slot if by_slot[s].bucket in full)
