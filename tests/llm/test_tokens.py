"""Token files, packing, token counts and the tokenizer cache."""

import math
import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfline.llm import packing, simple8b
from shelfline.llm.packing import boundaries, choose_cuts, pack_documents, padded
from shelfline.llm.token_counts import START, UnigramCounter, count_tokens, counter
from shelfline.llm.token_files import read_tokens, write_tokens
from shelfline.llm.tokenize import Encoder, append_end

from .data import awkward_texts, frame, prose, words

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def plain_ids(path, texts):
    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    return [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_cached_encoding_equals_the_library(path, spaced, monkeypatch):
    rng = random.Random(5)
    texts = [t for _, t in awkward_texts()]
    texts += ["ab½$$ c²! x2&& É!!! e\u0301!! don't, John's. abc' =\u0338 a=\u0338", "foo!!!!!!!!!! bar!!!!!!!! x×! y÷÷!"]
    for alphabet in ("aBé '.,!12\n\t  \u0338\u0301=<ſ²½—\xa0\u2003\u3000漢\x1c\x85Σ", "aBé '.,!12=é$ "):
        texts += ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(2000)]
    monkeypatch.setattr("shelfline.llm.tokenize.WORDS_HELD", 300)
    encoder = Encoder(path, spaced)
    for some in ([texts[i:i + 100] for i in range(0, len(texts), 100)] + [[None], ["a  b"], []]):
        ids, counts = encoder.encode(pa.array(some, pa.string()))
        want = plain_ids(path, some)
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == sum(want, [])


def test_end_ids_follow_every_text():
    ids, counts = append_end(np.array([5, 6, 7], dtype="<u4"), np.array([0, 2, 0, 1]), 9)
    assert ids.tolist() == [9, 5, 6, 9, 9, 7, 9] and counts.tolist() == [1, 3, 1, 2]


@pytest.mark.parametrize("values", [
    [], [7], [0] * 1000, list(range(3000)), [2 ** 64 - 1, 0, 2 ** 60, 2 ** 60 - 1, 1] * 100,
    [random.Random(1).randrange(2 ** random.Random(i).randrange(1, 64)) for i in range(5000)]])
def test_simple8b_round_trip_and_block_offsets(values):
    v = np.array(values, dtype=np.uint64)
    coded, blocks = simple8b.encode(v)
    assert (simple8b.decode(coded) == v).all() and blocks[-1] == len(coded)
    for k, (a, b) in enumerate(zip(blocks, blocks[1:])):
        assert (simple8b.decode(coded[a:b]) == v[k * simple8b.BLOCK:(k + 1) * simple8b.BLOCK]).all()


def test_token_files_round_trip(spark, monkeypatch):
    rows = awkward_texts()
    out = tempfile.mkdtemp(prefix="tokens-") + "/t"
    write_tokens(frame(spark, rows), out, WORDS, 1)
    got = read_tokens(spark, out, with_ids=True).orderBy("start").collect()
    want = dict(zip(map(str, rows), plain_ids(WORDS, [t for _, t in rows])))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted(
        (str(i), np.array(want[str((i, t))] + [1], dtype="<u4").tobytes()) for i, t in rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is None, x))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens


def test_token_files_of_an_empty_table(spark):
    out = tempfile.mkdtemp(prefix="tokens-") + "/t"
    write_tokens(frame(spark).limit(0), out, WORDS, 1)
    assert read_tokens(spark, out).count() == 0


def check_packing(rows, pieces, most=1024):
    """Pieces of (start, length, ids_crc32, ...) cover each document once."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    coded = defaultdict(list)
    for (i, _), ids in zip(rows, plain_ids(BYTES, [t for _, t in rows])):
        coded[i].append(ids + [0])
    for i, docs in coded.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(docs[0]))
                assert r.ids_crc32 == crc(docs[0][at:at + r.length])
                at += r.length
    total = waste = 0
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= most
        total, waste = total + at, waste + padded(at, most) - at
    return total, waste


@pytest.mark.parametrize("block", [8 << 20, 6000])
def test_packing(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_BYTES", block)
    rows = awkward_texts()
    pieces = pack_documents(frame(spark, rows), BYTES).collect()
    total, waste = check_packing(rows, pieces)
    assert waste < 0.01 * total + 3 * 1024
    assert pack_documents(frame(spark, rows).limit(0), BYTES).count() == 0


def test_long_gaps_get_places_to_cut():
    rows = awkward_texts()
    docs = [np.array(x + [0], dtype="<u4") for x in plain_ids(BYTES, [t for _, t in rows])]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    at, price = boundaries(ids, ends, packing.sentence_marks(BYTES), 64, 2.0, 8.0)
    assert max(np.diff(at)) <= 64 and set(ends) <= set(at) and (price[np.searchsorted(at, ends)] == 0).all()
    cuts = choose_cuts(at, price, 64, 8.0)
    assert cuts[0] == 0 and cuts[-1] == len(ids) and 0 < min(np.diff(cuts)) and max(np.diff(cuts)) <= 64


def test_cuts_are_the_best_there_are():
    rng = random.Random(8)
    tried = 0
    for _ in range(300):
        most, least, extra = 16, rng.choice([1, 4]), rng.choice([2.0, 3.0])
        at = np.unique([0] + [rng.randrange(1, 90) for _ in range(rng.randint(2, 20))])
        if len(at) < 2 or max(np.diff(at)) > most:
            continue
        tried += 1
        price = np.array([rng.choice([0.0, 1.0, 2.0]) for _ in at])

        def waste(n):
            return 0 if n >= least and n & (n - 1) == 0 else most - n

        best = {0: 0.0}
        for j in range(1, len(at)):
            options = []
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= most:
                    options.append(best[i] + waste(n))
                elif n <= 2 * most:
                    options.append(best[i] + 2 * most - n + extra)
            best[j] = price[j] + min(options)
        cuts = choose_cuts(at, price, most, extra, least)
        known = {int(x): p for x, p in zip(at, price)}
        got = 0.0
        for a, b, c in zip([None] + cuts, cuts, cuts[1:] + [None]):
            if b not in known:
                got += extra
                assert b - a == most
            elif b:
                got += known[b]
            if c is not None:
                got += most - (c - b) if b not in known else waste(c - b)
        assert math.isclose(got, best[len(at) - 1])
    assert tried > 30


def plain_count(model, word):
    """Unigram segmentation of one word without sharing."""
    text = START + word
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        n = len(text[i - 1].encode())
        options = [(best[i - 1][0] + n * model.byte_score, best[i - 1][1] - n)]
        options += [(best[j][0] + model.log_probs[text[j:i]], best[j][1] - 1)
                    for j in range(max(0, i - model.longest), i) if text[j:i] in model.log_probs]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_equal_unshared_scores(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = awkward_texts() + [(400, "x" * 300), (401, "漢字かな" * 700)]
    model = counter(path)
    cache = {}
    for _, t in rows:
        for w in words(t):
            cache[w] = cache.get(w) or plain_count(model, w)
    got = sorted(((r.doc_id, r.n_tokens) for r in count_tokens(frame(spark, rows), path).collect()), key=str)
    assert got == sorted(((i, sum(cache[w] for w in words(t))) for i, t in rows), key=str)
    assert count_tokens(frame(spark).limit(0), path).count() == 0


def test_trie_walk_in_any_order_and_after_a_reset(monkeypatch):
    rng = random.Random(3)
    model = UnigramCounter({"▁": -1.0, "a": -2.0, "ab": -2.5, "▁ab": -2.6, "b": -2.0, "bab": -3.0})
    monkeypatch.setattr("shelfline.llm.token_counts.COUNTS_HELD", 40)
    for _ in range(30):
        some = ["".join(rng.choice("abü") for _ in range(rng.randint(1, 9))) for _ in range(20)]
        some.append("".join(rng.choice("abü") for _ in range(rng.choice([255, 256, 257, 511, 512, 513, 900]))))
        assert model.counts_of([[w.encode()] for w in some]) == [plain_count(model, w) for w in some]
        assert max(map(len, model.counts)) <= 256


def test_prose_takes_fewer_tokens_than_characters(spark):
    text = prose(random.Random(1), 50)
    path = public_tokenizers.path("piece_bpe_32k.model")
    n = count_tokens(frame(spark, [(1, text)]), path).first().n_tokens
    assert 50 <= n < len(text)
