"""Token ids of many texts with the tokenizers library, one process at a time.

White-space rules of the two kinds of pre-tokenizer allow a text to be cut
into units whose ids do not depend on their neighbours.  Arrow kernels cut the
texts of a batch, find the distinct units and take their trailing marks off;
only the distinct words left are looked up in a bounded cache or encoded, and
the ids of all texts are then gathered by array indexing.
"""

from __future__ import annotations

import functools
import gc
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_HELD = 1_200_000             # cached words per worker process,
BYTES_HELD = 96 << 20              # their letters and ids together,
LONG_WORD = 128                    # and the longest word that stays cached
# Fixed by the pre-tokenizers: ASCII marks after a letter, up to the unit's
# end, are a pre-token of their own; letters are taken from Latin blocks only.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTER_AT_END = "[A-Za-zÀ-ÖØ-öø-ɏ]$"
TWO_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
WORD_END = "</w>"
LONGEST_TAIL = 8                 # bytes of marks that are taken off


def spaced_units(text: str) -> list[str]:
    """Units of a text with runs of white space: the first, and later ones
    that each follow one space.  A cut is made only at a space between two
    characters that are not white space; no pre-token crosses such a place."""
    out, parts = [], text.split(" ")
    now = parts[0]
    for p in parts[1:]:
        if p and now and not p[0].isspace() and not now[-1].isspace():
            out.append(now)
            now = p
        else:
            now = f"{now} {p}"
    return [*out, now]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The slices of `flat` (by `starts` and `sizes`) that `parts` names, end to end."""
    n = sizes[parts]
    at = np.cumsum(n)
    return flat[np.repeat(starts[parts] - at + n, n) + np.arange(at[-1] if len(at) else 0)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Encoder:
    """`spaced` says that a space belongs to the token after it (byte-level
    pre-tokens); otherwise white space only separates tokens.  Names of
    special tokens inside a text are ordinary text."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark runs a process per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        # What a normaliser does to A-Z anyway is done before words are looked up.
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        # Bytes of each token, where tokens spell the text byte by byte.
        names = sorted(((i, t) for t, i in self.tokenizer.get_vocab().items()))
        self.sizes = np.zeros(names[-1][0] + 1, dtype=np.int64)
        # Vocabularies of the other kind mark the last token of every pre-token.
        self.ends = np.zeros(names[-1][0] + 1, dtype=bool)
        for i, t in names:
            self.sizes[i], self.ends[i] = len(t), t.endswith(WORD_END)
        self.words: dict[str, bytes] = {}
        self.held_bytes = 0

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not cached, many in one call: words of letters
        (with the space before them) do not touch each other, and the tokens'
        sizes or end marks tell where each word's ids end."""
        for i in range(0, len(words), 2000):
            some, plain = [], []
            for w in words[i:i + 2000]:
                (plain if (w[1:] if self.spaced and w[:1] == " " else w).isalpha()
                 and (w[0] == " ") == self.spaced else some).append(w)
            text = ("" if self.spaced else " ").join(plain)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            if self.spaced:
                last = np.cumsum([len(w.encode()) for w in plain])
                reach = np.cumsum(self.sizes[ids])
                ends = np.searchsorted(reach, last) + 1
                whole = len(plain) == 0 or bool((ends <= len(reach)).all() and (reach[ends - 1] == last).all()
                                                and reach[-1] == last[-1])
            else:
                ends = np.flatnonzero(self.ends[ids]) + 1    # every word has one at least: equal numbers mean one each
                whole = len(ends) == len(plain)
            if whole:
                data, start = ids.tobytes(), 0
                for w, e in zip(plain, (4 * ends).tolist()):
                    self.words[w] = data[start:e]
                    start = e
            else:
                some += plain
            for w, c in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.words[w] = array("I", c.ids).tobytes()

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has."""
        held = self.words
        if len(held) > WORDS_HELD or self.held_bytes > BYTES_HELD:
            held.clear()
            self.held_bytes = 0
        fresh = [w for w in words if w not in held]
        self._learn(fresh)
        found = [held[w] for w in words]
        for w in fresh:              # text without spaces makes words as long as itself
            ids = held[w] if len(w) <= LONG_WORD else held.pop(w)
            self.held_bytes += (len(w) + len(ids)) * (len(w) <= LONG_WORD)
        return (np.frombuffer(b"".join(found), "<u4"),
                np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4)

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units, the unit at each place, and units per text."""
        if not self.spaced:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            coded = lists.flatten().dictionary_encode()
            return coded.dictionary, coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
        wide = pc.match_substring_regex(texts, TWO_SPACES).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        if wide.any():
            apart = pa.array([spaced_units(t) for t in texts.filter(pa.array(wide)).to_pylist()], lists.type)
            lists = pc.if_else(pa.array(wide), apart.take(pa.array(np.cumsum(wide) - 1).cast(pa.int64())), lists) \
                if wide.all() else pa.concat_arrays([lists, apart]).take(
                    pa.array(np.where(wide, len(lists) + np.cumsum(wide) - 1, np.arange(len(lists)))))
        sizes = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        at, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        firsts = _starts(sizes)
        at[firsts] += n                                          # a first unit has no space before it
        led = pc.binary_join_element_wise(pa.scalar(" "), coded.dictionary, "")
        return pa.concat_arrays([led, coded.dictionary.cast(led.type)]), at, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has; a null
        text has those of an empty one.  Any Arrow type of strings will do."""
        gc.disable()                 # the cache holds no cycles, and walking it is slow
        try:
            return self._encode(pc.fill_null(texts.cast(pa.string()), ""))
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        units, at, per_text = self._units(texts)
        used = np.bincount(at, minlength=len(units)) > 0          # of both kinds of a spaced unit
        if not used.all():
            units, at = units.filter(pa.array(used)), (np.cumsum(used) - 1)[at]
        words = pc.utf8_rtrim(units, characters=MARKS)
        size = pc.binary_length(units).to_numpy().astype(np.int64)
        tail = size - pc.binary_length(words).to_numpy()
        whole = (tail == 0) | (tail > LONGEST_TAIL) | ~pc.match_substring_regex(
            words, LETTER_AT_END).to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(whole), units, words)
        words = (pc.ascii_lower(words) if self.lower else words).dictionary_encode()
        tail[whole] = 0
        # Tails of up to 8 bytes, as numbers read backwards from the units' ends.
        _, offsets, data = units.buffers()
        ends = np.frombuffer(offsets, np.int32)[units.offset + 1:units.offset + 1 + len(units)].astype(np.int64)
        marked = np.flatnonzero(tail)
        padded = np.concatenate([np.zeros(8, np.uint8), np.frombuffer(data, np.uint8)])
        last = np.lib.stride_tricks.sliding_window_view(padded, 8)[ends[marked]]
        key = last.copy().view("<u8").ravel() >> ((LONGEST_TAIL - tail[marked]) * 8).astype(np.uint64)
        tails, which = np.unique(key, return_inverse=True)
        names = [int(k).to_bytes(8, "little").rstrip(b"\0").decode() for k in tails]

        flat, sizes = self._ids_of(words.dictionary.to_pylist() + names + [""])
        n_words = len(words.dictionary)
        second = np.full(len(units), len(sizes) - 1)             # no tail: no ids
        second[marked] = n_words + which
        parts = np.column_stack([words.indices.to_numpy(), second]).ravel()
        flat, sizes = gather(flat, _starts(sizes), sizes, parts), sizes[parts].reshape(-1, 2).sum(axis=1)
        ids = gather(flat, _starts(sizes), sizes, at)
        edges = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(edges)


@functools.lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    return Encoder(path, spaced)


def append_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` after each text's ids."""
    out = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
    return out, counts + 1


def text_batches(batch, text_index: int, most_bytes: int = 8 << 20):
    """Slices of an Arrow batch with at most about `most_bytes` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(sizes) // most_bytes
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]).tolist()
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
