"""Token counts under a unigram model, by dynamic programming on a trie.

The distinct pre-tokens of a batch are visited in sorted order, which walks
their trie depth first: the forward scores along the path to the last
pre-token stay on a stack, and a new one computes only what lies beyond the
prefix it shares.  Its token count is stored at its end, so a pre-token costs a
lookup from then on.  Tasks share nothing and documents are not shuffled.
"""

from __future__ import annotations

import functools
import math
import os.path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.texthash import split_words

START = "▁"                 # fixed by the vocabulary: the mark before a word
COUNTS_HELD = 700_000            # pre-tokens whose counts a worker process holds,
BYTES_HELD = 32 << 20            # their bytes together,
LONG_WORD = 256                  # and the longest one that is held
_STOP = object()


class UnigramCounter:
    """`log_probs` by piece.  A character that no piece covers is spelled in
    bytes: one token per UTF-8 byte, each scored below every piece."""

    def __init__(self, log_probs: dict[str, float]):
        self.log_probs = log_probs
        # A trie of the pieces read backwards: every end of a piece, with the
        # score of that end where it is a piece itself.
        self.ends: dict[str, float | None] = {}
        for piece, score in log_probs.items():
            for j in range(1, len(piece)):
                self.ends.setdefault(piece[j:], None)
            self.ends[piece] = score
        self.longest = max(map(len, log_probs), default=1)
        self.byte_score = min(log_probs.values(), default=0.0) - 10.0
        self.counts: dict[bytes, int] = {}
        self.held_bytes = 0
        self.path, self.best = "", [(0.0, 0)]        # (score, minus tokens) after each prefix of path

    def _forward(self, text: str, best: list, start: int) -> None:
        """Extend `best`, the forward scores up to `start`, to the end of
        `text`; of a long text only the last scores are held."""
        get, byte_score, base = self.ends.get, self.byte_score, 0
        for lo in range(start, len(text), LONG_WORD):
            for i in range(lo + 1, min(lo + LONG_WORD, len(text)) + 1):
                spelled = len(text[i - 1].encode("utf-8", "surrogatepass"))
                score, tokens = best[i - 1 - base]
                top = (score + spelled * byte_score, tokens - spelled)
                for j in range(i - 1, -1, -1):
                    p = get(text[j:i], _STOP)
                    if p is _STOP:                   # no piece ends like this
                        break
                    if p is not None:
                        score, tokens = best[j - base]
                        if (score + p, tokens - 1) > top:
                            top = (score + p, tokens - 1)
                best.append(top)
            if len(text) > LONG_WORD and len(best) > self.longest + 1:
                base += len(best) - self.longest - 1
                del best[:-self.longest - 1]

    def _count(self, text: str) -> int:
        """Tokens of a word; one that is not long shares the scores of the
        prefix that it has in common with the word before it."""
        if len(text) > LONG_WORD:
            best = [(0.0, 0)]
            self._forward(text, best, 0)
            return -best[-1][1]
        shared = len(os.path.commonprefix((self.path, text)))
        del self.best[shared + 1:]
        self._forward(text, self.best, shared)
        self.path = text
        return -self.best[-1][1]

    def counts_of(self, words: list[list[bytes]]) -> list[int]:
        """Tokens of several lists of words."""
        if len(self.counts) > COUNTS_HELD or self.held_bytes > BYTES_HELD:
            self.counts.clear()
            self.held_bytes = 0
        fresh = sorted(set().union(*words) - self.counts.keys())
        for w in fresh:
            self.counts[w] = self._count(START + w.decode())
        out = [sum(map(self.counts.__getitem__, w)) for w in words]
        for w in fresh:              # text without spaces makes words as long as itself
            if len(w) > LONG_WORD:
                del self.counts[w]
            else:
                self.held_bytes += len(w)
        return out


@functools.lru_cache(maxsize=2)
def counter(model_path: str) -> UnigramCounter:
    """The pieces of a public vocabulary.  It lists them by falling frequency
    without probabilities, so a piece of rank r gets Zipf's 1 / (r + 1), not
    normalised (a constant does not change which segmentation is best)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return UnigramCounter({p: -math.log(r + 2) for r, p in enumerate(pieces)})


def token_count(text: Column, model_path: str) -> Column:
    """Tokens of a whole text: the sum over its words of the tokens in each
    word's best segmentation (the fewest among equally good ones).  Null and
    empty texts have none.  `model_path` must exist on every executor."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        model = counter(model_path)
        out = []
        for i in range(0, len(texts), 500):
            some = [split_words(t.encode() if t else None) for t in texts.iloc[i:i + 500]]
            out += model.counts_of(some)
        return pd.Series(out, dtype="int64")
    return count(text)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id` and `n_tokens`.  Repeated and null ids
    are rows like others; an empty table gives an empty result."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       token_count(F.coalesce(F.col(text_col), F.lit("")), model_path).alias("n_tokens"))
