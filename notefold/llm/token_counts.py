"""Token counts under a unigram model, by dynamic programming over a trie.

Pre-tokens (words, each after a word mark) enter a trie once.  A node stands for
a prefix and holds its forward score: the best sum of piece scores over all
segmentations of the prefix, and the least number of tokens that reaches it.
Prefixes that words share are scored once; a word's end holds its count.
Characters in no piece cost a fixed penalty and one token for each UTF-8 byte.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from notefold.llm.common import lean, small_batches, texts

MARK = "▁"
#: What an unknown character scores below the worst piece.
PENALTY = 10.0


@functools.lru_cache(2)
def pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file and their scores, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(k): p.get_score(k) for k in range(p.get_piece_size()) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k))}


class Trie(dict):
    """Word (bytes) to complex(tokens, score), through forward scores at the nodes of a trie; emptied at a bound of nodes."""

    def __init__(self, score: dict[str, float], most: int = 1_200_000):
        self.score, self.most = score, most
        self.tails = {p[k:] for p in score for k in range(len(p))}  # a longer suffix that is none of these ends in no piece
        self.unknown = min((s for s in score.values() if s > -1e6), default=0.0) - PENALTY  # reserved pieces score far lower
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def __missing__(self, word: bytes) -> complex:
        if len(self.best) > self.most:
            self._reset()
        text = MARK + word.decode("utf-8", "replace")
        child, best, tokens, score, tails = self.child, self.best, self.tokens, self.score, self.tails
        at, path = 0, [0]
        for d, c in enumerate(text, 1):
            key = at << 21 | ord(c)
            at = child.get(key)
            if at is None:
                s = score.get(c)
                top, least = (best[path[-1]] + self.unknown, tokens[path[-1]] + len(c.encode())) if s is None else (best[path[-1]] + s, tokens[path[-1]] + 1)
                k = d - 2
                while k >= 0 and (tail := text[k:d]) in tails:
                    s = score.get(tail)
                    if s is not None:
                        s += best[path[k]]
                        if s > top or s == top and tokens[path[k]] + 1 < least:
                            top, least = s, tokens[path[k]] + 1
                    k -= 1
                at = child[key] = len(best)
                best.append(top)
                tokens.append(least)
            path.append(at)
        out = self[word] = complex(tokens[at], best[at])
        return out


@functools.lru_cache(2)
def trie(path: str) -> Trie:
    return Trie(pieces(path))


def _count(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(path)
        for b in batches:
            words, tokens, scores = [], [], []
            for t in b["text"].to_pylist():
                w = t.encode().split()
                found = sum(map(own.__getitem__, w), 0j)
                words.append(len(w))
                tokens.append(int(found.real))
                scores.append(found.imag)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, score for every row of docs.

    Words lie between runs of space and \\x09 to \\x0D.  n_tokens is the number of
    tokens in each word's best segmentation (of equally good ones the shortest),
    score the sum of their scores.  A null or empty text has zeros.  Rows that
    repeat an id, or have none, get a row each; an empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_count(model), "doc_id long, n_words long, n_tokens long, score double")
