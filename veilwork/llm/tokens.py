"""Token ids of many texts with a public tokenizer, encoding each distinct piece of text once in a worker.

Pieces are found and told apart as arrays, by the 64-bit hashes of ``words``: Python sees only pieces that are new.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from veilwork.llm.words import SPACE, Words, span_hashes

# Distinct pieces a worker keeps, and bytes of the longest of them; beyond, the ones of the last chunk are kept.
KEPT = 1 << 21
LONGEST = 64
END_OF_WORD = "</w>"
# Space characters beyond ASCII in front of ASCII ones: there a cut would split a run of space.
_MIXED = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[\t-\r ]")


def word_pieces(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without the space between them: begin and end of each, and where each text's ones begin."""
    return words.start, words.end, words.first


def spaced_pieces(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the space before them, and space after the last: byte-level pre-tokenizers never join across such a cut."""
    begin, end, first, counts = np.empty_like(words.start), words.end, words.first[:-1], words.counts
    begin[1:] = end[:-1]
    held = counts > 0
    begin[first[held]] = words.at[:-1][held]
    close = words.at[1:] - 1
    last = words.at[:-1].copy()
    last[held] = end[words.first[1:][held] - 1]
    rest = close > last
    whole = np.fromiter((_MIXED.search(t) is not None for t in texts), bool, len(texts))
    inner = ~np.repeat(whole, counts)
    rest, last = rest | whole, np.where(whole, words.at[:-1], last)
    # The piece after a text's words goes behind them.
    place = words.first[1:][rest]
    kept = np.concatenate([[0], np.cumsum(inner)])
    begin, end = np.insert(begin[inner], kept[place], last[rest]), np.insert(end[inner], kept[place], close[rest])
    return begin, end, np.concatenate([[0], np.cumsum(np.where(whole, 0, counts) + rest)])


class Encoder:
    """Ids of texts, each followed by ``end``; ``words`` for tokenizers that drop space between words."""

    def __init__(self, path: str, end: int, words: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(names.values()) + 1, np.int64)  # of the text that an id stands for
        self.bytes[list(names.values())] = [len(name.removesuffix(END_OF_WORD) if words else name) for name in names]
        self.pieces, self.end = word_pieces if words else spaced_pieces, end
        self._forget()

    def _forget(self) -> None:
        """Known pieces by hash, sorted; the number of each tells where its ids begin."""
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each known piece, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)

    def _together(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces that can stand in one text: none melts into the next, and the ids tell where each ends."""
        if self.pieces is word_pieces:  # ASCII, which no normalizer makes longer or shorter
            high = np.concatenate([[0], np.cumsum(buf > 127)])
            return high[begin] == high[end]
        last, before, third = (buf[np.maximum(end - k, 0)] for k in (1, 2, 3))
        space = (before == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))  # where wide spaces are, and much else
        return SPACE[buf[begin]] & ~SPACE[last] & ((last < 128) | ~space)

    def _encode(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces and how many each has: most pieces as one text, the others one by one."""
        joined = self._together(buf, begin, end)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        n, blob = int(joined.sum()), buf.tobytes()
        pieces = [blob[a:b] for a, b in zip(begin[order].tolist(), end[order].tolist())]
        ids, sizes = self._one_text(pieces[:n], (end - begin)[order[:n]])
        more = self._one_by_one(pieces[n:])
        ids, sizes = np.concatenate([ids, more[0]]), np.concatenate([sizes, more[1]])
        # Back into the order of the pieces.
        turn = np.argsort(order)
        starts = (np.cumsum(sizes) - sizes)[turn]
        sizes = sizes[turn]
        upto = np.cumsum(sizes)
        return ids[np.repeat(starts - upto + sizes, sizes) + np.arange(len(ids))], sizes

    def _one_text(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        between = b" " if self.pieces is word_pieces else b""
        whole = self.tokenizer.encode_batch_fast([between.join(pieces).decode()], add_special_tokens=False)[0].ids
        ids = np.array(whole, np.uint32)
        upto, ends = np.cumsum(self.bytes[ids]), np.cumsum(lengths)
        at = np.minimum(np.searchsorted(upto, ends), len(ids) - 1)
        if len(ends) and (len(ids) == 0 or at[-1] != len(ids) - 1 or (upto[at] != ends).any()):
            return self._one_by_one(pieces)  # an id that stands for less or more than its name
        return ids, np.diff(at, prepend=-1)

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the bounds of each text's ids."""
        words = Words(texts)
        begin, end, first = self.pieces(words, texts)
        which, distinct = pd.factorize(span_hashes(words.buf, begin, end))
        at = np.empty(len(distinct), np.int64)
        at[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # the first place of each
        number = self._find(distinct)
        new = np.flatnonzero(number < 0)
        ids, bounds = self.ids, self.at
        if len(new):
            more, sizes = self._encode(words.buf, begin[at[new]], end[at[new]])
            number[new] = np.arange(len(new)) + len(bounds) - 1
            ids, bounds = np.concatenate([ids, more]), np.concatenate([bounds, bounds[-1] + np.cumsum(sizes)])
            short = (end - begin)[at[new]] <= LONGEST
            self._remember(distinct[new][short], more[np.repeat(short, sizes)], sizes[short])
        # The end id follows the pieces of each text.
        number = np.append(number, len(bounds) - 1)
        ids, bounds = np.append(ids, np.uint32(self.end)), np.append(bounds, bounds[-1] + 1)
        turn = np.insert(which, first[1:], len(distinct))
        size = np.diff(bounds)[number]
        run = size[turn]
        upto = np.concatenate([[0], np.cumsum(run)])
        take = np.repeat(bounds[number][turn] - upto[:-1], run) + np.arange(upto[-1])
        return ids[take], upto[first + np.arange(len(first))]

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > KEPT:
            self._forget()
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.number = np.insert(self.hashes, place, hashes[order]), np.insert(self.number, place, order + len(self.at) - 1)
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])


@lru_cache(maxsize=4)
def encoder(path: str, end: int, words: bool) -> Encoder:
    """One for each worker process, whatever tasks it runs."""
    return Encoder(path, end, words)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
