"""Evaluation texts leaking into training text.

Wu-Manber multi-pattern search over words: the patterns are all windows of ``WINDOW`` words of the items, the alphabet
is the vocabulary, the block is a pair of words. A shift table over hashes of blocks tells how far the scan may jump when
a pair occurs at no or only at an early place of any pattern (it is read for all blocks of a document at once); a pair
that may end a pattern leads, with the pair that would begin it, to the bucket of patterns of these hashes, which are
compared word by word. Every pattern found is a place (item word, document word) from which item and
document are compared word by word in both directions, bridging altered words and insertions at a cost.

Items are broadcast in blocks of at most ``block_bytes`` of text, with some 20 bytes of arrays for each of their words
(34 MB measured for 8 MB of text, so some 140 MB in a worker for the 32 MB of a block), so their number is not bounded by memory; documents
are read once per block, whole, without a shuffle. One row per document and item, so nothing is ever paired.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4
#: Words of an item that make a case, and what the comparison charges: per altered word, per insertion, per inserted word.
LEAST_WORDS, ALTERED, INSERTION, INSERTED = 20, 1.5, 1.5, 0.15
#: An insertion may be so long; the comparison ends when the score is so far below its best.
LONGEST_INSERTION, DROP = 14, 6.0
#: Score that a case needs: sentences of one mould with other words in it match in scattered places only.
LEAST_SCORE = 12.5

_BREAK = re.compile(r"[\-‐­][ \t]*\r?\n\s*")
#: Characters in simple brackets that count as a remark in every reading, and with the brackets.
_REMARK, SHORT_REMARK = re.compile(r"\([^()]{0,160}\)|\[[^\[\]]{0,160}\]"), 162
_BRACKET = re.compile(r"[()\[\]]")
_APOSTROPHE = re.compile(r"['’`ʼ­​]")
_WORDS = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    """Words apart from case, punctuation, line breaks, hyphenation at them, and short bracketed remarks."""
    text = _REMARK.sub(" ", _BREAK.sub("", text))
    return _WORDS.findall(_APOSTROPHE.sub("", text.lower()))


def remarks(text: str) -> list[list[tuple[int, int]]]:
    """Places of balanced brackets by depth, the outermost first; brackets without a partner are passed over."""
    stack: list[tuple[str, int]] = []
    pairs = []
    for m in _BRACKET.finditer(text):
        c = m.group()
        if c in "([":
            stack.append((c, m.start()))
            continue
        opening = "(" if c == ")" else "["
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == opening), None)
        if at is not None:
            pairs.append((stack[at][1], m.end()))
            del stack[at:]
    levels: list[list[tuple[int, int]]] = []
    ends: list[int] = []
    for start, end in sorted(pairs):
        while ends and ends[-1] <= start:
            ends.pop()
        if len(ends) == len(levels):
            levels.append([])
        levels[len(ends)].append((start, end))
        ends.append(end)
    return levels


def readings(text: str) -> Iterator[list[str]]:
    """The words of a text without short remarks and, for each depth that holds a long or nested one, without those of the depth.

    A bracket may hold a remark or a passage, so no reading replaces another.
    """
    yield normal_words(text)
    levels = remarks(text)
    for depth, level in enumerate(levels):
        inner = levels[depth + 1] if depth + 1 < len(levels) else []
        if not inner and all(end - start <= SHORT_REMARK for start, end in level):
            continue
        kept, at = [], 0
        for start, end in level:
            kept.append(text[at:start])
            at = end
        yield normal_words(" ".join([*kept, text[at:]]))


#: Entries of the shift table, one byte each (a power of two); documents that are scanned together.
SHIFTS, TOGETHER = 1 << 20, 128


@functools.lru_cache(1 << 16)
def _code(word: str) -> int:
    """A 32-bit code of a word, the same in every process. Codes only select; words are compared themselves."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_code, words), dtype=np.uint64, count=len(words))


def _blocks(codes: np.ndarray) -> np.ndarray:
    """Hash of every pair of neighbouring words."""
    mixed = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def _keys(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of windows from the hashes of their last and their first pair of words."""
    return last * np.uint64(0x9E3779B97F4A7C15) + first


class WuManber:
    """Shift table, suffix buckets and items of one block of items, as arrays: some 20 bytes for a word of an item.

    The shift table has an entry of one byte for each hash of a pair of words: how far the end of a window may move when
    the pair stands there. The buckets are one array of windows, sorted by the hashes of their last and first pairs.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts = [i for i, t in items if t], [t for _, t in items if t]
        self.shift = np.full(SHIFTS, WINDOW - 1, dtype=np.uint8)
        suffixes, owners, places = [], [], []
        for k, text in enumerate(self.texts):
            blocks = _blocks(_codes(normal_words(text)))
            windows = len(blocks) - WINDOW + 2
            if windows < 1:
                continue
            for q in range(WINDOW - 1):
                np.minimum.at(self.shift, (blocks[q : q + windows] % np.uint64(SHIFTS)).astype(np.int64), WINDOW - 2 - q)
            suffixes.append(_keys(blocks[WINDOW - 2 :], blocks[:windows]))
            owners.append(np.full(windows, k, dtype=np.int32))
            places.append(np.arange(windows, dtype=np.int32))
        suffix = np.concatenate(suffixes) if suffixes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[order]
        self.owner = np.concatenate(owners)[order] if owners else np.zeros(0, dtype=np.int32)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, dtype=np.int32)
        self._at = {item: k for k, item in enumerate(self.ids)}
        self._words: dict[int, list[str]] = {}

    def words_of(self, item: int) -> list[str]:
        """Words of an item, made when it is first asked for."""
        if item not in self._words:
            if len(self._words) >= 4096:
                self._words.clear()
            self._words[item] = normal_words(self.texts[self._at[item]])
        return self._words[item]

    @property
    def items(self) -> dict[int, list[str]]:
        return {item: self.words_of(item) for item in self.ids}

    def seeds(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """All (text, item, item word, document word) at which a window of an item occurs, over several texts at once."""
        words = list(itertools.chain.from_iterable(texts))
        if len(words) < WINDOW or not len(self.suffix):
            return
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        blocks = _blocks(_codes(words))
        # Ends of windows that no shift passes over; the pair of blocks[e] ends with word e + 1.
        ends = np.flatnonzero(self.shift[(blocks & np.uint64(SHIFTS - 1)).view(np.int64)] == 0)
        ends = ends[ends >= WINDOW - 2]
        wanted = _keys(blocks[ends], blocks[ends - WINDOW + 2])
        first, last = np.searchsorted(self.suffix, wanted, "left"), np.searchsorted(self.suffix, wanted, "right")
        hit = last > first
        ends, first, last = ends[hit], first[hit], last[hit]
        text = np.searchsorted(starts, ends - WINDOW + 2, "right") - 1
        whole = text == np.searchsorted(starts, ends + 1, "right") - 1
        for t, e, lo, hi in zip(text[whole].tolist(), ends[whole].tolist(), first[whole].tolist(), last[whole].tolist()):
            window, place = words[e - WINDOW + 2 : e + 2], e - WINDOW + 2 - int(starts[t])
            for owner, at in zip(self.owner[lo:hi].tolist(), self.place[lo:hi].tolist()):
                if self.words_of(self.ids[owner])[at : at + WINDOW] == window:
                    yield t, self.ids[owner], at, place

    def occurrences(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """All (item, item word, document word) at which a window of an item occurs."""
        return (found[1:] for found in self.seeds([words]))

    def cases(self, text: str) -> list[tuple[int, int]]:
        """The items that the text holds, with the number of their words found."""
        return self.cases_of([text])[0]

    def cases_of(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The items that each text holds, with the number of their words found in its best reading."""
        read = [(k, words) for k, text in enumerate(texts) for words in readings(text)]
        places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, item, at, place in self.seeds([words for _, words in read]):
            places.setdefault((r, item), []).append((at, place))
        most: list[dict[int, int]] = [{} for _ in texts]
        for (r, item), seeds in places.items():
            k, words = read[r]
            if len(words) >= LEAST_WORDS - 4 and (best := self._best(item, words, seeds)) >= LEAST_WORDS:
                most[k][item] = max(best, most[k].get(item, 0))
        return [list(m.items()) for m in most]

    def _best(self, item: int, words: list[str], seeds: list[tuple[int, int]]) -> int:
        """The most item words in one passage around any of the seeds; 0 where no passage scores enough."""
        best, done = 0, set()
        for at, place in seeds:
            # A seed that an earlier comparison passed through tells nothing new.
            if (at, place) in done:
                continue
            count, score, passed = compare(self.words_of(item), words, at, place)
            done |= passed
            if score >= LEAST_SCORE and count > best:
                best = count
        return best


def compare(item: list[str], words: list[str], at: int, place: int) -> tuple[int, float, set[tuple[int, int]]]:
    """Item words found in one passage around a seed (altered ones included), the score, and the places passed."""
    passed: set[tuple[int, int]] = set()
    right = _extend(item, words, at, place, 1, passed)
    left = _extend(item, words, at - 1, place - 1, -1, passed)
    return right[0] + left[0], right[1] + left[1], passed


def _extend(item: list[str], words: list[str], i: int, j: int, step: int, passed: set[tuple[int, int]]) -> tuple[int, float]:
    score = best = 0.0
    covered = best_covered = 0
    n, m = len(item), len(words)
    while 0 <= i < n and 0 <= j < m:
        if item[i] == words[j]:
            score += 1
            covered += 1
            passed.add((i, j))
            if score >= best:
                best, best_covered = score, covered
            i, j = i + step, j + step
            continue
        # The cheapest way to go on: altered or left out words of the item, added words of the document.
        option = None
        for di in range(4):
            for dj in range(LONGEST_INSERTION + 1):
                if di == dj == 0:
                    continue
                a, b = i + step * di, j + step * dj
                if not (0 <= a < n and 0 <= b < m) or item[a] != words[b]:
                    continue
                # One agreeing word among many is chance; after more than one altered or added word the next must agree as well.
                if di + dj > 2 and not (0 <= a + step < n and 0 <= b + step < m and item[a + step] == words[b + step]):
                    continue
                altered, added = min(di, dj), dj - min(di, dj)
                left_out = di - min(di, dj)
                cost = ALTERED * (altered + left_out) + (INSERTION + INSERTED * (added - 1) if added else 0)
                if option is None or cost < option[0]:
                    option = (cost, di, dj, altered)
        if option is None or best - (score - option[0]) > DROP:
            break
        score -= option[0]
        covered += option[3]
        i, j = i + step * option[1], j + step * option[2]
    return best_covered, best


def leaks(documents: DataFrame, items: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """The items that each document contains: doc, item, words.

    ``documents``: doc, text; ``items``: item, text. Null and empty texts hold nothing; rows repeated under one item
    count once, documents come out once per row. Without items the result is empty.
    """
    items = items.where("item IS NOT NULL AND text IS NOT NULL").groupBy("item").agg(F.min("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    result = None
    for b in range(blocks):
        block = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
        matcher = documents.sparkSession.sparkContext.broadcast(WuManber(block))

        def search(batches: Iterator[pd.DataFrame], matcher=matcher) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for k in range(0, len(batch), TOGETHER):
                    docs, texts = batch["doc"].iloc[k : k + TOGETHER], batch["text"].iloc[k : k + TOGETHER]
                    rows += [(doc, item, n) for doc, found in zip(docs, matcher.value.cases_of(list(texts))) for item, n in found]
                yield pd.DataFrame(rows, columns=["doc", "item", "words"])

        part = documents.where("text IS NOT NULL").select("doc", "text").mapInPandas(search, "doc long, item long, words int")
        result = part if result is None else result.unionByName(part)
    return result
