"""Repair of text that was decoded with the wrong character encoding.

A multinomial naive Bayes classifier over hashed byte bigrams is trained on synthetically garbled words: clean words of
the corpus (a bounded sample) and words made from the letters of several alphabets, each passed through every chain of
wrong decodings, and through two ways of losing characters. For each word with characters beyond ASCII the classifier
ranks the chains; the most probable chain whose inversion is strictly decodable restores the word. A field in which a
word lost characters for good is affected, but can't be restored.

Training runs on the driver over at most ``sample_words`` words; the model (classes x buckets of 32-bit floats, some
250 KB) is shipped with the function. Inference is Arrow-batched and sees only fields that have characters beyond ASCII.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
SINGLE = ("latin-1", "cp1252", "cp1251", "mac_roman", "cp437")
#: Chains of wrong decodings, in the order in which they happened.
CHAINS = tuple((e,) for e in SINGLE) + tuple((a, b) for a in ("latin-1", "cp1252") for b in ("latin-1", "cp1252")) + (("cp1251", "cp1251"), ("mac_roman", "mac_roman"), ("cp437", "cp437"))
CLEAN, DROPPED = "clean", "dropped"
CLASSES = (CLEAN, DROPPED, *map(">".join, CHAINS))
#: Code point ranges of the letters and signs from which training words are made.
ALPHABETS = ((0x00A1, 0x00FF), (0x0100, 0x017F), (0x0391, 0x03CE), (0x0410, 0x0451), (0x2013, 0x2026), (0x20AC, 0x20AC), (0x1F300, 0x1F64F))
LOST = "�"
#: Log-odds that one strictly decodable sequence adds to a chain.
STRICT_BONUS = 4.0
#: Log-odds over a clean word that a leftover needs: as (of its class, of its completed word); either pair will do. The last
#: pair holds in fields in which another word is garbled.
LOST_MARGINS, LOST_MARGIN_BESIDE = ((0.0, 3.0), (11.0, -1.5)), (8.0, -4.0)
_SPACE = re.compile(r"([ \t\n\r\f\v]+)")
_BEYOND = re.compile(r"[^\x00-\x7f]")


def _decoding(encoding: str) -> list[str]:
    """Character of each byte; bytes the encoding leaves undefined stand for the control character of their number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_TO_CHAR = {e: _decoding(e) for e in SINGLE}
_TO_BYTE = {e: {c: b for b, c in reversed(list(enumerate(t)))} for e, t in _TO_CHAR.items()}


def garble(text: str, chain: tuple[str, ...]) -> str:
    """Text as it looks after its UTF-8 bytes were decoded wrongly, once for each encoding of the chain."""
    for e in chain:
        table = _TO_CHAR[e]
        text = "".join(table[b] for b in text.encode("utf-8", "surrogatepass"))
    return text


def ungarble(text: str, chain: tuple[str, ...]) -> str | None:
    """The inverse of :func:`garble`; null unless every step is strictly decodable."""
    for e in reversed(chain):
        table = _TO_BYTE[e]
        try:
            text = bytes(table[c] for c in text).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def plausible(text: str) -> bool:
    """Whether a word can be one that was written: no control characters, and its letters of one script."""
    scripts = {unicodedata.name(c, "?").split(" ", 1)[0] for c in text if unicodedata.category(c)[0] == "L"} - {"MODIFIER", "FEMININE", "MASCULINE", "MICRO"}
    return len(scripts) < 2 and not any(unicodedata.category(c) == "Cc" for c in text)


def drop_controls(text: str) -> str:
    """Garbled text whose control characters were dropped on the way."""
    return re.sub(r"[\x80-\x9f]", "", garble(text, ("latin-1",)))


def bigrams(text: str) -> np.ndarray:
    """Buckets of the byte bigrams of a word with marked ends."""
    raw = np.frombuffer(b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03", dtype=np.uint8).astype(np.int64)
    return (raw[:-1] * 2654435761 + raw[1:] * 40503) % 65521 % BUCKETS


def made_words() -> list[str]:
    """Words with one or two letters of each alphabet, at the start, in the middle, at the end, and alone."""
    words = []
    for low, high in ALPHABETS:
        step = 1 if high - low < 512 else 23
        letters = [chr(c) for c in range(low, high + 1, step) if chr(c).isprintable()]
        for i, c in enumerate(letters):
            other = letters[(i * 7 + 3) % len(letters)]
            words += [c, f"a{c}e", f"{c}on", f"st{c}", f"ne{c}{other}t", f"{c}{other}", f"M{c.upper()}R{other.upper()}"]
    return words


class EncodingModel:
    """Log-likelihood of each bigram bucket under each class."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    @classmethod
    def train(cls, clean_words: list[str], smoothing: float = 0.05) -> EncodingModel:
        """Counts the bigrams of the words as they are and garbled by every chain. Words the corpus has weigh more than made ones."""
        counts = np.full((len(CLASSES), BUCKETS), smoothing)
        for words, weight in ((clean_words, 3.0), (made_words(), 1.0)):
            for word in {d for w in words if (d := drop_controls(w)) != garble(w, ("latin-1",)) and d != w}:
                np.add.at(counts[1], bigrams(word), weight)
            for word in words:
                np.add.at(counts[0], bigrams(word), weight)
                for k, chain in enumerate(CHAINS, 2):
                    np.add.at(counts[k], bigrams(garble(word, chain)), weight)
        return cls(np.log(counts / counts.sum(axis=1, keepdims=True)))

    def scores(self, word: str) -> np.ndarray:
        return self.weights[:, bigrams(word)].sum(axis=1)

    def restore_word(self, word: str, beside: bool = False) -> tuple[str | None, str]:
        """The restored word and its class; null where characters are lost. ``beside``: other words of the field are garbled."""
        if LOST in word:
            return None, DROPPED
        scores = self.scores(word)
        sequences = len(re.findall(r"[^\x00-\x7f]{2,}", word)) or 1
        best = None
        for k, chain in enumerate(CHAINS, 2):
            restored = ungarble(word, chain)
            if restored is not None and restored != word and (best is None or scores[k] > best[0]):
                best = (scores[k], restored, CLASSES[k])
        if best and best[0] + STRICT_BONUS * sequences > scores[0]:
            return (None if LOST in best[1] else best[1]), best[2]
        if best is None and scores[1] > scores[0]:
            completed = self.completed(word) - scores[0]
            if any(scores[1] - scores[0] > a and completed > b for a, b in (*LOST_MARGINS, LOST_MARGIN_BESIDE)[: 3 if beside else 2]):
                return None, DROPPED
        return word, CLEAN

    def completed(self, word: str) -> float:
        """Clean score of the best word that the word can be a leftover of; minus infinity if there is none.

        Every lead character gets the control characters that it lacks, each choice the one that reads best; the word
        must then be strictly decodable, differ from what it was, and be a word of one script without control characters.
        """
        done, i = "", 0
        while i < len(word):
            lead = ord(word[i])
            need = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
            tail = re.match(r"[\xa0-\xbf]*", word[i + 1 :]).group()[:need] if need else ""
            missing = need - len(tail)
            if missing:
                controls = [chr(c) for c in range(0x80, 0xA0)]
                if missing == 1 and need < 3:
                    options = [word[i] + c + tail for c in controls] + ([word[i] + tail + c for c in controls] if tail else [])
                elif missing == 2 and need == 2:
                    options = [word[i] + "\x80" + c for c in controls]
                else:
                    options = [word[i] + "\x9f" + ("\x8e\x89" + tail)[-2:]]
                rest = re.match(r"[\x00-\x7f]{0,1}", word[i + 1 + len(tail) :]).group()
                # Two bytes stand for a letter; other signs of two bytes keep theirs, as none is a control character.
                letter = lambda r: need != 1 or unicodedata.category(r[len(r) - len(rest) - 1])[0] == "L"  # noqa: B023, E731
                read = [(self.scores(r)[0], o) for o in options if (r := ungarble(done + o + rest, ("latin-1",))) is not None and plausible(r) and letter(r)]
                if not read:
                    return -np.inf
                done += max(read)[1]
            else:
                done += word[i] + tail
            i += 1 + len(tail)
        original = ungarble(done, ("latin-1",))
        if original is None or original == word or not plausible(original):
            return -np.inf
        # Each gap was filled with the best of 32 choices.
        return float(self.scores(original)[0]) - 3.5 * (len(done) - len(word) > 0)

    def restore(self, text: str) -> tuple[bool, str | None, str]:
        """Whether the text is affected, the restored text (null where characters are lost), and the chains found."""
        parts, chains, lost = [], [], False
        for part in _SPACE.split(text):
            if _BEYOND.search(part):
                word, kind = self.restore_word(part)
                if kind == CLEAN and " " in part:
                    # A no-break space may be a space of the text or the end of a garbled letter.
                    pieces = re.split(r"((?<![ÂÃГ]) +)", part)
                    fixed = [self.restore_word(p) if _BEYOND.search(p) and p.strip(" ") else (p, CLEAN) for p in pieces]
                    if any(k != CLEAN for _, k in fixed):
                        word = None if any(w is None for w, _ in fixed) else "".join(w for w, _ in fixed)
                        kind = next(k for _, k in fixed if k != CLEAN)
                if kind != CLEAN:
                    chains.append(kind)
                    lost |= word is None
                parts.append(word or part)
            else:
                parts.append(part)
        if not chains:
            return False, text, CLEAN
        lost = lost or any(self.restore_word(p, True)[1] == DROPPED for p in _SPACE.split(text) if _BEYOND.search(p))
        return True, None if lost else "".join(parts), ",".join(sorted(set(chains)))


def beyond_ascii(text: Column) -> Column:
    """Whether the text needs looking at."""
    return text.rlike(r"[^\x00-\x7F]")


def train_on(fields: DataFrame, text: str = "text", sample_words: int = 4000) -> EncodingModel:
    """Model trained on a sample of the column's clean words: the ``sample_words`` of smallest hash.

    Words count as clean where no chain inverts them and no character is lost. An empty column leaves the made words.
    """
    words = fields.select(F.explode(F.split(F.col(text), r"[ \t\n\r]+")).alias("word")).where(beyond_ascii(F.col("word")) & (F.length("word") <= 40)).distinct()
    sample = [r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(sample_words).collect()]
    clean = [w for w in sample if LOST not in w and not any((r := ungarble(w, c)) is not None and r != w for c in CHAINS)]
    # A word that another word of the sample leaves when it loses controls doesn't teach what clean words look like.
    leftovers = {d for w in clean if (d := drop_controls(w)) != w}
    return EncodingModel.train([w for w in clean if w not in leftovers])


def restore_fields(fields: DataFrame, model: EncodingModel) -> DataFrame:
    """The affected rows of ``fields`` (record, field, text) with: restored (null where lost), chain.

    Rows without characters beyond ASCII, null texts included, are not affected. Rows repeated under one record and
    field come out once.
    """

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = functools.lru_cache(5_000)(model.restore)  # texts repeat; long ones aren't kept
        for batch in batches:
            done = [(r, f, t, *(again if len(t) <= 2_000 else model.restore)(t)) for r, f, t in zip(batch["record"], batch["field"], batch["text"])]
            rows = [(r, f, t, restored, chain) for r, f, t, affected, restored, chain in done if affected]
            if rows:
                yield pd.DataFrame(rows, columns=["record", "field", "text", "restored", "chain"])

    # Restored where the rows are read, once each; only affected rows are shuffled.
    found = fields.where(beyond_ascii(F.col("text"))).select("record", "field", "text").mapInPandas(restore, "record long, field string, text string, restored string, chain string")
    return found.distinct()
