"""Reading level of documents.

Words of the documents in one language are ranked by their frequency over all of them. A document's coverage rank is the
size of the smallest frequency-ranked vocabulary that covers a fixed share of its words; two shares are used. With the
complexity of its sentences (the median sentence's words and letters per word) they give a score whose weights are a
least-squares fit to the raters' bands, from one row of SQL sums, and whose band limits minimise disagreement with the
raters over a histogram of scores. Everything but the fit of five weights and three limits is SQL.

Whether a document is English is told by character trigrams: a naive Bayes classifier over hashed trigrams, fitted to all
documents, whose first labels come from function words and whose labels are then its own, until they stand still. Every
round reads all texts and leaves two counts for each bucket of trigrams, which are all that the driver sees.

Words travel as 64-bit hashes: two words of one hash would share a rank, which a vocabulary of a thousand million words
meets a few times. Ranks: a word's rank is one more than the number of words that are more frequent, found from the
histogram of counts, so that the vocabulary is never sorted in one task. The vocabulary is broadcast as two sorted arrays
(12 bytes a word) up to ``MAX_BROADCAST`` words (checked), and joined by shuffle beyond; both give the same ranks.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import statistics
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.session import keep

SHARES = (0.7, 0.9)
MAX_BROADCAST = 1_000_000
LEAST_WORDS = 60
FEATURES = ("log_rank_70", "log_rank_90", "log_sentence", "letters")
#: Buckets of the language classifier's trigrams; bytes of text, about, of which they are worked out at a time.
TRIGRAMS, PIECE = 1 << 16, 1 << 17
#: Function words by which the documents get their first labels.
ENGLISH = "the of and to in that is it for we this on with as be are not by have from which our will has they was at would what who an or".split()
OTHER = (
    "der die das und ist nicht wir zu den ein eine auf mit von für dem des im sich auch als wer sie ich "
    "le la les et est que de nous pour dans une un du sur pas ne ce qui au mais el los las en por con para una del il lo gli che non per una het een van niet det och att som"
).split()


#: Bracketed remarks and longer quotations: not the speaker's own.
_NOT_OWN, _MARK = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|[\"“„][^\"”“]{20,}[\"”“]"), re.compile(r"[(\[\"“„]")
_HYPHEN, _WORD = re.compile(r"[\-‐­][ \t]*\r?\n\s*"), re.compile(r"[^\W\d_]++(?:['’\-][^\W\d_]++)*+")
_SENTENCE = re.compile(r"[.!?][\"”’)\]]*\s+")
#: Apostrophes and hyphens that aren't between letters; tables of ASCII and of Windows-1252, in lower case, that blank all but these and letters.
_LOOSE = re.compile(r"['’\-](?:(?![^\W\d_])|(?<![^\W\d_]['’\-]))")
_BYTES = "".join(c if c in "'’-" or _WORD.fullmatch(c) else " " for c in (bytes([b]).decode("cp1252", "replace") for b in range(256))).encode("cp1252")
_ASCII = _BYTES[:128].decode("ascii")


def word_hash(word: str) -> int:
    """A 64-bit hash of a word, the same in every process."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Hashes(dict):
    """The :func:`word_hash` of words, kept until there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = found = word_hash(word)
        return found


_HASHES = _Hashes()


def _lower(text: str) -> str:
    """A text in lower case, hyphenation at line breaks undone."""
    return _HYPHEN.sub("", text.lower()) if "\n" in text else text.lower()


def _words(lower: str) -> list[str]:
    """What ``_WORD`` finds in a text in lower case; texts of single bytes are split without it, which is faster."""
    text = _LOOSE.sub(" ", lower) if "'" in lower or "-" in lower or "’" in lower else lower
    if text.isascii():
        return text.translate(_ASCII).split()
    try:
        return text.encode("cp1252").translate(_BYTES).decode("cp1252").split()
    except UnicodeEncodeError:
        return _WORD.findall(lower)


def words_of(text: str) -> list[str]:
    """Words in lower case, hyphenation at line breaks undone."""
    return _words(_lower(text))


def sentence_words(text: str) -> list[list[str]]:
    """The :func:`words_of` a text by sentence; no word spans the end of one."""
    return [_words(sentence) for sentence in _SENTENCE.split(_lower(text))]


def sentence_measures(sentences: list[list[str]]) -> tuple[float, float] | None:
    """Logarithm of the median number of words, and median letters a word, over sentences of three words or more; null without any."""
    long = [words for words in sentences if len(words) >= 3]
    return (math.log(statistics.median(map(len, long))), statistics.median(sum(map(len, words)) / len(words) for words in long)) if long else None


def is_english(words: Column) -> Column:
    """Whether a list of words has more English function words than those of other languages, and some."""
    start = F.struct(F.lit(0).alias("english"), F.lit(0).alias("other"), F.lit(0).alias("n"))

    def count(s: Column, w: Column) -> Column:
        return F.struct((s.english + F.when(w.isin(*ENGLISH), 1).otherwise(0)).alias("english"), (s.other + F.when(w.isin(*OTHER), 1).otherwise(0)).alias("other"), (s.n + 1).alias("n"))

    return F.aggregate(words, start, count, lambda s: (s.english > s.other) & (s.english * 20 >= s.n))


def first_labels(texts: list[str]) -> list[bool]:
    """:func:`is_english` of the words of texts."""
    english, other, out = frozenset(ENGLISH), frozenset(OTHER), []
    for words in map(words_of, texts):
        n = sum(map(english.__contains__, words))
        out.append(n * 20 >= len(words) and n > sum(map(other.__contains__, words)))
    return out


class Piece(NamedTuple):
    """Some texts, the buckets of their byte trigrams in lower case, one for each byte, and the bytes of each text.

    The last two bytes of a text begin no trigram and have the bucket ``TRIGRAMS``.
    """

    texts: list[str]
    buckets: np.ndarray
    lengths: np.ndarray


def pieces(texts: list[str]) -> Iterator[Piece]:
    """All texts, about ``PIECE`` bytes at a time, or one that is longer."""
    parts, size, done = [], 0, 0
    for i, text in enumerate(texts, 1):
        parts.append(f" {text.lower()} ".encode("utf-8", "surrogatepass"))
        size += len(parts[-1])
        if size >= PIECE or i == len(texts):
            lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int32)
            buckets = np.full(size, TRIGRAMS, dtype=np.int32)
            # The three bytes as a number modulo 65521, which 65536 exceeds by 15.
            buckets[:-2] = raw[:-2] * 15 + raw[1:-1] * 256 + raw[2:]
            buckets[:-2] -= 65521 * (buckets[:-2] >= 65521)
            ends = np.cumsum(lengths)
            buckets[ends - 1] = buckets[ends - 2] = TRIGRAMS
            yield Piece(texts[done:i], buckets, lengths)
            parts, size, done = [], 0, i


#: Tells of each text of a piece whether it is English.
Labels = Callable[[Piece], Sequence[bool]]


def trigram_counts(texts: list[str], labels: Labels) -> np.ndarray:
    """Occurrences of each bucket in English texts (first row) and in others."""
    total = np.zeros((2, TRIGRAMS + 1), dtype=np.int64)
    for piece in pieces(texts):
        row = np.where(labels(piece), 0, TRIGRAMS + 1).astype(np.int32)
        total += np.bincount(piece.buckets + np.repeat(row, piece.lengths), minlength=total.size).reshape(total.shape)
    return total[:, :TRIGRAMS]


def _given(labels: Sequence[bool]) -> Labels:
    """Labels at hand, of texts that are told once and in order."""
    rest = iter(labels)
    return lambda piece: list(itertools.islice(rest, len(piece.texts)))


class Language:
    """Log-odds of English for each trigram bucket."""

    def __init__(self, counts: np.ndarray):
        """From :func:`trigram_counts`. The lists of function words are two texts more, so that both classes are known."""
        counts = counts + trigram_counts([" ".join(ENGLISH), " ".join(OTHER)], _given([True, False]))
        chance = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * TRIGRAMS))
        self.odds = np.append(chance[0] - chance[1], 0.0).astype(np.float32)

    @classmethod
    def settle(cls, count: Callable[[Labels], np.ndarray], labels: Labels) -> Language:
        """Fitted to its own labels, from first ones, until they stand still; ``count``: the :func:`trigram_counts` of all texts under labels.

        Apart from rounding, every round makes the labelled texts likelier, so the rounds end; counts that come again end them in any case.
        """
        model, seen = None, set()
        while True:
            counts = count(labels)
            mark = hashlib.blake2b(counts.tobytes()).digest()
            if mark in seen:
                return model
            seen.add(mark)
            model = cls(counts)
            labels = model.labels

    @classmethod
    def fit(cls, texts: list[str], english: list[bool]) -> Language:
        """From texts at hand with first labels."""
        return cls.settle(lambda labels: trigram_counts(texts, labels), _given(english))

    def labels(self, piece: Piece) -> np.ndarray:
        """Whether each text of a piece is rather English; no text isn't."""
        return np.add.reduceat(self.odds[piece.buckets], np.cumsum(piece.lengths) - piece.lengths, dtype=np.float64) > 0

    def tell(self, texts: list[str]) -> list[bool]:
        """Whether each text is rather English; no text isn't."""
        return [bool(e) for piece in pieces(texts) for e in self.labels(piece)]

    def english(self, text: str) -> bool:
        """Whether the text is rather English; no text isn't."""
        return self.tell([text])[0]


def learn_language(documents: DataFrame) -> Language:
    """Classifier fitted to all documents (text). An empty table leaves the function words."""

    def count(labels: Labels) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, TRIGRAMS), dtype=np.int64)
            for batch in batches:
                total += trigram_counts(batch["text"].tolist(), labels)
            found = np.flatnonzero(total.any(axis=0))
            yield pd.DataFrame({"bucket": found, "english": total[0][found], "other": total[1][found]})

        rows = documents.select("text").mapInPandas(part, "bucket int, english long, other long").groupBy("bucket").agg(F.sum("english").alias("english"), F.sum("other").alias("other")).toPandas()
        counts = np.zeros((2, TRIGRAMS), dtype=np.int64)
        counts[:, rows["bucket"].to_numpy(dtype=np.int64)] = rows[["english", "other"]].to_numpy(dtype=np.int64).T
        return counts

    return Language.settle(count, lambda piece: first_labels(piece.texts))


def sentences(text: Column) -> Column:
    """Word lists of the sentences of a text, in lower case, hyphenation at line breaks undone."""
    joined = F.regexp_replace(F.lower(text), r"[\-‐­][ \t]*\r?\n\s*", "")
    return F.transform(F.split(joined, r"(?<=[.!?])[\"”’)\]]*\s+"), lambda s: F.regexp_extract_all(s, F.lit(r"\p{L}+(?:['’\-]\p{L}+)*"), 0))


def word_ranks(words: DataFrame) -> DataFrame:
    """Frequency rank of every word: word, rank. ``words``: word, n (occurrences; a word may have many rows)."""
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    # Distinct counts are few (their sum is bounded by the number of words), so this window is small.
    histogram = counts.groupBy("n").agg(F.count("*").alias("k"))
    ranks = histogram.select("n", (F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("rank"))
    return counts.join(ranks, "n").select("word", "rank")


def coverage(documents: DataFrame, ranks: DataFrame, shares: tuple[float, float]) -> DataFrame:
    """Coverage ranks of documents (doc, words, ...), joined word by word; documents come out once, with the two logarithms alone."""
    counted = documents.select("doc", F.explode("words").alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))
    ranked = counted.join(ranks, "word").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("r"), F.sum("n").alias("total"))

    def covering(share: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("rank"))
        walk = F.aggregate("r", start, lambda s, x: F.when(s.seen >= F.col("total") * share, s).otherwise(F.struct((s.seen + x.n).alias("seen"), x["rank"].cast("long").alias("rank"))))
        return F.log(walk["rank"].cast("double"))

    return ranked.select("doc", covering(shares[0]).alias(FEATURES[0]), covering(shares[1]).alias(FEATURES[1]))


def coverage_by_table(documents: DataFrame, ranks: DataFrame, shares: tuple[float, float]) -> DataFrame:
    """:func:`coverage` without a shuffle, for a vocabulary of bounded size: every row of ``documents`` with the two logarithms.

    Words that are strings are hashed; those of :func:`features` are hashes already.
    """
    if dict(documents.dtypes)["words"] == "array<string>":
        documents = documents.withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))
        ranks = ranks.select(F.xxhash64("word").alias("word"), "rank")
    rows = ranks.toPandas().sort_values("word")
    table = documents.sparkSession.sparkContext.broadcast((rows["word"].to_numpy(dtype=np.int64), rows["rank"].to_numpy(dtype=np.int32)))

    @F.pandas_udf("a double, b double")
    def covering(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, rank = table.value
        for batch in batches:
            sizes = np.array([len(words) for words in batch])
            out = np.full((len(batch), 2), np.nan)
            if sizes.sum():
                ranked = rank[np.searchsorted(known, np.concatenate([np.asarray(words, dtype=np.int64) for words in batch]))]
                ends = np.cumsum(sizes)
                for i, (size, end) in enumerate(zip(sizes, ends)):
                    if size:
                        r = np.sort(ranked[end - size : end])
                        out[i] = [np.log(r[max(0, int(np.ceil(s * size)) - 1)]) for s in shares]
            yield pd.DataFrame(out, columns=["a", "b"])

    return documents.withColumn("c", covering("words")).withColumns({FEATURES[0]: F.col("c.a"), FEATURES[1]: F.col("c.b")}).drop("c", "words")


def features(documents: DataFrame, shares: tuple[float, float] = SHARES) -> DataFrame:
    """Features of the English documents of at least ``LEAST_WORDS`` words (runs of non-space): doc and ``FEATURES``.

    ``documents``: doc, text; documents without text have none. A document that comes twice counts twice in the word
    frequencies and comes out once. Language and sentences are the speaker's own, or the whole text's where no sentence
    of their own is left; vocabulary and coverage are of the whole text. Texts are read once for each round of the language
    classifier and once for all else, which keeps word hashes and sentence measures.
    """
    spoken = documents.where(F.col("text").isNotNull() & F.col("doc").isNotNull()).select("doc", "text")
    language = learn_language(spoken)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            # Bytes are split at the white space of ASCII alone.
            long = [(doc, text) for doc, text in zip(batch["doc"], batch["text"]) if len(text) >= 2 * LEAST_WORDS - 1 and len(text.encode("utf-8", "surrogatepass").split(None, LEAST_WORDS - 1)) == LEAST_WORDS]
            owned = [_NOT_OWN.sub(" ", text) if _MARK.search(text) else text for _, text in long]
            told = language.tell([own if own.strip() else text for (_, text), own in zip(long, owned)])
            for (doc, text), own, english in zip(long, owned, told):
                if not english:
                    continue
                parts = sentence_words(own)
                words = list(itertools.chain.from_iterable(parts)) if own is text else words_of(text)
                measures = sentence_measures(parts) or (math.log(len(words)), sum(map(len, words)) / len(words)) if words else None
                if measures:
                    rows.append((doc, np.fromiter(map(_HASHES.__getitem__, words), dtype=np.int64, count=len(words)), *measures))
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "words", *FEATURES[2:]])

    measured = spoken.mapInPandas(measure, f"doc long, words array<long>, {FEATURES[2]} double, {FEATURES[3]} double")
    measured = keep(measured)
    ranks = keep(word_ranks(measured.select(F.explode("words").alias("word"), F.lit(1).alias("n"))))
    if ranks.count() <= MAX_BROADCAST:
        found = coverage_by_table(measured, ranks, shares)
    else:
        found = measured.drop("words").join(coverage(measured, ranks, shares), "doc")
    return keep(found.groupBy("doc").agg(*[F.min(f).alias(f) for f in FEATURES]))


def ratings(labels: DataFrame) -> DataFrame:
    """Mean band of every rated document: doc, band. Repeated ratings count once, null bands not at all."""
    return labels.where("band IS NOT NULL AND doc IS NOT NULL").select("doc", "rater", "band").distinct().groupBy("doc").agg(F.avg("band").alias("band"))


def calibrate(featured: DataFrame, rated: DataFrame, bands: int = 4) -> tuple[np.ndarray, list[float]] | None:
    """Weights (the last one constant) and band limits; null where no rated document has features."""
    joined = featured.join(rated, "doc").withColumn("one", F.lit(1.0))
    names = [*FEATURES, "one"]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("band")).alias(f"{a}__y") for a in names]
    row = joined.agg(*sums).first()
    if row["one__one"] is None:
        return None
    n = len(names)
    gram, moment = np.zeros((n, n)), np.zeros(n)
    for i, a in enumerate(names):
        moment[i] = row[f"{a}__y"]
        for j in range(i, n):
            gram[i, j] = gram[j, i] = row[f"{a}__{names[j]}"]
    weights = np.linalg.solve(gram + 1e-6 * np.eye(n) * max(1.0, row["one__one"]), moment)
    binned = joined.groupBy(F.floor(score(weights) * 50).alias("bin"), F.round("band").cast("int").alias("band")).count().collect()
    limits = []
    for k in range(1, bands):
        # The limit between bands k and k + 1, among all bin edges near their middle; ties go to the middle.
        edges = [e / 50 for e in range(50 * k, 50 * (k + 1) + 1)]
        wrong = {e: sum(r["count"] for r in binned if ((r.bin / 50 >= e) != (r.band > k))) for e in edges}
        limits.append(min(edges, key=lambda e: (wrong[e], abs(e - k - 0.5))))
    return weights, limits


def score(weights: np.ndarray) -> Column:
    """The linear score of a document."""
    total = F.lit(float(weights[-1]))
    for name, w in zip(FEATURES, weights):
        total = total + F.col(name) * F.lit(float(w))
    return total


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Reading band of every English document of at least ``LEAST_WORDS`` words: doc, band, score. Empty without ratings."""
    featured = features(documents)
    fit = calibrate(featured, ratings(labels))
    if fit is None:
        return featured.limit(0).select("doc", F.lit(None).cast("int").alias("band"), F.lit(None).cast("double").alias("score"))
    weights, limits = fit
    band = F.lit(1)
    for limit in limits:
        band = band + F.when(F.floor(F.col("score") * 50) / 50 >= limit, 1).otherwise(0)
    return featured.select("doc", score(weights).alias("score")).select("doc", band.cast("int").alias("band"), "score")
