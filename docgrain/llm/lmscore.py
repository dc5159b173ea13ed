"""Language-model scores by masked pseudo-likelihood: every token is predicted from the words on both sides.

The words of all documents are counted; the most frequent, whose number grows with the corpus, are the vocabulary,
the rest share buckets by their endings. A small network, trained in numpy, reads a window on both sides of a masked
position and gives a distribution over word classes and, within the class, over words. A word of a bucket has its share
of the bucket's count as its probability there; words that the corpus does not have share what its once-seen words
count, each by its spelling, so that all words there are have a sum of one at most. A document's score is the sum of the logarithms of its tokens'
probabilities.

Every window of the corpus trains the network, none twice after the start. The texts are dealt to shards and the shards
to rounds; a round trains the network on each of its shards from the same start, and the results are averaged.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.llm.shared import forget, materialise

CLASSES = 32
PER_CLASS = 32
SIZE = CLASSES * PER_CLASS
#: Tokens that stand for all other words, by their endings.
BUCKETS = 96
#: Words read on each side.
SIDE = 2
WIDTH = 24
#: Windows that give the start, about, and of a shard at least.
WINDOWS = 300_000
#: Share of all windows that trains the network: every one.
SHARE = 1.0
#: Windows of a shard for every token number where that is more than WINDOWS: shards and the parameters that they send
#: then both grow with the square root of the corpus.
PER_TOKEN = 100
#: Rounds that the shards are dealt to after the start.
ROUNDS = 2
#: Words with at least this times the square root of the number of tokens are predicted by themselves.
OWN = 0.2
#: Words with a known count that every task holds; counts of rarer words are joined.
COMMON = 200_000
#: Rows that are scored at once; their scores fit a cache.
CACHED = 1 << 13
#: Tokens scored at once.
AT_ONCE = 1 << 16
#: Occurrences of a token in a batch whose gradients are added side by side; those of more frequent ones go token by token.
LEVELS = 32
#: Steps between two looks at how large the scores may get.
LOOK = 8
#: Parameters that are averaged in one group.
SLICE = 1 << 13
#: Words that a task counts before it hands its counts on; bounds its memory.
HELD_WORDS = 200_000

_TO_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else 32 for b in range(256))
OFFSETS = tuple(k for k in range(-SIDE, SIDE + 1) if k)
PAD = SIZE


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; digits are alike, punctuation separates."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def bucket(word: bytes) -> int:
    """Number of the token that stands for a word of no own."""
    return SIZE - BUCKETS + zlib.crc32(word[-3:]) % BUCKETS


def _number(i: int) -> int:
    """Token number of the i-th word: those of the buckets and of PAD are left out."""
    return i if i < SIZE - BUCKETS else i + BUCKETS + 1


class Numbers:
    """Token numbers of the network, kept as bytes."""

    def __init__(self, tokens: int):
        self.dtype = np.dtype("<u2" if tokens <= 1 << 16 else "<i4")

    def packed(self, tokens: np.ndarray) -> bytes:
        return tokens.astype(self.dtype).tobytes()

    def tokens(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)


class Vocabulary(dict):
    """Token numbers of words; unknown words get their bucket's, and a bounded number of them is remembered."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, _number(i)) for i, w in enumerate(words))
        self.limit = len(self) + HELD_WORDS

    def __missing__(self, word: bytes) -> int:
        token = bucket(word)
        if len(self) < self.limit:
            self[word] = token
        return token

    def __reduce__(self):
        return Vocabulary, ([w for w, i in self.items() if not SIZE - BUCKETS <= i < SIZE],)

    def tokens(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def windows_of(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of (neighbours..., token) for the positions ``at``; places beyond the ends are PAD."""
    ends = np.full(SIDE, PAD, tokens.dtype)
    padded = np.concatenate((ends, tokens, ends))
    return np.stack([padded[at + SIDE + k] for k in OFFSETS] + [tokens[at]], axis=1)


def _less_picked(z: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """In place of ``z``, the gradient of the mean of -log softmax but for a factor of each row, which is returned."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    whole = z @ np.ones(z.shape[1], z.dtype)
    z[np.arange(len(z)), at] -= whole
    return (1 / (whole * len(z)))[:, None]


def _bounded(w: np.ndarray, b: np.ndarray, less: float = 0.0) -> bool:
    """Whether no hidden row, of numbers from -1 to 1, gives a score whose exponential overflows, nor would with ``less`` more."""
    return bool((np.abs(w).sum(axis=-2) + b).max(initial=0) < 75 - less)


def _log_picked(z: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """One column of each row of the log-softmax; ``z`` is overwritten."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    picked = z[np.arange(len(z)), at]
    return picked - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """``rows[at] = values``, each row copied as one value, which is faster."""
    whole = np.dtype((np.void, rows.shape[1] * rows.itemsize))
    rows.view(whole)[:, 0][at] = values.view(whole)[:, 0]


@dataclass
class WindowNetwork:
    """One hidden layer over the neighbours; a softmax over classes and one over the words of each class."""

    embed: np.ndarray  # places x tokens, PAD among them, x WIDTH
    bias: np.ndarray
    class_w: np.ndarray
    class_b: np.ndarray
    word_w: np.ndarray  # classes x WIDTH x tokens of a class
    word_b: np.ndarray
    #: For every token number the one that the network knows it by, and the logarithm of its share of that one's count.
    known_as: np.ndarray | None = None
    within: np.ndarray | None = None

    @classmethod
    def new(cls, seed: int = 3, tokens: int = SIZE) -> WindowNetwork:
        """A network for the token numbers below ``tokens``."""
        rng = np.random.default_rng(seed)
        f = np.float32
        each = max(PER_CLASS, math.ceil(math.sqrt(tokens)))
        classes = CLASSES if tokens == SIZE else math.ceil(tokens / each)
        net = cls(
            rng.normal(0, 0.1, (len(OFFSETS), max(SIZE + 1, tokens), WIDTH)).astype(f),
            np.zeros(WIDTH, f),
            rng.normal(0, 0.1, (WIDTH, classes)).astype(f),
            np.zeros(classes, f),
            rng.normal(0, 0.1, (classes, WIDTH, each)).astype(f),
            np.zeros((classes, each), f),
        )
        number = np.arange(classes * each)
        net.word_b.reshape(-1)[(number >= tokens) | (number == PAD)] = -1e9  # no token
        return net

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.class_w, self.class_b, self.word_w, self.word_b]

    @classmethod
    def fit(cls, windows: np.ndarray, epochs: int = 3, batch: int = 1024, rate: float = 0.05, seed: int = 3) -> WindowNetwork:
        """Adagrad on the cross-entropy of the masked token. Without windows the network stays as it began."""
        net = cls.new(seed)
        net.train(windows, net.no_steps(), epochs, batch, rate, seed)
        return net

    def no_steps(self) -> list[np.ndarray]:
        """Adagrad's sums before the first step."""
        return [np.full_like(p, 1e-3) for p in self.parts]

    def train(self, windows: np.ndarray, sums: list[np.ndarray], epochs: int = 1, batch: int = 1024, rate: float = 0.05, seed: int = 3) -> None:
        """Go on from these parameters and sums, both of which change."""
        rng = np.random.default_rng(seed)
        words, word_sums, step = self._words(), np.concatenate((sums[4], sums[5][:, None]), axis=1), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                if step % LOOK == 0:  # a step moves a parameter by ``rate`` at most
                    less = LOOK * rate * (WIDTH + 1)
                    bounded = _bounded(self.class_w, self.class_b, less), _bounded(words[:, :-1], words[:, -1], less)
                step += 1
                found, (embed, *others) = self._gradients(windows[order[i : i + batch]], words, bounded)
                for p, s, g in zip([*self.parts[1:4], words], [*sums[1:4], word_sums], others, strict=True):
                    s += g * g
                    g *= rate
                    g /= np.sqrt(s)
                    p -= g
                rows, squares = self.embed.reshape(-1, WIDTH), sums[0].reshape(-1, WIDTH)  # other rows have no gradient
                s = squares.take(found, axis=0)
                s += embed * embed
                _put(squares, found, s)
                embed *= rate
                embed /= np.sqrt(s, out=s)
                p = rows.take(found, axis=0)
                p -= embed
                _put(rows, found, p)
        self.word_w[:], self.word_b[:] = words[:, :-1], words[:, -1]
        sums[4][:], sums[5][:] = word_sums[:, :-1], word_sums[:, -1]

    def _words(self) -> np.ndarray:
        """Classes x (WIDTH + 1) x tokens of a class: the biases below the others."""
        return np.concatenate((self.word_w, self.word_b[:, None]), axis=1)

    def hidden(self, places: np.ndarray) -> np.ndarray:
        h = self.embed[0].take(places[:, 0], axis=0)
        h += self.bias
        for k in range(1, len(OFFSETS)):
            h += self.embed[k].take(places[:, k], axis=0)
        return np.tanh(h, out=h)

    def gradients(self, windows: np.ndarray) -> list[np.ndarray]:
        words = self._words()
        found, (embed, *others, word) = self._gradients(windows, words, (_bounded(self.class_w, self.class_b), _bounded(self.word_w, self.word_b)))
        whole = np.zeros_like(self.embed)
        whole.reshape(-1, WIDTH)[found] = embed
        return [whole, *others, word[:, :-1], word[:, -1]]

    def _gradients(self, windows: np.ndarray, words: np.ndarray, bounded: tuple[bool, bool]) -> tuple[np.ndarray, list]:
        """The rows of ``embed``, all places after one another, that the windows have, and the gradients: of those rows, the other parts and ``words``."""
        n, (classes, each) = len(windows), self.word_b.shape
        windows = windows[np.argsort(_small(windows[:, -1] // each, classes), kind="stable")]
        token = windows[:, -1].astype(np.int64)
        group = token // each
        ends = np.searchsorted(group, np.arange(classes + 1)).tolist()
        # A row's one stands for its bias; the rows of all classes share one softmax, products alone go class by class.
        h = self.hidden(windows)
        h1 = np.ones((n, WIDTH + 1), h.dtype)
        h1[:, :-1] = h
        d = h1 @ np.concatenate((self.class_w, self.class_b[None]))
        by = _less_picked(d, group, bounded[0])
        g_class, dh = (h1 * by).T @ d, d @ self.class_w.T
        dh *= by
        z = np.empty((n, each), h.dtype)
        parts = [(c, i, j) for c, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
        for c, i, j in parts:
            np.matmul(h1[i:j], words[c], out=z[i:j])
        by = _less_picked(z, token - group * each, bounded[1])
        h1 *= by
        g_word, more = np.zeros_like(words), np.empty_like(h)
        for c, i, j in parts:
            np.matmul(h1[i:j].T, z[i:j], out=g_word[c])
            np.matmul(z[i:j], words[c, :-1].T, out=more[i:j])
        more *= by
        dh += more
        h *= h
        dh *= np.subtract(1, h, out=h)
        rows, owner = [], []
        for k in range(len(OFFSETS)):
            column = _small(windows[:, k], self.embed.shape[1])
            rows.append(np.argsort(column, kind="stable"))
            owner.append(column[rows[-1]] + np.int64(k * self.embed.shape[1]))
        found, embed = _rows_by(np.concatenate(owner), dh, np.concatenate(rows))
        return found, [embed, dh.sum(0), g_class[:-1], g_class[-1], g_word]

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of the last column, given the others."""
        more = 0.0
        if self.known_as is not None:
            more, windows = self.within[windows[:, -1]], self.known_as[windows]
        out, (classes, each) = np.empty(len(windows)), self.word_b.shape
        bounded = _bounded(self.class_w, self.class_b), _bounded(self.word_w, self.word_b)
        class_w, word_w = np.concatenate((self.class_w, self.class_b[None])), self._words()
        for at in range(0, len(windows), CACHED):
            part = windows[at : at + CACHED]
            order = np.argsort(_small(part[:, -1] // each, classes), kind="stable")
            part = part[order]
            token = part[:, -1].astype(np.int64)
            group = token // each
            ends = np.searchsorted(group, np.arange(classes + 1)).tolist()
            h1, z = np.ones((len(part), WIDTH + 1), self.bias.dtype), np.empty((len(part), each), self.bias.dtype)
            h1[:, :-1] = self.hidden(part)
            logs = _log_picked(h1 @ class_w, group, bounded[0]).astype(np.float64)
            for c, (i, j) in enumerate(zip(ends, ends[1:])):
                if i < j:
                    np.matmul(h1[i:j], word_w[c], out=z[i:j])
            logs += _log_picked(z, token - group * each, bounded[1])
            out[at + order] = logs
        return out + more

    def sums(self, texts: Iterator[np.ndarray]) -> list[float]:
        """The summed log-probability of each text, given its token numbers."""
        sums: list[float] = []
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if waiting:
                logs = self.log_probabilities(np.concatenate([w for _, w in waiting]))
                owners = np.repeat([k for k, _ in waiting], [len(w) for _, w in waiting])
                for k, part in zip(*(x.tolist() for x in _sums_by(owners, logs)), strict=True):
                    sums[k] += part
                waiting.clear()
                held = 0

        for k, tokens in enumerate(texts):
            sums.append(0.0)
            for at in range(0, len(tokens), AT_ONCE):
                waiting.append((k, windows_of(tokens, np.arange(at, min(at + AT_ONCE, len(tokens))))))
                held += len(waiting[-1][1])
                if held >= AT_ONCE:
                    flush()
        flush()
        return sums


class Spelling:
    """Probabilities of words as byte strings: each byte by the one before, and the end as one of them.

    Fitted on different words, with one added to every count, so that all byte strings sum to one.
    """

    #: Bytes of words, in any order; a digit stands for all, and 32 for the end.
    ALPHABET = (32, 48, *range(97, 123), *range(128, 256))

    def __init__(self, words: list[bytes]):
        pairs = np.zeros((256, 256))
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
        np.add.at(pairs, (data[:-1], data[1:]), 1)
        pairs[:, self.ALPHABET] += 1
        with np.errstate(divide="ignore"):
            self.logs = np.log(pairs / pairs[:, self.ALPHABET].sum(axis=1, keepdims=True)).tolist()

    def log_probability(self, word: bytes) -> float:
        out, last = 0.0, 32
        for b in word:
            out += self.logs[last][b]
            last = b
        return out + self.logs[last][32]


@dataclass
class LanguageScorer:
    """Vocabulary and network; ``spelling`` and, by bucket, the logarithm of the share of its count that unknown words have.

    ``corpus`` has the different texts that it was fitted on: (key, tokens, more), by the hash of the text the numbers that
    the network knows its words by, and what the words' shares of their buckets add. ``rare`` has what the counts of
    rare words add to that: (key, more), None without any.
    """

    vocabulary: Vocabulary
    network: WindowNetwork
    spelling: Spelling
    unknown_share: dict[int, float]
    rare: DataFrame | None = None
    corpus: DataFrame | None = None

    def unseen(self, word: bytes) -> float:
        """Log-probability of a word that the corpus does not have, within its bucket."""
        return self.unknown_share.get(bucket(word), 0.0) + self.spelling.log_probability(word)

    def score(self, texts: Iterator[str | None]) -> list[tuple[int, float]]:
        """(number of tokens, summed log-probability) of each text; 0 and 0.0 without words. Rare words count as unknown ones."""
        scored: list[tuple[int, float]] = []

        def numbers() -> Iterator[np.ndarray]:
            for text in texts:
                words = words_of(text)
                tokens = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
                unknown = Counter(words[i] for i in np.nonzero((tokens >= SIZE - BUCKETS) & (tokens < SIZE))[0].tolist())
                scored.append((len(tokens), sum(n * self.unseen(w) for w, n in unknown.items())))
                yield tokens

        sums = self.network.sums(numbers())
        return [(n, more + s) for (n, more), s in zip(scored, sums, strict=True)]


def _small(numbers: np.ndarray, below: int) -> np.ndarray:
    """Numbers as 16 bits, where they fit, which numpy sorts faster."""
    return numbers.astype(np.uint16) if below <= 1 << 16 else numbers


def _sums_by(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.nonzero(np.concatenate(([True], owner[1:] != owner[:-1])))[0]
    return owner[starts], np.add.reduceat(value, starts, axis=0)


def _rows_by(owner: np.ndarray, value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners, which come sorted, in an order of their own, and the sums of the ``value[rows]`` that they have."""
    starts = np.nonzero(np.concatenate(([True], owner[1:] != owner[:-1])))[0]
    counts = np.diff(np.append(starts, len(owner)))
    most_first = np.argsort(-counts, kind="stable")
    starts, counts = starts[most_first], counts[most_first]
    sums = value.take(rows[starts], axis=0)
    more = len(counts) - np.searchsorted(counts[::-1], np.arange(1, LEVELS + 1), side="right")  # owners with more than that
    for level in range(1, LEVELS):
        m = more[level - 1]
        sums[:m] += value.take(rows[starts[:m] + level], axis=0)
    for i in range(more[-1]):
        rest = rows[starts[i] + LEVELS : starts[i] + counts[i]]
        sums[i] += np.ones(len(rest), value.dtype) @ value.take(rest, axis=0)
    return owner[starts], sums


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents: counted within tasks first, then by word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["t"]:
                held.update(words_of(text))
                if len(held) >= HELD_WORDS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    parts = docs.select(F.col(text_col).alias("t")).where("t is not null").mapInPandas(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _own_and_common(counts: DataFrame, total: int) -> tuple[list[tuple[bytes, int]], int, int]:
    """The most frequent words with their counts, in order; how many of them the network predicts; the least count of a common word."""
    # One row for each count that occurs, about the square root of the tokens at most.
    sizes = sorted((r["n"], r["count"]) for r in counts.groupBy("n").count().collect())
    held, floor = 0, (sizes[-1][0] + 1 if sizes else 1)
    for n, words in reversed(sizes):
        if (held := held + words) > COMMON:
            break
        floor = n
    own = max(SIZE - BUCKETS, sum(words for n, words in sizes if n >= max(floor, OWN * math.sqrt(total))))
    if held and floor > sizes[-1][0]:
        raise ValueError("COMMON is less than the number of most frequent words")
    held_words = counts.where(F.col("n") >= floor).select("word", "n").toArrow()
    common = sorted(zip(held_words["word"].to_pylist(), held_words["n"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    return common, min(own, len(common)), floor


def _training(texts: list, times: list[int], vocabulary: Vocabulary | Numbers, known_as: np.ndarray | None, most: int) -> Iterator[np.ndarray]:
    """All windows of the texts, each so many times, at most ``most`` and a part at once, in an order of their own: that of arrival must not matter."""
    waiting, held = [], 0
    for text, n in sorted(zip(texts, times, strict=True)):
        tokens = vocabulary.tokens(text)
        if known_as is not None:
            tokens = known_as[tokens]
        for at in range(0, len(tokens), AT_ONCE):
            rows = windows_of(tokens, np.arange(at, min(at + AT_ONCE, len(tokens))))
            left = n
            while left:
                now = min(left, max(1, AT_ONCE // len(rows)))
                waiting.append(rows if now == 1 else np.tile(rows, (now, 1)))
                left, held = left - now, held + now * len(rows)
                if held >= most:
                    yield np.concatenate(waiting)
                    waiting, held = [], 0
    if waiting:
        yield np.concatenate(waiting)


def _averaged(net: WindowNetwork, sums: list[np.ndarray], dealt: DataFrame, batch: int, most: int) -> WindowNetwork:
    """Train on every shard from the same parameters and sums; the parameters are averaged by the numbers of windows.

    A task adds up its shards; then the parameters are added a slice at a time.
    """
    start = dealt.sparkSession.sparkContext.broadcast((net, sums))

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        net, sums = start.value
        net, sums, n = WindowNetwork(*[p.copy() for p in net.parts]), [s.copy() for s in sums], 0
        for rows in _training(list(frame["tokens"]), frame["n"].tolist(), Numbers(net.embed.shape[1]), None, most):
            net.train(rows, sums, 1, batch, seed=5)
            n += len(rows)
        flat = np.concatenate([x.ravel() for x in net.parts])
        return pd.DataFrame({"p": [flat.astype("<f4").tobytes()], "n": [n]})

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, n = None, 0
        for frame in batches:
            for p, m in zip(frame["p"], frame["n"].tolist(), strict=True):
                part = np.frombuffer(p, "<f4").astype(np.float64) * m
                flat, n = part if flat is None else flat + part, n + m
        if n:
            for k in range(0, len(flat), SLICE):
                yield pd.DataFrame({"k": [k], "p": [flat[k : k + SLICE].astype("<f8").tobytes()], "n": [n]})

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(zip(frame["p"], frame["n"].tolist(), strict=True))  # not as they arrive
        whole = sum(np.frombuffer(p, "<f8") for p, _ in parts) / sum(n for _, n in parts)
        return pd.DataFrame({"k": frame["k"].iloc[:1], "p": [whole.astype("<f4").tobytes()]})

    trained = dealt.select("shard", "tokens", "n").groupBy("shard").applyInPandas(train, "p binary, n long")
    means = materialise(trained.mapInPandas(slices, "k long, p binary, n long").groupBy("k").applyInPandas(mean, "k long, p binary"), "network")
    found = sorted((r["k"], bytes(r["p"])) for r in means.collect())
    forget(means)
    start.unpersist()
    if not found:
        return net
    flat, ends = np.frombuffer(b"".join(p for _, p in found), "<f4").astype(np.float32), np.cumsum([x.size for x in net.parts])[:-1]
    return WindowNetwork(*[x.reshape(y.shape).copy() for x, y in zip(np.split(flat, ends), net.parts, strict=True)])


def fit_scorer(docs: DataFrame, text_col: str = "text", windows: int = WINDOWS) -> LanguageScorer:
    """Vocabulary from the counts of all words; network from the windows of all tokens.

    The driver sees the texts of about ``windows`` windows for the start; all are trained on where they are, in shards
    of about ``windows`` or more. Equal texts are dealt evenly over the shards.
    """
    counts = materialise(word_counts(docs, text_col), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common, own, floor = _own_and_common(counts, total)
    size = max(SIZE, _number(own - 1) + 1)
    vocabulary = Vocabulary([w for w, _ in common])

    # Of each bucket, the count of its words, and how many of them occur once.
    by_bucket = counts.groupBy((F.crc32(F.substring("word", -3, 3)) % BUCKETS + SIZE - BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once"))
    rest = {b: 0 for b in range(SIZE - BUCKETS, SIZE)}
    unknown = {b: 1 for b in rest}
    for r in by_bucket.collect():
        rest[r["b"]], unknown[r["b"]] = r["n"], r["once"] + 1
    for word, n in common[:own]:
        rest[bucket(word)] -= n
        unknown[bucket(word)] -= n == 1
    logs = {b: math.log(rest[b] + unknown[b]) for b in rest}
    known_as = np.arange(max(SIZE + 1, size, _number(len(common) - 1) + 1), dtype=np.int32)
    within = np.zeros(len(known_as))
    for i, (word, n) in enumerate(common[own:], own):
        known_as[_number(i)], within[_number(i)] = bucket(word), math.log(n) - logs[bucket(word)]
    spelling = Spelling([w for w, _ in common])
    scorer = LanguageScorer(vocabulary, None, spelling, {b: math.log(unknown[b]) - logs[b] for b in rest})

    has_rare = floor > 1
    shard_size = max(windows, PER_TOKEN * size if size > SIZE and windows >= WINDOWS else 0)
    shards = max(1, round(SHARE * total / shard_size))
    numbers = Numbers(max(SIZE + 1, size))
    shares = within.copy()
    shares[list(logs)] = [-x for x in logs.values()]  # of a rare word, whose count comes by a join
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, known_as, shares, numbers))

    @F.pandas_udf("tokens binary, rare binary, more double")
    def numbered(texts: pd.Series) -> pd.DataFrame:
        vocabulary, known_as, shares, numbers = held.value
        rows = []
        for text in texts:
            words = words_of(text)
            tokens = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
            at = np.nonzero(tokens < 0)[0]
            rare = [words[i] for i in at.tolist()]
            tokens[at] = [bucket(w) for w in rare]
            rows.append((numbers.packed(known_as[tokens]), b" ".join(rare), float(shares[tokens].sum())))
        return pd.DataFrame(rows, columns=["tokens", "rare", "more"])

    # Each different text once: its words' numbers are read for the network and for the scores.
    equal = docs.select(F.col(text_col).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    equal = materialise(equal.select("t", "n", F.xxhash64("t").alias("key"), numbered("t").alias("x")).select("t", "n", "key", "x.*"), "texts")
    turn = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(shards)).cast("int") - 1))
    mine = F.floor(F.col("n") / shards) + F.when(F.col("turn") < F.col("n") % shards, 1).otherwise(0)
    dealt = equal.withColumn("turn", turn).select("t", "tokens", "key", mine.cast("long").alias("n"), F.pmod(F.col("key") + F.col("turn"), F.lit(shards)).alias("shard"))
    start = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < int((windows / shard_size) * (1 << 30))
    first = dealt.where(F.col("shard") == 0).where(start).select("tokens", "n").toArrow()
    net = WindowNetwork.new(tokens=size)
    sums, batch = net.no_steps(), max(1024, size // 2)
    for rows in _training(first["tokens"].to_pylist(), first["n"].to_pylist(), numbers, None, 2 * windows):
        net.train(rows, sums, 3, batch)
    for r in range(min(ROUNDS, shards) if shards > 1 else 0):
        net = _averaged(net, sums, dealt.where(F.col("shard") % min(ROUNDS, shards) == r), batch, 2 * shard_size)
    net.known_as, net.within, scorer.network, scorer.corpus = known_as, within, net, equal.select("key", "tokens", "more")
    if has_rare:  # a rare word occurs less than ``floor`` times, so no key is hot
        each = equal.where("length(rare) > 0").select("key", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("word"))
        each = each.withColumn("word", F.col("word").cast("binary")).join(counts.where(F.col("n") < floor), "word")
        scorer.rare = materialise(each.groupBy("key").agg(F.sum(F.log("n")).alias("more")), "rare")
    return scorer


def with_scores(docs: DataFrame, text_col: str = "text", into: str = "lm", windows: int = WINDOWS) -> DataFrame:
    """``docs`` with a struct ``into``: n_tokens, log_prob (summed) and mean_log_prob.

    Null texts and texts without words have no token, a sum of 0 and a null mean. Every word of the corpus has a
    probability of its own. All rows and columns stay; an empty table gives an empty result.
    """
    scorer = fit_scorer(docs, text_col, windows)
    shared = docs.sparkSession.sparkContext.broadcast(WindowNetwork(*scorer.network.parts))

    @F.pandas_udf("n long, s double")
    def score(tokens: pd.Series) -> pd.DataFrame:
        network = shared.value
        numbers = Numbers(network.embed.shape[1])
        held = [numbers.tokens(x) for x in tokens]
        return pd.DataFrame({"n": [len(x) for x in held], "s": network.sums(iter(held))}, columns=["n", "s"])

    scored = scorer.corpus.select("key", score("tokens").alias("x"), "more").select("key", "x.n", (F.col("x.s") + F.col("more")).alias("s"))
    if scorer.rare is not None:
        scored = scored.join(scorer.rare, "key", "left").select("key", "n", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"))
    # One row for a hash, whatever texts have it.
    scored = scored.groupBy(F.col("key").alias("__key")).agg(F.min("n").alias("__n"), F.min("s").alias("__s"))
    # Null texts have the hash of no text and no score.
    out = docs.withColumn("__key", F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))).join(scored, "__key", "left")
    n, whole = F.coalesce("__n", F.lit(0).cast("long")), F.coalesce("__s", F.lit(0.0))
    out = out.withColumn(into, F.struct(n.alias("n_tokens"), whole.alias("log_prob"), F.when(n > 0, whole / n).alias("mean_log_prob")))
    return out.drop("__key", "__n", "__s")


def perplexity(lm: Column) -> Column:
    """Pseudo-perplexity of a score."""
    return F.exp(-lm["mean_log_prob"])
