"""Language-model scores (operator 7): a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Classes of the first softmax, words in each. The last class holds all other words, in classes of their own, and the unknown one.
CLASSES, WIDTH = 32, 64
HEAD = (CLASSES - 1) * WIDTH
#: Words whose counts every task has; those of the rest are joined.
KNOWN = 1 << 16
#: Context symbols: the head's words, other words by their ending, and the beginning of a text.
ENDINGS = 256
BEGIN = HEAD + ENDINGS
SYMBOLS = BEGIN + 1
#: Gradient updates, and their step; updates of the classes beyond the head.
ROUNDS, RATE, TAIL_ROUNDS = 6, 0.35, 50
#: Tokens handled at a time, and distinct words a task holds before it hands on its counts.
CHUNK, HELD = 1 << 18, 500_000
#: Statistics that a task takes for one gradient.
STATISTICS = 4_000_000
#: Parts in which gradients are summed.
BLOCKS = 64
#: The token that ends a text; no word is empty.
END = b""

# rows of the class table: bias, previous symbol, the one before (skip), then those of hashed pairs;
# rows of the word table: bias of each class, then those of hashed (previous symbol, class)
_PREVIOUS, _SKIP, _PAIR = 1, 1 + SYMBOLS, 1 + 2 * SYMBOLS


def hashed_rows(distinct: int) -> int:
    """Rows of each hashed table: a power of two, about eight to sixteen times the square root of the number of words."""
    return 1 << max(10, math.ceil(math.log2(8 * math.sqrt(max(1, distinct)))))


def sizes(rows: int) -> tuple[int, int]:
    """Weights of the class table and of the word table."""
    return (_PAIR + rows) * CLASSES, (CLASSES - 1 + rows) * WIDTH


def tail_classes(distinct: int) -> int:
    """Classes of the words beyond the head: the square root of the number of words."""
    return max(1, math.isqrt(max(0, distinct - 1)) + 1)


def tail_class(word: bytes, n: int) -> int:
    """Words that end alike are in one class."""
    return zlib.crc32(word[-3:]) % n


def tokens(text: str) -> list[bytes]:
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def _ending(word: bytes) -> int:
    return HEAD + zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Vocabulary:
    """The most frequent words and what the corpus has in all. ``rest``: tokens outside the head; ``once``: words met once."""

    words: list[bytes]
    counts: list[int]
    total: int
    distinct: int
    rest: int
    once: int

    @property
    def rows(self) -> int:
        return hashed_rows(self.distinct)

    @property
    def tails(self) -> int:
        return tail_classes(self.distinct)

    def unknown(self) -> float:
        """Probability of the unknown word within the last class: the share of words met once."""
        if not self.rest:
            return 1.0
        return min(0.5, self.once / self.rest) if self.once else 1.0 / (self.rest + 1)


class Reader:
    """Texts as arrays of words, classes and contexts."""

    def __init__(self, v: Vocabulary):
        self.index = {w: k for k, w in enumerate(v.words)}
        n = len(v.words)
        rank = np.arange(n + 1)  # the last place is for words outside
        self.cls = np.where(rank < min(n, HEAD), rank // WIDTH, CLASSES - 1).astype(np.int64)
        self.symbol = np.array([k if k < HEAD else _ending(w) for k, w in enumerate(v.words)] + [-1], np.int64)
        self.cls[-1] = CLASSES - 1
        self.tails = v.tails
        self.tail = np.array([tail_class(w, v.tails) for w in v.words] + [-1], np.int64)
        self.counts = np.array([*v.counts, 0], np.float64)
        self.place = np.full(SYMBOLS * SYMBOLS, -1, np.int32)

    def chunks(self, texts: Iterator[tuple[int, str]]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]]:
        """(tokens, word index or -1, symbol before, symbol before that, starts, row numbers, places of the words outside); whole texts, about CHUNK tokens at a time."""
        toks: list[bytes] = []
        starts: list[int] = []
        rows: list[int] = []
        for row, text in texts:
            starts.append(len(toks))
            rows.append(row)
            toks += tokens(text)
            if len(toks) >= CHUNK:
                yield self._arrays(toks, starts, rows)
                toks, starts, rows = [], [], []
        if toks:
            yield self._arrays(toks, starts, rows)

    def _arrays(self, toks: list[bytes], starts: list[int], rows: list[int]):
        word = np.fromiter(map(self.index.get, toks, repeat(-1)), np.int64, len(toks))
        symbol = self.symbol[word]
        out = np.flatnonzero(word < 0)
        if len(out):
            symbol[out] = [_ending(toks[k]) for k in out.tolist()]
        s = np.array(starts)
        one = np.empty_like(symbol)
        one[1:], one[s] = symbol[:-1], BEGIN
        two = np.empty_like(symbol)
        two[2:], two[:2] = symbol[:-2], BEGIN
        two[s] = BEGIN
        two[np.minimum(s + 1, len(two) - 1)] = BEGIN
        return toks, word, one, two, s, rows, out

    def tail_of(self, toks: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words beyond the head, their classes)."""
        at = np.flatnonzero(self.cls[word] == CLASSES - 1)
        c = self.tail[word[at]]
        new = np.flatnonzero(c < 0)
        c[new] = [zlib.crc32(toks[k][-3:]) % self.tails for k in at[new].tolist()]
        return at, c

    def contexts(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs as numbers, and each position's place among them, by a table over all pairs instead of a sort."""
        code = one * SYMBOLS + two
        self.place[code] = 0
        distinct = np.flatnonzero(self.place == 0)
        self.place[distinct] = np.arange(len(distinct))
        at = self.place[code]
        self.place[distinct] = -1
        return distinct, at


def _hashed(code: np.ndarray, rows: int) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(36)).astype(np.int64) % rows


def _class_rows(code: np.ndarray, rows: int) -> list[np.ndarray]:
    return [_PREVIOUS + code // SYMBOLS, _SKIP + code % SYMBOLS, _PAIR + _hashed(code, rows)]


def _word_rows(one: np.ndarray, cls: np.ndarray, rows: int) -> np.ndarray:
    return CLASSES - 1 + _hashed(one * CLASSES + cls, rows)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


class Weights:
    def __init__(self, flat: np.ndarray):
        self.rows = (len(flat) - sum(sizes(0))) // (CLASSES + WIDTH)
        n, _ = sizes(self.rows)
        self.cls, self.word = flat[:n].reshape(-1, CLASSES), flat[n:].reshape(-1, WIDTH)

    def classes(self, code: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes in each context."""
        x = self.cls[0] + sum(self.cls[r] for r in _class_rows(code, self.rows))
        return _log_softmax(x)

    def words(self, one: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Log probabilities of a head class's words after each symbol."""
        return _log_softmax(self.word[cls] + self.word[_word_rows(one, cls, self.rows)])


# ------------------------------------------------------------------------------------------------------------ counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(tok binary, n): each token's count, the end included; tasks count first and hand on partial counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["tok", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.update(tokens(t.as_py() or ""))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "tok binary, n long").groupBy("tok").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The KNOWN most frequent words (ties by the word) come to the driver, with the sums; the end is always of the head.

    How many words there are by sixteenths of the count's logarithm tells from which count on these are; only words from there on
    are sorted, so a task sends what may be chosen and not its own KNOWN best."""
    size = F.floor(F.log2("n") * 16)
    sums = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("n") == 1, 1)).alias("once")).first()
    least, seen = 0, 0
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["size"]):  # at most 1,008 rows
        least, seen = r["size"], seen + r["words"]
        if seen >= KNOWN:
            break
    top = [(bytes(r["tok"]), r["n"]) for r in counts.where(size >= least).orderBy(F.desc("n"), "tok").limit(KNOWN).collect()]
    end = [x for x in top if x[0] == END] or [(bytes(r["tok"]), r["n"]) for r in counts.where(F.length("tok") == 0).collect()]
    top = end + [x for x in top if x[0] != END]
    head = sum(n for _, n in top[:HEAD])
    once = (sums["once"] or 0) - sum(n == 1 for _, n in top[:HEAD])
    return Vocabulary([w for w, _ in top], [n for _, n in top], sums["t"] or 0, sums["v"] or 0, (sums["t"] or 0) - head, max(0, once))


def _packed(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Statistics as rows of up to a million keys, as distances to the key before, and counts, compressed."""
    for s in range(0, len(key), 1 << 20):
        k, c = key[s: s + (1 << 20)].astype("<i8"), n[s: s + (1 << 20)].astype("<i4")
        k = np.diff(k, prepend=np.int64(0))
        packed = [pa.array([zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)], pa.binary()) for x in (k, c)]
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int8()), pa.array([len(k)], pa.int64()), *packed], names=["kind", "size", "key", "n"])


def _unpacked(key: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and their counts."""
    planes = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(size, -1).T for x, size in ((key, 8), (n, 4))]
    return np.cumsum(np.ascontiguousarray(planes[0]).view("<i8").ravel()), np.ascontiguousarray(planes[1]).view("<i4").ravel()


PACKED = "kind byte, size long, key binary, n binary"


def _statistics(shared):
    """Counts of (context, class), (previous symbol, word of the head) and (previous symbol, class beyond the head): what the
    likelihood depends on. Summed per task and packed, a few rows for millions of statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words, tails = np.zeros(SYMBOLS * HEAD, np.int64), np.zeros(SYMBOLS * reader.tails, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for toks, word, one, two, _, _, _ in reader.chunks((k, t.as_py() or "") for k, t in enumerate(batch.column(0))):
                code, at = reader.contexts(one, two)
                per = np.bincount(at * CLASSES + reader.cls[word])
                some = np.flatnonzero(per)
                held.append((code[some // CLASSES] * CLASSES + some % CLASSES, per[some]))
                inside = np.flatnonzero((word >= 0) & (word < HEAD))
                words += np.bincount(one[inside] * HEAD + word[inside], minlength=len(words))
                at, c = reader.tail_of(toks, word)
                tails += np.bincount(one[at] * reader.tails + c, minlength=len(tails))
                if sum(len(k) for k, _ in held) > 6_000_000:
                    key, n = merged()
                    if len(key) > 3_000_000:
                        yield from _packed(0, key, n)
                        held = []
                    else:
                        held = [(key, n)]
        if held:
            yield from _packed(0, *merged())
        for kind, table in ((1, words), (2, tails)):
            some = np.flatnonzero(table)
            yield from _packed(kind, some, table[some])

    return run


def _tail_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, n in zip(batch.column("key"), batch.column("n")):
            key, n = _unpacked(key.as_py(), n.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])


def _tail_symbol(tails: int, total: np.ndarray):
    """The classes' log probabilities after one symbol: gradient updates of its row of weights, from the classes' own counts on."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(tails)
        seen[pdf["key"].to_numpy() % tails] = pdf["n"]
        bias, row, rows = np.log(total + 0.5), np.zeros(tails), seen.sum()
        for _ in range(TAIL_ROUNDS):
            x = bias + row
            expected = np.exp(x - x.max())
            expected *= rows / expected.sum()
            # the step is scaled by a weight's own counts; ten more hold weights with few counts near the classes' shares
            row += 2 * RATE * (seen - expected - 0.1 * row) / (seen + expected + 10.0)
        x = bias + row
        x -= x.max()
        x -= np.log(np.exp(x).sum())
        return pd.DataFrame({"symbol": [int(pdf["symbol"].iloc[0])], "x": [x.astype("<f4").tobytes()]})

    return run


def train_tail(stats: DataFrame, v: Vocabulary, totals: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes beyond the head, a row for each previous symbol: SYMBOLS times the square root of the
    number of words. Each symbol's row is fitted by a task of its own; a symbol not met has the classes' shares."""
    keyed = stats.where("kind = 2").mapInArrow(_tail_rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    fitted = keyed.withColumn("symbol", F.floor(F.col("key") / v.tails).cast("int")).groupBy("symbol").applyInPandas(_tail_symbol(v.tails, totals), "symbol int, x binary")
    shares = np.log((totals + 0.5) / (totals + 0.5).sum()).astype(np.float32)
    out = np.tile(shares, (SYMBOLS, 1))
    for r in fitted.collect():
        out[r["symbol"]] = np.frombuffer(r["x"], "<f4")
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and each element's place among them."""
    new = np.r_[True, x[1:] != x[:-1]]
    return x[new], np.cumsum(new) - 1


def _gradient(shared):
    """Observed minus expected counts of every weight under the current weights, and observed plus expected, summed over a task's statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, scales = shared.value
        w = Weights(w)
        grad = np.zeros(sum(sizes(w.rows)), np.float64)
        scale = np.zeros(len(grad), np.float64)
        g, s = Weights(grad), Weights(scale)

        def add(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            table[rows[begin]] += np.add.reduceat(values[order], begin, axis=0)

        def tally(where: np.ndarray, column: np.ndarray, n: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            seen = np.bincount(where * logp.shape[1] + column, n, logp.size).reshape(logp.shape)
            expected = np.exp(logp) * seen.sum(1, keepdims=True)
            return seen - expected, seen + expected

        for batch in batches:
            for kind, keys, counts in zip(batch.column("kind").to_pylist(), batch.column("key"), batch.column("n")):
                keys, counts = _unpacked(keys.as_py(), counts.as_py())
                for start in range(0, len(keys), 200_000):
                    key, n = keys[start: start + 200_000], counts[start: start + 200_000]
                    if kind == 0:
                        code, at = _runs(key // CLASSES)
                        d, e = tally(at, key % CLASSES, n, w.classes(code))
                        for to, x in ((g.cls, d), (s.cls, e))[: 1 + scales]:
                            to[0] += x.sum(0)
                            for rows in _class_rows(code, w.rows):
                                add(to, rows, x)
                    else:
                        one, word = key // HEAD, key % HEAD
                        pair, at = _runs(one * CLASSES + word // WIDTH)
                        one, cls = pair // CLASSES, pair % CLASSES
                        d, e = tally(at, word % WIDTH, n, w.words(one, cls))
                        for to, x in ((g.word, d), (s.word, e))[: 1 + scales]:
                            add(to, cls, x)
                            add(to, _word_rows(one, cls, w.rows), x)
        both = [(0, grad)] + [(1, scale)] * scales
        parts = [(kind * BLOCKS + k, zstandard.compress(x.astype(np.float32).tobytes(), 1)) for kind, flat in both for k, x in enumerate(np.array_split(flat, BLOCKS))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["block", "x"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(zstandard.decompress(x.as_py()), np.float32).astype(np.float64)
            held[k] = held[k] + x if k in held else x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in held.values()], pa.binary())], names=["block", "x"])


def initial(v: Vocabulary) -> np.ndarray:
    """Biases from the counts; places without a word get none of the probability."""
    flat = np.zeros(sum(sizes(v.rows)), np.float32)
    w = Weights(flat)
    head = np.zeros(HEAD)
    head[: min(HEAD, len(v.counts))] = v.counts[:HEAD]
    w.cls[0] = np.log(np.r_[head.reshape(-1, WIDTH).sum(1), v.rest] + 0.5)
    w.word[: CLASSES - 1] = np.where(head > 0, np.log(np.maximum(head, 1e-9)), -60.0).reshape(-1, WIDTH)
    return flat


def train(docs: DataFrame, v: Vocabulary, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, log probabilities of the classes beyond the head). The statistics are counted once and stored; each round every task
    gives the gradient of its part at the current weights, the parts are summed by blocks, and the driver, which holds the weights
    (96 floats for each hashed row, so they grow with the square root of the vocabulary), takes a step scaled by each weight's own
    counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)
    every = stored(docs.select("text").mapInArrow(_statistics(shared), PACKED))
    stats = every.where("kind < 2")
    # tasks that are worth the size of a gradient
    tasks = max(1, -(-(stats.agg(F.sum("size")).first()[0] or 0) // STATISTICS))
    stats = stats.coalesce(tasks) if tasks < stats.rdd.getNumPartitions() else stats
    flat, scale = initial(v), None
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast((flat, k == 0))
        sums = stats.mapInArrow(_gradient(sent), "block int, x binary").repartition(BLOCKS, "block").mapInArrow(_summed, "block int, x binary")
        got = {r["block"]: np.frombuffer(r["x"], np.float32) for r in sums.collect()}  # the weights' size, once or twice
        if not got:
            break
        if k == 0:
            scale = np.concatenate([got[BLOCKS + b] for b in range(BLOCKS)])
        flat = (flat + RATE * np.concatenate([got[b] for b in range(BLOCKS)]) / (scale + 10.0) * (1 + 1.0 * (k > 0))).astype(np.float32)
    return flat, train_tail(every, v, totals)


# ------------------------------------------------------------------------------------------------------------ scores


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat, tails, totals = shared.value
        reader, w = Reader(v), Weights(flat)
        ln10, floor = np.log(10), v.total + v.distinct + 1
        base_of = np.log((reader.counts + 1) / floor) / ln10
        # a word's share of its class, without the count where the class isn't known yet
        share = np.log((1 - v.unknown()) / np.maximum(totals, 1) + 1e-300)
        names = ["doc_id", "tk", "tok", "tf", "n_tokens", "n_known", "base", "score"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            ids, tks = batch.column(0), batch.column(1)
            for toks, word, one, two, starts, rows, out in reader.chunks((k, t.as_py() or "") for k, t in enumerate(batch.column(2))):
                code, at = reader.contexts(one, two)
                cls = reader.cls[word]
                score = w.classes(code)[at, cls].astype(np.float64) / ln10
                inside = np.flatnonzero(cls < CLASSES - 1)
                pair, where = np.unique(one[inside] * CLASSES + cls[inside], return_inverse=True)
                score[inside] += w.words(pair // CLASSES, pair % CLASSES)[where, word[inside] % WIDTH] / ln10
                tail, c = reader.tail_of(toks, word)
                known = np.zeros(len(word))
                known[tail] = (tails[one[tail], c] + share[c]) / ln10
                in_list = word[tail] >= 0
                score[tail[in_list]] += known[tail[in_list]] + np.log(reader.counts[word[tail[in_list]]]) / ln10
                base = base_of[word]
                base[out] = 0.0  # joined later
                size = np.diff(np.r_[starts, len(toks)])
                r = pa.array(rows)
                none = pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays([ids.take(r), tks.take(r), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(size), pa.array(np.add.reduceat((word >= 0).astype(np.int64), starts)),
                                                  pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts))], names=names)
                if len(out):
                    doc = np.searchsorted(starts, out, "right") - 1
                    index: dict[tuple[int, bytes], int] = {}
                    at = np.array([index.setdefault(k, len(index)) for k in zip(doc.tolist(), map(toks.__getitem__, out.tolist()))])
                    r = pa.array([rows[d] for d, _ in index])
                    none = pa.nulls(len(index))
                    yield pa.RecordBatch.from_arrays([ids.take(r), tks.take(r), pa.array([t for _, t in index], pa.binary()), pa.array(np.bincount(at)), *(none.cast(t) for t in types[4:7]),
                                                      pa.array(np.bincount(at, known[out]))], names=names)

    return run


def class_totals(counts: DataFrame, v: Vocabulary) -> np.ndarray:
    """Tokens of each class beyond the head: as many rows as classes reach the driver."""
    out = np.zeros(v.tails, np.int64)
    last = F.substring("tok", F.greatest(F.lit(1), F.octet_length("tok") - 2), F.lit(3))
    for c, n in counts.groupBy((F.crc32(last) % v.tails).alias("c")).agg(F.sum("n")).collect():
        out[c] = n
    for word, n in zip(v.words[:HEAD], v.counts[:HEAD]):
        out[tail_class(word, v.tails)] -= n
    return out


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every whole text under a model learnt from the rows where ``learn`` holds.

    Tokens are words without ASCII white space, A-Z lower-cased, and an end. The model's outcomes are the base's: the words
    met in training and one unknown word. P(word | context) = P(class | context) P(word | class, context): 31 classes of 64
    frequent words each, and one for all others, which has about as many classes again as the square root of the number of words,
    by the words' last three bytes. The first 32 classes depend on the two symbols before, on each alone (the farther one is a
    skip feature) and on their hashed pair; a head class's words on the symbol before, hashed with the class; the classes beyond
    on the symbol before. Within a class beyond the head a word has its share of the class's tokens, and the unknown word, which
    has no class, the share of words met once among all beyond the head. Hashed rows, too, grow with the square root of the number
    of words.

    Counts of the 65,536 most frequent words are with every task; for the others a text's words join the counts, a word
    as often as it occurs in the text only once. Null or empty text: the end alone. Null doc_id stays null (and learns by
    ``learn``). Repeated rows are counted and given back each. Nothing to learn from: the unknown word has all the probability.
    Empty table: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text"))
    seen = docs.where(learn).select("text")
    counts = stored(word_counts(seen))
    v = vocabulary(counts)
    totals = class_totals(counts, v)
    shared = spark.sparkContext.broadcast((v, *train(seen, v, totals), totals))
    parts = stored(base.mapInArrow(_scores(shared), "doc_id long, tk long, tok binary, tf long, n_tokens long, n_known long, base double, score double"))
    u, floor = v.unknown(), float(v.total + v.distinct + 1)
    rest = parts.where("tok is not null").select("doc_id", "tk", "tok", "tf", "score").join(counts, "tok", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    per = F.when(c > 0, F.col("score") + F.col("tf") * F.log10(c)).otherwise(F.col("tf") * float(np.log10(u)))
    rest = rest.select("doc_id", "tk", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_tokens"), F.when(c > 0, F.col("tf")).otherwise(0).alias("n_known"),
                       (F.col("tf") * F.log10((c + 1) / floor)).alias("base"), per.alias("score"))
    whole = parts.where("tok is null").select("doc_id", "tk", F.lit(1).cast("long").alias("rows"), "n_tokens", "n_known", "base", "score")
    sums = whole.unionByName(rest).groupBy("doc_id", "tk").agg(*[F.sum(x).alias(x) for x in ("rows", "n_tokens", "n_known", "base", "score")])
    each = sums.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(
        "doc_id", *[(F.col(x) / F.col("rows")).cast("long").alias(x) for x in ("n_tokens", "n_known")], F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))
