"""Toxicity (operator 9): a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the subsequences, what each position of their span is worth, characters compared at a time, power of the kernel.
ORDER, DECAY, WINDOW, POWER = 3, 0.8, 20, 3
#: Most landmarks: words that tell toxic texts apart. Of all words, so many are expected to be as telling by chance.
TELLING, CHANCE = 128, 1.0
#: Kernel values below count as none; a landmark that no word of a text labelled 0 comes nearer to than this stands for an insult by
#: itself; how often one landmark counts in a text.
FAINT, ALONE, OFTEN = 0.1, 0.3, 3.0
#: Share of the weight that clean texts with one insult put in have in the fit, and as many with one in disguise.
PUT_IN = 0.15
#: Most labelled rows of each label that the fit takes.
SAMPLE = 3000
#: Words that a worker remembers, and those of them that resemble a landmark; when full it starts anew, which changes no result.
REMEMBERED, RESEMBLING = 1_000_000, 100_000
THRESHOLD = 0.7
#: Stands for any inserted character.
ANY = "\x01"
#: Begins every word, so that stems weigh more than endings.
START = "^"

_NOT_LETTERS = re.compile(r"[\W_]+")
#: Three or more letters that stand alone.
_SPELLED = re.compile(r"(?<!\S)\w(?:[\s.*-]+\w){2,}(?!\S)")


def cleaned(word: str) -> str:
    return _NOT_LETTERS.sub("", word)


def parts_of(word: str) -> list[str]:
    """The words that punctuation joins, where it joins any."""
    parts = _NOT_LETTERS.split(word)
    return [p for p in parts if len(p) >= ORDER] if len(parts) > 1 else []


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, and letters that stand alone put together."""
    low = text.lower()
    words = low.split()
    if len(low) < 3 * len(words) or _SPELLED.search(low):
        words += [x.group() for x in _SPELLED.finditer(low)]
    return words


def units(text: str) -> list[str]:
    """The words of a text as they are judged: each without its punctuation, and what stands between that."""
    return [u for w in words_of(text) for u in dict.fromkeys([cleaned(w), *parts_of(w)]) if u]


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n characters, and what their spans are worth."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1)


PLACES = {n: _places(n) for n in range(ORDER, WINDOW + 1)}


def _codes(words: list[str], n: int) -> np.ndarray:
    """The subsequences of words of n characters as integers, one row each."""
    chars = np.array([list(map(ord, w)) for w in words], np.int64).reshape(len(words), n)
    at = PLACES[n][0]
    return (chars[:, at[:, 0]] << 42) | (chars[:, at[:, 1]] << 21) | chars[:, at[:, 2]]


def subsequences(word: str) -> dict[int, float]:
    """Weight of each subsequence of a word, scaled to length 1 (its first WINDOW characters: landmarks are no longer)."""
    word = (START + word)[:WINDOW]
    out: dict[int, float] = {}
    if len(word) >= ORDER:
        for c, w in zip(_codes([word], len(word))[0].tolist(), PLACES[len(word)][1].tolist()):
            out[c] = out.get(c, 0.0) + w
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {c: v / norm for c, v in out.items()}


def _dot(x: dict[int, float], y: dict[int, float]) -> float:
    return sum(v * y.get(c, 0.0) for c, v in x.items())


def kernel(a: str, b: str) -> float:
    """1 for equal words; a power of a kernel is a kernel, and sets near words further off from those that share a few letters."""
    return _dot(subsequences(a), subsequences(b)) ** POWER


class Landmarks:
    """Kernel values of any words against the landmarks."""

    def __init__(self, words: list[str]):
        self.words = words
        maps = [subsequences(w) for w in words]
        self.codes = np.array(sorted({c for m in maps for c in m}), np.int64)
        at = {c: k for k, c in enumerate(self.codes.tolist())}
        self.weights = np.zeros((len(self.codes) + 1, len(words)), np.float32)  # the last row: in no landmark
        for j, m in enumerate(maps):
            for c, v in m.items():
                self.weights[at[c], j] = v
        #: The characters of landmarks, and for each three of them their row in ``weights``; 0 stands for any other character.
        self.alphabet = np.array(sorted({ord(c) for w in words for c in START + w}), np.uint32)
        k = len(self.alphabet) + 1
        three = [np.searchsorted(self.alphabet, self.codes >> shift & 0x1FFFFF) + 1 for shift in (42, 21, 0)]
        self.row = np.full(k**3 if k <= 256 else 0, len(self.codes), np.int32)
        if len(self.row):
            self.row[(three[0] * k + three[1]) * k + three[2]] = np.arange(len(self.codes))

    def _possible(self, parts: list[str], n: int, least: float) -> np.ndarray:
        """Which words of n characters can reach ``least``: products with the landmarks over the length that a word has at least,
        namely where no subsequence occurs twice. Nothing needs sorting for that."""
        at, weight = PLACES[n]
        chars = np.array(parts, f"U{n}").view(np.uint32).reshape(len(parts), n)
        ids = np.searchsorted(self.alphabet, chars)
        ids[ids == len(self.alphabet)] = 0
        ids = np.where(self.alphabet[ids] == chars, ids + 1, 0).astype(np.int32)
        k, width = len(self.alphabet) + 1, len(self.codes) + 1
        places = self.row[(ids[:, at[:, 0]] * k + ids[:, at[:, 1]]) * k + ids[:, at[:, 2]]]
        places += np.arange(len(parts), dtype=np.int32)[:, None] * width
        share = np.bincount(places.ravel(), np.tile(weight, len(parts)), len(parts) * width).astype(np.float32).reshape(len(parts), width)
        return (share @ self.weights).max(1) >= least ** (1 / POWER) * np.sqrt((weight**2).sum()) * (1 - 1e-4)

    def against(self, words: list[str], least: float = 0.0) -> np.ndarray:
        """Rows of kernel values. A word longer than WINDOW takes the best of its overlapping windows; one shorter than ORDER has none.

        Values below ``least`` may come out as 0: the part of a word that lies in any landmark's subsequences bounds all its values.
        """
        out = np.zeros((len(words), len(self.words)), np.float32)
        parts: dict[int, list[tuple[int, str]]] = {}
        for k, w in enumerate(words):
            w = START + w
            for s in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2) if len(w) > WINDOW else (0,):
                p = w[s: s + WINDOW]
                if len(p) >= ORDER:
                    parts.setdefault(len(p), []).append((k, p))
        for n, each in parts.items():
            weight = PLACES[n][1]
            for start in range(0, len(each), step := max(1, 15_000 // len(weight))):
                some = each[start: start + step]
                if least and len(self.row):
                    some = [some[k] for k in np.flatnonzero(self._possible([p for _, p in some], n, least)).tolist()]
                    if not some:
                        continue
                codes = _codes([p for _, p in some], n)
                order = np.argsort(codes, axis=1)
                codes, w = np.take_along_axis(codes, order, 1), weight[order]
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                flat = np.flatnonzero(first)
                total, code, row = np.add.reduceat(w.ravel(), flat), codes.ravel()[flat], flat // codes.shape[1]
                norm = np.sqrt(np.bincount(row, total * total, len(some)))
                at = np.searchsorted(self.codes, code)
                at[at == len(self.codes)] = 0
                hit = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
                own = np.array([k for k, _ in some])
                if least:
                    share = np.sqrt(np.bincount(row[hit], total[hit] ** 2, len(some))) / norm
                    near = share * (1 + 1e-6) >= least ** (1 / POWER)
                    hit &= near[row]
                if not hit.any():
                    continue
                r = row[hit]
                begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                values = np.add.reduceat(self.weights[at[hit]] * total[hit, None].astype(np.float32), begin, axis=0)
                r = r[begin]
                values /= norm[r, None]
                own = own[r]
                if (own[1:] > own[:-1]).all():  # one part a word
                    out[own] = np.maximum(out[own], values)
                else:
                    np.maximum.at(out, own, values)
        some = np.flatnonzero(out.any(1))
        out[some] **= POWER
        return out


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 500) -> np.ndarray:
    """Linear support vector machine: weighted squared hinge loss, accelerated gradient; the last column of x is 1."""
    top = np.linalg.eigvalsh((x * weight[:, None]).T @ x / weight.sum())[-1]
    rate, u, v = 1.0 / (2 * top + ridge), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(0.0, 1 - y * (x @ v))
        new = v - rate * (-2 * ((weight * slack * y) @ x) / weight.sum() + ridge * v)
        v, u = new + k / (k + 3) * (new - u), new
    return u


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, a fifth of the weight on label 1, with smoothed targets.

    Newton steps, each halved until the loss falls; where they don't settle, the curve isn't one and that is an error.
    """
    p, n = y.sum(), (~y).sum()
    t = np.where(y, (p + 1) / (p + 2), 1 / (n + 2))
    spread = max(1e-9, float(np.std(f)))
    x, ab, weight = np.c_[(f - f.mean()) / spread, np.ones_like(f)], np.zeros(2), np.where(y, 0.2 / p, 0.8 / n)

    def loss(ab: np.ndarray) -> float:
        z = x @ ab
        return float((weight * (np.logaddexp(0, z) - t * z)).sum() + 1e-9 * ab @ ab)

    now = loss(ab)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ ab, -500, 500)))
        g = x.T @ (weight * (q - t)) + 2e-9 * ab
        if np.abs(g).max() < 1e-7:
            break
        step, size = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 2e-9 * np.eye(2), g), 1.0
        while size > 1e-12 and (then := loss(ab - size * step)) > now - 1e-4 * size * (g @ step):
            size /= 2
        if size <= 1e-12:
            break
        ab, now = ab - size * step, then
    if np.abs(g).max() > 1e-4:
        raise RuntimeError("calibration did not settle")
    return float(ab[0] / spread), float(ab[1] - ab[0] * f.mean() / spread)


class Model:
    """``weights``: for each landmark that of its sum and that of its largest value; ``alone``: landmarks that are insults by themselves."""

    def __init__(self, landmarks: list[str], weights: list[float], bias: float, slope: float, offset: float, alone: list[str]):
        self.landmarks, self.weights, self.bias, self.slope, self.offset, self.alone = landmarks, weights, bias, slope, offset, alone


def chosen(texts: list[list[str]], toxic: np.ndarray) -> list[str]:
    """Landmarks: words by how much oftener texts labelled 1 have them, in standard errors, near equals left out.

    Only those that chance doesn't explain: among all words tried, less than CHANCE are expected to be as one-sided.
    """
    pos, neg = Counter(), Counter()
    for t, y in zip(texts, toxic):
        (pos if y else neg).update({w for w in t if ORDER <= len(w) < WINDOW})
    p, n = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))

    def excess(w: str) -> float:
        share = (pos[w] + neg[w] + 0.5) / (p + n + 1)
        return (pos[w] / p - neg[w] / n) / math.sqrt(share * (1 - share) * (1 / p + 1 / n))

    share = p / (p + n)

    def unlikely(w: str) -> bool:
        """So many or more of the word's texts are labelled 1 by chance at most CHANCE times in all the words."""
        k, all_ = pos[w], pos[w] + neg[w]
        tail, term = 0.0, math.exp(math.lgamma(all_ + 1) - math.lgamma(k + 1) - math.lgamma(all_ - k + 1) + k * math.log(share) + (all_ - k) * math.log(1 - share))
        for i in range(k, all_ + 1):
            tail += term
            term *= (all_ - i) / (i + 1) * share / (1 - share)
        return tail * len(pos) < CHANCE

    ranked = sorted(((excess(w), w) for w in pos if pos[w] * n > 4 * neg[w] * p and unlikely(w)), reverse=True)
    out: list[str] = []
    maps: list[dict[int, float]] = []
    for _, w in ranked[: 20 * TELLING]:
        m = subsequences(w)
        if all(_dot(m, o) < 0.95 for o in maps):
            out.append(w)
            maps.append(m)
        if len(out) == TELLING:
            break
    return out


def _faint(values: np.ndarray) -> np.ndarray:
    return np.where(values >= FAINT, values, 0).astype(np.float32)


def _pooled(values: np.ndarray) -> np.ndarray:
    """A text from its different words' kernel values: for each landmark the sum of what exceeds FAINT, and the largest value."""
    if not len(values):
        return np.zeros(2 * values.shape[1], np.float32)
    return np.r_[np.minimum(OFTEN, np.maximum(0, values - FAINT).sum(0) / (1 - FAINT)), values.max(0)].astype(np.float32)


def _with_word(pooled: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Pooled texts with one more word each."""
    n = values.shape[1]
    return np.c_[np.minimum(OFTEN, pooled[:, :n] + np.maximum(0, values - FAINT) / (1 - FAINT)), np.maximum(pooled[:, n:], values)]


def fit(rows: list[tuple[str, int]]) -> Model:
    """From labelled texts: a linear machine over what ``_pooled`` makes of a text, so the kernel of a text and a landmark is the sum of
    the word kernels, and its largest. Labelled texts have several insults, and none in disguise; so that one of those is enough,
    clean texts with one insult put in, as it is and with a character more, count as label 1, too. These insults are landmarks
    that no word of a text labelled 0 resembles."""
    rows = list(dict(rows).items())  # copies once
    toxic = np.array([bool(y) for _, y in rows], bool)
    nothing = Model([], [], 0.0, 0.0, math.log((toxic.sum() + 1) / ((~toxic).sum() + 1)) if len(rows) else -3.0, [])
    if not toxic.any() or toxic.all():
        return nothing
    texts = [list(dict.fromkeys(units(t))) for t, _ in rows]
    words = chosen(texts, toxic)
    if not words:
        return nothing
    every = sorted({w for t in texts for w in t})
    at, marks = {w: k for k, w in enumerate(every)}, Landmarks(words)
    values = _faint(marks.against(every))
    bags = [np.array([at[w] for w in t], np.int64) for t in texts]
    x = np.array([_pooled(values[b]) for b in bags])
    clean = values[np.unique(np.concatenate([b for b, y in zip(bags, toxic) if not y] or [np.zeros(0, np.int64)]))]
    alone = np.flatnonzero(clean.max(0, initial=0.0) < ALONE)
    extra, share = [], [0.5 - PUT_IN * bool(len(alone))]
    if len(alone):
        own = _faint(marks.against([words[k] for k in alone]))
        gapped = _faint(marks.against([words[k][:i] + ANY + words[k][i:] for k in alone for i in range(1, len(words[k]))]))
        pick = np.random.default_rng(0)
        for v in (own, gapped):
            v = np.tile(v, (-(-200 // len(v)), 1))
            extra.append(_with_word(x[~toxic][pick.integers(0, (~toxic).sum(), len(v))], v))
            share.append(PUT_IN / 2)
    parts = [x[toxic], *extra, x[~toxic]]
    z, y = np.concatenate(parts), np.repeat([True] * (len(parts) - 1) + [False], list(map(len, parts)))
    weight = np.concatenate([np.full(len(p), w / len(p)) for p, w in zip(parts, [*share, 0.5])])
    u = _descend(np.c_[z, np.ones(len(z))], np.where(y, 1.0, -1.0), weight)
    slope, offset = _platt(z @ u[:-1] + u[-1], y)
    return Model(words, u[:-1].tolist(), float(u[-1]), slope, offset, [words[k] for k in alone])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.landmarks = model, Landmarks(model.landmarks)
        self.weights = np.array(model.weights)
        self.inside = [w for w in model.alone if len(w) > ORDER]
        self._forget()

    def _forget(self) -> None:
        #: Words met; of those that resemble a landmark the rows of their units; of each unit its row, -1 if it has none.
        self.known: set[str] = set()
        self.near: dict[str, tuple[int, ...]] = {}
        self.unit: dict[str, int] = {}
        self.rows, self.used = np.zeros((1024, len(self.model.landmarks)), np.float32), 0

    def _windows(self, words: list[str]) -> list[tuple[int, str]]:
        """Pieces of words that hold an insult beside another word, at every position: the insult, or with one character put in
        between. Pieces with characters replaced are left out: parts of ordinary words are too often like these."""
        out: set[tuple[int, str]] = set()
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, own in by_length.items():
            marks = [m for m in self.inside if n >= len(m) + ORDER]
            rows = max(1, 2_000_000 // max(1, n))
            for start in range(0, len(own) if marks else 0, rows):
                some = own[start: start + rows]
                chars = np.array([words[k] for k in some], f"U{n}").view(np.uint32).reshape(len(some), n)
                for m in marks:
                    count = np.zeros((len(some), n + 1), np.int32)
                    np.cumsum(np.isin(chars, np.array(list(map(ord, set(m))), np.uint32)), axis=1, out=count[:, 1:])
                    for size in (len(m), len(m) + 1):
                        for r, i in zip(*np.nonzero(count[:, size:] - count[:, :-size] >= len(m))):
                            piece = words[some[r]][i: i + size]
                            if piece == m or any(piece[:j] + piece[j + 1:] == m for j in range(1, len(m))):
                                out.add((some[r], piece))
        return list(out)

    def _values(self, words: list[str]) -> np.ndarray:
        """Kernel values of words as ``cleaned`` gives them, where higher those of the pieces of a longer word."""
        out = np.zeros((len(words), len(self.model.landmarks)), np.float32)
        for start in range(0, len(words), 5_000):
            found = self.landmarks.against(words[start: start + 5_000], FAINT)
            some = np.flatnonzero(found.any(1))
            out[start + some] = _faint(found[some])
        windows = self._windows(words)
        each = list(dict.fromkeys(p for _, p in windows))
        of = dict(zip(each, _faint(self.landmarks.against(each)))) if each else {}
        for k, p in windows:
            out[k] = np.maximum(out[k], of[p])
        return out

    def _learn(self, words: list[str]) -> None:
        letters = [(w,) if w.isalpha() else tuple(u for u in dict.fromkeys([cleaned(w), *parts_of(w)]) if u) for w in words]
        fresh = [u for u in dict.fromkeys(u for x in letters for u in x) if u not in self.unit]
        values = self._values(fresh)
        some = np.flatnonzero(values.any(1))
        self.unit.update(dict.fromkeys(fresh, -1))
        while self.used + len(some) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used: self.used + len(some)] = values[some]
        self.unit.update((fresh[k], self.used + i) for i, k in enumerate(some.tolist()))
        self.used += len(some)
        self.known.update(words)
        rows = ((w, tuple(r for u in x if (r := self.unit[u]) >= 0)) for w, x in zip(words, letters))
        self.near.update((w, r) for w, r in rows if r)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.landmarks:
            return np.full(len(texts), 1 / (1 + math.exp(-self.model.offset)))
        if len(self.known) > REMEMBERED or self.used > RESEMBLING:
            self._forget()
        lists = [set(words_of(t)) for t in texts]
        self._learn(sorted(set().union(*lists) - self.known))
        found = [dict.fromkeys(r for w in sorted(x & self.near.keys()) for r in self.near[w]) for x in lists]
        margin = np.array([_pooled(self.rows[list(x)]) @ self.weights if x else 0.0 for x in found]) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(self.model.slope * margin + self.model.offset, -40, 40)))


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """The worker's own, with the words it knows from earlier tasks."""
    key = (tuple(model.landmarks), tuple(model.weights), model.slope, model.offset)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def train(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """Fit on labelled documents outside ``held_out``, a condition on doc_id: of each label the SAMPLE rows whose hashed ids are
    smallest, whole texts; the driver holds these and nothing else. Null labels, ids and texts are left out."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out).dropDuplicates(["doc_id"])
    ids = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).unionByName(
        known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    return fit([(r["text"], r["toxic"]) for r in sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], r["text"]))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text.

    The kernel of two words is the gap-weighted subsequence kernel of order 3: inserted characters lengthen spans and
    so lower the value smoothly; punctuation inside words is left out and also read as an end of words, letters that stand alone
    are also read as one word, and in words written together insults are also looked for at every position. A text is described
    by the kernel's sum and largest value over its different words, for each landmark (Nyström without whitening), and judged by a linear
    support vector machine; a word longer than WINDOW by its overlapping windows. Null or empty text: no words, the machine's offset
    alone. Repeated rows stay. Empty table: empty result. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = s.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
