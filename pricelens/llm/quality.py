"""Quality rules (operator 10): fixed limits, and robust multivariate outliers per language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, without

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Probability of the chi-square bound.
BOUND = 0.999


def _chi_square(q: float, p: float) -> float:
    return p * max(0.0, 1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def _alone(share: float) -> float:
    """The standard deviation with which ``share`` of a statistic that is zero in all other rows reaches the bound by itself."""
    return float(np.log1p(100 * share)) / _chi_square(BOUND, 6) ** 0.5


#: Dimensions of the statistic vector, and the least standard deviation that each is given. Word length and capitals spread
#: in every cell, so theirs only keep the matrix invertible. The others are zero in most clean documents and would reject every
#: document in which they aren't: theirs let that share of symbols, double lines, repeats or digits reject alone.
DIMS = {"word_length": 0.01, "symbols": _alone(0.05), "dup_lines": _alone(0.3), "repeats": _alone(0.3), "upper": 0.05, "digits": _alone(0.15)}
P = len(DIMS)
#: Share of the rows that the estimates rest on; concentration steps.
H, STEPS = 0.75, 5
#: Rows that a source's language counts for in the source's estimate, all languages in the language's, and ``WIDE`` in theirs.
PRIOR = 200
#: Spread of each dimension where nothing is known.
WIDE = 2.0
#: Sources whose estimates (half a kilobyte each) are broadcast.
BROADCAST_CELLS = 20_000


def repeated_words(words: list[bytes], n: int = 8) -> int:
    """Words in windows of ``n`` that occur twice or more. Windows are hashed; those whose hashes meet are compared as words."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k: k + m]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    met = np.zeros(m, bool)
    met[order[1:][same]] = met[order[:-1][same]] = True
    at = np.flatnonzero(met)
    keys = [b" ".join(words[i: i + n]) for i in at.tolist()]
    count = Counter(keys)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, k in zip(at.tolist(), keys):
        if count[k] > 1:
            edge[i] += 1
            edge[i + n] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics_of(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, letters A-Z, digits 0-9."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = sum(map(raw.count, map(str.encode, SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, digits


def _vector(s: tuple[int, ...]) -> list[float] | None:
    n, chars, symbols, dups, repeats, lines, upper, digits = s
    if not n:
        return None
    share = lambda a, b: float(np.log1p(100 * a / b))
    return [float(np.log(chars / n)), share(symbols, chars), share(dups, lines), share(repeats, n), share(upper, chars), share(digits, chars)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "lang", "source", "tk", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "v"]
    for batch in batches:
        rows = [statistics_of(t.as_py() or "") for t in batch.column(4)]
        counts = list(zip(*rows)) or [[] for _ in range(8)]
        arrays = [batch.column(k) for k in range(4)] + [pa.array(counts[k], pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([_vector(s) for s in rows], pa.list_(pa.float64()))], names=names)


def measured(docs: DataFrame) -> DataFrame:
    """Counts and the transformed vector of every whole text; ``tk`` tells rows with the same doc_id and different texts apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.xxhash64("text").alias("tk"), F.col("text"),
    ).mapInArrow(_measure, "doc_id long, lang string, source string, tk long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, v array<double>")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _distance(v: str, mean: str, inverse: str) -> Column:
    d = [F.col(v)[i] - F.col(mean)[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        row = F.lit(0.0)
        for j in range(P):
            row = row + F.col(inverse)[i * P + j] * d[j]
        total = total + d[i] * row
    return total


MOMENTS = "lang string, source string, n double, mean array<double>, cov array<double>, log_factor double"


def _moments(key: tuple, n: float, mean: np.ndarray, cov: np.ndarray, log_factor: float) -> pd.DataFrame:
    lang, source = (None if pd.isna(k) else k for k in key)
    return pd.DataFrame({"lang": [lang], "source": [source], "n": [float(n)], "mean": [mean.tolist()], "cov": [cov.ravel().tolist()], "log_factor": [log_factor]})


def _start(key, bins: pd.DataFrame) -> pd.DataFrame:
    """Median and quartile range of each dimension, from counts per bin."""
    mean, width = np.zeros(P), np.ones(P)
    for k, part in bins.groupby("dim"):
        part = part.sort_values("bin")
        cum = part["n"].cumsum().to_numpy()
        at = [part["bin"].iloc[int(np.searchsorted(cum, q * cum[-1]))] * 0.02 for q in (0.25, 0.5, 0.75)]
        mean[int(k)], width[int(k)] = at[1], (at[2] - at[0]) / 1.349
    return _moments(key, bins["n"].sum() / P, mean, np.diag(width**2), 0.0)


def _step(key, bins: pd.DataFrame) -> pd.DataFrame:
    """Mean and second moments of the nearest share H: whole bins of distance, the last one that it takes included; and the
    consistency factor that brings the median distance to a chi-square variable's."""
    bins = bins.sort_values("bin")
    cum = bins["n"].cumsum().to_numpy()
    last = int(np.searchsorted(cum, H * cum[-1]))
    near = bins.iloc[: last + 1]
    n = near["n"].sum()
    mean = near[[f"s{i}" for i in range(P)]].sum().to_numpy() / n
    second = np.empty((P, P))
    for i in range(P):
        for j in range(i, P):
            second[i, j] = second[j, i] = near[f"q{i}_{j}"].sum() / n
    median = 2 ** ((bins["bin"].iloc[int(np.searchsorted(cum, 0.5 * cum[-1]))] + 0.5) / 8)
    log_factor, free = bins["log_factor"].sum() / cum[-1], bins["free"].sum() / cum[-1]
    log_factor += np.log(median / _chi_square(0.5, max(1.0, free)))
    return _moments(key, cum[-1], mean, second - np.outer(mean, mean), float(np.clip(log_factor, np.log(0.1), np.log(10))))


def _towards(own: tuple, other: tuple) -> tuple:
    """(n, mean, covariance, logarithm of the factor), mixed with PRIOR rows like those of ``other``."""
    w = own[0] / (own[0] + PRIOR)
    return own[0], *(w * a + (1 - w) * b for a, b in zip(own[1:], other[1:]))


def _estimates(whole: tuple | None):
    """Maps moments of a source and of its language to the source's mean and inverse covariance, given those of all rows.

    The factor scales the estimate, not the floors; ``free`` counts the dimensions whose spread is the estimate's rather than the floor's.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                top = (0.0, whole[1], np.eye(P) * WIDE**2, 0.0)
                language = _towards((r.n_lang, np.array(r.mean_lang), np.array(r.cov_lang).reshape(P, P), r.log_factor_lang), _towards(whole, top))
                _, mean, cov, log_factor = _towards((r.n, np.array(r.mean), np.array(r.cov).reshape(P, P), r.log_factor), language)
                cov = np.exp(log_factor) * cov
                full = cov + np.diag(np.square(list(DIMS.values())))
                out.append((r.lang, r.source, mean.tolist(), np.linalg.inv(full).ravel().tolist(), log_factor, float(np.trace(np.linalg.solve(full, cov)))))
            yield pd.DataFrame(out, columns=["lang", "source", "mean", "inverse", "log_factor", "free"])

    return run


def _per_level(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per source, per language (source null) and of everything (both null), from sums per source and ``keys``."""
    none = F.lit(None).cast("string")
    levels = F.array(*[F.struct(a.alias("lang"), b.alias("source")) for a, b in ((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none))])
    values = [c for c in parts.columns if c not in ("lang", "source", *keys)]
    return parts.withColumn("level", F.explode(levels)).groupBy("level.lang", "level.source", *keys).agg(*[F.sum(c).alias(c) for c in values])


def _state(moments: DataFrame) -> DataFrame:
    """Estimates per source from stored moments of all levels; those of all rows, some fifty numbers, come to the driver."""
    top = moments.where("lang is null").first()
    whole = None if top is None else (top["n"], np.array(top["mean"]), np.array(top["cov"]).reshape(P, P), top["log_factor"])
    languages = moments.where("lang is not null and source is null").drop("source").withColumnsRenamed({c: f"{c}_lang" for c in ("n", "mean", "cov", "log_factor")})
    return moments.where("source is not null").join(languages, "lang").mapInPandas(
        _estimates(whole), "lang string, source string, mean array<double>, inverse array<double>, log_factor double, free double")


def robust_distances(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance from the minimum-covariance-determinant estimates of the row's language and
    source; null without a vector.

    The search starts at medians and quartile ranges and takes STEPS concentration steps: in each, every row's distance is
    binned (8 bins per doubling), the bins' counts and moments are summed per source with map-side combine, and the
    estimates of the nearest share H come from a source's bins alone, of which there are at most some hundreds. No source's rows
    ever meet in one task. The same bins, summed further, give the estimates per language and of all rows, and each
    estimate is mixed with PRIOR rows like those of the level above: sources of any size are judged in the same way, large ones by
    themselves, small ones by their language, and next to nothing is rejected where there are only a few rows in all. The consistency
    factor, over or under 1, brings the median distance to that of a chi-square variable of as many dimensions as spread.
    """
    key = ["lang", "source"]
    usable = rows.where("v is not null").select(*key, "v")
    bins = usable.select(*key, F.posexplode("v").alias("dim", "x")).groupBy(*key, "dim", F.floor(F.col("x") / 0.02).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    moments = settled(_per_level(bins, ["dim", "bin"]).groupBy(*key).applyInPandas(_start, MOMENTS))
    # a few numbers per source: sent to every task while they are few, so that a hot source isn't dealt to one; else Spark joins and splits
    small = (lambda df: F.broadcast(df)) if moments.count() <= BROADCAST_CELLS else (lambda df: df)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("log_factor").alias("log_factor"), F.sum("free").alias("free"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(P)],
            *[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"q{i}_{j}") for i in range(P) for j in range(i, P)]]
    for _ in range(STEPS):
        near = usable.join(small(_state(moments)), key).withColumn("bin", F.floor(F.log2(F.greatest(_distance("v", "mean", "inverse"), F.lit(2.0**-10))) * 8))
        moments = settled(_per_level(near.groupBy(*key, "bin").agg(*sums), ["bin"]).groupBy(*key).applyInPandas(_step, MOMENTS))
    return rows.join(small(_state(moments)), key, "left").withColumn("d2", _distance("v", "mean", "inverse")).drop("mean", "inverse", "log_factor", "free", "v")


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, the counts, base_failed, kept, d2): kept unless a base limit fails or the distance is over the chi-square bound.

    ``docs`` has doc_id, text, lang, source. Null or empty text: no words, so base_failed. Null lang or source: the empty
    string. Repeated rows stay and count as often as they occur. A few rows in all: judged by wide spreads, see ``PRIOR``.
    Empty table: empty result. Other columns are ignored.
    """
    out = robust_distances(settled(measured(docs)))
    far = F.coalesce(F.col("d2") > _chi_square(BOUND, P), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | far))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns, whatever these are called.

    A rejected row goes with all its repetitions; null doc_ids are compared like others. Null or empty text: rejected. Empty table:
    empty result.
    """
    return without(docs, assess(docs).where("not kept").select("doc_id", "tk"))
