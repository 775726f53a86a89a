"""Splitting of same-case words into known words, scored by frequency and length."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    alpha: float = 9.0
    beta: float = 5.0
    gamma: float = 3.0
    power: float = 1.8
    theta: float = 2.0
    known: float = 10.0
    usual_length: float = 4.94


#: Up to this length, at most so many parts; and the bounds of a typo candidate.
MOST_PARTS = [(10, 5), (15, 6), (30, 7), (math.inf, 8)]
TYPO = {"whole": 10.0, "result": 4.0, "length": 8}


def weight(word: str, freq: float, whole: bool, known: bool, w: Weights) -> float:
    off = len(word) - w.usual_length
    by_freq = math.log(freq + w.alpha) ** w.theta * (w.known if whole and known else 1)
    return by_freq / math.log((off if off >= 0 else -w.beta * off) + w.gamma)


def best_split(word: str, freq: float, freqs: dict[str, float], general, w: Weights = Weights()) -> tuple[str, list[str], float]:
    """(outcome, parts, score): outcome is ``split``, ``keep`` or ``typo``. The best of all segmentations is found by
    dynamic programming over (end, number of parts): the score divides the sum of weights by a power of
    the number, so the best sum for each number is enough."""
    n, most = len(word), next(m for length, m in MOST_PARTS if len(word) <= length)
    whole = weight(word, freq, True, word in general, w)
    best: list[dict[int, tuple[float, int]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0.0, 0)
    for end in range(1, n + 1):
        for start in range(end):
            part = word[start:end]
            if part in freqs and not (start == 0 and end == n):
                s = weight(part, freqs[part], False, False, w)
                for k, (total, _) in best[start].items():
                    if k < most and (k + 1 not in best[end] or total + s > best[end][k + 1][0]):
                        best[end][k + 1] = (total + s, start)
    options = [(1.0 if word in freqs else 0.0, 1)] + [(t / k**w.power / whole, k) for k, (t, _) in best[n].items() if k > 1]
    score, k = max(options, key=lambda x: (x[0], -x[1]))
    if whole < TYPO["whole"] and score < TYPO["result"] and n >= TYPO["length"]:
        return "typo", [word], score
    if score <= 1 or k == 1:
        return "keep", [word], score
    parts, end = [], n
    while k:
        start = best[end][k][1]
        parts.append(word[start:end])
        end, k = start, k - 1
    return "split", parts[::-1], score


#: Bits of the signature of a vocabulary as a power of two (a table of 32 MB): a part whose bit isn't set is no word. Only speed depends on it.
SIGNATURE_BITS = 28


def _bit(word: Column) -> Column:
    return F.crc32(word.cast("binary")).bitwiseAND(F.lit((1 << SIGNATURE_BITS) - 1))


def _signature(vocab: DataFrame) -> np.ndarray:
    """Bits of the words' checksums, of a size that doesn't depend on their number."""
    at = vocab.where("token is not null").select(_bit(F.col("token")).alias("b"))
    rows = at.groupBy(F.shiftright("b", 5).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (SIGNATURE_BITS - 5), np.uint32)
    out[rows["i"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def _own_frequencies(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``words`` with (parts, freqs): the vocabulary's words within each word and their frequencies, by a join."""
    shared, mask = words.sparkSession.sparkContext.broadcast(_signature(vocab)), (1 << SIGNATURE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            rows = []
            for token in b.column(0):
                t = token.as_py()
                parts = {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
                rows += [(t, p) for p in parts if bits[(h := crc32(p.encode()) & mask) >> 5] >> (h & 31) & 1]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["token", "part"])
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["token", "part"])

    pairs = words.select("token").distinct().mapInArrow(run, "token string, part string")
    freqs = vocab.where("token is not null").groupBy(F.col("token").alias("part")).agg(F.max("freq").alias("n"))
    own = pairs.join(freqs, "part").groupBy("token").agg(F.collect_list(F.struct("part", "n")).alias("own"))
    return words.join(own.select("token", F.col("own.part").alias("parts"), F.col("own.n").alias("freqs")), "token", "left")


def split_words(vocab: DataFrame, general: DataFrame, cache: DataFrame | None = None, w: Weights = Weights(), most_words: int = 2_000_000) -> DataFrame:
    """(token, outcome, parts, score) of each word of a vocabulary (token, freq).

    Cached words and dictionary words of four letters or more keep what is known. The frequencies are a
    vocabulary, broadcast up to ``most_words`` words (checked) and joined beyond: each word then brings the known words within it along. Both give the same splits."""
    known = vocab.select("token", "freq").where("token is not null").limit(most_words + 1).toArrow()
    joined = known.num_rows > most_words
    shared = vocab.sparkSession.sparkContext.broadcast({} if joined else dict(zip(known["token"].to_pylist(), known["freq"].to_pylist())))
    del known
    words = vocab.select("token", "freq").where("token is not null and token <> ''")
    words = words.join(general.select("token", F.lit(True).alias("general")).distinct(), "token", "left")
    if cache is None:
        words = words.withColumn("cached", F.lit(None).cast("array<string>"))
    else:
        words = words.join(cache.groupBy("token").agg(F.min("parts").alias("cached")), "token", "left")
    if joined:
        words = _own_frequencies(words, vocab)
    else:
        words = words.withColumn("parts", F.lit(None).cast("array<string>")).withColumn("freqs", F.lit(None).cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs = shared.value
        for b in batches:
            rows = []
            for row in zip(*(b.column(i) for i in range(6))):
                t, n, general, cached, parts, numbers = (x.as_py() for x in row)
                if cached is not None:
                    rows.append((t, "split" if len(cached) > 1 else "keep", cached, 0.0))
                elif general and len(t) >= 4:
                    rows.append((t, "keep", [t], 0.0))
                else:
                    rows.append((t, *best_split(t, n, dict(zip(parts, numbers)) if joined else freqs, {t} if general else (), w)))
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["token", "outcome", "parts", "score"])

    return words.select("token", "freq", "general", "cached", "parts", "freqs").mapInArrow(run, "token string, outcome string, parts array<string>, score double")


def error_statistics(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Splits (word, parts) against hand-made ones; null parts are words kept whole. Rates and the weighted error."""
    a, e = actual.select("word", F.col("parts").alias("a"), F.lit(True).alias("in_a")), expected.select("word", F.col("parts").alias("e"), F.lit(True).alias("in_e"))
    j = a.join(e, "word", "full_outer")
    split_a, split_e = F.col("in_a") & F.col("a").isNotNull(), F.coalesce(F.col("e").isNotNull(), F.lit(False))
    kept_a = F.col("in_a") & F.col("a").isNull()
    kept_e = F.col("in_e") & F.col("e").isNull()
    n = j.agg(
        F.count_if(split_a & split_e & (F.col("a") == F.col("e"))).alias("tp_same"), F.count_if(split_a & split_e & (F.col("a") != F.col("e"))).alias("tp_not_same"), F.count_if(split_a & ~split_e).alias("fp"),
        F.count_if(kept_a & F.coalesce(kept_e, F.lit(False))).alias("tn"), F.count_if(kept_a & ~F.coalesce(kept_e, F.lit(False))).alias("fn"), F.count_if("in_e").alias("total"),
    )
    rate = lambda c: F.round(F.try_divide(F.col(c), F.col("total")), 6)
    return n.select("*", rate("fp").alias("fp_error"), rate("fn").alias("fn_error"), rate("tp_not_same").alias("not_same_error")).withColumn(
        "weighted", F.round(0.6 * F.try_divide("tp_not_same", "total") + 0.2 * F.try_divide("fp", "total") + 0.2 * F.try_divide("fn", "total"), 6)
    )
