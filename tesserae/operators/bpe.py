"""Byte-pair encoding: pair statistics, learning, encoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import code, markers, text
from tesserae.plans.staging import stage


def splittable(vocab: DataFrame) -> DataFrame:
    """Without placeholders and special tokens, which are never split."""
    return vocab.where(~F.col("token").isin(*markers.ALL, *markers.ONE_SIGN, *markers.TWO_SIGNS, *markers.ONE_SIGN_VERBOSE, *markers.COMMENT_MARKS, "\t", "\n", "\\t", "\\n", ""))


def pair_statistics(words: DataFrame) -> DataFrame:
    """(left, right, freq) over words (symbols, freq)."""
    p = words.select(F.explode(text.pairs(F.col("symbols"))).alias("p"), "freq")
    return p.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("freq").alias("freq"))


def symbols(vocab: DataFrame) -> DataFrame:
    return vocab.select("token", "freq", F.filter(F.split("token", ""), lambda c: c != "").alias("symbols"))


def merge_pair(words: DataFrame, left: str, right: str) -> DataFrame:
    """Join every occurrence of the pair, from the left, within the symbol arrays."""
    def step(acc, s):
        n = F.size(acc)
        hit = (n > 0) & (F.element_at(acc, F.when(n > 0, n).otherwise(1)) == left) & (s == right)
        return F.when(hit, F.array_append(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.lit(left + right))).otherwise(F.array_append(acc, s))
    # a joined symbol equals ``left`` only if right is empty, so one pass from the left is the merge
    return words.withColumn("symbols", F.aggregate("symbols", F.array().cast("array<string>"), step))


#: Words whose pairs are looked at together; only memory depends on it.
BLOCK_WORDS = 250_000


def learn(vocab: DataFrame, n_merges: int, words_in_task: int = 4_000_000, every: int = 20, known: DataFrame | None = None) -> DataFrame:
    """(rank, left, right, freq): the most frequent pair is merged, again and again; ties by pair.

    A vocabulary is far smaller than its corpus. It is written once; up to ``words_in_task`` words (checked) one task
    learns on it, on flat arrays; beyond that each merge is an aggregation over the distributed words,
    with the lineage cut every so many merges. Both give the same merges. ``known`` merges are kept as the first
    ones, and learning goes on behind them; a list of merges is a model of ``n_merges`` rows at most and is learnt once, in this call."""
    words, spark = stage(splittable(vocab).select("token", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq")), "bpe-words"), vocab.sparkSession
    done = [] if known is None else [tuple(r) for r in known.where(F.col("rank") < n_merges).select("rank", "left", "right", "freq").orderBy("rank").collect()]
    ranks = {(left, right): rank for rank, left, right, _ in done}
    schema = "rank int, left string, right string, freq bigint"
    if words.count() <= words_in_task:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _learned(((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches), n_merges - len(done), ranks)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], ["rank", "left", "right", "freq"])

        rows = words.coalesce(1).mapInArrow(run, schema).collect()
        return spark.createDataFrame([*done, *((rank + len(done), *rest) for rank, *rest in sorted(map(tuple, rows)))], schema)
    start = encode(words, known).join(words, "token").select("token", "freq", F.col("subwords").alias("symbols")) if done else symbols(words)
    rows, current = done, stage(start, "bpe")
    for rank in range(len(done), n_merges):
        best = pair_statistics(current).orderBy(F.desc("freq"), "left", "right").first()
        if best is None:
            break
        rows.append((rank, best["left"], best["right"], best["freq"]))
        current = merge_pair(current, best["left"], best["right"])
        if rank % every == every - 1:
            current = stage(current, "bpe")
    return spark.createDataFrame(rows, schema)


def learned(vocab: list[tuple[str, int]], n_merges: int, known: dict[tuple[str, str], int] | None = None) -> list[tuple[int, str, str, int]]:
    """Merges of a vocabulary in memory, behind those of ``known``."""
    return _learned([([t for t, _ in vocab], [n for _, n in vocab])], n_merges, known)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of equal keys in it, keys, sums of weights)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order, starts, keys[starts], np.add.reduceat(weights[order], starts) if len(keys) else weights[:0]


def _learned(chunks: Iterable[tuple[list[str], list[int]]], n_merges: int, known: dict[tuple[str, str], int] | None = None) -> list[tuple[int, str, str, int]]:
    """Words are flat arrays of symbols; each pair has the words it may stand in. Counts of pairs are kept up by the words a merge touches, the top pair comes from a lazily cleaned heap."""
    first = 0x110000  # symbols below it are characters
    names: list[str] = []
    ids: dict[str, int] = {}

    def number(s: str) -> int:
        if len(s) == 1:
            return ord(s)
        if s not in ids:
            ids[s] = first + len(names)
            names.append(s)
        return ids[s]

    flat, lengths, numbers = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for tokens, freqs in chunks:
        parts = [code.merge_word(t, known) for t in tokens] if known else tokens
        flat.append(np.array([number(s) for w in parts for s in w], np.int32) if known else np.frombuffer("".join(tokens).encode("utf-32-le"), np.int32))
        lengths.append(np.array([len(w) for w in parts], np.int32))
        numbers.append(np.array(freqs, np.int64))
    symbol, size, freq = np.concatenate(flat), np.concatenate(lengths), np.concatenate(numbers)
    del flat, lengths, numbers
    start = np.cumsum(size, dtype=np.int64) - size
    name = lambda i: chr(i) if i < first else names[i - first]

    def places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in ``words``) of each symbol of some words."""
        n = size[words]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), n)
        return np.repeat(start[words] - (np.cumsum(n, dtype=np.int64) - n), n) + np.arange(len(owner)), owner

    def pairs(s: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair as one number, index of its word)."""
        inner = owner[1:] == owner[:-1]
        return ((s[:-1].astype(np.int64) << 32) | s[1:])[inner], owner[:-1][inner]

    count: dict[int, int] = {}
    where: dict[int, list[np.ndarray]] = {}

    def note(keys: np.ndarray, words: np.ndarray) -> None:
        order, starts, distinct, _ = _sums(keys, words)
        for k, w in zip(distinct.tolist(), np.split(words[order], starts[1:])):
            where.setdefault(k, []).append(w.copy())

    for at in range(0, len(size), BLOCK_WORDS):
        words = np.arange(at, min(at + BLOCK_WORDS, len(size)), dtype=np.int32)
        place, owner = places(words)
        keys, own = pairs(symbol[place], owner)
        _, _, distinct, n = _sums(keys, freq[words[own]])
        for k, x in zip(distinct.tolist(), n.tolist()):
            count[k] = count.get(k, 0) + x
        note(keys, words[own])
    entry = lambda k: (-count[k], (name(k >> 32), name(k & 0xFFFFFFFF)), k)
    heap = [entry(k) for k in count]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < n_merges:
        n, (left, right), key = heapq.heappop(heap)
        if count.get(key, 0) != -n or not n:
            continue
        out.append((len(out), left, right, -n))
        a, b, new = key >> 32, key & 0xFFFFFFFF, number(left + right)
        touched = np.unique(np.concatenate(where.pop(key)))
        changed: dict[int, int] = {}
        for at in range(0, len(touched), BLOCK_WORDS):
            words = touched[at:at + BLOCK_WORDS]
            place, owner = places(words)
            s = symbol[place]
            hits = np.flatnonzero((s[:-1] == a) & (s[1:] == b) & (owner[1:] == owner[:-1]))
            if a == b and len(hits):  # of a run, every second one, from the left
                begin = np.concatenate(([True], np.diff(hits) != 1))
                hits = hits[(hits - np.maximum.accumulate(np.where(begin, hits, 0))) % 2 == 0]
            before, own = pairs(s, owner)
            keep = np.ones(len(s), bool)
            s[hits] = new
            keep[hits + 1] = False
            old, s, owner = own, s[keep], owner[keep]
            size[words] = np.bincount(owner, minlength=len(words))
            symbol[places(words)[0]] = s
            after, own = pairs(s, owner)
            _, _, distinct, d = _sums(np.concatenate((before, after)), np.concatenate((-freq[words[old]], freq[words[own]])))
            for k, x in zip(distinct[d != 0].tolist(), d[d != 0].tolist()):
                changed[k] = changed.get(k, 0) + x
            made = ((after >> 32) == new) | ((after & 0xFFFFFFFF) == new)
            note(after[made], words[own[made]])
        for k, d in changed.items():
            if d:
                count[k] = count.get(k, 0) + d
                if count[k] > 0:
                    heapq.heappush(heap, entry(k))
        count.pop(key, None)
    return out


def encode(words: DataFrame, merges: DataFrame, n_merges: int | None = None) -> DataFrame:
    """(token, subwords) for distinct words; merges are a model of a fixed number of rows (``n_merges`` of them, or all) and are broadcast."""
    m = merges if n_merges is None else merges.where(F.col("rank") < n_merges)
    ranks = words.sparkSession.sparkContext.broadcast({(r["left"], r["right"]): r["rank"] for r in m.select("rank", "left", "right").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [code.merge_word(t, ranks.value) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["token", "subwords"])

    return words.select("token").where("token is not null").distinct().mapInArrow(run, "token string, subwords array<string>")


def subword_vocabulary(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, freq) of the subwords of a vocabulary."""
    j = vocab.join(encoded, "token").select(F.explode("subwords").alias("token"), "freq")
    return j.groupBy("token").agg(F.sum("freq").alias("freq"))
