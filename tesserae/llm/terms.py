"""Frequency of every distinct term, kept up by signed deltas.

Records are the (project, file) with a non-null token. Added, changed and deleted records are turned into
signed changes of each term's occurrences and record count; unchanged records cancel before anything is
counted. The changes are summed and merged into a persistent table that is partitioned by term hash, so
an update rewrites sums, never recounts the collection. The first load is the delta from nothing.
A record's row has a bit for each hash part that holds terms of it; a part that appears or goes adds or takes its
own bit, so the sum is exact whichever parts a delta names, and the record counts while a bit is left.

Path of a load: runs of rows of one record are packed into lists where they are read (one row a run and
part instead of one a token), lists are brought together by record and part (``PARTS`` hash parts of a record's
terms, so that one huge record is several tasks; records go by a 128-bit hash), exact repeats are dropped, spellings are merged (NFC,
surrounding blanks), and each task pre-aggregates by term before the second, small shuffle.

Defined results: null tokens are no terms and make no record; tokens of blanks only make a record but no
term; null frequencies count as 0; exact repeats of a row count once; null projects or files are values.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.staging import shared_dir, stage

#: A term in fewer records is rare; in more than this share of all records common.
RARE, COMMON = 3, 0.40
#: Hash parts of a record's terms.
PARTS = 4
#: Terms a task holds before it hands its sums on.
HELD = 200_000
#: Partitions of the persistent table.
BUCKETS = 64
#: One in so many records is new, shorter, longer or gone in the update of ``p4_updated``.
CHANGED = 64

#: Signs between packed tokens and for a sign itself; see ``_escaped``.
_SEP, _ESC = "\x1f", "\x1e"
_PACKED = "h1 bigint, h2 bigint, part int, sign int, chunk int, plain boolean, tokens string, freqs string"
_DELTAS = "kind int, key string, occurrences bigint, records bigint"


def normal(token: str) -> str:
    return token.strip() if token.isascii() else unicodedata.normalize("NFC", token).strip()


def _escaped(token: str) -> str:
    """``token`` so that packed tokens can be told apart whatever they hold."""
    return token.replace(_ESC, _ESC + "0").replace(_SEP, _ESC + "1") if _ESC in token or _SEP in token else token


def _unescaped(token: str) -> str:
    return token.replace(_ESC + "1", _SEP).replace(_ESC + "0", _ESC)


def _pack(sign: int):
    """Runs of rows of one record (h1, h2, chunk, token, freq) as one row for each part: tokens and frequencies as joined strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from xxhash import xxh32_intdigest

        parts: dict[str, int] = {}  # -1 - part for tokens that aren't in normal form
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h1, h2, chunk, token, freq = (b.column(i) for i in range(5))
            coded = token.dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(parts) > HELD:
                parts.clear()
            for w in words:
                if w not in parts:
                    v = normal(w)
                    part = xxh32_intdigest(v) % PARTS
                    parts[w] = part if v == w and _ESC not in w and _SEP not in w and w else -1 - part
            of = np.fromiter(map(parts.__getitem__, words), dtype=np.int64, count=len(words))
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero(code >= 0)
            if not len(keep):
                continue
            chunks = chunk.cast(pa.int64()).fill_null(-1 << 40).to_numpy(zero_copy_only=False)
            new = np.zeros(n, dtype=bool)
            for c in (h1.to_numpy(), h2.to_numpy(), chunks):
                new[1:] |= c[1:] != c[:-1]
            part = of[code[keep]]
            plain = part >= 0
            slot = np.cumsum(new)[keep] * PARTS + np.where(plain, part, -1 - part)
            order = np.argsort(slot, kind="stable")
            at, slot = keep[order], slot[order]
            starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
            first, m = pa.array(at[starts]), len(starts)
            shown = pa.array([_escaped(w) for w in words], pa.string())
            tokens = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(shown, pa.array(code[at]))), _SEP)
            freqs = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(freq.cast(pa.int64()).fill_null(0).cast(pa.string()), pa.array(at))), " ")
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(h1, first), pc.take(h2, first), pa.array((slot[starts] % PARTS).astype(np.int32)), pa.array(np.full(m, sign, dtype=np.int32)), pc.take(chunk, first).cast(pa.int32()),
                    pa.array(np.minimum.reduceat(plain[order], starts)), tokens, freqs,
                ],
                ["h1", "h2", "part", "sign", "chunk", "plain", "tokens", "freqs"],
            )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by record and part, so that a record's lists follow each other."""
    import numpy as np

    records: Counter = Counter()  # by term; occurrences are kept as what they exceed the records by
    more: dict[str, int] = {}
    present: list[tuple[str, int]] = []

    def close(key, rows):
        """One record's part: exact repeats are dropped within a sign, equal sides cancel."""
        name = f"{key[0]}:{key[1]}"
        if len(rows) == 1:
            sign, chunk, plain, tokens, freqs = rows[0]
            words = tokens.split(_SEP)
            if plain and sign > 0 and len(set(words)) == len(words):
                records.update(words)
                for w, f in zip(words, freqs.split(" ")):
                    if f != "1":
                        more[w] = more.get(w, 0) + int(f) - 1
                present.append((name, 1 << key[2]))
                return
        sides: list[dict[str, int]] = []
        for sign in (1, -1):
            side: dict[str, int] = {}
            for _, t, f in {(c, t, f) for s, c, _, ts, fs in rows if s == sign for t, f in zip(ts.split(_SEP), fs.split(" "))}:
                w = normal(_unescaped(t))
                side[w] = side.get(w, 0) + int(f)
            sides.append(side)
        if sides[0] == sides[1]:
            return
        for side, sign in zip(sides, (1, -1)):
            if side:
                present.append((name, sign << key[2]))
                for w, f in side.items():
                    if w:
                        records[w] += sign
                        more[w] = more.get(w, 0) + sign * (f - 1)

    def flush():
        kinds = np.concatenate((np.zeros(len(records), dtype=np.int32), np.ones(len(present), dtype=np.int32)))
        keys = [*records, *(k for k, _ in present)]
        rec = [*records.values(), *(s for _, s in present)]
        occ = [*(n + more.get(w, 0) for w, n in records.items()), *([0] * len(present))]
        out = pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], ["kind", "key", "occurrences", "records"])
        records.clear()
        more.clear()
        present.clear()
        return out

    last, rows = None, []
    for b in batches:
        for h1, h2, part, *row in zip(*(b.column(i).to_pylist() for i in range(8))):
            key = (h1, h2, part)
            if key != last:
                if rows:
                    close(last, rows)
                last, rows = key, []
            rows.append(row)
        if len(records) > HELD or len(present) > HELD:
            yield flush()
    if rows:
        close(last, rows)
    yield flush()


def term_deltas(added: DataFrame | None, removed: DataFrame | None = None) -> DataFrame:
    """Signed sums (kind, key, occurrences, records): kind 0 of terms, kind 1 of the parts that hold terms of a record (``records`` are bits).

    ``added`` and ``removed`` hold the rows (project, file, chunk, token, freq) of the new and old state of
    the records that may have changed."""
    packed = None
    for rows, sign in ((added, 1), (removed, -1)):
        if rows is not None:
            record = (F.xxhash64("project", F.isnull("project"), "file"), F.xxhash64(F.lit(1), "file", F.isnull("file"), "project"))
            p = rows.select(record[0].alias("h1"), record[1].alias("h2"), "chunk", "token", "freq").mapInArrow(_pack(sign), _PACKED)
            packed = p if packed is None else packed.unionByName(p)
    sorted_runs = packed.repartition("h1", "h2", "part").sortWithinPartitions("h1", "h2", "part")
    return sorted_runs.mapInArrow(_count, _DELTAS).groupBy("kind", "key").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def merge(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The state (kind, key, occurrences, records) after ``deltas``; terms and records that are gone are dropped."""
    if state is None:
        return deltas.where("records <> 0 or occurrences <> 0")
    both = state.select("kind", "key", "occurrences", "records").unionByName(deltas)
    return both.groupBy("kind", "key").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")


def save(state: DataFrame, path: str) -> None:
    """Write a state, partitioned by key hash, for later merges."""
    state.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def marked(state: DataFrame) -> DataFrame:
    """(token, occurrences, records, mark): mark is rare, common or null. One number, the record count, goes to the driver."""
    total = state.where("kind = 1").count()
    mark = F.when(F.col("records") < RARE, "rare").when(F.col("records") > COMMON * total, "common")
    return state.where("kind = 0").select(F.col("key").alias("token"), "occurrences", "records", mark.alias("mark"))


def p4_terms(spark, sf_dir: str) -> DataFrame:
    state = stage(merge(None, term_deltas(spark.read.parquet(f"{sf_dir}/partial_vocab.parquet"))), "terms")
    return marked(state)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return p4_terms(spark, sf_dir).where("mark is not null").select("token", "mark")


def before_update(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, added, removed): an earlier state of ``rows`` and the two sides of the records that differ. Of each
    ``CHANGED`` records, one isn't there yet, one has only a part of its terms, one has more terms, and one has a twin that goes."""
    at = F.pmod(F.xxhash64("project", "file"), F.lit(CHANGED))
    shorter = (at == 1) & (F.pmod(F.xxhash64("token"), F.lit(3)) == 0)
    longer, twin = F.concat("token", F.lit("_old")), F.concat(F.coalesce("file", F.lit("")), F.lit(".old"))
    few = rows.where(at.isin(2, 3)).withColumns({"token": F.when(at == 2, longer).otherwise(F.col("token")), "file": F.when(at == 3, twin).otherwise(F.col("file"))})
    return rows.where((at >= 2) | shorter).unionByName(few), rows.where(at < 3), rows.where((at == 2) | shorter).unionByName(few)


def p4_updated(spark, sf_dir: str) -> DataFrame:
    """The terms after an earlier state of the table was saved, read again and brought up to date by the delta of its changed records."""
    rows = spark.read.parquet(f"{sf_dir}/partial_vocab.parquet").select("chunk", "project", "file", "token", "freq")
    old, added, removed = before_update(rows)
    path = f"{shared_dir(spark).rstrip('/')}/term_state-{uuid.uuid4().hex}"
    save(merge(None, term_deltas(old)), path)
    return marked(stage(merge(spark.read.parquet(path), term_deltas(added, removed)), "terms"))
