"""Language statistics of files and what is decided by them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.code import Token, is_foreign

#: Default thresholds: share, words, distinct words of code; the same of code with strings.
THRESHOLDS = (0.006, 2.01, 2.01, 0.019, 3.939599999999999, 2.01)
SAMPLE = 15


def statistics(tokens: DataFrame, foreign: Column, *by: str) -> DataFrame:
    """Words, distinct words, foreign ones and both shares per group, with up to ``SAMPLE`` foreign words.
    Counts are made per word first, so that a group's words are spread over tasks."""
    each = tokens.groupBy(*by, "token").agg(F.count("*").alias("n"), F.first(foreign).alias("foreign"))
    bad = F.col("foreign")
    out = each.groupBy(*by).agg(
        F.sum("n").alias("total"), F.count("*").alias("total_uq"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("non_eng"), F.count_if(bad).alias("non_eng_uq"),
        F.array_join(F.slice(F.sort_array(F.collect_set(F.when(bad, F.col("token")))), 1, SAMPLE), ",").alias("sample"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return out.withColumn("percent", share("non_eng", "total")).withColumn("percent_uq", share("non_eng_uq", "total_uq"))


def foreign_files(stats: DataFrame, t: tuple = THRESHOLDS, inclusive: bool = False) -> DataFrame:
    """Files beyond the thresholds; ``inclusive`` as in the threshold search, exclusive as in the store."""
    over = (lambda c, v: F.col(c).cast("double") >= v) if inclusive else (lambda c, v: F.col(c).cast("double") > v)
    code = over("code_percent", t[0]) & over("code_non_eng", t[1]) & over("code_non_eng_uq", t[2])
    strings = over("code_str_percent", t[3]) & over("code_str_non_eng", t[4]) & over("code_str_non_eng_uq", t[5])
    return stats.where(code | strings)


def threshold_metrics(tagged: DataFrame, grid: DataFrame) -> DataFrame:
    """Precision, recall and their mean for each threshold vector (id, a, b, c, d, e, f): the grid is a small
    table of parameters, so each file is tested against it where it is read, and only counts are shuffled."""
    g = F.broadcast(grid)
    over = lambda c, v: F.col(c).cast("double") >= F.col(v)
    hit = (over("code_percent", "a") & over("code_non_eng", "b") & over("code_non_eng_uq", "c")) | (over("code_str_percent", "d") & over("code_str_non_eng", "e") & over("code_str_non_eng_uq", "f"))
    n = tagged.join(g).groupBy("id").agg(F.count_if(hit & F.col("noneng")).alias("tp"), F.count_if(hit).alias("selected"), F.count_if(F.col("noneng")).alias("relevant"))
    p, r = F.coalesce(F.try_divide("tp", "selected"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "relevant"), F.lit(0.0))
    return n.select("id", "tp", "selected", "relevant", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round((p + r) / 2, 6).alias("metric"))


#: The three readings of a file, by the contexts of the words that count (null: code).
CONFIGURATIONS = {"code": (None,), "code_str": (None, "string"), "code_str_com": (None, "string", "comment")}


def by_context(tokens: DataFrame, *by: str) -> DataFrame:
    """Words, distinct words, foreign ones and their shares per group of code alone, with strings, and with comments too,
    from (by..., token, ctx, foreign), in one pass: a word is counted once a group and context, then once a group with the contexts it stands in."""
    each = tokens.groupBy(*by, "token").agg(
        F.first("foreign").alias("foreign"), F.count_if(F.col("ctx").isNull()).alias("c0"), F.count_if(F.col("ctx") == "string").alias("c1"), F.count_if(F.col("ctx") == "comment").alias("c2")
    )
    out = []
    for i, name in enumerate(CONFIGURATIONS):
        n = sum((F.col(f"c{k}") for k in range(1, i + 1)), F.col("c0"))
        bad = F.coalesce(F.col("foreign"), F.lit(False))
        out += [
            F.sum(n).alias(f"{name}_total"), F.count_if(n > 0).alias(f"{name}_total_uq"), F.sum(F.when(bad, n).otherwise(0)).alias(f"{name}_non_eng"), F.count_if(bad & (n > 0)).alias(f"{name}_non_eng_uq"),
        ]
    return _shares(each.groupBy(*by).agg(*out))


def _shares(rows: DataFrame) -> DataFrame:
    for name in CONFIGURATIONS:
        for end in ("", "_uq"):
            rows = rows.withColumn(f"{name}_percent{end}", F.round(F.coalesce(F.try_divide(f"{name}_non_eng{end}", f"{name}_total{end}"), F.lit(0.0)), 6))
    return rows


#: Columns of ``word_counts``: one row a file, whose arrays run over its distinct words.
WORD_COUNTS = {"token": "array<string>", "foreign": "array<boolean>", "code": "array<int>", "string": "array<int>", "comment": "array<int>"}


def word_counts(tokens: list[Token]) -> list[tuple]:
    """The identifiers of a parsed file with their counts by context, and whether they are foreign; no row without identifiers."""
    words: dict[str, list] = {}
    for t in tokens:
        if t.kind == "ident":
            w = words.setdefault(t.text, [is_foreign(t), 0, 0, 0])
            w[1 if t.ctx is None else 2 if t.ctx == "str" else 3] += 1
    return [([*words], *([w[i] for w in words.values()] for i in range(4)))] if words else []


def of_files(counts: DataFrame, *by: str) -> DataFrame:
    """``by_context`` of (by..., ``WORD_COUNTS``): the words of a file that was delivered several times are added up, and a word is foreign if it is in one of them. A file is one row, not one a word."""
    files = counts.groupBy(*by).agg(F.collect_list(F.struct(*WORD_COUNTS)).alias("texts"))
    names = [f"{name}_{n}" for name in CONFIGURATIONS for n in ("total", "total_uq", "non_eng", "non_eng_uq")]
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for texts in b.column(n):
                words: dict[str, list] = {}
                for x in texts.as_py():
                    for token, *new in zip(*(x[c] for c in WORD_COUNTS)):
                        if w := words.get(token):
                            words[token] = [w[0] or new[0], *(i + k for i, k in zip(w[1:], new[1:]))]
                        else:
                            words[token] = new
                row = []
                for i in range(1, len(CONFIGURATIONS) + 1):
                    each = [(w[0], c) for w in words.values() if (c := sum(w[1:i + 1]))]
                    bad = [c for foreign, c in each if foreign]
                    row += [sum(c for _, c in each), len(each), sum(bad), len(bad)]
                out.append(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array([r[i] for r in out], pa.int64()) for i in range(len(names)))], [*by, *names])

    types = dict(counts.dtypes)
    return _shares(files.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in by), *(f"{c} bigint" for c in names)])))
