"""Running forms of the batch operators over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import vocab


def vocabulary(stream: DataFrame, tokens: Column) -> DataFrame:
    """Token counts of everything seen so far (output mode complete or update)."""
    return vocab.vocabulary(vocab.explode_tokens(stream, tokens))


def windowed(stream: DataFrame, time: str, late: str, width: str, slide: str | None = None, *by: str) -> DataFrame:
    """Counts per tumbling or sliding window; rows later than ``late`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, time: str, late: str, gap: str, *by: str) -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def full_words(stream: DataFrame, key: str, tokens: str) -> DataFrame:
    """Full words of token pieces that arrive piece by piece: a word begun in one piece is carried, per key, to the next."""
    import pandas as pd

    from tesserae.functions import code

    def run(k, frames, state):
        held = list(state.get[0]) if state.exists else []
        for pdf in frames:
            out = []
            for piece in pdf[tokens]:
                all_tokens = held + list(piece)
                ranges, rest = code.full_words(all_tokens)
                held = all_tokens[rest:]
                out += [(k[0], " ".join(all_tokens[a:b])) for a, b in ranges]
            state.update((held,))
            yield pd.DataFrame(out, columns=[key, "word"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, word string", "held array<string>", "append", "NoTimeout")
