"""Source files that do not parse.

Method: table-driven parsers built from the bundled grammars (``grammars.py``) read the whole token
stream of a file and report the first token that no valid file can have there.

Defined results: a null or empty text, an unknown extension or a null file name is no case; a text
of white space only is parsed like any other (valid for JavaScript and Python, invalid for XML and
JSON, valid for Java). Repeated rows count once; a file delivered with different texts is flagged if
one of them is invalid. Columns beyond project, file and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammars, lexers
from .grammar_engine import Grammar

#: Extension -> (grammar, lexer).
LANGUAGES = {"java": ("JAVA", lexers.java), "js": ("JAVASCRIPT", lexers.javascript), "py": ("PYTHON", lexers.python), "xml": ("XML", lexers.xml), "json": ("JSON", lexers.json)}
ERRORS = "project string, file string, ext string, line int, message string"


@cache
def grammar(ext: str) -> Grammar:
    return Grammar(getattr(grammars, LANGUAGES[ext][0]), "file", grammars.SOFT.get(ext, ()))


def first_error(ext: str, text: str) -> tuple[int, str] | None:
    """(line, message) of the first token at which ``text`` stops being a file of ``ext``; None if it is one."""
    g = grammar(ext)
    lines = LANGUAGES[ext][1](text)
    bad = g.parse([terms for _, terms in lines], ext == "js")
    if bad is None:
        return None
    line, terms = lines[bad[0]]
    term = terms[bad[1]]
    return line, "unexpected end of file" if term == "EOF" else "unreadable text" if term == "BAD" else f"unexpected {term}"


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for project, file, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            ext = file.rpartition(".")[2].lower()
            if ext in LANGUAGES and (bad := first_error(ext, text)):
                out.append((project, file, ext, *bad))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))],
            ["project", "file", "ext", "line", "message"],
        )


def syntax_errors(corpus: DataFrame) -> DataFrame:
    """One row (project, file, ext, line, message) for each invalid text of ``corpus`` (project, file, text).

    The parse runs where the rows are read; only flagged files are shuffled, to drop repeats."""
    texts = corpus.select("project", "file", "text").where("file is not null and text is not null and text <> ''")
    return texts.mapInArrow(_errors, ERRORS).distinct()


def rates(corpus: DataFrame, errors: DataFrame) -> DataFrame:
    """Files, invalid files and their share per (project, ext)."""
    ext = F.lower(F.element_at(F.split("file", r"\."), -1))
    files = (
        corpus.where("file is not null and text is not null and text <> ''").select("project", "file", ext.alias("ext"))
        .where(F.col("ext").isin(*LANGUAGES)).distinct().groupBy("project", "ext").agg(F.count("*").alias("n_files"))
    )
    bad = errors.select("project", "file", "ext").distinct().groupBy("project", "ext").agg(F.count("*").alias("bad"))
    j = files.alias("f").join(bad.alias("b"), F.col("f.project").eqNullSafe(F.col("b.project")) & (F.col("f.ext") == F.col("b.ext")), "left")
    n_bad = F.coalesce("bad", F.lit(0).cast("bigint"))
    return j.select("f.project", "f.ext", "n_files", n_bad.alias("n_invalid"), F.round(n_bad / F.col("n_files"), 6).alias("rate"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return syntax_errors(spark.read.parquet(f"{sf_dir}/raw_corpus.parquet")).select("project", "file").distinct()


def p5_errors(spark, sf_dir: str) -> DataFrame:
    return syntax_errors(spark.read.parquet(f"{sf_dir}/raw_corpus.parquet"))


def p5_rates(spark, sf_dir: str) -> DataFrame:
    corpus = spark.read.parquet(f"{sf_dir}/raw_corpus.parquet")
    return rates(corpus, syntax_errors(corpus))
