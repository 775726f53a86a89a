"""Same or near-same files across splits.

Method: edit-distance segment join. A file is the string of its code lines in a fixed order: lines in
at most ``HEAVY`` classes of files by their hash, then the others, the rarest first, counted exactly. As lines may
agree in any order, sorting loses nothing, and two files agree in four fifths of their lines iff the
longer string becomes the shorter by at most k deletions and insertions with k as ``misses`` says. An
evaluation string is cut into k+1 segments, the first k of one line each; k edits leave one of them whole,
so some line among the first k+1 stands among the first k'+1 lines of the train string, at an allowed
position. Matches are verified over the whole strings: in sorted strings the banded table reduces to
their intersection, the band to the length and position bounds.

A code line is a statement or heading (Java, JavaScript: text between ``;``, ``{`` and ``}``) or a line
(Python, XML, JSON) without white space and comments; package and import lines and the XML
declaration are left out, layout therefore too.

A line in few classes makes few pairs. A heavy line stands among a file's first ones only where the file has too few
others; such keys are divided by the length of the files, as lengths that differ by more than a fifth can't agree.

Files with equal strings are one class: classes are joined, pairs of files expanded at the end.
Defined results: null, empty and code-less files pair with nothing; a file in several splits under one
name isn't paired with itself; repeated rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.staging import stage

#: Share of the code lines of the longer file that must agree, as a fraction (parts, of).
AGREE = (4, 5)
#: Classes from which a line is heavy.
HEAVY = 64
#: Heavy lines that are broadcast (16 bytes each); more of them are joined instead.
HEAVY_LINES = 2_000_000

_STRIP = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|/\*(?s:.*?)\*/|//[^\n]*")
_STRIP_PY = re.compile(r"\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|#[^\n]*")
_IMPORT = re.compile(r"(?m)^[ \t]*(?:package|import)\b[^\n;]*;?")
_IMPORT_PY = re.compile(r"(?m)^[ \t]*(?:import\b[^\n]*|from\s+[\w.]+\s+import\b(?:[^\n(]*\([^)]*\)|[^\n]*))")
_NO_LINE = str.maketrans("{};", "\n\n\n")
_SPACE = {c: None for c in map(ord, " \t\r\f\v\xa0​﻿")}


def code_lines(text: str, ext: str) -> list[str]:
    keep = lambda m: m[1] or " "
    if ext == "py":
        text = _IMPORT_PY.sub("", _STRIP_PY.sub(keep, text))
    elif ext == "xml":
        text = re.sub(r"<!--(?s:.*?)-->|<\?(?s:.*?)\?>", "", text)
    elif ext in ("java", "js"):
        text = _IMPORT.sub("", _STRIP.sub(keep, text))
        text = text.translate(_SPACE)
        # a statement may run over several lines: only the signs that end one divide
        return [x for x in text.replace("\n", "").translate(_NO_LINE).split("\n") if x]
    return [x for x in text.translate(_SPACE).split("\n") if x and x not in ("{", "}", "[", "]", "},", "],")]


def misses(n: int) -> int:
    """Lines of a file of ``n`` code lines that may be missing in a near-same one."""
    return n - -(-AGREE[0] * n // AGREE[1])


_BAGS = "split string, project string, file string, class binary, bag array<bigint>"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    for b in batches:
        rows = []
        for split, project, file, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            seen: Counter = Counter()
            bag = []
            for line in code_lines(text, file.rpartition(".")[2].lower()):
                n = seen[line]
                seen[line] = n + 1
                bag.append(xxh3_64_intdigest(line, n))
            if bag:
                a = np.array(bag, dtype=np.uint64).view(np.int64)
                a.sort()
                rows.append((split, project, file, xxh3_128_digest(a.tobytes()), a))
        offsets = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r[4]) for r in rows], out=offsets[1:])
        values = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["split", "project", "file", "class", "bag"])


_HEADS = "class binary, line bigint, pos int, n int, train boolean, eval boolean, weight bigint"


def _heads_by_broadcast(classes: DataFrame, heavy: DataFrame) -> DataFrame:
    import numpy as np

    table = heavy.orderBy("line").toArrow()
    shared = classes.sparkSession.sparkContext.broadcast((table["line"].to_numpy(), table["weight"].to_numpy()))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, weights = shared.value
        for b in batches:
            ids, bags, train, evl = b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()
            flat, offsets = bags.flatten().to_numpy(), bags.offsets.to_numpy()
            offsets = offsets - offsets[0]
            weight = np.zeros(len(flat), dtype=np.int64)
            if len(lines):
                at = np.minimum(np.searchsorted(lines, flat), len(lines) - 1)
                weight = np.where(lines[at] == flat, weights[at], 0)
            out: list[list] = [[], [], [], [], [], [], []]
            for i, cid in enumerate(ids):
                a, w = flat[offsets[i]:offsets[i + 1]], weight[offsets[i]:offsets[i + 1]]
                n = len(a)
                m = misses(n) + 1
                order = np.lexsort((a, w))[:m]
                for column, v in zip(out, ([cid] * m, a[order].tolist(), range(m), [n] * m, [train[i]] * m, [evl[i]] * m, w[order].tolist())):
                    column.extend(v)
            types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["class", "line", "pos", "n", "train", "eval", "weight"])

    return classes.select("class", "bag", "train", "eval").mapInArrow(head, _HEADS)


def _heads_by_join(classes: DataFrame, heavy: DataFrame) -> DataFrame:
    n = F.size("bag")
    lines = classes.select("class", "train", "eval", n.alias("n"), F.explode("bag").alias("line")).join(heavy, "line", "left")
    ordered = lines.groupBy("class").agg(
        F.first("train").alias("train"), F.first("eval").alias("eval"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), "line"))).alias("lines")
    )
    kept = F.col("n") - F.ceil(F.col("n") * AGREE[0] / AGREE[1]).cast("int") + 1
    each = ordered.select("class", "train", "eval", "n", F.posexplode(F.slice("lines", F.lit(1), kept)).alias("pos", "line"))
    return each.select("class", F.col("line.line").alias("line"), "pos", "n", "train", "eval", F.col("line.weight").cast("bigint").alias("weight"))


def first_lines(classes: DataFrame) -> DataFrame:
    """The first k+1 lines of each class (class, line, pos, n, train, eval, weight); weight is the number of classes with a heavy line, else 0."""
    counts = classes.select(F.explode("bag").alias("line")).groupBy("line").agg(F.count("*").alias("weight"))
    heavy = stage(counts.where(F.col("weight") > HEAVY), "overlap-heavy")
    return (_heads_by_broadcast if heavy.count() <= HEAVY_LINES else _heads_by_join)(classes, heavy)


def class_pairs(classes: DataFrame) -> DataFrame:
    """(eval_class, train_class) of ``classes`` (class, bag, train, eval) that agree. Equal classes included."""
    # a base above 5/4 puts lengths that can agree into the same or neighbouring steps
    step = F.when(F.col("weight") > 0, F.floor(F.log(1.3, "n"))).otherwise(-9).cast("int")
    heads = stage(first_lines(classes).withColumn("step", step), "overlap-heads")
    near_steps = F.when(F.col("weight") > 0, F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).otherwise(F.array("step"))
    e, t = heads.where("eval").withColumn("step", F.explode(near_steps)).alias("e"), heads.where("train").alias("t")
    need = F.ceil(F.greatest("e.n", "t.n") * AGREE[0] / AGREE[1])
    near = e.join(t, (F.col("e.line") == F.col("t.line")) & (F.col("e.step") == F.col("t.step"))).where(
        (F.least("e.n", "t.n") >= need) & (F.least(F.col("e.n") - F.col("e.pos"), F.col("t.n") - F.col("t.pos")) + F.least("e.pos", "t.pos") >= need) & (F.col("e.class") != F.col("t.class"))
    )
    candidates = near.select(F.col("e.class").alias("eval_class"), F.col("t.class").alias("train_class")).distinct()
    a = classes.select(F.col("class").alias("eval_class"), F.col("bag").alias("eval_bag"))
    b = classes.select(F.col("class").alias("train_class"), F.col("bag").alias("train_bag"))
    agreeing = (
        candidates.join(a, "eval_class").join(b, "train_class")
        .where(F.size(F.array_intersect("eval_bag", "train_bag")) * AGREE[1] >= F.greatest(F.size("eval_bag"), F.size("train_bag")) * AGREE[0])
        .select("eval_class", "train_class")
    )
    same = classes.where("train and eval").select(F.col("class").alias("eval_class"), F.col("class").alias("train_class"))
    return agreeing.unionByName(same)


def overlaps(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, class pairs): files (split, project, file, class), pairs (eval_class, train_class)."""
    texts = corpus.select("split", "project", "file", "text").where("file is not null and text is not null and text <> '' and split in ('train', 'test', 'valid')")
    files = stage(texts.mapInArrow(_bags, _BAGS), "overlap-files")
    is_train = F.col("split") == "train"
    classes = stage(files.groupBy("class").agg(F.first("bag").alias("bag"), F.max(is_train).alias("train"), F.max(~is_train).alias("eval")), "overlap-classes")
    return files.drop("bag").distinct(), class_pairs(classes)


def file_pairs(corpus: DataFrame) -> DataFrame:
    """One row (split, eval_project, eval_file, train_project, train_file) for each pair of files that agree."""
    files, pairs = overlaps(corpus)
    e = files.where("split <> 'train'").select(F.col("class").alias("eval_class"), "split", F.col("project").alias("eval_project"), F.col("file").alias("eval_file"))
    t = files.where("split = 'train'").select(F.col("class").alias("train_class"), F.col("project").alias("train_project"), F.col("file").alias("train_file"))
    both = pairs.join(e, "eval_class").join(t, "train_class")
    other = ~(F.col("eval_project").eqNullSafe(F.col("train_project")) & (F.col("eval_file") == F.col("train_file")))
    return both.where(other).select("split", "eval_project", "eval_file", "train_project", "train_file").distinct()


def p6_found(spark, sf_dir: str) -> DataFrame:
    pairs = file_pairs(spark.read.parquet(f"{sf_dir}/raw_corpus.parquet"))
    e, t = F.struct(F.col("eval_project").alias("project"), F.col("eval_file").alias("file")), F.struct(F.col("train_project").alias("project"), F.col("train_file").alias("file"))
    a, b = F.least(e, t), F.greatest(e, t)
    return pairs.select(a.project.alias("project_a"), a.file.alias("file_a"), b.project.alias("project_b"), b.file.alias("file_b")).distinct()


def p6_counts(spark, sf_dir: str) -> DataFrame:
    """Overlapping files and pairs per evaluation split and project."""
    pairs = file_pairs(spark.read.parquet(f"{sf_dir}/raw_corpus.parquet"))
    each = pairs.groupBy("split", "eval_project", "eval_file").agg(F.count("*").alias("pairs"))
    return each.groupBy("split", F.col("eval_project").alias("project")).agg(F.count("*").alias("files"), F.sum("pairs").alias("pairs"))
