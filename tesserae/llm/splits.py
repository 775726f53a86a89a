"""Splits that keep related records together.

Projects tied by an author's mail address, a repository or a name form components (large-star /
small-star rounds over star-shaped edges, so a key shared by a third of all projects costs one edge a
project). Components are bundled by identical size and label profile, a min-cost flow allots the
bundles' files to the splits (cost of leaving the present label, higher cost of missing a quota), the
flow is rounded to whole components and members are ranked by hash.

The driver sees only the bundles: with N files there are at most about 3 * sqrt(2 N) of them, as
components of distinct sizes add up to N.

Defined results: null, empty and placeholder authors and null or unreadable urls tie nothing; names
without a leading number count as they are; files of null projects are one component each; repeated rows
count once; an empty table gives no rows.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.staging import stage

#: Share of the files wanted in each split.
PROPORTIONS = {"train": 0.70, "valid": 0.15, "test": 0.15}
#: Cost of a file beyond or below its split's quota, against 1 for a file that changes its split.
MISS_COST = 1000
#: Ranges of the member hash by which large bundles are ranked without one task for all of a bundle.
RANK_RANGES = 1024

# Authors nobody is.
_PLACEHOLDER_LOCAL = ["you", "your", "your.name", "youremail", "your.email", "user", "username", "name", "email", "root", "nobody", "none", "unknown", "anonymous", "noreply", "no-reply", "donotreply", "no_author", "invalid"]
_MAIL = r"([^\s<>()\[\]\",;:]+@[^\s<>()\[\]\",;:]+)"


def author_key(author):
    """The lower-case mail address of an author, null for placeholders."""
    mail = F.regexp_extract(F.lower(author), _MAIL, 1)
    local, domain = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    known = (mail != "") & ~local.isin(*_PLACEHOLDER_LOCAL) & domain.contains(".") & ~domain.startswith("localhost")
    return F.when(known, mail)


def repository_key(url):
    """host/owner/name in lower case, however the url is written; null if it names no repository."""
    u = F.lower(F.trim(url))
    u = F.regexp_replace(u, r"^[a-z+]+://", "")
    u = F.regexp_replace(u, r"[?#].*$", "")
    u = F.regexp_replace(u, r"^[^/@]*@", "")
    u = F.regexp_replace(u, r"^([^/:]+):(?:\d+/)?", "$1/")
    u = F.regexp_replace(u, r"^www\.", "")
    m = F.regexp_replace(F.regexp_extract(u, r"^([^/]+/+[^/]+/+[^/]+)", 1), "/+", "/")
    m = F.regexp_replace(m, r"\.git$", "")
    return F.when(m != "", m)


def name_key(project):
    return F.lower(F.regexp_replace(project, r"^\d+_", ""))


def ties(projects: DataFrame, project_list: DataFrame, project_authors: DataFrame) -> DataFrame:
    """Distinct (project, key): the keys by which projects are tied."""
    names = projects.select("project").unionByName(project_list.select(F.col("name").alias("project"))).unionByName(project_authors.select("project"))
    parts = (
        project_authors.select("project", F.concat(F.lit("a:"), author_key(F.col("author"))).alias("key")),
        project_list.select(F.col("name").alias("project"), F.concat(F.lit("r:"), repository_key(F.col("url"))).alias("key")),
        names.select("project", F.concat(F.lit("n:"), name_key(F.col("project"))).alias("key")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("project is not null and key is not null").distinct()


def components(tied: DataFrame) -> DataFrame:
    """(project, group_key) for each project tied to another: its component's smallest project.

    Every round is two joins with pre-aggregated minima and is written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain. Only a count and a checksum reach the driver."""
    star = tied.groupBy("key").agg(F.min("project").alias("v"))
    edges = tied.join(star, "key").where("project <> v").select(F.col("project").alias("u"), "v").distinct()
    edges = stage(edges, "ties")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every edge points from the larger to the smaller node
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), "ties")
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    roots = edges.select(F.col("v").alias("project"), F.col("v").alias("group_key"))
    return edges.select(F.col("u").alias("project"), F.col("v").alias("group_key")).unionByName(roots).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def allot(bundles: list[tuple[int, str, int]], proportions: dict[str, float] = PROPORTIONS) -> list[dict[str, int]]:
    """Components of each bundle (size, label, count) that go to each split.

    Min-cost flow in units of files: bundle -> split at cost 0 for the bundle's own label and 1 a file
    otherwise, split -> sink at cost 0 within the quota and ``MISS_COST`` beyond. With three splits a
    shortest augmenting path visits each split once, so paths are found over the splits alone: moving
    files from split s to t costs the cheapest re-assignment among the bundles with flow into s. A heap for each
    pair of splits holds these; a bundle whose flow into s has gone is dropped when it comes up."""
    splits = list(proportions)
    total = sum(s * c for s, _, c in bundles)
    quota = {k: total * p for k, p in proportions.items()}
    flow = [{k: float(s * c) if k == (label if label in proportions else splits[0]) else 0.0 for k in splits} for s, label, c in bundles]
    load = {k: sum(f[k] for f in flow) for k in splits}
    move = lambda i, a, b: (b != bundles[i][1]) - (a != bundles[i][1])
    heaps = {(a, b): [(move(i, a, b), -bundles[i][0], i) for i, f in enumerate(flow) if f[a] > 1e-9] for a in splits for b in splits if a != b}
    for h in heaps.values():
        heapify(h)
    while True:
        over = [k for k in splits if load[k] > quota[k] + 1e-6]
        under = [k for k in splits if load[k] < quota[k] - 1e-6]
        if not over or not under:
            break
        arc = {}
        for (a, b), h in heaps.items():
            while h and flow[h[0][2]][a] <= 1e-9:
                heappop(h)
            arc[a, b] = h[0] if h else None
        best = None
        for a in over:
            for b in under:
                paths = [[a, b], *([a, c, b] for c in splits if c not in (a, b))]
                for p in paths:
                    steps = [arc[x, y] for x, y in zip(p, p[1:])]
                    if all(s is not None for s in steps):
                        cost = sum(s[0] for s in steps)
                        if best is None or cost < best[0]:
                            best = (cost, p, steps)
        if best is None or best[0] >= MISS_COST:
            break
        _, p, steps = best
        amount = min(load[p[0]] - quota[p[0]], quota[p[-1]] - load[p[-1]], *(flow[s[2]][x] for s, x in zip(steps, p)))
        for s, x, y in zip(steps, p, p[1:]):
            i = s[2]
            if flow[i][y] <= 1e-9:
                for c in splits:
                    if c != y:
                        heappush(heaps[y, c], (move(i, y, c), -bundles[i][0], i))
            flow[i][x] -= amount
            flow[i][y] += amount
        load[p[0]] -= amount
        load[p[-1]] += amount
    # rounding: whole components by the integral part, the rest, largest first, to the split furthest below its quota
    out = [{k: int(f[k] / s + 1e-9) if s else 0 for k in splits} for f, (s, _, _) in zip(flow, bundles)]
    load = {k: sum(o[k] * s for o, (s, _, _) in zip(out, bundles)) for k in splits}
    for i in sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], bundles[i][1])):
        size, label, count = bundles[i]
        for _ in range(count - sum(out[i].values())):
            k = max(splits, key=lambda k: (quota[k] - load[k] if size else 0, k == label, proportions[k]))
            out[i][k] += 1
            load[k] += size
    # repair: components move from a split above its quota to one below, as long as both come nearer
    moved = True
    while moved:
        moved = False
        for i in sorted(range(len(bundles)), key=lambda i: -bundles[i][0]):
            size = bundles[i][0]
            for a in splits:
                for b in splits:
                    if size and out[i][a] and load[a] - quota[a] > 1e-9 and load[b] < quota[b]:
                        n = min(out[i][a], int(min(load[a] - quota[a], quota[b] - load[b]) / size + 0.5))
                        before = abs(load[a] - quota[a]) + abs(load[b] - quota[b])
                        if n and abs(load[a] - n * size - quota[a]) + abs(load[b] + n * size - quota[b]) < before - 1e-9:
                            out[i][a] -= n
                            out[i][b] += n
                            load[a] -= n * size
                            load[b] += n * size
                            moved = True
    return out


def assign(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(project, file, split) for every distinct file of ``files`` (train_test_valid, project, file), components whole."""
    spark = files.sparkSession
    label = F.min_by("train_test_valid", F.when(F.col("train_test_valid") == "train", 0).when(F.col("train_test_valid") == "valid", 1).otherwise(2))
    each = files.where("file is not null").groupBy("project", "file").agg(label.alias("label"))
    j = each.join(groups, "project", "left").withColumn("component", F.coalesce(F.concat(F.lit("g:"), F.col("group_key")), F.concat(F.lit("p:"), F.col("project")), F.concat(F.lit("f:"), F.col("file"))))
    each = stage(j.select("project", "file", "label", "component"), "split-files")
    sizes = each.groupBy("component").agg(F.count("*").alias("size"), *(F.count_if(F.col("label") == k).alias(k) for k in PROPORTIONS))
    profile = F.when(F.col("train") >= F.greatest("valid", "test"), "train").when(F.col("valid") >= F.col("test"), "valid").otherwise("test")
    sizes = stage(sizes.select("component", "size", profile.alias("label"), F.pmod(F.xxhash64("component"), F.lit(RANK_RANGES)).alias("range")), "split-components")
    ranges = sizes.groupBy("size", "label", "range").agg(F.count("*").alias("n"))
    bundles = sorted((r["size"], r["label"], r["c"]) for r in ranges.groupBy("size", "label").agg(F.sum("n").alias("c")).collect())
    rows, at = [], allot(bundles)
    for (size, label, count), o in zip(bundles, at):
        start = 0
        for k in PROPORTIONS:
            if o[k]:
                rows.append((size, label, start, start + o[k], k))
            start += o[k]
    quotas = spark.createDataFrame(rows, "size bigint, label string, from_rank bigint, to_rank bigint, split string")
    before = ranges.withColumn("before", F.sum("n").over(Window.partitionBy("size", "label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inside = F.row_number().over(Window.partitionBy("size", "label", "range").orderBy(F.xxhash64("component", F.lit(1)), "component"))
    ranked = sizes.withColumn("r", inside).join(before, ["size", "label", "range"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("r") - 1)
    # the quotas have at most three rows a bundle; see the bound above
    of = ranked.join(F.broadcast(quotas), ["size", "label"]).where("rank >= from_rank and rank < to_rank").select("component", "split")
    return each.join(of, "component").select("project", "file", "split")


def _ties(spark, sf_dir: str) -> DataFrame:
    return ties(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("projects", "project_list", "project_authors")))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return components(_ties(spark, sf_dir))


def p1_splits(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/langstats.parquet"), components(_ties(spark, sf_dir)))


def p1_balance(spark, sf_dir: str) -> DataFrame:
    """Files, projects and share of each split."""
    done = p1_splits(spark, sf_dir)
    n = done.groupBy("split").agg(F.count("*").alias("files"), F.count_distinct("project").alias("projects"))
    return n.withColumn("share", F.round(F.col("files") / F.sum("files").over(Window.partitionBy(F.lit(1))), 4))
