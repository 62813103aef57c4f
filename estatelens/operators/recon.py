"""Aggregates that describe a repository: composition, history, shared literals, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import family_of, literal_is_noise, seam_kind

DAYS_IN_MONTH = 30.44
#: Candidate registries that are compared with each other at most.
MOST_SETS = 2000


def composition(files: DataFrame, by: str = "lang", size: str = "lines") -> DataFrame:
    """Files, size and share of the total size of each group."""
    grouped = files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total"))
    return grouped.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


def recent(history: DataFrame, at: str, months: float) -> DataFrame:
    """Rows within so many months of the newest one, never of today."""
    newest = history.agg(F.max(at).alias("m")).scalar()
    return history.filter(F.col(at) >= newest - F.make_dt_interval(F.lit(int(months * DAYS_IN_MONTH))))


def hotspots(touches: DataFrame, sizes: DataFrame, key: str, size: str, top: int = 15) -> DataFrame:
    """Touches times size, the largest first, ties by key."""
    n = touches.groupBy(key).agg(F.count(F.lit(1)).alias("touches"))
    return n.join(sizes.select(key, size), key).withColumn("score", F.col("touches") * F.col(size)).orderBy(F.desc("score"), key).limit(top)


def bus_factor(touches: DataFrame, area: list[str], author: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """Areas of enough touches where one author has most of them; of equal authors the smallest."""
    by = touches.groupBy(*area, author).agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy(*area).agg(F.sum("n").alias("touches"), F.min_by(author, F.struct(-F.col("n"), F.col(author))).alias("top_author"), F.max("n").alias("top_n"))
    return top.filter((F.col("touches") >= least) & (F.col("top_n") / F.col("touches") >= share))


def shared_literals(literals: DataFrame, family: str, least_families: int = 2) -> DataFrame:
    """literal with its number of files and the families that know it, for those that several families know."""
    by_family = literals.groupBy("literal", family).agg(F.lit(1).alias("__one"))
    wide = by_family.groupBy("literal").agg(F.array_sort(F.collect_list(family)).alias("families")).filter(F.size("families") >= least_families)
    files = literals.join(wide.select("literal"), "literal", "left_semi").groupBy("literal").agg(F.count_distinct("file").alias("files"))
    return wide.join(files, "literal").select("literal", "files", "families")


def seams(literals: DataFrame, imports: DataFrame) -> DataFrame:
    """(literal, kind, languages, families, files): literals that two families of languages know, or two files of one family if it is a route.

    literals(file, lang, literal); imports(target): what modules import isn't a seam but a dependency, and plain literals name nothing.
    """
    named = literals.select("file", "lang", "literal").filter(~literal_is_noise(F.col("literal"))).join(imports.select(F.col("target").alias("literal")).distinct(), "literal", "left_anti")
    by_lang = named.select("literal", "lang").distinct().groupBy("literal").agg(F.array_sort(F.collect_list("lang")).alias("languages"))
    wide = by_lang.withColumn("families", F.array_sort(F.array_distinct(F.transform("languages", family_of)))).withColumn("kind", seam_kind(F.col("literal")))
    able = wide.filter((F.size("families") > 1) | (F.col("kind") == "route"))
    files = named.join(able.select("literal"), "literal", "left_semi").groupBy("literal").agg(F.count_distinct("file").alias("files"))
    return able.join(files, "literal").filter((F.size("families") > 1) | (F.col("files") > 1)).select("literal", "kind", "languages", "families", "files")


def seam_report(found: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, by kind, by pair of languages) of seams: the widest first, then those in most files, ties by literal."""
    candidates = found.orderBy(F.desc(F.size("families")), F.desc("files"), "literal").limit(top)
    pairs = found.filter(F.size("languages") == 2).groupBy(F.array_join("languages", " - ").alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    return candidates, found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), pairs


#: Words of a commit's subject that tell of a repair.
REPAIR = r"(?i)\b(fix(?:es|ed)?|bug(?:fix)?|hotfix|patch|repair|исправл|фикс|починк|дефект)\b"


def archaeology(history: DataFrame, files: DataFrame, months: float = 0) -> DataFrame:
    """(path, lines, commits, fix_commits, score) of all files(path, lines): how often each was touched and repaired; untouched ones have 0.

    history(commit, at, author, subject, path). months: only so far back from the newest commit; 0: all.
    """
    within = recent(history, "at", months) if months else history
    touched = within.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.count(F.when(F.col("subject").rlike(REPAIR), 1)).alias("fix_commits"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    j = files.join(touched, "path", "left").select("path", "lines", zero("commits"), zero("fix_commits"))
    return j.withColumn("score", F.col("commits") * F.col("lines"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of left are in right, as one row."""
    a = left.select(key).distinct()
    hit = a.join(right.select(key).distinct().withColumn("__r", F.lit(1)), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("ids"), F.count("__r").alias("known"))


def drop_overlapping(sets: DataFrame, group: str, ids: str, share: float = 0.8, most: int = MOST_SETS) -> DataFrame:
    """Greedy, from the largest set on (ties by name): a set mostly inside an already kept one goes.

    sets are candidate registries; the loop runs on the driver over their names, sizes and overlaps. More than `most` of them are refused with
    ValueError, as overlaps are as many as pairs. An id's sets are paired where the id is, so a common id makes most**2 / 2 pairs at most.
    """
    rows = sets.select(F.col(group).alias("g"), F.explode(F.array_distinct(ids)).alias("i")).distinct()
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} sets")
    size = {r.g: r.n for r in sizes}
    held = rows.groupBy("i").agg(F.array_sort(F.collect_list("g")).alias("gs")).filter(F.size("gs") > 1).groupBy("gs").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("gs", lambda x, k: F.transform(F.slice("gs", k + 2, F.size("gs")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    common = held.select("n", F.inline(pairs)).groupBy("x", "y").agg(F.sum("n").alias("n")).collect()  # most**2 / 2 rows at most
    shares = {(r.x, r.y): r.n for r in common} | {(r.y, r.x): r.n for r in common}
    kept: list = []
    for g in sorted(size, key=lambda g: (-size[g], g)):
        if all(shares.get((g, k), 0) < share * size[g] for k in kept):
            kept.append(g)
    return sets.filter(F.col(group).isin(kept))


def evaluation(questions: DataFrame, found: DataFrame) -> DataFrame:
    """recall and precision of each question: expected items found; forbidden items seen. 1.0 where nothing is asked."""
    seen = found.select("question", "item").distinct().withColumn("__seen", F.lit(1))
    j = questions.join(seen, ["question", "item"], "left")
    ratio = lambda expected: F.sum(F.when(F.col("expected") == expected, F.coalesce("__seen", F.lit(0)))) / F.sum(F.when(F.col("expected") == expected, 1))
    return j.groupBy("question").agg(F.round(F.coalesce(ratio(True), F.lit(1.0)), 3).alias("recall"), F.round(1 - F.coalesce(ratio(False), F.lit(0.0)), 3).alias("precision"))


def import_graph(imports: DataFrame, files: DataFrame, namespaces: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst), counts) of imports(path, target) between files.

    A target is a file, or a namespace(namespace, path) that up to `most` files declare; wider ones, external ones and files that import
    themselves are counted and left out.
    """
    direct = imports.join(files.select(F.col("path").alias("target"), F.col("path").alias("dst")), "target").select("path", "target", "dst")
    wide = namespaces.groupBy("namespace").agg(F.count_distinct("path").alias("n"))
    by_space = imports.join(namespaces.select(F.col("namespace").alias("target"), F.col("path").alias("dst")).distinct(), "target").join(wide.select(F.col("namespace").alias("target"), "n"), "target")
    every = direct.union(by_space.filter(F.col("n") <= most).select("path", "target", "dst")).distinct()
    edges = every.filter("path <> dst").select(F.col("path").alias("src"), "dst").distinct()
    seen = direct.select("path", "target").union(by_space.select("path", "target")).distinct()
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return edges, count(edges, "edges").union(count(imports.distinct().join(seen, ["path", "target"], "left_anti"), "external")).union(count(by_space.filter(F.col("n") > most).select("path", "target").distinct(), "too_wide")).union(count(every.filter("path = dst"), "self"))


def structure(ranks: DataFrame, edges: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """(by folder, no one imports): rank sums of folders, and files without incoming edges, both in a fixed order."""
    folder = F.regexp_replace("node", "/?[^/]*$", "")
    sums = ranks.groupBy(folder.alias("directory")).agg(F.round(F.sum("rank"), 6).alias("rank"), F.count(F.lit(1)).alias("files")).orderBy(F.desc("rank"), "directory").limit(top)
    return sums, ranks.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti").orderBy("node")


def why(commits: DataFrame, file: str, limit: int = 5) -> DataFrame:
    """The newest commits(commit, at, author, subject, file) that touch a file."""
    return commits.filter(F.col("file") == file).orderBy(F.desc("at"), "commit").limit(limit).select("commit", "at", "author", "subject")


def check_changes(changes: DataFrame, predicted: DataFrame) -> DataFrame:
    """(change, obvious, found, missed): of the roots whose own files a change touches, how many a prediction names.

    changes(change, root); predicted(change, root).
    """
    hit = predicted.select("change", "root").distinct().withColumn("__p", F.lit(1))
    j = changes.select("change", "root").distinct().join(hit, ["change", "root"], "left")
    return j.groupBy("change").agg(F.count(F.lit(1)).alias("obvious"), F.count("__p").alias("found"), F.array_sort(F.collect_set(F.when(F.col("__p").isNull(), F.col("root")))).alias("missed"))


def limits(files: DataFrame) -> DataFrame:
    """(reason, files, bytes) of what wasn't read, and how much was."""
    return files.groupBy(F.coalesce("skipped", F.lit("read")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
