"""Exact and near duplicates over word shingles with a bound on a shingle's documents, components, and who stays.

The self-join joins only shingles in 2 to `most_docs` documents. That bound is part of the operator's meaning (frequent
sequences are stock phrases, not copies), and it keeps the join linear: a shingle brings at most most_docs^2 / 2 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words, exact_key, shingles
from ..shared import forget, stage

#: Fixed values.
N, MIN_SHARED, MOST_DOCS, DUPLICATE, RELATED = 5, 3, 20, 0.7, 0.3


def doc_shingles(docs: DataFrame, id_col: str = "doc_id", n: int = N) -> DataFrame:
    """(id, s): the distinct shingles of each text, exploded."""
    return docs.select(F.col(id_col).alias("id"), ascii_words(F.coalesce("text", F.lit(""))).alias("w")).select("id", F.explode(shingles(F.col("w"), n)).alias("s"))


def shared_pairs(sh: DataFrame, most_docs: int = MOST_DOCS, min_shared: int = MIN_SHARED) -> DataFrame:
    """(a, b, shared, sim) of pairs a < b with enough common shingles; sim is over all shingles of the smaller text.

    Shingles meet as 64-bit hashes, written once: counts, joins and sizes read that table instead of the texts.
    """
    sh = stage(sh.select("id", F.xxhash64("s").alias("s")), "shingles")
    size = sh.groupBy("id").agg(F.count("*").alias("n"))
    # ids of a shingle are gathered up to one more than the bound, so a frequent shingle never fills a row
    per = sh.groupBy("s").agg(F.count("*").alias("df")).filter(F.col("df").between(2, most_docs)).select("s")
    ids = sh.join(per, "s").groupBy("s").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = ids.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    got = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    got = got.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return got.select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("sim"))


def stock_shingles(sh: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    return sh.groupBy("s").agg(F.count("*").alias("df")).filter(F.col("df") > most_docs)


def exact_clusters(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, key): equal keys are equal texts."""
    return docs.select(F.col(id_col).alias("id"), ascii_words(F.coalesce("text", F.lit(""))).alias("w")).select("id", exact_key(F.col("w")).alias("key"))


def exact_edges(keys: DataFrame) -> DataFrame:
    """A star for each key: (first id, other id). Minima are taken before the shuffle, so copies don't meet in a task."""
    first = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return keys.join(first, "key").filter("id <> a").select("a", F.col("id").alias("b"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): root is the smallest id connected to id.

    Labels go to neighbours and then to the label's own label (pointer jumping), so rounds grow with the logarithm
    of the longest path. Every round is a written table.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    at = stage(vertices.select("id", F.col("id").alias("root")).distinct(), "labels")
    while True:
        near = both.join(at.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        new = at.join(near, at["id"] == near["a"], "left").select("id", F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = new.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = stage(new.join(jump, "root").select("id", F.least("root", "up").alias("root")), "labels")
        same = new.join(at.withColumnRenamed("root", "was"), "id").filter("root <> was").isEmpty()
        forget(at)
        if same:
            forget(both)
            return new
        at = new


def cluster_decisions(rows: DataFrame, pairs: DataFrame, duplicate: float = DUPLICATE) -> DataFrame:
    """rows(id, key, grp, label, ord, suite) and their pairs, to (id, root, size, reason, group_root).

    Clusters are components over exact keys and pairs from `duplicate` on; pairs with a suite row don't spread. In a
    cluster with a suite row all are `in_suite`, as is a row similar to one; a cluster with both labels is a
    `label_conflict` as a whole; of any other the first by ord stays and the rest are `duplicate`. Clusters without suite rows merge
    their groups, also if they are dropped for their labels; a merged group's name is the smallest one.
    """
    suite = rows.filter("suite").select("id")
    touching = pairs.join(suite.select(F.col("id").alias("b")), "b", "left_semi")
    inside = pairs.join(suite.select(F.col("id").alias("b")), "b", "left_anti")
    edges = exact_edges(rows.select("id", "key")).union(inside.filter(F.col("sim") >= duplicate).select("a", "b"))
    rooted = stage(rows.join(components(rows.select("id"), edges), "id"), "clusters")
    facts = rooted.groupBy("root").agg(
        F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("suite").alias("has_suite"), F.min(F.struct("ord", "id"))["id"].alias("first")
    )
    # groups of a cluster are linked to its smallest group
    own = rooted.join(facts.filter("size > 1 AND NOT has_suite"), "root").select("root", "grp")
    star = own.join(own.groupBy("root").agg(F.min("grp").alias("a")), "root").filter("grp <> a").select("a", F.col("grp").alias("b")).distinct()
    groups = components(rooted.filter("NOT suite").select(F.col("grp").alias("id")).distinct(), star).select(F.col("id").alias("grp"), F.col("root").alias("group_root"))
    hit = touching.select(F.col("a").alias("id")).distinct().withColumn("like_suite", F.lit(True))
    got = rooted.filter("NOT suite").join(facts, "root").join(hit, "id", "left").join(groups, "grp")
    reason = F.when(F.col("has_suite") | F.col("like_suite"), "in_suite").when(F.col("size") == 1, None).when(F.col("lo") != F.col("hi"), "label_conflict").when(F.col("id") != F.col("first"), "duplicate")
    return got.select("id", "root", "size", reason.alias("reason"), "group_root")


def separate_related(pairs: DataFrame, split: DataFrame) -> DataFrame:
    """Ids to drop so that no related pair (a, b) lies on both sides of the split(id, side, rank); pairs in order, none
    twice hit; of a pair the one with the smaller rank goes.

    A pair that comes before all others that share an id with it is decided whatever else happens, so each round decides all such
    pairs at once and takes out what they hit. Every round is a written table.
    """
    sides = split.select("id", "side", "rank")
    p = pairs.select("a", "b").join(sides.toDF("a", "sa", "ra"), "a").join(sides.toDF("b", "sb", "rb"), "b").filter("sa <> sb")
    left = stage(p.select("a", "b", F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("goes")), "related")
    gone = split.select("id").limit(0)
    while not left.isEmpty():
        first = left.select(F.explode(F.array("a", "b")).alias("v"), F.struct("a", "b").alias("pair")).groupBy("v").agg(F.min("pair").alias("pair"))
        at = left.join(first.toDF("a", "pa"), "a").join(first.toDF("b", "pb"), "b")
        mine = F.struct("a", "b")
        decided = stage(at.filter((mine == F.col("pa")) & (mine == F.col("pb"))).select("a", "b", "goes"), "related")
        hit = decided.select(F.col("goes").alias("v")).distinct()
        gone = gone.union(hit)
        rest = left.join(decided, ["a", "b"], "left_anti")
        for side in ("a", "b"):
            rest = rest.join(hit.withColumnRenamed("v", side), side, "left_anti")
        rest = stage(rest.select("a", "b", "goes"), "related")
        forget(left)
        left = rest
    return gone


def one_class_phrases(docs: DataFrame, label: str, n: int = 5, min_rows: int = 150, share: float = 0.97, top: int = 20, part: int | None = 8) -> DataFrame:
    """The most frequent sequences almost all of whose documents are of one class; `part`: one hash in so many is counted."""
    w = docs.select(F.col(label).alias("label"), "source", ascii_words(F.col("text"), "'").alias("w"))
    p = w.select("label", "source", F.explode(shingles(F.col("w"), n)).alias("phrase"))
    if part:
        p = p.filter(F.crc32("phrase") % part == 0)
    per = p.groupBy("phrase", "source").agg(F.count("*").alias("n"), F.sum("label").alias("ai"))
    per = per.groupBy("phrase").agg(F.sum("n").alias("n_rows"), F.sum("ai").alias("ai"), F.max(F.struct("n", "source"))["source"].alias("source"))
    one = F.greatest(F.col("ai"), F.col("n_rows") - F.col("ai")) >= share * F.col("n_rows")
    return per.filter((F.col("n_rows") >= min_rows) & one).orderBy(F.desc("n_rows"), "phrase").limit(top).select("phrase", "n_rows", F.round(F.col("ai") / F.col("n_rows"), 3).alias("ai_share"), "source")
