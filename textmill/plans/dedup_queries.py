"""Queries on duplicates, contamination, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import unit
from ..functions.text import ascii_words, exact_key, prefix_group
from ..operators import dedup, split
from .base import SCORED, scored, unit_sql
from .catalogue import query, table

W = "regexp_extract_all(lower(text), '[a-z0-9]+')"
KEYS = f"k AS (SELECT doc_id AS id, sha256(array_to_string({W}, ' ')) AS key FROM documents)"
SH = f"""w AS (SELECT doc_id AS id, {W} AS w FROM documents),
sh AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w))"""
PAIRS = f"""{SH}, nn AS (SELECT id, count(*) AS n FROM sh GROUP BY id), df AS (SELECT s FROM sh GROUP BY s HAVING count(*) BETWEEN 2 AND 20),
sp AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM sh a JOIN df USING (s) JOIN sh b USING (s) WHERE a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 3),
pairs AS (SELECT a, b, shared, shared / least(x.n, y.n) AS sim FROM sp JOIN nn x ON x.id = a JOIN nn y ON y.id = b)"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pairs(spark, sf_dir):
    return dedup.shared_pairs(dedup.doc_shingles(docs(spark, sf_dir)))


@query(f"WITH {KEYS} SELECT key, count(*) AS n, min(id) AS first_id FROM k GROUP BY key HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return dedup.exact_clusters(docs(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query(f"WITH {KEYS} SELECT min(id) AS doc_id FROM k GROUP BY key")
def keep_first(spark, sf_dir):
    return dedup.exact_clusters(docs(spark, sf_dir)).groupBy("key").agg(F.min("id").alias("doc_id")).select("doc_id")


@query(f"WITH {KEYS} SELECT key, count(*) AS n FROM k GROUP BY key HAVING min(id % 2) <> max(id % 2)")
def label_conflict(spark, sf_dir):
    """Copies with different labels; the label is put by the id, as the labels of the table never clash."""
    k = dedup.exact_clusters(docs(spark, sf_dir)).withColumn("quality", F.col("id") % 2)
    return k.groupBy("key").agg(F.count("*").alias("n"), F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo <> hi").select("key", "n")


@query(f"WITH {SH} SELECT s, count(*) AS df FROM sh GROUP BY s HAVING count(*) > 20")
def stock_shingles(spark, sf_dir):
    return dedup.stock_shingles(dedup.doc_shingles(docs(spark, sf_dir)))


@query(f"WITH {PAIRS} SELECT a, b, shared, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.7")
def near_dup_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).filter("sim >= 0.7").withColumn("sim", F.round("sim", 6))


@query(f"WITH {PAIRS} SELECT a, b, shared, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.3 AND sim < 0.7")
def near_dup_related(spark, sf_dir):
    return pairs(spark, sf_dir).filter("sim >= 0.3 AND sim < 0.7").withColumn("sim", F.round("sim", 6))


COMPONENTS = f"""{PAIRS}, {KEYS}, ee AS (SELECT a, b FROM pairs WHERE sim >= 0.7 UNION SELECT x.id, y.id FROM k x JOIN k y USING (key) WHERE x.id < y.id),
e AS (SELECT a, b FROM ee UNION SELECT b, a FROM ee), reach AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.m),
comp AS (SELECT id, min(m) AS root FROM reach GROUP BY id)"""


def duplicate_components(spark, sf_dir):
    d = docs(spark, sf_dir)
    edges = dedup.exact_edges(dedup.exact_clusters(d)).union(pairs(spark, sf_dir).filter("sim >= 0.7").select("a", "b"))
    return dedup.components(d.select(F.col("doc_id").alias("id")), edges)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT id AS doc_id, root FROM comp")
def dup_components(spark, sf_dir):
    return duplicate_components(spark, sf_dir).select(F.col("id").alias("doc_id"), "root")


@query(f"""WITH RECURSIVE {COMPONENTS}, g AS (SELECT DISTINCT root, source AS grp FROM comp JOIN documents ON doc_id = id),
ge AS (SELECT DISTINCT x.grp AS a, y.grp AS b FROM g x JOIN g y USING (root)), gr AS (SELECT grp, grp AS m FROM g UNION SELECT gr.grp, ge.b FROM gr JOIN ge ON ge.a = gr.m)
SELECT grp, min(m) AS merged FROM gr GROUP BY grp""")
def merged_groups(spark, sf_dir):
    own = duplicate_components(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("grp")), "id").select("root", "grp").distinct()
    star = own.join(own.groupBy("root").agg(F.min("grp").alias("a")), "root").select("a", F.col("grp").alias("b")).filter("a <> b").distinct()
    return dedup.components(own.select(F.col("grp").alias("id")).distinct(), star).select(F.col("id").alias("grp"), F.col("root").alias("merged"))


SUITE = """u AS (SELECT doc_id AS id, text, false AS suite FROM documents UNION ALL SELECT 1000000000000 + item_id, text, true FROM benchmark)"""
_suite_sql = f"WITH {SUITE}, " + PAIRS.replace("doc_id AS id", "id").replace("FROM documents", "FROM u").replace(
    "pairs AS", "pairs AS"
) + ", ks AS (SELECT id, suite, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS key FROM u)"


@query(_suite_sql + """ SELECT id AS doc_id FROM ks WHERE NOT suite AND (id IN (SELECT a FROM pairs WHERE b >= 1000000000000 AND a < 1000000000000 AND sim >= 0.3) OR key IN (SELECT key FROM ks WHERE suite))""")
def suite_contamination(spark, sf_dir):
    """Documents equal to a held-out item or at least 0.3 similar to one."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("suite"))
    u = d.unionByName(table(spark, sf_dir, "benchmark").select((F.lit(10**12) + F.col("item_id")).alias("id"), "text", F.lit(True).alias("suite")))
    like = dedup.shared_pairs(dedup.doc_shingles(u, "id")).filter((F.col("b") >= 10**12) & (F.col("a") < 10**12) & (F.col("sim") >= 0.3)).select(F.col("a").alias("id"))
    keys = u.select("id", "suite", ascii_words(F.col("text")).alias("w")).select("id", "suite", exact_key(F.col("w")).alias("key"))
    equal = keys.filter("NOT suite").join(keys.filter("suite").select("key").distinct(), "key", "left_semi").select("id")
    return like.union(equal).distinct().select(F.col("id").alias("doc_id"))


@query()
def cluster_decisions(spark, sf_dir):
    """The whole duplicate step: who goes and why, and the merged group of each row."""
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.select(F.col("doc_id").alias("id"), "text", prefix_group(F.col("text")).alias("grp"), F.coalesce("quality", F.lit(0)).alias("label"), F.col("doc_id").alias("ord"), F.lit(False).alias("suite"))
    b = table(spark, sf_dir, "benchmark").select((F.lit(10**12) + F.col("item_id")).alias("id"), "text", F.lit("").alias("grp"), F.lit(0).alias("label"), (F.lit(10**12) + F.col("item_id")).alias("ord"), F.lit(True).alias("suite"))
    u = d.unionByName(b)
    rows = u.withColumn("_w", ascii_words(F.col("text"))).withColumn("key", exact_key(F.col("_w"))).drop("_w", "text")
    got = dedup.cluster_decisions(rows, dedup.shared_pairs(dedup.doc_shingles(u, "id")))
    return got.select(F.col("id").alias("doc_id"), "root", "size", "reason", "group_root")


@query()
def related_separation(spark, sf_dir):
    d = docs(spark, sf_dir)
    side = split.side_of(F.col("source"), "50")
    s = d.select(F.col("doc_id").alias("id"), side.alias("side"), split.rank_of(side).alias("rank"))
    return dedup.separate_related(pairs(spark, sf_dir).filter("sim >= 0.3 AND sim < 0.7"), s).select(F.col("id").alias("doc_id"))


_ph = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


@query(f"""WITH w AS (SELECT doc_id, quality AS label, source, {_ph} AS w FROM documents JOIN labels USING (doc_id)),
p AS (SELECT DISTINCT doc_id, label, source, array_to_string(w[i:i + 4], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT phrase, source, count(*) AS n, sum(label) AS ai FROM p GROUP BY ALL)
SELECT phrase, sum(n)::BIGINT AS n_rows, round(sum(ai) / sum(n), 3) AS ai_share, max({{'n': n, 's': source}}).s AS source FROM c GROUP BY phrase
HAVING sum(n) >= 4 AND greatest(sum(ai), sum(n) - sum(ai)) >= 0.97 * sum(n) ORDER BY n_rows DESC, phrase LIMIT 20""")
def one_class_phrases(spark, sf_dir):
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return dedup.one_class_phrases(d, "label", min_rows=4, part=None)


def side_sql(group: str, seed: str = "50") -> str:
    u = unit_sql(f"'{seed}:split:' || {group}")
    return f"CASE WHEN {u} < 0.1 THEN 'test' WHEN {u} < 0.15 THEN 'validation' ELSE 'train' END"


GROUPS = "substr(sha1(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')[1:12], ' ')), 1, 16)"


@query(f"SELECT doc_id, {side_sql('grp')} AS split FROM (SELECT doc_id, {GROUPS} AS grp FROM documents)")
def hash_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", split.side_of(prefix_group(F.col("text")), "50").alias("split"))


@query(f"SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {side_sql('grp')} AS split FROM (SELECT {GROUPS} AS grp FROM documents)) GROUP BY split")
def split_shares(spark, sf_dir):
    c = hash_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("split", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # three rows


@query(f"""WITH g AS (SELECT conv_id, role, {side_sql("(conv_id::VARCHAR || role)")} AS side FROM conversations),
m AS (SELECT conv_id, max(CASE side WHEN 'test' THEN 2 WHEN 'validation' THEN 1 ELSE 0 END) AS r FROM g GROUP BY conv_id)
SELECT conv_id, CASE r WHEN 2 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM g JOIN m USING (conv_id) GROUP BY ALL""")
def split_max_rank(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.col("conv_id").cast("string"), "role").alias("grp"))
    return split.split_groups(c, "50", "conv_id", "grp").groupBy("conv_id", "split").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id FROM (SELECT conv_id, {side_sql("(conv_id || ':' || turn // 2)")} AS split FROM conversations) GROUP BY conv_id HAVING min(split) <> max(split)")
def split_disjoint(spark, sf_dir):
    """Conversations that a split by pairs of turns, which is wrong, puts on two sides."""
    pair = F.concat_ws(":", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string"))
    c = table(spark, sf_dir, "conversations").select("conv_id", pair.alias("grp"))
    return split.disjoint(split.split_groups(c, "50", "grp", "grp"), "conv_id", "split")


@query(f'WITH {SCORED} SELECT "view", label, count(*) AS n FROM sc GROUP BY ALL')
def view_counts(spark, sf_dir):
    s = scored(spark, sf_dir)
    group = F.when(F.col("source").isin("src18", "src19"), F.concat(F.lit("bed:"), "source")).otherwise(F.col("source"))
    v = split.view_of(F.col("lang"), group, F.col("generator"), ["es"], ["bed:"], ["g3"])
    return s.groupBy(v.alias("view"), "label").agg(F.count("*").alias("n"))


_h = lambda seed, key: f"sha256('{seed}:' || {key})"


@query(f"""WITH a AS (SELECT doc_id, source, lang, {_h('50', 'doc_id')} AS h FROM documents WHERE lang <> 'es'), r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS r1 FROM a),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r1 > 1, h, doc_id) AS n FROM r) SELECT doc_id FROM t WHERE n <= 4 UNION ALL SELECT doc_id FROM documents WHERE lang = 'es'""")
def topk_per_group(spark, sf_dir):
    return split.select_generations(docs(spark, sf_dir), "source", "lang", "doc_id", 4, "50", ["es"]).select("doc_id")


@query(f"""WITH r AS (SELECT doc_id, lang, quality, rep, row_number() OVER (PARTITION BY rep, lang, quality ORDER BY sha256('9:' || rep || ':' || doc_id), doc_id) AS k,
  count(*) OVER (PARTITION BY rep, lang, quality) AS n FROM documents JOIN labels USING (doc_id), range(200) t(rep))
SELECT rep, doc_id, CASE WHEN k <= n // 2 THEN 0 ELSE 1 END AS half FROM r""")
def stratified_half(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return split.half_split(d, ["lang", "quality"], "doc_id", 200, "9").select("rep", "doc_id", "half")


@query(f"""WITH d AS (SELECT doc_id, lang, quality, {_h('3', 'doc_id')} AS h FROM documents JOIN labels USING (doc_id)), k AS (SELECT count(*) AS k FROM (SELECT DISTINCT lang, quality FROM d)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY h, doc_id) AS r FROM d) SELECT doc_id FROM r, k WHERE r <= greatest(1, 60 // k.k) ORDER BY h, doc_id LIMIT 60""")
def stratified_sample(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return split.stratified_sample(d, ["lang", "quality"], "doc_id", 60, "3").select("doc_id")


@query(f"""WITH q AS (SELECT lang, source, 50 // count(*) OVER (PARTITION BY lang) + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY source) = 1 THEN 50 % count(*) OVER (PARTITION BY lang) ELSE 0 END AS quota
  FROM (SELECT DISTINCT lang, source FROM documents)), r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_h('7', 'doc_id')}, doc_id) AS r FROM documents)
SELECT doc_id FROM r JOIN q USING (lang, source) WHERE r <= quota""")
def quota_sample(spark, sf_dir):
    return split.quota_sample(docs(spark, sf_dir), ["lang"], 50, "doc_id", "7").select("doc_id")


@query(f"SELECT doc_id, CASE WHEN {unit_sql("'8:' || doc_id")} < 0.9 THEN 'train' ELSE 'holdout' END AS part FROM documents")
def seeded_holdout(spark, sf_dir):
    return split.holdout(docs(spark, sf_dir), "doc_id", 0.9, "8").select("doc_id", "part")


@query("SELECT doc_id FROM documents WHERE source = 'src1' EXCEPT SELECT doc_id FROM labels")
def unlabelled_except(spark, sf_dir):
    return docs(spark, sf_dir).filter("source = 'src1'").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def toxic_intersect(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").intersect(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))
