"""Queries on pages and hosts, ordered folds, stores, latencies, vectors, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as fs
from ..functions import text as tx
from ..operators import counts, folds, hosts, store
from ..sources import html
from .base import unit_sql
from .catalogue import query, table

HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
SITES = ["example.com", "site1.example.com", "org", "blog.site2.org"]


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def listed(spark, sf_dir):
    """A block list made from the pages: the parents of a seeded third of the hosts, and some of the hosts."""
    h = pages(spark, sf_dir).select(hosts.host_of(F.col("url")).alias("host")).distinct()
    u = fs.unit(F.concat(F.lit("list:"), "host"))
    return h.filter(u < 0.5).select(F.when(u < 0.2, F.regexp_replace("host", r"^[^.]+\.", "")).otherwise(F.col("host")).alias("domain"), F.when(u < 0.3, "first").otherwise("second").alias("source"))


LISTED = f"""h AS (SELECT DISTINCT {HOST} AS host FROM pages), li AS (SELECT CASE WHEN {unit_sql("'list:' || host")} < 0.2 THEN regexp_replace(host, '^[^.]+\\.', '') ELSE host END AS domain,
  CASE WHEN {unit_sql("'list:' || host")} < 0.3 THEN 'first' ELSE 'second' END AS source FROM h WHERE {unit_sql("'list:' || host")} < 0.5)"""
SUB = lambda x: f"array_to_string(string_split({x}, '.')[i:], '.')"


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def page_hosts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hosts.host_of(F.col("url")).alias("host"))


@query(f"WITH {LISTED} SELECT host, max({{'n': length(domain), 'd': domain}}).d AS site FROM h, (SELECT DISTINCT domain FROM li) WHERE host = domain OR ends_with(host, '.' || domain) GROUP BY host")
def host_suffix_block(spark, sf_dir):
    h = pages(spark, sf_dir).select(hosts.host_of(F.col("url")).alias("host"))
    return hosts.suffix_match(h, listed(spark, sf_dir).select(F.col("domain").alias("site")))


_compact = "SELECT DISTINCT domain FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE ends_with(a.domain, '.' || b.domain) AND contains(b.domain, '.'))"


@query(f"WITH {LISTED} {_compact.format('li')}")
def compact_hosts(spark, sf_dir):
    return hosts.compact(listed(spark, sf_dir).select("domain"))


@query(f"WITH {LISTED}, f AS (SELECT * FROM li WHERE source = 'first') SELECT 'first' AS source, (SELECT count(DISTINCT domain) FROM f) AS n, (SELECT count(*) FROM ({_compact.format('f')})) AS added UNION ALL SELECT 'second', (SELECT count(DISTINCT domain) FROM li WHERE source = 'second'), (SELECT count(*) FROM ({_compact.format('li')})) - (SELECT count(*) FROM ({_compact.format('f')}))")
def source_contributions(spark, sf_dir):
    return hosts.contributions(listed(spark, sf_dir), ["first", "second"])


@query(f"""WITH {LISTED}, m AS (SELECT host, bool_or(ends_with('.' || host, '.' || domain) AND source = 'second' AND contains(domain, '.')) AS builtin, bool_or(ends_with('.' || host, '.' || domain) AND source = 'first') AS own FROM h, li GROUP BY host)
SELECT host, CASE WHEN own THEN 'user' WHEN builtin AND NOT ends_with(host, '.example') THEN 'builtin' END AS reason, CASE WHEN own OR builtin AND NOT ends_with(host, '.example') THEN 'blocked' ELSE 'auto' END AS policy FROM m""")
def scan_policy(spark, sf_dir):
    h = pages(spark, sf_dir).select(hosts.host_of(F.col("url")).alias("host"))
    li = listed(spark, sf_dir)
    lifted = spark.createDataFrame([("example",)], "site string")
    return hosts.policies(h, li.filter("source = 'first'").select(F.col("domain").alias("site")), li.filter("source = 'second'").select(F.col("domain").alias("site")), lifted, lifted, "all")


@query(r"SELECT page_id, regexp_matches(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/?$|^/(index\.[a-z]+|[a-z]{2}(-[a-z]{2})?)/?$') AS homepage FROM pages")
def homepage_filter(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hosts.homepage(F.col("url")).alias("homepage"))


@query()
def html_paragraphs(spark, sf_dir):
    return html.paragraphs(pages(spark, sf_dir))


@query()
def html_skipped(spark, sf_dir):
    return html.skipped_elements(pages(spark, sf_dir))


@query()
def page_texts(spark, sf_dir):
    return html.join_paragraphs(html.paragraphs(pages(spark, sf_dir)), 15)


@query()
def paragraph_groups(spark, sf_dir):
    """Candidates of each page, short neighbours grouped, tiny groups left out, with the text that a group is scored by."""
    c = html.candidates(pages(spark, sf_dir), limits=(2000,)).select("page_id", F.col("groups")[0].alias("grp"), "pos", "text", "words")
    g = folds.drop_small_groups(c, "page_id", "grp").groupBy("page_id", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("m"), F.sum("words").alias("words"))
    whole = F.array_join(F.transform("m", lambda x: x["text"]), "\n\n")
    g = g.select("page_id", "grp", F.size("m").alias("members"), "words", whole.alias("whole")).withColumn("text", tx.clip(F.col("whole"), 2000))
    return g.select("page_id", "grp", "members", "words", "text", (F.length("text") < F.length("whole")).alias("truncated"))


@query()
def grouping_summary(spark, sf_dir):
    """How many paragraphs are short before and after grouping, for several limits."""
    limits = (1000, 2000, 4000)
    c = html.candidates(pages(spark, sf_dir), limits=limits).select("page_id", "words", F.posexplode("groups").alias("i", "grp"))
    g = c.groupBy("i", "page_id", "grp").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.count_if(F.col("words") < 120).alias("short"))
    s = g.groupBy("i").agg(F.sum("n").alias("paragraphs"), F.sum("short").alias("short_paragraphs"), F.count("*").alias("units"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("words") < 120).alias("short_units"))
    return s.select(F.element_at(F.array(*map(F.lit, limits)), F.col("i") + 1).alias("most_chars"), "paragraphs", "short_paragraphs", "units", "multi", "short_units")


def lengths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").alias("pos"), F.length(F.coalesce("text", F.lit(""))).alias("text_length"))


LEN = "l AS (SELECT conv_id, turn AS pos, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY {0}) AS k FROM conversations)"


@query(f"""WITH RECURSIVE {LEN.format('turn')}, f AS (SELECT conv_id, pos, n, k, 0 AS batch, 1 AS items, n AS chars FROM l WHERE k = 1 UNION ALL
SELECT l.conv_id, l.pos, l.n, l.k, CASE WHEN f.items >= 5 OR f.chars + l.n > 2500 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.items >= 5 OR f.chars + l.n > 2500 THEN 1 ELSE f.items + 1 END,
  CASE WHEN f.items >= 5 OR f.chars + l.n > 2500 THEN l.n ELSE f.chars + l.n END FROM f JOIN l ON l.conv_id = f.conv_id AND l.k = f.k + 1)
SELECT conv_id, pos, n AS text_length, batch::BIGINT AS batch FROM f""")
def batches(spark, sf_dir):
    return folds.batches(lengths(spark, sf_dir), "conv_id")


@query(f"""WITH RECURSIVE {LEN.format("length(coalesce(text, '')), turn")}, f AS (SELECT conv_id, pos, n, k, 0 AS bucket, n AS first FROM l WHERE k = 1 UNION ALL
SELECT l.conv_id, l.pos, l.n, l.k, CASE WHEN l.n > f.first * 1.25 + 16 THEN f.bucket + 1 ELSE f.bucket END, CASE WHEN l.n > f.first * 1.25 + 16 THEN l.n ELSE f.first END FROM f JOIN l ON l.conv_id = f.conv_id AND l.k = f.k + 1)
SELECT conv_id, pos, n AS text_length, bucket::BIGINT AS bucket FROM f""")
def length_buckets(spark, sf_dir):
    return folds.length_buckets(lengths(spark, sf_dir), "conv_id")


@query("SELECT conv_id, turn AS pos, (count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS island FROM conversations")
def break_islands(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "role")
    return folds.running_islands(c, "conv_id", F.col("role") == "user").select("conv_id", "pos", "island")


# stores: events stand for scores that were put, the newest of a user counts

NOW = 1_706_745_600_000  # the end of the month that the events cover


def entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("k"), F.round(F.col("value") / (1 + F.abs("value")), 6).alias("p"), F.col("event_type").alias("m"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"))


ENTRIES = 'en AS (SELECT user_id::VARCHAR AS k, round(value / (1 + abs(value)), 6) AS p, event_type AS m, epoch_us(ts) // 1000 AS "at", event_id AS ord FROM events)'
NEWEST = f'{ENTRIES}, nw AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY k ORDER BY "at" DESC, ord) = 1)'


@query(f"""WITH {NEWEST} SELECT k, p, m, "at" FROM nw""")
def feedback_latest(spark, sf_dir):
    return store.newest(entries(spark, sf_dir), ["k"], "at", "ord").select("k", "p", "m", "at")


@query(f"""WITH {NEWEST}, ks AS (SELECT DISTINCT k FROM en) SELECT k, CASE WHEN m = 'click' AND "at" >= {NOW - 7 * 86400000} THEN p END AS p FROM ks JOIN nw USING (k)""")
def store_lookup_ttl(spark, sf_dir):
    e = entries(spark, sf_dir)
    return store.lookup(e.select("k").distinct(), store.newest(e, ["k"], "at", "ord"), "click", NOW, 7)


@query(f"""WITH {NEWEST} SELECT k, "at" FROM nw WHERE "at" >= {NOW - 30 * 86400000} ORDER BY "at" DESC, k LIMIT 25""")
def store_prune_cap(spark, sf_dir):
    return store.prune(store.newest(entries(spark, sf_dir), ["k"], "at", "ord").select("k", "p", "m", "at"), NOW, 30, 25).select("k", "at")


@query(f"""WITH {NEWEST}, o AS (SELECT k, p FROM nw WHERE k::BIGINT % 3 <> 0), n AS (SELECT k, 1 - p AS p FROM nw WHERE k::BIGINT % 2 = 0 OR k::BIGINT % 3 = 0) SELECT k, round(p, 6) AS p FROM n UNION ALL SELECT k, round(p, 6) FROM o WHERE k NOT IN (SELECT k FROM n)""")
def store_upsert(spark, sf_dir):
    e = store.newest(entries(spark, sf_dir), ["k"], "at", "ord").select("k", "p")
    k = F.col("k").cast("long")  # every key is in one of the sides at least
    old, new = e.filter(k % 3 != 0), e.filter((k % 2 == 0) | (k % 3 == 0)).withColumn("p", 1 - F.col("p"))
    return store.upsert(old, new).select("k", F.round("p", 6).alias("p"))


def feedback(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(key.alias("id"), "text", F.when(F.col("role") == "assistant", "ai").otherwise("human").alias("label"), F.when(F.col("turn") % 4 == 0, "guess").otherwise("own").alias("basis"), F.round(fs.unit(key), 6).alias("p"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))


FEEDBACK = f"""fb AS (SELECT conv_id || ':' || turn AS id, substr(trim(text), 1, 2000) AS text, CASE WHEN role = 'assistant' THEN 'ai' ELSE 'human' END AS label, CASE WHEN turn % 4 = 0 THEN 'guess' ELSE 'own' END AS basis,
  round({unit_sql("conv_id || ':' || turn")}, 6) AS p, 'm' || (conv_id % 3) AS model FROM conversations WHERE role <> 'system')"""


@query(f"""WITH {FEEDBACK} SELECT model, count(*) AS n, count(*) FILTER (label = 'human') AS human, count(*) FILTER (label = 'ai') AS ai, count(*) FILTER (basis = 'guess') AS guess,
  count(*) FILTER ((p >= 0.5) <> (label = 'ai')) AS disagree, sum(length(text))::BIGINT AS chars FROM fb WHERE length(text) > 0 GROUP BY model""")
def feedback_info(spark, sf_dir):
    return store.feedback_info(store.sanitise_feedback(feedback(spark, sf_dir)).filter("valid"), ["model"])


@query(f"WITH {FEEDBACK} SELECT model, count(*) AS n, count(*) FILTER (label = 'human' AND p >= 0.5) AS fp, count(*) FILTER (label = 'ai' AND p < 0.5) AS fn FROM fb WHERE basis <> 'guess' GROUP BY model")
def feedback_by_model(spark, sf_dir):
    return store.errors_by_model(feedback(spark, sf_dir))


@query(f"WITH {FEEDBACK} SELECT id, CASE basis WHEN 'own' THEN 0.95 ELSE 0.6 END AS confidence, substr(sha256(text), 1, 32) AS k FROM fb")
def feedback_training(spark, sf_dir):
    f = store.sanitise_feedback(feedback(spark, sf_dir))
    return f.select("id", store.confidence(F.col("basis")).alias("confidence"), fs.text_key(F.col("text")).alias("k"))


@query("""WITH d AS (SELECT substr(sha256(text), 1, 32) AS k, max(length(text)) AS n FROM documents GROUP BY 1) SELECT k, round(n / (n + 1000), 6) AS score FROM d""")
def fill_missing_scores(spark, sf_dir):
    """Scores of half of the texts are there; the rest is scored once for each distinct text."""
    d = table(spark, sf_dir, "documents").select(fs.text_key(F.col("text")).alias("k"), "text")
    scorer = lambda t: F.round(F.length(t) / (F.length(t) + 1000), 6)
    done = d.filter(F.col("k") < "8").dropDuplicates(["k"]).select("k", scorer(F.col("text")).alias("score"))
    return store.score_missing(d, done, scorer)


@query("""WITH s AS (SELECT user_id % 5 AS candidate, event_type AS stage, quantile_cont(value, 0.5) AS med, min(value) AS fastest FROM events GROUP BY ALL)
SELECT candidate, stage, round(med, 6) AS median, round(fastest, 6) AS fastest, round(sum(med) OVER (PARTITION BY candidate ORDER BY stage ROWS UNBOUNDED PRECEDING), 6) AS until_exit FROM s""")
def latency_until_exit(spark, sf_dir):
    u = until(spark, sf_dir)
    return u.select("candidate", "stage", *[F.round(c, 6).alias(c) for c in ("median", "fastest", "until_exit")])


def until(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("candidate"), F.col("event_type").alias("stage"), "value")
    return counts.until_exit(e, ["candidate"], "stage", "value")


@query("""WITH s AS (SELECT user_id % 5 AS candidate, event_type AS stage, quantile_cont(value, 0.5) AS med FROM events GROUP BY ALL), u AS (SELECT *, sum(med) OVER (PARTITION BY candidate ORDER BY stage ROWS UNBOUNDED PRECEDING) AS t FROM s),
h AS (SELECT event_type AS stage, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type)
SELECT candidate, round(sum(share * t), 6) AS expected, round(max(t), 6) AS whole, round(100 * (1 - sum(share * t) / max(t)), 6) AS saved FROM u JOIN h USING (stage) GROUP BY candidate""")
def latency_expected(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    shares = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("stage", (F.col("n") / F.col("t")).alias("share"))  # a row for each stage
    x = counts.expected_time(until(spark, sf_dir), shares, ["candidate"], "stage")
    return x.select("candidate", *[F.round(c, 6).alias(c) for c in ("expected", "whole", "saved")])


@query("SELECT user_id, event_type, min(value) AS value FROM events GROUP BY ALL")
def latency_best_of(spark, sf_dir):
    return counts.best_of(table(spark, sf_dir, "events").select("user_id", "event_type", "value"), ["user_id", "event_type"], "value")


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE md5(text) END AS h FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id, CASE WHEN n.h IS NULL THEN 'gone' WHEN o.h IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN n USING (doc_id)""")
def refetch_changes(spark, sf_dir):
    """States between two versions of a table, here two overlapping parts of documents."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 3 <> 0 OR doc_id % 4 = 0").select("doc_id", F.md5("text").alias("h"))
    new = d.filter("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.md5("text")).alias("h"))
    return counts.changes(old, new, "doc_id", "h")


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_max([abs(x::DOUBLE) for x in embedding]) AS top FROM embeddings)
SELECT vec_id, round(CASE WHEN top > 0 THEN top / 127 ELSE 1 END, 9) AS scale, list_sum([round_even(x / CASE WHEN top > 0 THEN top / 127 ELSE 1 END, 0)::BIGINT for x in e])::BIGINT AS total FROM s""")
def quantise_row(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", fs.quantise(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.values", F.lit(0), lambda a, x: a + x).alias("total"))


@query()
def quantise_block(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(fs.quantise_blocks(F.col("embedding"))).alias("block", "q")).select("vec_id", "block", F.round("q.scale", 9).alias("scale"), F.to_json("q.values").alias("vals"))


@query("SELECT vec_id, i AS pos, round((embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]) / 2, 6) + 0.0 AS value FROM embeddings, range(32) t(i)")
def mean_pool(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(fs.pool_pairs(F.col("embedding"))).alias("pos", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("""WITH e AS (SELECT vec_id, [abs(x::DOUBLE) for x in embedding] AS p FROM embeddings) SELECT vec_id, list_position(p, list_max(p))::BIGINT - 1 AS label, round(list_max(p) / list_sum(p), 6) AS top FROM e""")
def soft_targets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", fs.normalised(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("p"))
    return e.select("vec_id", fs.arg_max(F.col("p")).alias("label"), F.round(F.array_max("p"), 6).alias("top"))


# streams: run to the end of what there is, then read as tables


def _last(spark, df):
    """The whole result of a stream after its last batch, in the shared folder: it grows with the keys, so it never goes to the driver."""
    import uuid

    from ..shared import shared_dir

    path = f"{shared_dir(spark)}/textmill/stream-{uuid.uuid4().hex}"
    last = []

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[:] = [number]

    q = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], df.schema)


def _events_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    # a file source reads a folder; a single file is given by its name as the pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not _is_file(spark, path) else f"{sf_dir}/event[s].parquet")


def _is_file(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("SELECT event_type, CASE WHEN value >= 80 THEN 'red' WHEN value >= 50 THEN 'yellow' ELSE 'green' END AS level, count(*) AS n FROM events GROUP BY ALL")
def stream_level_counts(spark, sf_dir):
    from ..streaming.scoring import live_levels

    s = _events_stream(spark, sf_dir).select("event_type", F.col("value").alias("p"), F.lit(None).cast("int").alias("words"))
    return _last(spark, live_levels(s, fs.Grading(50, 80), "event_type"))


@query("SELECT user_id, event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Event-time windows over a stream: an addition, as event time has no counterpart in online scoring."""
    from ..streaming.scoring import windowed

    w = windowed(_events_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "31 days", "1 day", ["user_id", "event_type"], "value")
    m = _last(spark, w)
    return m.select("user_id", "event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type || ':' || user_id AS text, substr(sha256('m' || chr(2) || event_type || ':' || user_id), 1, 32) AS k, length(event_type || ':' || user_id) / 100 AS p FROM (SELECT DISTINCT event_type, user_id FROM events)")
def stream_score_dedup(spark, sf_dir):
    """Each distinct text of a stream is scored once into a keyed store, which is joined back."""
    import uuid

    from ..shared import shared_dir
    from ..streaming.scoring import run_available, score_batch

    path = f"{shared_dir(spark)}/textmill/scores-{uuid.uuid4().hex}"
    text = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    run_available(_events_stream(spark, sf_dir).select(text.alias("text")), f"{path}-checkpoint", score_batch(path, "m", lambda t: F.length(t) / 100, NOW))
    texts = table(spark, sf_dir, "events").select(text.alias("text")).distinct().withColumn("k", fs.store_key("m", F.col("text")))
    return texts.join(spark.read.parquet(f"{path}/batch=*").select("k", "p"), "k").select("text", "k", "p")


