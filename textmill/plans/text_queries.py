"""Queries on texts: counts, features, normalisation, cleaning, pieces, language, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..operators import counts
from .base import WORDS_SQL, group_sql
from .catalogue import query, table

SP, WD = tx.SPACE, tx.WORD
Q = lambda rx: rx.replace("'", "''")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {WORDS_SQL} AS n_words, length(text) AS n_chars, round(length(text) / greatest({WORDS_SQL}, 1), 6) AS chars_per_word FROM documents")
def word_count(spark, sf_dir):
    n = tx.word_count(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", n.alias("n_words"), F.length("text").alias("n_chars"), F.round(F.length("text") / F.greatest(n, F.lit(1)), 6).alias("chars_per_word"))


@query(f"SELECT lang, {group_sql(WORDS_SQL, tx.LENGTH_GROUPS)} AS length_group, count(*) AS n FROM documents GROUP BY ALL")
def length_group_receipt(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", udfs.words("text").alias("n"))  # a column, as every limit of a group reads it
    return counts.receipt(d.withColumn("length_group", tx.length_group(F.col("n"))), ["lang", "length_group"])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def receipt_grouping_sets(spark, sf_dir):
    return counts.totals(docs(spark, sf_dir), [["lang", "source"], ["lang"], []])


@query("SELECT lang, source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS percent FROM documents GROUP BY lang, source")
def share_of_language(spark, sf_dir):
    return counts.share_of_parent(docs(spark, sf_dir), ["lang", "source"], ["lang"])


_rates = ", ".join(f"round(100.0 * len(regexp_extract_all(text, '{Q(('(?m)' if n == 'markdown' else '') + rx)}')) / greatest({WORDS_SQL}, 1), 6) AS {n}" for n, rx in tx.PER_100_WORDS.items())


@query(f"SELECT doc_id, {WORDS_SQL}::DOUBLE AS words, round(length(text) / greatest({WORDS_SQL}, 1), 6) AS chars_per_word, {_rates} FROM documents")
def surface_features(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[(F.round(c, 6) if n != "words" else tx.word_count(F.col("text")).cast("double")).alias(n) for n, c in tx.feature_rates(F.col("text")).items()])


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{Q(rx)}') AS {n}" for n, rx in tx.FLAGS.items()) + " FROM documents")
def feature_flags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in tx.feature_flags(F.col("text")).items()])


@query(f"""SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, trim(regexp_replace(translate(regexp_replace(text, '{tx.INVISIBLE}', '', 'g'),
  '{Q(tx.CURLY)}', '{Q(tx.STRAIGHT)}'), '[{SP}]+', ' ', 'g')) AS t FROM documents)""")
def normalise_whitespace_quotes(spark, sf_dir):
    t = tx.single_spaces(tx.straight_quotes(tx.strip_invisible(F.col("text"))))
    return docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


_marks = Q(rf"[{WD}] (?:n't|'s|'re|'ve|'ll|'m|'d)(?:[^{WD}]|\z)|[{WD}] [,.](?: |\n?\z)|\( [{WD}]|[{WD}] \)")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_marks}')) AS marks FROM documents")
def tokenisation_marks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.tokenisation_marks(F.col("text")).alias("marks"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN regexp_replace(text, '([{WD}])([.,])', '\\1 \\2', 'g') ELSE text END AS text FROM documents)
WHERE len(regexp_extract_all(text, '{_marks}')) >= 3 AND 100 * len(regexp_extract_all(text, '{_marks}')) >= 1.5 * {WORDS_SQL}""")
def tokenised_filter(spark, sf_dir):
    """Half of the texts get the spaces of a tokeniser first."""
    spaced = F.when(F.length("text") % 2 == 0, F.regexp_replace("text", f"([{WD}])([.,])", "$1 $2")).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", spaced.alias("text")).filter(tx.is_tokenised(F.col("text"))).select("doc_id")


def normalised(rows: DataFrame, column: str = "text") -> DataFrame:
    """The text after all steps, and `changes`: the names of those that changed it. Each step is a column of its own, so none is computed twice."""
    rows = rows.withColumn("_0", F.col(column))
    names = []
    for i, (name, step) in enumerate(tx.NORMALISE_STEPS):
        rows = rows.withColumn(f"_{i + 1}", step(F.col(f"_{i}")))
        names.append(F.when(F.col(f"_{i + 1}") != F.col(f"_{i}"), F.lit(name)))
    last = len(tx.NORMALISE_STEPS)
    rows = rows.withColumn(column, F.col(f"_{last}")).withColumn("changes", F.array_compact(F.array(*names)))
    return rows.drop(*[f"_{i}" for i in range(last + 1)])


@query()
def normalise_full(spark, sf_dir):
    return normalised(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", F.concat_ws(",", "changes").alias("changes"))


def cleaned(rows: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Adds reason (null: kept) and changes to rows(id, source, sub_source, prompt_type, grp, text), and changes the text; a
    dropped row has none.

    openings(grp, opening): the human text that a continuation of the group begins with. changes names what was done up to
    the drop, in order.
    """
    t = F.col("text")
    if openings is None:
        rows = rows.withColumn("opening", F.lit(None).cast("string"))
    else:
        rows = rows.join(openings.select("grp", "opening"), "grp", "left")
    dated = (F.col("source") == "wikimedia") & (F.col("sub_source") == "wikinews") & t.rlike(tx.DATELINE)
    named = [F.when(dated, "dateline")]
    rows = rows.withColumn("_n", F.array(*named)).withColumn("text", F.when(dated, F.regexp_replace(t, tx.DATELINE, "")).otherwise(t))
    add = lambda name, holds: F.array_append("_n", F.when(holds, F.lit(name)))
    for name, rx in tx.BOILERPLATE:
        rows = rows.withColumn("_n", add(name, t.rlike(rx))).withColumn("text", F.regexp_replace(t, rx, ""))
    rows = rows.withColumn("_n", add("prompt_echo", t.rlike(tx.PROMPT_ECHO))).withColumn("text", tx.cut_prompt_echo(t))
    goes_on = (F.col("source") == "mage") & F.coalesce(F.col("prompt_type") == "continuation", F.lit(False))
    shared = tx.shared_words(t, F.col("opening"))
    long_enough = tx.once(shared, lambda n: F.when(F.coalesce(n, F.lit(0)) < 10, 30).otherwise(n))
    rows = rows.withColumn("_n", add("shared_opening", goes_on)).withColumn("_rest", F.when(goes_on, tx.cut_words(t, long_enough)))
    head = F.regexp_replace(F.substr(t, F.lit(1), F.length(t) - F.length("_rest")), f"[{SP}]+$", "")
    rows = rows.withColumn("_in", F.coalesce(goes_on & ~tx.ends_complete(head), F.lit(False))).withColumn("text", F.coalesce("_rest", t))
    rows = normalised(rows.withColumn("_tokenised", tx.is_tokenised(t)))
    rows = rows.withColumn("_cut", F.when(F.col("_in"), tx.after_first_sentence(t)).otherwise(t)).withColumn("_end", tx.trim_end(F.col("_cut")))
    reason = F.when(F.col("_tokenised"), "tokenised").when(F.col("_cut").isNull(), "no_sentence_after_opening").when(tx.word_count(F.col("_end")) < tx.MIN_WORDS, "short")
    before, steps = F.array_compact("_n"), F.when(F.col("_tokenised"), F.array().cast("array<string>")).otherwise(F.col("changes"))
    trimmed = F.when(~F.col("_tokenised") & (F.col("_cut") != F.col("_end")), F.array(F.lit("incomplete_end"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("reason", reason).withColumn("changes", F.concat(before, steps, trimmed)).withColumn("text", F.when(F.col("reason").isNull(), F.col("_end")))
    return rows.drop("opening", "_n", "_rest", "_in", "_tokenised", "_cut", "_end")


def soiled(spark, sf_dir) -> DataFrame:
    """rows(doc_id, lang, source, sub_source, prompt_type, grp, text): all documents, with what cleaning looks for put into some of them."""
    kind, t = F.pmod(F.xxhash64("doc_id"), F.lit(8)), F.col("text")
    lead = F.array_join(F.slice(F.split(t, " "), 1, 12), " ")
    text = (
        F.when(kind == 0, F.concat(F.lit("Friday, June 5, 2009 "), t))
        .when(kind == 1, F.concat(t, F.lit("\n\nHello, users of CMV! This is a footnote from your moderators. Read on. Happy CMVing!")))
        .when(kind == 2, F.concat(t, F.lit(" The following is the full text of the abstract for a paper titled X from arxiv.org: "), lead))
        .when(kind == 3, F.regexp_replace(t, r"(?<=\w)([.,])", " $1"))
        .otherwise(t)
    )
    source = F.when(kind == 0, "wikimedia").when(kind >= 6, "mage").otherwise(F.col("source"))
    return docs(spark, sf_dir).select("doc_id", "lang", source.alias("source"), F.when(kind == 0, "wikinews").otherwise(F.col("lang")).alias("sub_source"), F.when(kind >= 6, "continuation").otherwise("").alias("prompt_type"), F.col("doc_id").alias("grp"), text.alias("text"))


def cleaned_soiled(spark, sf_dir) -> DataFrame:
    words = tx.first_words(F.col("text"), F.lit(25))
    openings = soiled(spark, sf_dir).filter(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 6).select("grp", F.concat(F.array_join(words, " "), F.lit(" other words")).alias("opening"))
    return cleaned(soiled(spark, sf_dir), openings.distinct())


@query()
def clean_rows(spark, sf_dir):
    """Openings are known for half of the continuations, the first 25 words of their texts."""
    return cleaned_soiled(spark, sf_dir).select("doc_id", "text", "reason", F.concat_ws(",", "changes").alias("changes"))


@query()
def clean_drop_receipt(spark, sf_dir):
    return counts.receipt(cleaned_soiled(spark, sf_dir), ["lang", "reason"])


_prefix = f"substr(sha1(array_to_string(regexp_extract_all(lower(text), '[{WD}]+')[1:12], ' ')), 1, 16)"


@query(f"SELECT doc_id, {_prefix} AS grp FROM documents")
def prefix_group(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.prefix_group(F.col("text")).alias("grp"))


@query(f"SELECT grp, count(*) AS n FROM (SELECT {_prefix} AS grp FROM documents) GROUP BY grp ORDER BY n DESC, grp LIMIT 5")
def group_sizes_top5(spark, sf_dir):
    return counts.top(prefix_group(spark, sf_dir), "grp", 5)


_end = "[.!?\\x{2026}][\"''\\x{201d}\\x{2019}\\x{bb})\\]]?"


@query(f"""WITH c AS (SELECT doc_id, text, substr(text, 1, 1500) AS cut FROM documents),
e AS (SELECT *, regexp_extract(cut, '(?s)^(.*{_end})[{SP}\\x{{feff}}]', 1) AS sentence, regexp_extract(cut, '(?s)^(.*) ', 1) AS word FROM c)
SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text WHEN length(sentence) >= 900 THEN sentence
  WHEN contains(cut, ' ') AND length(word) >= 900 THEN word ELSE cut END AS t FROM e)""")
def clip_text(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", tx.clip(F.col("text"), 1500).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


@query("""WITH p AS (SELECT doc_id, substr(text, 1, 1500) AS t FROM documents),
c AS (SELECT doc_id, [substr(t, i + 1, 500) for i in range(0, greatest(length(t), 1), 400)] AS ps FROM p),
k AS (SELECT doc_id, CASE WHEN len([x for x in ps if length(x) >= 200]) > 0 THEN [x for x in ps if length(x) >= 200] ELSE ps[1:1] END AS ps FROM c)
SELECT doc_id, i - 1 AS pos, ps[i] AS piece FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM k)""")
def chunks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("pos", "piece"))


@query()
def excerpts(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text").withColumn("e", udfs.excerpt()(F.col("doc_id").cast("string"), F.col("text")))
    return d.select("doc_id", F.col("e.start").alias("first"), F.col("e.end").alias("last"), F.substr("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("excerpt"))


@query()
def split_halves(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", udfs.split_half("text").alias("h")).select("doc_id", "h.first", "h.second")


@query()
def seeded_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", udfs.seeded(F.concat(F.lit("50:"), F.col("doc_id").cast("string"))).cast("string").alias("h"))


_sets = {k: "[" + ", ".join(f"'{w}'" for w in v.split()) + "]" for k, v in tx.FUNCTION_WORDS.items()}
_hits = ", ".join(f"{{'h': len([x for x in w if list_contains({s}, x)]), 'i': {-i}, 'k': '{k}'}}" for i, (k, s) in enumerate(_sets.items()))
_detect = f"""l0 AS (SELECT doc_id, lang, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '\\p{{Latin}}')) AS latin,
  regexp_extract_all(lower(text), '\\p{{L}}+(?:[''’]\\p{{L}}+)?') AS w FROM documents),
l1 AS (SELECT *, list_reverse_sort([{_hits}]) AS r FROM l0),
l2 AS (SELECT doc_id, lang, CASE WHEN letters < 20 OR latin * 2 < letters THEN '' WHEN len(w) >= 12 AND r[1].h > 0 AND r[1].h >= len(w) * 0.12 AND r[1].h >= r[2].h * 1.5
  THEN r[1].k ELSE '' END AS detected FROM l1)"""


def detected(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", "text", tx.language_words(F.col("text")).alias("w"))
    return d.select("doc_id", "lang", tx.detect_language(F.col("text"), F.col("w")).alias("detected"))


@query(f"WITH {_detect} SELECT doc_id, detected FROM l2")
def detect_language(spark, sf_dir):
    return detected(spark, sf_dir).select("doc_id", "detected")


@query(f"WITH {_detect} SELECT lang, CASE WHEN detected = '' THEN lang ELSE detected END AS final, CASE WHEN detected NOT IN ('', 'en') THEN detected ELSE '' END AS \"foreign\", count(*) AS n FROM l2 GROUP BY ALL")
def language_confusion(spark, sf_dir):
    d = detected(spark, sf_dir)
    return counts.receipt(d.withColumn("final", F.coalesce(F.nullif("detected", F.lit("")), "lang")).withColumn("foreign", tx.foreign(F.col("detected"), ["en"])), ["lang", "final", "foreign"])


@query("""SELECT conv_id, turn, to_json({'text': text}) AS state, CASE WHEN role = 'assistant' THEN 0.95 ELSE 0.05 END AS p_ai, CASE WHEN role = 'assistant' THEN 0.05 ELSE 0.95 END AS p_human
FROM conversations WHERE role <> 'system' AND length(text) > 0""")
def training_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter((F.col("role") != "system") & (F.length("text") > 0))
    p = F.when(F.col("role") == "assistant", F.lit(0.95)).otherwise(F.round(1 - F.lit(0.95), 4))
    return c.select("conv_id", "turn", F.to_json(F.struct("text")).alias("state"), p.alias("p_ai"), F.round(1 - p, 4).alias("p_human"))


@query()
def corpus_checksum(spark, sf_dir):
    return counts.checksum(docs(spark, sf_dir), ["doc_id", "text", "lang", "source"])
