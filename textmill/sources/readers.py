"""Readers with explicit schemas, and parsers of labelled corpora into one row format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prefix_group

ROW = "id string, source string, sub_source string, domain string, label int, generator string, grp string, text string, meta map<string,string>"
QA = "question string, human_answers array<string>, chatgpt_answers array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """JSON lines; strict: a bad line or a missing file stops the run; lenient: both are nothing."""
    if lenient:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, quoted fields of any length and line breaks; all strings; a byte-order mark goes."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("encoding", "UTF-8").csv(path)
    r = r.toDF(*[c.removeprefix("﻿") for c in r.columns])
    return r.select(*[F.col(c).cast("string") for c in columns])


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated lines; empty ones and those that begin with # go."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    return lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha256"))


def stopped(ok: Column, message: Column, value: Column) -> Column:
    """value, or an error that stops the run."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def make_rows(items: DataFrame, source: str, domains: dict[str, str | None], renames: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Rows in the corpus format. domains: sub_source to domain, None leaves a sub_source out; an unknown one stops the run.
    Empty texts go."""
    known = [F.lit(x) for k, v in domains.items() for x in (k, v or "")]
    sub = stopped(F.col("sub_source").isin(*domains), F.concat(F.lit(f"{source}: unknown sub_source "), F.coalesce("sub_source", F.lit("null"))), F.col("sub_source"))
    names = [F.lit(x) for kv in renames.items() for x in kv]
    r = items.withColumn("sub_source", sub).withColumn("domain", F.create_map(*known)[F.col("sub_source")])
    r = r.filter((F.col("domain") != "") & (F.trim("text") != ""))
    generator = F.when(F.col("label") == 0, "human").otherwise(F.coalesce(F.create_map(*names)[F.col("generator")], "generator") if names else F.col("generator"))
    return r.select(
        F.concat_ws(":", F.lit(source), "id").alias("id"), F.lit(source).alias("source"), "sub_source", "domain", F.col("label").cast("int").alias("label"),
        generator.alias("generator"), F.concat_ws(":", F.lit(source), "grp").alias("grp"), "text", F.col("meta").cast("map<string,string>").alias("meta"),
    )



def parse_answers(items: DataFrame, sub: str, ordinal: str = "line") -> DataFrame:
    """Questions with lists of human and generated answers, to a row for each; a question is a group."""
    group = F.concat_ws(":", F.lit(sub), F.col(ordinal).cast("string"))

    def side(column: str, tag: str, label: int) -> DataFrame:
        r = items.select(group.alias("grp"), F.posexplode(column).alias("j", "text"))
        return r.select(F.concat("grp", F.lit(f":{tag}"), F.col("j").cast("string")).alias("id"), F.lit(sub).alias("sub_source"), F.lit(label).alias("label"), F.lit("chatgpt").alias("generator"), "grp", "text", F.create_map().cast("map<string,string>").alias("meta"))

    return side("human_answers", "h", 0).unionByName(side("chatgpt_answers", "a", 1))


#: Fixed values.
PROMPT_TYPES = ("continuation", "topical", "specified")


def parse_coded(items: DataFrame, part: str, out_of_domain: bool = False, known: tuple[str, ...] = (), repeats_humans: bool = False, ordinal: str = "line") -> DataFrame:
    """Rows whose origin is a code (`sub_human`, `sub_machine_<prompt>_<generator>`, or of an out-of-domain file `sub_gpt4`,
    `sub_human_para`, `sub_gpt4_para`) and whose label is 1 for human. Another code, or a label against it, stops the run."""
    src = F.col("src")
    machine = rf"^(.*?)_machine_({'|'.join(PROMPT_TYPES)})_(.+)$"
    loose = rf"^({'|'.join(known) or '(?!)'})_(gpt4|human_para|gpt4_para)$"
    tail = F.regexp_extract(src, loose, 2)
    human = src.rlike("_human$")
    coded = F.when(human, F.struct(F.regexp_replace(src, "_human$", "").alias("sub"), F.lit("").alias("prompt"), F.lit("human").alias("generator")))
    coded = coded.when(src.rlike(machine), F.struct(F.regexp_extract(src, machine, 1).alias("sub"), F.regexp_extract(src, machine, 2).alias("prompt"), F.regexp_extract(src, machine, 3).alias("generator")))
    prompt = F.when(tail == "human_para", "paraphrase_of_human").when(tail == "gpt4_para", "paraphrase").otherwise("")
    generator = F.when(tail == "human_para", "gpt-3.5-trubo").otherwise("gpt4")
    coded = coded.when(tail != "", F.struct(F.regexp_extract(src, loose, 1).alias("sub"), prompt.alias("prompt"), generator.alias("generator")))
    fits = coded.isNotNull() & ((F.col("label") == "1") == human)
    r = items.withColumn("_c", stopped(fits, F.concat(F.lit("label or code unexpected: "), F.coalesce(src, F.lit("null"))), coded))
    if repeats_humans:
        r = r.filter(F.col("_c.generator") != "human")
    text = F.regexp_replace("text", "^﻿", "")
    group = F.concat(F.lit("ood:"), F.col("_c.sub")) if out_of_domain else prefix_group(text)
    meta = F.map_filter(F.create_map(F.lit("split"), F.lit(part), F.lit("prompt_type"), F.col("_c.prompt")), lambda _, v: v != "")
    return r.select(F.concat_ws(":", F.lit(part), F.col(ordinal).cast("string")).alias("id"), F.col("_c.sub").alias("sub_source"), F.when(F.col("_c.generator") == "human", 0).otherwise(1).alias("label"), F.col("_c.generator").alias("generator"), group.alias("grp"), text.alias("text"), meta.alias("meta"))


def parse_attacked(items: DataFrame, domains: list[str], attacks: tuple[str, ...] = ("none",)) -> DataFrame:
    """Generations with their human document's id as group. An unknown domain stops the run, whatever the attack."""
    r = items.withColumn("domain", stopped(F.col("domain").isin(*domains), F.concat(F.lit("unknown domain "), F.coalesce("domain", F.lit("null"))), F.col("domain"))).filter(F.col("domain").isNotNull() & F.col("attack").isin(*attacks))
    human = F.col("model") == "human"
    meta = F.map_filter(F.create_map(F.lit("attack"), F.col("attack"), F.lit("decoding"), F.when(~human, F.col("decoding")), F.lit("repetition_penalty"), F.when(~human, F.col("repetition_penalty"))), lambda _, v: v.isNotNull())
    return r.select("id", F.col("domain").alias("sub_source"), F.when(human, 0).otherwise(1).alias("label"), F.col("model").alias("generator"), F.col("source_id").alias("grp"), F.col("generation").alias("text"), meta.alias("meta"))


PARSERS: dict[str, Callable[..., DataFrame]] = {"answers": parse_answers, "coded": parse_coded, "attacked": parse_attacked}
