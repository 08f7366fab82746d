"""Chat formatting: final messages are folded from an event log and rendered for training.

The log has one row per event. Events of one message share its key; in the order of (seq, kind, text) they fold to the
message's final text:

* ``message`` starts it with a text,
* ``delta`` appends streamed text,
* ``edit`` replaces all text so far,
* ``regenerate`` drops all text so far and starts anew with its own text (usually empty, deltas follow).

Any other kind, and null, counts as ``delta``. Only DataFrame functions are used. Messages are grouped by (conversation,
message key), so a conversation with very many messages is folded by many tasks; it meets in one row only for its text.

Defined results: null texts and roles are empty strings; the role is that of the first event with one; repeated events
append or replace again; an empty log gives an empty result; columns other than those named are ignored; a conversation
whose id is null is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

#: Strings that common chat templates read as control marks.
CONTROL_STRINGS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|startoftext|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
)
OPEN, CLOSE = "<s>", "</s>"
_REST = "|".join("\\Q" + s[1:] + "\\E" for s in CONTROL_STRINGS)


def escape(text: Column) -> Column:
    r"""Put a backslash behind the first sign of each control string: ``</s>`` becomes ``<\/s>``, ``<\/s>`` ``<\\/s>``.

    No control string is left, and :func:`unescape` takes exactly one backslash away again, so every text comes back.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def fold_messages(events: DataFrame, message_key: list[str]) -> DataFrame:
    """Rows (conv_id, *message_key, pos, role, text), one for each message; pos is the seq of its first event."""
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    restart = kind.isin("message", "edit", "regenerate")
    e = events.select("conv_id", *message_key, "seq", F.when(restart, 0).otherwise(1).alias("_k"), "role", F.coalesce("text", F.lit("")).alias("text"))
    of_message = Window.partitionBy("conv_id", *message_key)
    e = e.withColumn("_last", F.max(F.when(F.col("_k") == 0, F.struct("seq", "_k", "text"))).over(of_message))
    e = e.withColumn("_here", F.struct("seq", "_k", "text"))
    live = F.col("_last").isNull() | (F.col("_here") >= F.col("_last"))
    return e.groupBy("conv_id", *message_key).agg(
        F.min("seq").alias("pos"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        # an event repeated as a whole restarts alike; of equal last restarts one text counts
        F.array_sort(F.collect_list(F.when(live & (F.col("_k") == 1), F.struct("seq", "text")))).alias("_deltas"),
        F.first("_last").alias("_last"),
    ).select(
        "conv_id", *message_key, "pos", F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.coalesce(F.col("_last")["text"], F.lit("")), F.array_join(F.transform("_deltas", lambda d: d["text"]), "")).alias("text"),
    )


def render(messages: DataFrame, order: list[str]) -> DataFrame:
    """Rows (conv_id, formatted, loss_mask): each turn is ``<s>``, the URL-encoded role, a line feed, the escaped text, ``</s>``.

    loss_mask holds (start, length) in code points of formatted, one for each assistant text, in order.
    """
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), F.url_encode(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", *order, (F.col("role") == "assistant").alias("_loss"), F.length(head).alias("_head"), F.length(body).alias("_body"), F.concat(head, body, F.lit(CLOSE)).alias("_turn"))
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_at", F.coalesce(F.sum(F.length("_turn").cast("long")).over(before), F.lit(0)))
    got = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_turn", "_loss", "_head", "_body"))).alias("_all"))
    spans = F.transform(F.filter("_all", lambda t: t["_loss"]), lambda t: F.struct((t["_at"] + t["_head"]).alias("start"), t["_body"].alias("length")))
    return got.select("conv_id", F.array_join(F.transform("_all", lambda t: t["_turn"]), "").alias("formatted"), spans.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a rendered conversation."""
    parts = F.split(formatted, CLOSE, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(t: Column) -> Column:
        cut = F.instr(t, "\n")
        role = F.url_decode(F.substr(t, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1))
        return F.struct(role.alias("role"), unescape(F.substr(t, cut + 1)).alias("text"))

    return F.transform(turns, one)


def format_conversations(events: DataFrame, message_key: list[str]) -> DataFrame:
    """The whole operator: fold the log, then render; conversations keep the order (pos, message key) of their messages."""
    return render(fold_messages(events, message_key), ["pos", *message_key])


#: Code points of one streamed delta of `as_events`.
DELTA = 200


def as_events(turns: DataFrame, key: list[str], at: str) -> DataFrame:
    """Turns (conv_id, *key, role, text) as the log of a chat that streams them; it folds back to the same texts.

    Each text comes in deltas of `DELTA` code points. By a hash of its key, a message is streamed plainly, or starts with a
    draft that is regenerated, or with a draft and a delta that an edit replaces, or with its first delta at once.
    seq is (column `at`, number within the message).
    """
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft, none = F.concat(F.substring("text", 1, 40), F.lit(" </s> draft")), F.lit("")
    way = F.pmod(F.xxhash64("conv_id", *key), F.lit(4))
    head = (
        F.when(way == 0, F.array(event("message", none)))
        .when(way == 1, F.array(event("message", draft), event("regenerate", none)))
        .when(way == 2, F.array(event("message", draft), event("delta", draft), event("edit", none)))
        .otherwise(F.array(event("message", F.element_at(F.concat("_parts", F.array(none)), 1))))
    )
    rest = F.when(way == 3, F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0)))).otherwise(F.col("_parts"))
    log = turns.withColumn("_parts", parts).select("conv_id", *key, "role", F.col(at).alias("_at"), F.concat(head, F.transform(rest, lambda t: event("delta", t))).alias("_log"))
    log = log.select("conv_id", *key, "role", "_at", F.posexplode("_log").alias("_i", "_e"))
    return log.select("conv_id", *key, F.struct("_at", "_i").alias("seq"), F.col("_e.kind").alias("kind"), F.when(F.col("_i") == 0, F.col("role")).alias("role"), F.col("_e.text").alias("text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation and the probe -1.

    The turns become an event log with drafts, edits, regenerations and deltas, which is folded and rendered. Of rows that
    share conversation and turn each is a message, in the order of role and text; a null turn comes first.
    """
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = rows.unionByName(probe).withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    return digest(format_conversations(as_events(rows, ["turn", "copy"], "turn"), ["turn", "copy"]))


def digest(formatted: DataFrame) -> DataFrame:
    """Checks read back from the rendered text and its mask."""
    got = formatted.withColumn("_turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))), "")
    return got.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    rest = "|".join("".join("\\" + c if c in "[]|/<>_" and c != "_" else c for c in s[1:]) for s in CONTROL_STRINGS)
    esc = f"regexp_replace(text, '([<\\[])(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{OPEN}{CLOSE}') + length(role) + 1 + length({esc}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


OP2_SQL = _sql()
