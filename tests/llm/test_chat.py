import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from textmill.llm import chat

from .conftest import ODD

SCHEMA = "conv_id long, msg long, seq long, kind string, role string, text string, formatted string"


def brute(events):
    """conv -> [(role, text)]"""
    per = defaultdict(list)
    for c, m, s, k, r, t, _ in events:
        per[c, m].append((s, 0 if k in ("message", "edit", "regenerate") else 1, t or "", r))
    out = defaultdict(list)
    for (c, m), es in sorted(per.items(), key=lambda x: (min(e[0] for e in x[1]), x[0][1])):
        text = ""
        for _, k, t, _ in sorted(es, key=lambda e: e[:3]):
            text = t if k == 0 else text + t
        role = min([(e[0], e[3]) for e in es if e[3] is not None], default=(0, ""))[1]
        out[c].append((role, text))
    return out


def test_fold_and_render_round_trip(spark):
    rnd = random.Random(5)
    words = ["hi", "</s>", "<\\/s>", "[INST]", "\\", "<", "<s>", "\n", "&", "😀", "", None]
    events = []
    for c in range(12):
        seq = 0
        for m in range(rnd.randint(0, 6)):
            for _ in range(rnd.randint(1, 6)):
                seq += rnd.randint(0, 1)
                events.append((c, m, seq, rnd.choice(["message", "delta", "delta", "edit", "regenerate", None]), rnd.choice(["user", "assistant", None, "we ird\n%"]), "".join(w or "" for w in rnd.choices(words, k=3)), "clash"))
    df = spark.createDataFrame(events, SCHEMA).repartition(4)
    got = chat.format_conversations(df, ["msg"]).select("conv_id", "formatted", "loss_mask", chat.parse(F.col("formatted")).alias("t")).collect()
    want = brute(events)
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        assert [(t.role, t.text) for t in r.t] == want[r.conv_id]
        assert r.formatted.count("</s>") == len(want[r.conv_id])
        assert len(r.loss_mask) == sum(role == "assistant" for role, _ in want[r.conv_id])


def test_every_control_string_is_escaped(spark):
    rows = [(i, s * 2 + "\\" + s) for i, s in enumerate(chat.CONTROL_STRINGS)] + [(99, ""), (98, "<<\\\\/s>[[/INST]")]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("e", chat.escape(F.col("text"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.text and not any(s in r.e for s in chat.CONTROL_STRINGS)


def test_empty_log(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA), ["msg"]).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 2, None, "x"), (1, 1, "assistant", "b"), (None, 0, "user", "null id"), (2, 0, "assistant", "a</s>"), (2, 0, "assistant", "a</s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op2_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("user\nq\nassistant\n\nassistant\nb\n\nx\n") and got[1].loss_chars == 1
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("a</s>a</s>")
    probe = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == sha(probe) and got[-1].loss_chars == len(probe) and None in got


def test_turns_as_an_event_log(spark):
    rnd = random.Random(11)
    texts = [t or "" for t in ODD if t != "\u0000 nul"] + ["é😀\n" * 500, "</s>" * 300, "a" * chat.DELTA, "b" * (chat.DELTA + 1)]
    turns = [(c, t, "assistant" if t % 2 else "user", rnd.choice(texts)) for c in range(40) for t in range(rnd.randint(1, 6))]
    turns += [(99, i, "assistant", t) for i, t in enumerate(texts)] + [(98, 0, "user", "long " * 500_000), (97, None, None, "no turn")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    log = chat.as_events(df, ["turn"], "turn")
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert all(kinds[k] > 5 for k in ("message", "delta", "edit", "regenerate"))
    got = chat.format_conversations(log, ["turn"]).select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()
    want = defaultdict(list)
    for c, _, role, text in sorted(turns, key=lambda x: (x[0], x[1] or 0)):
        want[c].append((role or "", text))
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in got} == want
