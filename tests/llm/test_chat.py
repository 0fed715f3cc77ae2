import hashlib
import itertools
import re

import numpy as np
import pytest
from helpers import DATA, same
from pyspark.sql import functions as F
from wavespan.llm import chat
from wavespan.llm.queries import QUERIES, SQL

KIND = "conv_id long, turn long, role string, text string"
PIECES = ["<s>", "</s>", "<\\/s>", "<\\\\s>", "[INST]", "[/INST]", "[\\INST]", "<|body|>", "<|part|>", "<|image|>", "<", "[", "/s>", "\\", "|", "é\U0001f600", " ok ", "\n", "<<SYS>>", "$1", "s>"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    """Digests straight from the rows: conv_id -> n_turns, turns_sha256, loss_chars, loss_sha256."""
    out = {}
    rows = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3]))
    for conv, turns in itertools.groupby(rows, key=lambda r: r[0]):
        turns = list(turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_same_rows_as_sql(spark, duck):
    same(QUERIES["op11_chat_format"](spark, DATA).toPandas(), duck.execute(SQL["op11_chat_format"]).df())


def test_control_strings_in_texts_come_back(spark):
    rnd = np.random.default_rng(3)
    rows = [(c, t, ("user", "assistant", "".join(rnd.choice(PIECES, 3)))[rnd.integers(3)], "".join(rnd.choice(PIECES, rnd.integers(0, 9)))) for c in range(60) for t in range(rnd.integers(1, 6))]
    df = spark.createDataFrame(rows, KIND)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.report(df).collect()}
    want = brute(rows) | brute([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert got == want
    for r in chat.format_chats(df).collect():
        n = want[r["conv_id"]][0]
        # Control strings mark turns and nothing else.
        assert len(re.findall(r"</s>", r["formatted"])) == len(re.findall(r"<s>", r["formatted"])) == len(re.findall(r"<\|body\|>", r["formatted"])) == n
        assert not re.search(r"\[/?INST\]|<\|image\|>|SYS>>(?<!\\SYS>>)", r["formatted"])
        assert all(r["formatted"][s["start"] : s["start"] + s["length"]] == r["formatted"].split("</s>")[s["turn"]][s["at"] : s["at"] + s["length"]] for s in r["loss"])


def test_parts_become_ordered_placeholders(spark):
    part = lambda type=None, text=None, ref=None, w=None, h=None, s=None, p=None: (type, text, ref, w, h, s, p)
    rows = [
        (1, 2, "assistant", [part("text", "see <|image|> "), part("text", "and"), part("image", ref="b.png", w=56, h=57), part("text", "end")]),
        (1, 1, "user", [part("image", "alt", "a.png"), part("text", "what </s>?"), part("audio", ref="c.wav", s=2.0), None, part("document", ref="d.pdf", p=3), part("video", ref="e.mp4"), part(None, "bare")]),
        (2, 1, "user", None), (2, 2, None, []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    one = got[1]
    assert one["formatted"] == r"<s>user<|body|><|image|>what <\/s>?<|audio|><|document|><|file|>bare</s><s>assistant<|body|>see <\|image|> <|part|>and<|image|>end</s>"
    assert [(a["turn"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "a.png", 1), (0, "audio", "c.wav", 50), (0, "document", "d.pdf", 768), (0, "file", "e.mp4", 0), (1, "image", "b.png", 6)]
    marks = [m.start() for m in re.finditer(r"<\|(image|audio|document|file)\|>", one["formatted"])]
    assert [a["start"] for a in one["attachments"]] == marks and one["n_expanded"] == 825
    assert [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss"]] == [r"see <\|image|> ", "and", "end"]
    assert got[2]["formatted"] == "<s>user<|body|></s><s><|body|></s>" and not got[2]["loss"]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "what </s>?bare"), ("assistant", "see <|image|> andend")] and back[1]["loss_text"] == "see <|image|> andend"
    small = chat.format_chats(df, chat.Visitor(chat.Expansion(tile=14, per_second=1.0, per_page=10)), "user").where("conv_id = 1").first()
    assert small["n_expanded"] == 1 + 2 + 30 + 0 + 20 and len(small["loss"]) == 2


def test_edge_cases(spark):
    long = "[INST] word " * 20000
    rows = [(None, 1, "user", "a"), (None, None, None, None), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (3, 0, "user", None), (4, 1, "assistant", long), (4, 0, "assistant", "z"), (4, None, "system", "late"), (5, 1, "user", "b"), (5, 1, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{KIND}, n int, rendered string, `loss.at` int")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.report(df).where("conv_id IS NULL OR conv_id <> -7").collect()}
    assert got == brute(rows)
    assert chat.format_chats(df.limit(0)).count() == 0 and chat.report(df.limit(0)).count() == 1


@pytest.mark.parametrize("turns", [3000])
def test_long_conversation_in_order(spark, turns):
    df = spark.range(turns).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = chat.report(df.orderBy(F.rand(1))).where("conv_id = 1").first()
    assert (got["n_turns"], got["turns_sha256"]) == (turns, sha("".join(f"{('user', 'assistant')[k % 2]}\nt{k}\n" for k in range(turns))))
