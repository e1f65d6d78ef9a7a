import hashlib
import time

from pyspark.sql import functions as F

from tests.llm.helpers import rows
from weftline.llm import chat


def test_turns_come_back(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "\\ <| \\l \\e |> [INST", None, "", "<|turn|>user<|text|>x<|end|>", "ends with <", "日本\n\\", "[\\INST]<\\|"]
    data = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, None, "a"), (2, 0, "user<|text|>", "b"), (2, None, "assistant", "c"), (2, 0, None, "a"), (None, 0, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"parts": chat.text_part(F.col("text")), "formatted": F.lit(1), "turns": F.lit("")})
    made = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_chat(made).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in data[: len(texts)]]
    assert got[1].loss_text == "".join(t or "" for k, t in enumerate(texts) if k % 2)
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "c"), ("", "a"), ("", "a"), ("user<|text|>", "b")]
    d = {r.conv_id: r for r in chat.chat_digests(made).collect()}
    assert d[None].n_turns == 1 and d[2].loss_sha256 == hashlib.sha256(b"c").hexdigest()
    assert d[1].formatted_chars == len(made.where("conv_id = 1").first().formatted)
    assert chat.chat_digests(chat.format_chat(df.limit(0))).count() == 0


def test_parts(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:double>>"
    data = [(1, 0, "user", [("text", "see <|x", None, None), ("image", None, "a.png", 2.0), ("text", " and ", None, None), ("audio", None, "b.wav", 1.5)]), (1, 1, "assistant", [("document", None, "c.pdf", None), ("text", "ok", None, None)]), (1, 2, "user", None), (1, 3, "user", [("video", "odd", None, None)])]
    made = chat.format_chat(spark.createDataFrame(data, kind))
    r = made.first()
    assert r.formatted == "<|turn|>user<|text|>see \\l|x<|image:0|> and <|audio:1|><|end|><|turn|>assistant<|text|><|document:2|>ok<|end|><|turn|>user<|text|><|end|><|turn|>user<|text|>odd<|end|>"
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 512), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 600)]
    assert r.attachment_tokens == 1150
    assert rows(chat.read_chat(made), "loss_text") == [("ok",)]


def _of(spark, turns):
    made = spark.range(turns).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit("r").alias("ref"), F.lit(1.0).alias("units"))
    return made.withColumn("parts", F.array(part("text", F.concat(F.lit("word "), F.col("turn").cast("string"))), part("image", F.lit(None).cast("string"))))


def test_long_conversation(spark):
    made = chat.format_chat(_of(spark, 20_000))
    r = chat.read_chat(made).first()
    assert len(r.turns) == 20_000 and r.turns[19_999].text == "word 19999"
    assert r.loss_text == "".join(f"word {k}" for k in range(1, 20_000, 2))
    assert [a.number for a in made.first().attachments] == list(range(20_000))


def test_time_grows_with_turns(spark):
    def seconds(turns):
        began = time.time()
        chat.chat_digests(chat.format_chat(_of(spark, turns))).collect()
        return time.time() - began

    seconds(1_000)
    assert seconds(80_000) < 8 * max(1, seconds(20_000))  # 16 times, if each turn were counted from the first


def test_many_parts_in_a_turn(spark):
    parts = [("text", f"t{k}", None, None) if k % 2 else ("audio", None, f"a{k}", 1.0) for k in range(9_999)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", [("image", None, "x", 1.0)])], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:double>>")
    made = chat.format_chat(df).first()
    assert made.attachments[-1].number == 5_000 and made.formatted.endswith("<|image:5000|><|end|>") and made.attachment_tokens == 5_000 * 25 + 256
    assert chat.read_chat(chat.format_chat(df)).first().loss_text == "".join(f"t{k}" for k in range(1, 9_999, 2))
