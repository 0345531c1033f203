"""Column functions on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from granary.functions import convert, records, repair, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def kind(v):
    return {bool: "boolean", int: "int", list: "array<string>"}.get(type(v), "string")


@pytest.mark.parametrize("t, want", [("<response>4</response>", "4"), ("a < b and c > d", "a  d"), ("<<response>x>", ""), (None, ""), (" x　", "x")])
def test_strip_tags(spark, t, want):
    assert one(spark, text.strip_tags(F.col("t")), t=t) == want


@pytest.mark.parametrize("t, want", [("a\r\nb\rc\x00\x0b\td\x85", "a\nb\nc\td\x85"), (None, "")])
def test_sanitize(spark, t, want):
    assert one(spark, text.sanitize(F.col("t")), t=t) == want


@pytest.mark.parametrize(
    "t, want",
    [("1. a 2. b Step 3: c", 3), ("- a\n* b\n• c", 3), ("First we, then first and First", 3), ("This is a plain sentence, long. And this is another sentence here. x", 2), ("x", 1), ("", 0), (None, 0), ("١. one", 1), ("<thinking>1. a</thinking>", 1)],
)
def test_reasoning_steps(spark, t, want):
    assert one(spark, text.reasoning_steps(F.col("t")), t=t) == want


def test_token_count(spark):
    assert one(spark, text.token_count(F.col("t")), t=" a b\n c ") == 3
    assert one(spark, text.token_count(F.col("t")), t="  ") == 0


@pytest.mark.parametrize(
    "t, want",
    [
        ("What is?", ["Too short"]), ("x" * 501, ["Too long", "No ending punctuation"]), ("Solve \\(x\\) now.", ["Contains LaTeX"]),
        ("A fine question here? ", []), ("Please TODO this.", ["Contains placeholder"]), (None, ["Too short", "No ending punctuation"]),
    ],
)
def test_quality_issues(spark, t, want):
    assert one(spark, text.quality_issues(F.col("t")), t=t) == want


@pytest.mark.parametrize(
    "t, domain, want",
    [
        ("s" * 501, "Summarization", "Summarize the following: " + "s" * 500 + "..."), ("s", "Summarization", "Summarize: s"), ("s?", "Summarization", "s?"), ("c?", "Coding", "c?"),
        ("c" * 201, "Coding", "Write a function that: " + "c" * 200), (" c ", "Coding", "Write: c"), ("m", "Math", "m"),
    ],
)
def test_as_question(spark, t, domain, want):
    assert one(spark, text.as_question(F.col("t"), F.col("d")), t=t, d=domain) == want


def test_dedup_keys_and_slugs(spark):
    assert one(spark, text.dedup_key(F.col("t")), t=" What  Is ") == "what  is"
    assert one(spark, text.dedup_key(F.col("t"), False, True), t=" What  Is ") == "What Is"
    assert one(spark, text.slug(F.col("t")), t="Tool Use") == "tool_use"
    assert one(spark, text.unslug(F.col("t")), t="tool_use") == "Tool Use"
    assert one(spark, text.has_markup(F.col("t")), t="x <B>y</B>") is True
    assert one(spark, text.has_section_tag(F.col("t")), t="x <b>") is False
    assert one(spark, text.percent(F.col("a"), F.col("b")), a=1, b=0) is None


ITEM = '{"question": "q", "difficulty": "easy", "domain": "Math"}'


@pytest.mark.parametrize("t, want", [(f"```json\n[{ITEM}]\n```", 1), (f"[{ITEM}, {ITEM}]", 2), ("nonsense", None), (None, None), ('[{"question": "\\(x\\) \\d", "domain": "Math"}]', 1)])
def test_parse_quick(spark, t, want):
    got = one(spark, repair.parse_quick(F.col("t")), t=t)
    assert (len(got) if got is not None else None) == want


@pytest.mark.parametrize("parse", [repair.parse_with_latex, repair.parse_aggressive, lambda c: repair.parse_aggressive(c, commands=False)])
def test_parsers_with_latex(spark, parse):
    raw = 'Here:\n```json\n[{"question": "What is \\(x\\) \\[y\\] and \\sqrt{4} \\d?", "difficulty": "easy", "domain": "Math"}]\n```\nDone'
    got = one(spark, parse(F.col("t")), t=raw)
    assert len(got) == 1 and got[0].question.startswith("What is x y and sqrt{4}")
    assert one(spark, parse(F.col("t")), t="no json") is None
    assert len(one(spark, parse(F.col("t")), t=f"[{ITEM}]")) == 1


def test_parse_answers_and_align(spark):
    assert one(spark, repair.parse_answers(F.col("t")), t='Sure: ["a", "b\nc"] ok') == ["a", "b c"]
    assert one(spark, repair.parse_answers(F.col("t")), t="no") is None
    assert one(spark, repair.align(F.col("t"), F.lit(3)), t=["a"]) == ["a", None, None]
    assert one(spark, repair.align(F.col("t"), F.lit(1)), t=["a", "b"]) == ["a"]
    assert one(spark, repair.align(repair.parse_answers(F.col("t")), F.lit(2)), t="no") == [None, None]


def test_sections(spark):
    of = lambda t: one(spark, repair.sections(F.col("t")), t=t)
    assert tuple(of("a<draft>d</draft><thinking>t</thinking><response>r</response>")) == ("<draft>d</draft>", "<thinking>t</thinking>", "<response>r</response>")
    assert tuple(of("Draft:\none\n\nThinking\ntwo\nFinal answer:\nthree")) == ("<draft>\none\n</draft>", "<thinking>\ntwo\n</thinking>", "<response>\nthree\n</response>")
    assert of("p1\n\np2\n\np3\n\np4").response == "<response>\np3\np4\n</response>"
    assert tuple(of("abcdefg")) == ("<draft>ab</draft>", "<thinking>cd</thinking>", "<response>efg</response>")
    assert of("") is None and of(None) is None
    got = one(spark, repair.parse_sections(F.col("t")), t='x {"draft": "d", "thinking": "t", "response": "r"} y')
    assert tuple(got) == ("d", "t", "r")
    assert one(spark, repair.parse_sections(F.col("t")), t='{"draft": "d"}') is None


@pytest.mark.parametrize(
    "d, t, r, want",
    [
        ("d", "t", "r", "Let me work through this step by step:\n\nd\n\nChecking my reasoning:\nt\n\nFinal answer:\nr"), ("d", "", "r", "Let me work through this:\n\nd\n\nFinal answer:\nr"),
        (None, "t", "<response>r</response>", "Analyzing this problem:\n\nt\n\nFinal answer:\nr"), ("", None, "r", "r"), ("d", "t", "", ""),
    ],
)
def test_hard_response(spark, d, t, r, want):
    assert one(spark, records.hard_response(F.col("d"), F.col("t"), F.col("r")), d=d, t=t, r=r) == want


def test_records(spark):
    df = spark.createDataFrame([("q\r", "a b", "Math")], "q string, a string, d string")
    r = df.select(*records.easy_record(F.col("q"), F.col("a"), F.col("d"), "m")).first()
    assert r.prompt == "q\n" and r.metadata.token_count == 2 and r.metadata.requires_reasoning is False
    s = F.struct(F.lit("d e").alias("draft"), F.lit("1. x 2. y").alias("thinking"), F.lit("r").alias("response"))
    h = df.select(*records.hard_record(F.col("q"), s, F.col("d"), "m")).first()
    assert h.metadata.reasoning_steps == 2 and h.metadata.token_count == 7
    assert one(spark, records.stratum(F.col("a"), F.col("b")), a="x", b=None) == "x|unknown"
    assert one(spark, records.loss_text(F.col("i"), F.col("o"), F.col("p"), F.col("r")), i=None, o="o", p="p", r="r") == "p\n\nr"
    assert one(spark, records.input_of(F.col("i"), F.col("p")), i="", p="p") == "p"
    with pytest.raises(Exception, match="neither input nor prompt"):
        one(spark, records.input_of(F.col("i"), F.col("p")), i="", p=None)
    assert one(spark, records.chat_text(records.messages(F.col("p"), F.col("r"))), p="hi", r="yo").count("<|eot_id|>") == 2


def test_converters(spark):
    drop = convert.from_drop(spark.createDataFrame([(" p ", "q", []), ("p", "q", ["a", "b"])], "passage string, question string, answers array<string>")).collect()
    assert [(r.response, r.metadata.num_answers) for r in drop] == [("Unknown", 0), ("a", 2)]
    mmlu = spark.createDataFrame([("q", ["a", "b", "c", "d", "e"], 1, "anatomy"), ("q", ["a"], 3, "x"), ("q", ["a", "b"], -1, "x"), ("q", ["a"], 0, "us_history")], "question string, choices array<string>, answer int, subject string")
    got = convert.from_mmlu(mmlu).collect()
    assert [(r.response, r.metadata.difficulty) for r in got] == [("B. b", "hard"), ("A. a", "medium")] and "D. d\n\nAnswer:" in got[0].prompt and "from us history." in got[1].prompt
    math = convert.from_math(spark.createDataFrame([("p", "s", "Level 2", "t"), ("p", "s", "Level 5", "t")], "problem string, solution string, level string, type string")).collect()
    assert [r.metadata.difficulty for r in math] == ["medium", "hard"]
    assert convert.from_mgsm(spark.createDataFrame([("", "", ""), ("q", "a", "1")], "question string, answer string, answer_number string")).count() == 1
    assert one(spark, convert.drop_answers(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.col("a")), a="x") == ["x"]
    assert one(spark, convert.assembled_choices(F.col("a"), F.col("b"), F.col("c")), a="x", b=None, c="y") == ["x", "y"]
    generic = convert.to_validation(spark.createDataFrame([("t", "o")], "text string, target string"), "mmlu").first()
    assert (generic.input, generic.output, generic.metadata.difficulty) == ("t", "o", "easy")


def test_batch_and_generation_prompts(spark):
    df = spark.createDataFrame([(0, 1, "b"), (0, 0, "a"), (1, 0, "c")], "batch int, pos int, q string")
    assert {r.batch: r.prompt for r in records.batch_prompt(df, "batch", "pos", "q").collect()} == {0: "Question 1: a\n\nQuestion 2: b", 1: "Question 1: c"}
    assert "about x" in one(spark, records.generation_prompt(F.col("d"), F.lit("easy"), F.array(F.lit("x")), F.col("d"), 5), d="Math")
    assert json.loads('["ok"]') == ["ok"]


def test_sections_of_all_texts(spark, tmp_path):
    """Every branch against plain Python, on texts with and without line breaks."""
    import hashlib

    from granary.plans.catalogue import QUERIES

    kinds = ("draft", "thinking", "response")

    def brute(t):
        if not t:
            return [None] * 3
        if all(f"<{k}>" in t for k in kinds):
            return [t[t.index(f"<{k}>") : t.index(f"</{k}>") + len(k) + 3] for k in kinds]
        now, got = "", {k: [] for k in kinds}
        for line in t.split("\n"):
            named = next((k for k, words in zip(kinds, (("draft",), ("thinking",), ("response", "final"))) if len(line) < 50 and any(w in line.lower() for w in words)), None)
            if named:
                now = named
            elif now and line.strip():
                got[now].append(line)
        if all(got.values()):
            return [f"<{k}>\n" + "\n".join(got[k]) + f"\n</{k}>" for k in kinds]
        parts = [p for p in t.split("\n\n") if p.strip()]
        whole, open_, join = (parts, "\n", "\n".join) if len(parts) >= 3 else (t, "", str)
        n = len(whole)
        return [f"<{k}>{open_}{join(whole[n * i // 3 : n * (i + 1) // 3])}{open_}</{k}>" for i, k in enumerate(kinds)]

    texts = [None, "", "ab", "one line only", "two\nlines", "a\n\nb\n\nc\n\nd", "p\n\n \n\nq", "x <draft>1</draft>\n<thinking>2</thinking><response>3</response>", "Draft:\na\n\nThinking\nb\nFinal\nc\nd"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: list(r)[1:] for r in QUERIES["sections_of_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: [x and hashlib.md5(x.encode()).hexdigest() for x in brute(t)] for i, t in enumerate(texts)}
