"""Record constructors: training rows, prompts and chat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import reasoning_steps, sanitize, strip_tags, token_count


#: Fixed values of the format: how a hard answer's parts are joined, and what marks easy and hard rows.
WITH_BOTH = ("Let me work through this step by step:\n\n", "\n\nChecking my reasoning:\n")
WITH_DRAFT, WITH_THINKING, ANSWER = "Let me work through this:\n\n", "Analyzing this problem:\n\n", "\n\nFinal answer:\n"
MARKS = {"easy": {"task_type": "general", "complexity": "low"}, "hard": {"task_type": "complex", "complexity": "high"}}


def question_record(question: Column, domain: Column, model: str, difficulty: str = "easy") -> list[Column]:
    """question, difficulty, domain, model_used, generated_at."""
    return [question.alias("question"), F.lit(difficulty).alias("difficulty"), domain.alias("domain"), F.lit(model).alias("model_used"), F.lit(None).cast("string").alias("generated_at")]


def _answer_meta(domain: Column, model: str, difficulty: str, tokens: Column, *more: Column) -> Column:
    hard = difficulty == "hard"
    return F.struct(
        F.lit(difficulty).alias("difficulty"), domain.alias("domain"), *[F.lit(v).alias(k) for k, v in MARKS[difficulty].items()],
        F.lit(hard).alias("requires_reasoning"), F.lit("none").alias("harm_category"), tokens.alias("token_count"), F.lit(model).alias("teacher_model"), *more,
    ).alias("metadata")


def easy_record(question: Column, answer: Column, domain: Column, model: str) -> list[Column]:
    a = sanitize(answer)
    return [sanitize(question).alias("prompt"), a.alias("response"), _answer_meta(domain, model, "easy", token_count(a))]


def hard_record(question: Column, sections: Column, domain: Column, model: str) -> list[Column]:
    parts = {k: sanitize(sections[k]) for k in ("draft", "thinking", "response")}
    return [sanitize(question).alias("prompt"), *[v.alias(k) for k, v in parts.items()], _answer_meta(domain, model, "hard", token_count(parts["draft"]) + token_count(parts["thinking"]) + token_count(parts["response"]), reasoning_steps(parts["thinking"]).alias("reasoning_steps"))]


def easy_response(response: Column) -> Column:
    return strip_tags(response)


def hard_response(draft: Column, thinking: Column, response: Column) -> Column:
    """Draft, check and answer as one text, by which of them are there."""
    d, t, r = strip_tags(draft), strip_tags(thinking), strip_tags(response)
    answer = F.concat(F.lit(ANSWER), r)
    return (
        F.when((d != "") & (t != "") & (r != ""), F.concat(F.lit(WITH_BOTH[0]), d, F.lit(WITH_BOTH[1]), t, answer))
        .when((d != "") & (r != ""), F.concat(F.lit(WITH_DRAFT), d, answer))
        .when((t != "") & (r != ""), F.concat(F.lit(WITH_THINKING), t, answer))
        .otherwise(r)
    )


def clean_training_rows(df: DataFrame, difficulty: Column) -> DataFrame:
    """prompt, response, ... of rows with draft, thinking and response: the latter cleaned by difficulty, the others gone."""
    col = lambda n: F.col(n) if n in df.columns else F.lit("")
    cleaned = F.when(F.coalesce(difficulty, F.lit("easy")) == "hard", hard_response(col("draft"), col("thinking"), col("response"))).otherwise(easy_response(col("response")))
    return df.withColumn("response", cleaned).drop("draft", "thinking")


def input_of(input_: Column, prompt: Column) -> Column:
    """The input, or the prompt where it is null or empty; an error where both are."""
    got = F.coalesce(F.nullif(input_, F.lit("")), F.nullif(prompt, F.lit("")))
    return F.coalesce(got, F.raise_error(F.lit("a row has neither input nor prompt")).cast("string"))


def loss_text(input_: Column, output: Column, prompt: Column, response: Column) -> Column:
    return F.coalesce(F.concat(input_, F.lit("\n\n"), output), F.concat(prompt, F.lit("\n\n"), response))


def teacher_record(example_id: Column, input_: Column, output: Column, original: Column, difficulty: Column, domain: Column, model: str, seconds: Column, **params: Column) -> list[Column]:
    meta = F.struct(original.alias("original_output"), example_id.alias("example_id"), F.lit(model).alias("teacher_model"), F.struct(*[v.alias(k) for k, v in params.items()]).alias("generation_params"), token_count(output).alias("num_tokens_generated"), seconds.alias("generation_time"))
    return [input_.alias("input"), output.alias("output"), difficulty.alias("difficulty"), domain.alias("domain"), meta.alias("metadata")]


def messages(prompt: Column, response: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", prompt), turn("assistant", response))


def chat_text(turns: Column) -> Column:
    """Turns (role, content) in the header format of Llama 3 chats."""
    one = lambda t: F.concat(F.lit("<|start_header_id|>"), t["role"], F.lit("<|end_header_id|>\n\n"), t["content"], F.lit("<|eot_id|>"))
    return F.concat(F.lit("<|begin_of_text|>"), F.array_join(F.transform(turns, one), ""))


def stratum(*keys: Column) -> Column:
    """Keys joined by |, each 'unknown' where it is null."""
    return F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("unknown")) for k in keys])


def generation_prompt(domain: Column, difficulty: Column, subtopics: Column, key: Column, count: int) -> Column:
    """A request for questions on a subtopic that a hash of key chooses."""
    topic = F.get(subtopics, F.pmod(F.xxhash64(key), F.size(subtopics)).cast("int"))
    return F.format_string(f"Generate {count} unique %s questions for %s about %s. Return a JSON array.", difficulty, domain, topic)


def batch_prompt(df: DataFrame, batch: str, position: str, question: str) -> DataFrame:
    """One prompt a batch: its questions by position, numbered, with blank lines between."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(question).alias("q")))), lambda x, i: F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(": "), x["q"]))
    return df.groupBy(batch).agg(F.array_join(lines, "\n\n").alias("prompt"))
