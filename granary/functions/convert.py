"""Benchmark rows of several shapes as one: prompt, response and metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import strip

#: Fixed values of the format.
HARD_SUBJECTS = (
    "abstract_algebra", "anatomy", "astronomy", "college_biology", "college_chemistry", "college_computer_science", "college_mathematics",
    "college_physics", "computer_security", "formal_logic", "high_school_physics", "machine_learning", "professional_law",
)
LETTERS = ("A", "B", "C", "D")
DOMAIN_OF = {"math": "Math", "gpqa": "Science", "humaneval": "Coding", "mgsm": "Math", "mmlu": "Reasoning", "drop": "Reading"}
PROMPTS = {
    "drop": ("Read the following passage and answer the question.\n\nPassage: ", "\n\nQuestion: ", "\n\nAnswer:"),
    "gpqa": ("Answer the following graduate-level science question.\n\nQuestion: ", "\n\nAnswer:"),
    "humaneval": ("Complete the following Python function.\n\n",),
    "math": ("Solve the following math problem. Show your work.\n\nProblem: ", "\n\nSolution:"),
    "mgsm": ("Solve this grade-school math problem.\n\nProblem: ", "\n\nAnswer:"),
    "mmlu": ("Answer the following multiple choice question from ", ".\n\nQuestion: ", "\n\n", "\n\nAnswer:"),
}
METADATA = ("difficulty", "domain", "source", "num_answers", "task_id", "entry_point", "level", "type", "answer_number", "subject", "answer_index")
_KIND = {"num_answers": "bigint", "answer_index": "int"}


def _prompt(benchmark: str, *fields: Column) -> Column:
    """The benchmark's fixed parts with the fields after each."""
    parts = [F.lit(p) for p in PROMPTS[benchmark]]
    return F.concat(*[x for pair in zip(parts, [*fields, F.lit("")][: len(parts)]) for x in pair])


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def estimate_difficulty(benchmark: Column, level: Column, subject: Column) -> Column:
    easy_levels = F.lower(F.coalesce(level, F.lit(""))).isin("level 1", "level 2", "easy")
    return (
        F.when(benchmark.isin("GPQA", "MATH"), F.when(easy_levels, "medium").otherwise("hard"))
        .when(benchmark == "HumanEval", "medium")
        .when(benchmark == "MMLU", F.when(F.coalesce(subject, F.lit("")).isin(*HARD_SUBJECTS), "hard").otherwise("medium"))
        .otherwise("easy")
    )


def _row(prompt: Column, response: Column, **metadata: Column) -> list[Column]:
    fields = [metadata.get(k, F.lit(None)).cast(_KIND.get(k, "string")).alias(k) for k in METADATA]
    return [prompt.alias("prompt"), response.alias("response"), F.struct(*fields).alias("metadata")]


def from_drop(df: DataFrame) -> DataFrame:
    answers = F.coalesce(F.col("answers"), F.array().cast("array<string>"))
    prompt = _prompt("drop", _text("passage"), _text("question"))
    return df.select(*_row(prompt, F.coalesce(F.get(answers, F.lit(0)), F.lit("Unknown")), difficulty=F.lit("easy"), domain=F.lit("reading_comprehension"), source=F.lit("DROP"), num_answers=F.size(answers)))


def from_gpqa(df: DataFrame) -> DataFrame:
    prompt = _prompt("gpqa", _text("question"))
    return df.select(*_row(prompt, _text("answer"), difficulty=F.lit("hard"), domain=F.lit("science_qa"), source=F.lit("GPQA")))


def from_humaneval(df: DataFrame) -> DataFrame:
    prompt = _prompt("humaneval", _text("prompt"))
    return df.select(*_row(prompt, _text("canonical_solution"), difficulty=F.lit("medium"), domain=F.lit("code_generation"), source=F.lit("HumanEval"), task_id=F.coalesce("task_id", F.lit("")), entry_point=F.coalesce("entry_point", F.lit(""))))


def math_fields(df: DataFrame) -> DataFrame:
    """problem, solution, level, type, of rows that may have question and answer in place of the first two."""
    either = lambda *names: F.coalesce(*(F.col(n) for n in names if n in df.columns), F.lit(""))
    return df.select(either("problem", "question").alias("problem"), either("solution", "answer").alias("solution"), either("level").alias("level"), either("type").alias("type"))


def field_text(path: str) -> Column:
    """The text of a field, stripped; a dotted path leads through structs. A null on the way gives the empty text."""
    from granary.functions.text import strip

    found = F.col(f"`{path.split('.')[0]}`")
    for name in path.split(".")[1:]:
        found = found[name]
    return strip(F.coalesce(found.cast("string"), F.lit("")))


def from_math(df: DataFrame) -> DataFrame:
    prompt = _prompt("math", _text("problem"))
    return df.select(*_row(prompt, _text("solution"), difficulty=estimate_difficulty(F.lit("MATH"), F.col("level"), F.lit("")), domain=F.lit("mathematics"), source=F.lit("MATH"), level=_text("level"), type=_text("type")))


def from_mgsm(df: DataFrame) -> DataFrame:
    """Rows without a question or an answer go."""
    prompt = _prompt("mgsm", _text("question"))
    full = df.filter((_text("question") != "") & (_text("answer") != ""))
    return full.select(*_row(prompt, _text("answer"), difficulty=F.lit("easy"), domain=F.lit("grade_school_math"), source=F.lit("MGSM"), answer_number=_text("answer_number")))


def lettered(choices: Column) -> Column:
    """The first four choices, a line each, with letters."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.array_join(F.transform(F.slice(choices, 1, len(LETTERS)), lambda x, i: F.concat(F.get(letters, i), F.lit(". "), x)), "\n")


def from_mmlu(df: DataFrame) -> DataFrame:
    """Rows whose answer is no index of a choice, or not among the first four, go."""
    choices, index = F.coalesce(F.col("choices"), F.array().cast("array<string>")), F.coalesce(F.col("answer").cast("int"), F.lit(0))
    subject = _text("subject")
    prompt = _prompt("mmlu", F.replace(subject, F.lit("_"), F.lit(" ")), _text("question"), lettered(choices))
    response = F.concat(F.get(F.array(*[F.lit(x) for x in LETTERS]), index), F.lit(". "), F.get(choices, index))
    out = df.select(*_row(prompt, response, difficulty=estimate_difficulty(F.lit("MMLU"), F.lit(""), F.col("subject")), domain=F.lit("multitask_understanding"), source=F.lit("MMLU"), subject=subject, answer_index=index))
    return out.filter(F.col("response").isNotNull())


#: Each benchmark's converter; add to it for others.
CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"drop": from_drop, "gpqa": from_gpqa, "humaneval": from_humaneval, "math": from_math, "mgsm": from_mgsm, "mmlu": from_mmlu}


def unify(tables: dict[str, DataFrame]) -> DataFrame:
    """The converted rows of all benchmarks by name."""
    parts = [CONVERTERS[name](df) for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_validation(df: DataFrame, benchmark: str) -> DataFrame:
    """input, output, metadata of rows of any of four shapes, by which columns a row has."""
    have = lambda n: F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string")
    shapes = [("problem", "solution"), ("question", "answer")]
    first = F.coalesce(*[F.when(have(a).isNotNull() & have(b).isNotNull(), F.struct(have(a).alias("i"), have(b).alias("o"))) for a, b in shapes],
                       F.when(have("prompt").isNotNull(), F.struct(have("prompt").alias("i"), F.coalesce(have("canonical_solution"), F.lit("")).alias("o"))),
                       F.struct(F.coalesce(have("input"), have("text"), F.lit("")).alias("i"), F.coalesce(have("output"), have("target"), F.lit("")).alias("o")))
    meta = {"difficulty": "easy" if benchmark == "mmlu" else "hard", "domain": DOMAIN_OF.get(benchmark, "Reasoning"), "source": f"benchmark:{benchmark}", "task_type": "evaluation", "benchmark": benchmark}
    return df.select(first["i"].alias("input"), first["o"].alias("output"), F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("metadata"))


def drop_answers(spans: Column, answer_text: Column, answer: Column) -> Column:
    """Answers as an array, from the first form that is there: spans, a text, a single value."""
    return F.coalesce(spans, F.when(answer_text.isNotNull(), F.array(answer_text)), F.when(answer.isNotNull(), F.array(answer)), F.array().cast("array<string>"))


def assembled_choices(correct: Column, *incorrect: Column) -> Column:
    """The correct choice, then those of the others that are there."""
    return F.array_compact(F.array(correct, *incorrect))
