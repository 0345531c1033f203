"""Column functions that read what a language model wrote: JSON in fences, with LaTeX, or cut; sections with or without tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import strip

ITEMS = "array<struct<question:string,difficulty:string,domain:string>>"
_STRAY = r'\\(?!["\\/bfnrtu])'


def outer_array(c: Column) -> Column:
    """From the first [ to the last ], null if there is none."""
    found = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def outer_object(c: Column) -> Column:
    """From the first { to the last }, null if there is none."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, r"```json\s*|\s*```", "")


def fenced(c: Column) -> Column:
    """What stands in the first fence, or the text if there is none. An unclosed fence loses its last character."""
    start = F.when(F.instr(c, "```json") > 0, F.instr(c, "```json") + 7).when(F.instr(c, "```") > 0, F.instr(c, "```") + 3)
    rest = F.substring(c, start, F.char_length(c))
    length = F.when(F.instr(rest, "```") > 0, F.instr(rest, "```") - 1).otherwise(F.char_length(rest) - 1)
    return F.when(start.isNull(), c).otherwise(strip(F.substring(rest, F.lit(1), length)))


def without_stray_backslashes(c: Column) -> Column:
    return F.regexp_replace(c, _STRAY, "")


def joined_lines(c: Column) -> Column:
    """Line ends that no backslash precedes become spaces."""
    return F.regexp_replace(c, r"(?<!\\)\n", " ")


def parse_quick(c: Column, schema: str = ITEMS) -> Column:
    """Fences and stray backslashes removed, then parsed; null if that fails."""
    return F.from_json(without_stray_backslashes(without_fences(c)), schema)


def parse_with_latex(c: Column, schema: str = ITEMS) -> Column:
    """As it is if it parses; else the fence's content without LaTeX delimiters and with common commands spelt out."""
    t = F.regexp_replace(fenced(c), r"\\[()\[\]]", "")
    t = F.regexp_replace(t, r"\\(frac|sqrt|sum|int|lim)", "$1")
    return F.coalesce(F.from_json(c, schema), F.from_json(without_stray_backslashes(t), schema))


def parse_aggressive(c: Column, schema: str = ITEMS, commands: bool = True) -> Column:
    """The fence's content without LaTeX delimiters, with backslashes of `\\name{...}` removed (if commands), parsed."""
    t = F.regexp_replace(fenced(c), r"\\[()\[\]]", "")
    if commands:
        pieces = F.regexp_extract_all(t, F.lit(r"(?s)\\[a-zA-Z]+\{[^}]*\}|.[^\\]*|\\"), F.lit(0))
        t = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\\[a-zA-Z]+\{[^}]*\}$"), F.replace(p, F.lit("\\"), F.lit(""))).otherwise(p)), "")
    return F.from_json(without_stray_backslashes(t), schema)


def parse_answers(c: Column) -> Column:
    """An array of strings out of an answer, tried once more with its line ends joined; null if both fail."""
    t = strip(c)
    t = F.when(t.startswith("["), t).otherwise(F.coalesce(outer_array(t), t))
    return F.coalesce(F.from_json(t, "array<string>"), F.from_json(joined_lines(t), "array<string>"))


def align(answers: Column, n: Column) -> Column:
    """The answers padded with nulls or cut to n; n nulls for null answers."""
    none = F.array_repeat(F.lit(None).cast("string"), n)
    return F.slice(F.concat(F.coalesce(answers, F.array().cast("array<string>")), none), F.lit(1), n)


def parse_sections(c: Column) -> Column:
    """struct(draft, thinking, response) of a JSON object that has all three, else null."""
    got = F.from_json(outer_object(c), "draft string, thinking string, response string")
    return F.when(got["draft"].isNotNull() & got["thinking"].isNotNull() & got["response"].isNotNull(), got)


def _tagged(t: Column, tag: str) -> Column:
    a, b = F.instr(t, f"<{tag}>"), F.instr(t, f"</{tag}>")
    return F.when((a > 0) & (b > 0), F.substring(t, a, F.greatest(b + len(tag) + 3 - a, F.lit(0))))


def _struct(parts: list[Column]) -> Column:
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("draft", "thinking", "response"))])


def tagged_sections(c: Column) -> Column:
    """From each first opening tag to the first closing one, tags included; null unless all three are there."""
    parts = [_tagged(c, t) for t in ("draft", "thinking", "response")]
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), _struct(parts))


def headed_sections(c: Column) -> Column:
    """Lines under headers: a line under 50 characters that names a section opens it; blank lines go."""
    kinds = ("draft", "thinking", "response")
    start = F.struct(F.lit("").alias("now"), *[F.array().cast("array<string>").alias(k) for k in kinds])

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        short = F.char_length(line) < 50
        opened = (
            F.when(short & low.contains("draft"), "draft")
            .when(short & low.contains("thinking"), "thinking")
            .when(short & (low.contains("response") | low.contains("final")), "response")
        )
        text = strip(line) != ""
        return F.struct(F.coalesce(opened, acc["now"]).alias("now"), *[F.when(opened.isNull() & text & (acc["now"] == k), F.concat(acc[k], F.array(line))).otherwise(acc[k]).alias(k) for k in kinds])

    got = F.aggregate(F.split(c, "\n"), start, step)
    full = (F.size(got["draft"]) > 0) & (F.size(got["thinking"]) > 0) & (F.size(got["response"]) > 0)
    return F.when(full, _struct([F.concat(F.lit(f"<{k}>\n"), F.array_join(got[k], "\n"), F.lit(f"\n</{k}>")) for k in kinds]))


def thirds(c: Column) -> Column:
    """Thirds of the paragraphs, or of the characters where there are fewer than three."""
    kinds = ("draft", "thinking", "response")
    paragraphs = F.filter(F.split(c, "\n\n"), lambda p: strip(p) != "")
    n, m = F.size(paragraphs), F.char_length(c)
    cut = lambda total: [F.lit(0), F.floor(total / 3).cast("int"), F.floor(total * 2 / 3).cast("int"), total]
    a, b = cut(n), cut(m)
    by_paragraph = [F.concat(F.lit(f"<{k}>\n"), F.array_join(F.slice(paragraphs, a[i] + 1, a[i + 1] - a[i]), "\n"), F.lit(f"\n</{k}>")) for i, k in enumerate(kinds)]
    by_character = [F.concat(F.lit(f"<{k}>"), F.substring(c, b[i] + 1, b[i + 1] - b[i]), F.lit(f"</{k}>")) for i, k in enumerate(kinds)]
    return F.when(n >= 3, _struct(by_paragraph)).otherwise(_struct(by_character))


def sections(c: Column) -> Column:
    """Tags if there, else headers, else thirds. Null and empty answers have none."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(tagged_sections(t), headed_sections(t), thirds(t)))
