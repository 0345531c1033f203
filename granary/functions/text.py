"""Column functions on text. White space and digits are Unicode's, as `(?U)` makes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section tags of answers; marks of a placeholder; marks of LaTeX; endings of a complete question.
SECTION_TAGS = ("response", "draft", "thinking", "answer")
PLACEHOLDERS = ("...", "TODO", "FIXME", "[placeholder]", "<placeholder>")
LATEX_MARKS = ("\\(", "\\[", "\\frac")
ENDINGS = ("?", ".", "!", ":", '"', "'")
STEP_WORDS = ("First", "Second", "Third", "Fourth", "Fifth", "Next", "Then", "Finally", "Additionally", "Moreover")
#: Patterns of a step number and of a bullet, and how texts become questions, with the longest text that is taken whole.
NUMBERED, BULLET = r"(?:\d+\.|Step \d+:|#\d+)", r"(?:^|\n)\s*[-*•]\s+"
SUMMARY, TASK = ("Summarize: ", "Summarize the following: ", 500), ("Write: ", "Write a function that: ", 200)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_tags(c: Column) -> Column:
    """Section tags first, then anything between angle brackets (also in `a < b and c > d`), then outer white space."""
    known = F.regexp_replace(c, f"</?(?:{'|'.join(SECTION_TAGS)})>", "")
    return strip(F.regexp_replace(F.coalesce(known, F.lit("")), "<[^>]+>", ""))


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def wrap_tag(c: Column, tag: str) -> Column:
    return F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))


def sanitize(c: Column) -> Column:
    """Line ends as LF; control characters below 32 go, but for LF and tab; null as empty."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(lines, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def token_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def dedup_key(c: Column, fold_case: bool = True, collapse: bool = False) -> Column:
    key = collapse_space(c) if collapse else strip(c)
    return F.lower(key) if fold_case else key


def has_markup(c: Column) -> Column:
    """A letters-only tag is left."""
    return F.coalesce(c.rlike("(?i)</?[a-z]+>"), F.lit(False))


def has_section_tag(c: Column) -> Column:
    return F.coalesce(c.rlike("<(?:draft|thinking|response)>"), F.lit(False))


def reasoning_steps(c: Column) -> Column:
    """Numbered steps; without any, bullets; else distinct step words; else sentences over 20 characters, 5 at most. 1 at least,
    and 0 for an empty text."""
    text = F.regexp_replace(c, "</?thinking>", "")
    found = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    numbered = found("(?iU)" + NUMBERED)
    bullets = found("(?U)" + BULLET)
    words = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?iU)\b(?:{'|'.join(STEP_WORDS)})\b"), F.lit(0))))
    sentences = F.least(F.size(F.filter(F.split(text, r"(?U)[.!?]\s+"), lambda s: F.char_length(strip(s)) > 20)), F.lit(5))
    steps = F.when(numbered > 0, numbered).when(bullets > 0, bullets).when(words > 0, words).otherwise(sentences)
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.greatest(steps, F.lit(1))).cast("int")


def quality_issues(c: Column, shortest: int = 10, longest: int = 500) -> Column:
    """What is wrong with a question, as an array of names."""
    text = F.coalesce(c, F.lit(""))
    any_of = lambda marks: F.array_max(F.array(*[F.contains(text, F.lit(m)) for m in marks]))
    rules = [
        (F.char_length(text) < shortest, "Too short"),
        (F.char_length(text) > longest, "Too long"),
        (any_of(LATEX_MARKS), "Contains LaTeX"),
        (~F.right(strip(text), F.lit(1)).isin(*ENDINGS), "No ending punctuation"),
        (any_of(PLACEHOLDERS), "Contains placeholder"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def as_question(c: Column, domain: Column) -> Column:
    """A text put as a question or task of its domain; a summary's dots and the bounds 500 and 200 are part of the format."""
    t = strip(c)
    asks = t.endswith("?")

    def put(short: str, long: str, most: int, end: str = "") -> Column:
        return F.when(F.char_length(t) > most, F.concat(F.lit(long), F.left(t, F.lit(most)), F.lit(end))).otherwise(F.concat(F.lit(short), t))

    return F.when((domain == "Summarization") & ~asks, put(*SUMMARY, "...")).when(asks, t).when(domain == "Coding", put(*TASK)).otherwise(t)


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def unslug(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def preview(c: Column, n: int = 200) -> Column:
    return F.left(c, F.lit(n))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def ascii_json(json: Column) -> Column:
    """JSON with each character that is not printable ASCII as one \\uXXXX escape, or two beyond the basic plane."""
    escape = F.lit("\\\\u$1")
    one = lambda c: F.when(F.ascii(c) < 127, c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), F.lit("(....)"), escape))
    return F.when(json.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.split(json, ""), one), "")).otherwise(json)
