"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.constants import BUCKETS, ENTITIES, FORMULAIC

#: white space as Python's strip() and split() see it
BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Only a text that begins or ends with a blank goes through the pattern, which looks at every place."""
    at_ends = F.left(text, F.lit(1)).rlike(BLANK) | F.right(text, F.lit(1)).rlike(BLANK)
    return F.when(at_ends, F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")).otherwise(text)


def words(text: Column) -> Column:
    """As Python's split(): no empty words."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Unwraps ~~struck~~ text, drops runs of three or more dots, collapses blanks, strips lines and drops empty ones."""
    text = F.regexp_replace(strip(text), r"(?d)~~(.*?)~~", "$1")
    text = F.regexp_replace(text, "[.·]{3,}", "")
    text = F.regexp_replace(text, " [ \\t]+|\\t[ \\t]*", " ")  # single spaces stay as they are
    lines = F.transform(F.split(text, LINE_END), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def clean_census(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "¤/�¬", "    "), f"{BLANK}+", " ")


def stem(filename: Column) -> Column:
    """The name without its last suffix; a leading dot is none."""
    name = F.element_at(F.split(filename, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def page_key(filename: Column) -> Column:
    """The stem without a trailing group of digits behind an underscore; the stem where there is none."""
    name = stem(filename)
    return F.when(name.rlike(r"^.*_[0-9]+$"), F.regexp_extract(name, r"^(.*)_[0-9]+$", 1)).otherwise(name)


def century(year: Column) -> Column:
    """``year // 100 + 1`` as text, ``unk`` for what is no positive whole number."""
    value = year.try_cast("int")
    return F.when(value > 0, (F.floor(value / 100) + 1).cast("string")).otherwise(F.lit("unk"))


def subfolder(path: Column) -> Column:
    """The folder of a relative path, or the one above it where the folder is ``images``; empty at the root."""
    parts = F.split(path, "/")
    folder, above = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
    return F.coalesce(F.when(folder == "images", above).otherwise(folder), F.lit(""))


def without_thinking(text: Column) -> Column:
    return F.when(text.contains("</think>"), F.regexp_replace(text, r"(?s)^.*?</think>[\n ]*", "")).otherwise(text)


def thinking_tokens(total: Column, prompt: Column, completion: Column) -> Column:
    zero = F.lit(0)
    return F.greatest(F.coalesce(total, zero) - F.coalesce(prompt, zero) - F.coalesce(completion, zero), zero)


def render_prompt(template: str, text: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{{text}}"), F.translate(text, "()", ""))


def mime(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in ((".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".png", "image/png"), (".webp", "image/webp"), (".gif", "image/gif")) for x in pair])
    return F.coalesce(known[suffix], F.lit("image/jpeg"))


def base64(text: Column) -> Column:
    """A text's bytes in base64, in one line: the built-in one breaks lines."""
    return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))


def is_new_model(model: Column) -> Column:
    return F.lower(model).rlike("^(gpt-5|o1|o3)")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def is_formulaic(line: Column) -> Column:
    return line.rlike(f"(?iu)({'|'.join(FORMULAIC)})")


def entity_pattern(entity: str, case_sensitive: bool = False) -> str:
    return f"(?{'U' if case_sensitive else 'iuU'})({ENTITIES[entity]})"


def entity_matches(text: Column, entity: str, case_sensitive: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(entity_pattern(entity, case_sensitive)), F.lit(1))


def entity_begins(word: Column) -> Column:
    """Whether a date can begin with a word: it ends with a digit."""
    return word.rlike(r"(?U)\d$")


def length_bucket(n_words: Column) -> Column:
    out = F.lit("51+")
    for name, most in reversed(BUCKETS):
        out = F.when(n_words <= most, F.lit(name)).otherwise(out)
    return F.when(n_words < 1, F.lit("51+")).otherwise(out)
