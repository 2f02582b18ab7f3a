"""Parsing of model answers: column functions that never raise; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:[A-Za-z]+)?\s*(.*?)```"


def strip_fences(text: Column) -> Column:
    """The content of the first code fence, or the trimmed text."""
    inner = F.regexp_extract(text, FENCE, 1)
    return F.trim(F.when(F.contains(text, F.lit("```")) & (inner != ""), inner).otherwise(text))


def without_fences(text: Column) -> Column:
    """The text with the marks of code fences taken out."""
    return F.trim(F.replace(F.replace(F.trim(text), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def id_list(text: Column) -> Column:
    """A JSON array of integer-likes as bigints (2.7 is 2, "3" is 3, true is 1); null if any item fails or it is no array."""
    items = F.try_variant_get(F.try_parse_json(without_fences(text)), "$", "array<bigint>")
    whole = F.filter(F.array(items), lambda a: ~F.exists(a, lambda x: x.isNull()))  # reads the text once, not once to test and once to return
    return F.get(whole, 0)


def strict_id_list(text: Column) -> Column:
    """Like :func:`id_list`, but only an array of plain integers passes."""
    body = without_fences(text)
    return F.when(body.rlike(r"^\[\s*(-?\d+(\s*,\s*-?\d+)*)?\s*\]$"), id_list(text))


def ids_within(ids: Column, allowed: Column) -> Column:
    """Whether a list is there and all its ids are allowed."""
    return F.coalesce(F.forall(ids, lambda x: F.array_contains(allowed, x)), F.lit(False))


def prediction_ids(text: Column, success: Column) -> Column:
    """The ids of an answer; a failed prediction has none."""
    return F.when(F.coalesce(success, F.lit(True)), id_list(text))


def answer_after_thinking(text: Column) -> Column:
    """What follows the last closing think tag."""
    return F.trim(F.substring_index(text, "</think>", -1))


def first_list(text: Column) -> Column:
    """The ids of the whole answer, or else of the first bracketed list that reads as ids."""
    body = strip_fences(answer_after_thinking(text))
    found = F.transform(F.regexp_extract_all(body, F.lit(r"(\[[^\[\]]*\])"), F.lit(1)), id_list)
    return F.coalesce(id_list(body), F.get(F.filter(found, lambda x: x.isNotNull()), 0))


def last_list(text: Column) -> Column:
    """The ids of a list that ends the text."""
    return id_list(F.regexp_extract(text, r"(\[[^\[\]\n]*\])\s*$", 1))


def coordinate_path(text: Column) -> Column:
    """All bracketed points of two or three numbers as ``array<array<double>>``; a missing third number is 0."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    points = F.regexp_extract_all(text, F.lit(rf"\[\s*({number}\s*,\s*{number}(?:\s*,\s*{number})?)\s*\]"), F.lit(1))
    return F.transform(points, lambda p: F.slice(F.concat(F.transform(F.split(p, r"\s*,\s*"), lambda v: v.cast("double")), F.array(F.lit(0.0))), 1, 3))


def option_letter(text: Column, options: str = "ABCD") -> Column:
    """The one option that a short final answer names, by letter or by number; empty: none or not just one."""
    body = F.when(F.contains(text, F.lit("<think>")) & ~F.contains(text, F.lit("</think>")), F.lit("")).otherwise(answer_after_thinking(text))
    marks = F.array_distinct(F.transform(F.regexp_extract_all(F.upper(body), F.lit(rf"(?:^|[^A-Z0-9])([{options}])(?=$|[^A-Z0-9])"), F.lit(1)), lambda x: x))
    digit = F.regexp_extract(body, rf"^\(?([1-{len(options)}])\)?\.?$", 1)
    by_digit = F.substring(F.lit(options), F.coalesce(F.try_to_number(digit, F.lit("9")).cast("int"), F.lit(1)), F.lit(1))
    return F.when(F.char_length(body) > 160, F.lit("")).when(F.size(marks) == 1, F.get(marks, 0)).when(digit != "", by_digit).otherwise(F.lit(""))


def choice_lines(text: Column) -> Column:
    """Non-empty lines without their leading option marks."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\(?[A-Z][.):]\s*", "")))
    return F.filter(lines, lambda x: x != "")


def first_token(text: Column) -> Column:
    """The first word without trailing dots."""
    return F.rtrim(F.regexp_extract(text, r"^\s*(\S+)", 1), F.lit("."))


def finite_number(text: Column) -> Column:
    """The first word as a finite double."""
    value = first_token(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def normalized(text: Column) -> Column:
    """Trimmed and lower-cased; blank is null."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def slug(text: Column, length: int = 160) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit(length))


def json_object(text: Column) -> Column:
    """The text, or what lies between its first and last brace, as a variant; null unless an object."""
    body = strip_fences(text)
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    found = F.coalesce(F.try_parse_json(body), F.try_parse_json(inner))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def nested_number(value: Column, path: str, default: float = 0.0) -> Column:
    """A number inside a variant, or the default."""
    return F.coalesce(F.try_variant_get(value, path, "double"), F.lit(default))


def _plain_id(x: Column) -> Column:
    """A variant that is a whole number, or text of one, or an object that has one as its id."""
    kind = F.schema_of_variant(x)
    number = F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(x, "$", "bigint")).when((kind == "STRING") & F.try_variant_get(x, "$", "string").rlike(r"^\s*-?\d+\s*$"), F.try_variant_get(x, "$", "bigint"))
    return number


def collected_ids(text: Column) -> Column:
    """What the collector takes for an answer: the whole text, its fence, then each bracketed list and each object in it.

    Lists may hold whole numbers or objects with id, display_id or displayId; an object may hold such
    a list as display_ids.  Fractions and booleans are no ids.
    """
    found = F.concat(F.array(text, strip_fences(text)), F.regexp_extract_all(text, F.lit(r"(\[[^\[\]]*\])"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?s)(\{[^{}]*\})"), F.lit(1)))

    def read(c: Column) -> Column:
        v = F.try_parse_json(c)
        items = F.coalesce(F.try_variant_get(v, "$.display_ids", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
        ids = F.transform(items, lambda x: F.coalesce(_plain_id(x), *[_plain_id(F.try_variant_get(x, f"$.{k}", "variant")) for k in ("id", "display_id", "displayId")]))
        return F.when(~F.exists(ids, lambda i: i.isNull()), ids)

    return F.get(F.filter(F.transform(found, read), lambda x: x.isNotNull()), 0)
