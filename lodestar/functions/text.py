"""Text predicates for prompts and rationales."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of :func:`rationale_issues`, in the order in which they are listed.
ISSUES = ("no_open_tag", "no_close_tag", "fenced", "banned_phrase", "no_final_list")


def _bounded(phrase: str) -> str:
    return rf"(?i)\b{re.escape(phrase)}\b"


def stripped(text: Column) -> Column:
    """Without white space at both ends; linear in the text, which a pattern that ends in ``\\s+$`` is not."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text between word boundaries."""
    return F.coalesce(text.rlike(_bounded(phrase)), F.lit(False))


def phrase_count(text: Column, phrase: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_bounded(phrase))), F.lit(0))


def has_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs, anywhere and in any case."""
    folded = F.lower(text)
    return F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(folded, F.lower(p))), F.lit(False))


def in_order(text: Column, groups: list[list[str]]) -> Column:
    """Whether each group has a phrase that occurs after the earliest match of the group before it."""
    folded, at = F.lower(text), F.lit(1)
    for group in groups:
        rest = F.substring(folded, at, F.char_length(folded))
        found = [F.when(F.instr(rest, p.lower()) > 0, F.struct(F.instr(rest, p.lower()).alias("start"), F.lit(i).alias("i"), F.lit(max(len(p), 1)).alias("size"))) for i, p in enumerate(group)]
        first = F.array_min(F.array(*found))
        at = at + first["start"] + first["size"] - 1
    return F.coalesce(at > 0, F.lit(False))


def mentions_all(text: Column, ids: Column) -> Column:
    """Whether the text has the ids as a JSON list, or "1 through n" where they are 1 to n."""
    listed = F.contains(F.regexp_replace(text, r"\s+", ""), F.to_json(ids))
    run = (F.size(ids) > 0) & (F.array_sort(ids) == F.sequence(F.lit(1).cast("long"), F.greatest(F.size(ids), F.lit(1)).cast("long")))
    return F.coalesce(listed | (run & F.contains(F.lower(text), F.concat(F.lit("1 through "), F.size(ids).cast("string")))), F.lit(False))


def format_class(text: Column) -> Column:
    """One of six classes, by think tags and a list that stands alone in the last line after them."""
    body = stripped(text)
    starts, opened, closed = body.startswith("<think>"), F.contains(body, F.lit("<think>")), F.contains(body, F.lit("</think>"))
    line = F.substring_index(body, "\n", -1)
    tail = stripped(line).rlike(r"^\[[^\n]*\]$")
    return (
        F.when(starts & closed & tail, F.lit("ok"))
        .when(~opened & tail, F.lit("plain_plus_tail"))
        .when(starts & ~closed, F.lit("open_no_close"))
        .when(starts & closed, F.lit("json_inside_or_missing_tail"))
        .when(~opened, F.lit("plain_no_tail"))
        .otherwise(F.lit("other"))
    )


def canonical_rationale(text: Column, ids: Column) -> Column:
    """Tags around the bare rationale and the ids as a list in the last line; null if the text ends with another list."""
    trailing = F.regexp_replace(F.regexp_extract(text, r"(\[[^\[\]\n]*\])\s*$", 1), r"\s+", "")
    body = stripped(F.regexp_replace(F.regexp_replace(text, r"</?think>", ""), r"\[[^\[\]\n]*\]\s*$", ""))
    return F.when((trailing == "") | (trailing == F.to_json(ids)), F.concat(F.lit("<think>\n"), body, F.lit("\n</think>\n"), F.to_json(ids)))


def rationale_issues(text: Column, banned: list[str]) -> Column:
    """The codes of what is wrong with a rationale."""
    tests = (~text.startswith("<think>"), ~F.contains(text, F.lit("</think>")), F.contains(text, F.lit("```")), has_any(text, banned), ~text.rlike(r"\[[^\[\]\n]*\]\s*$"))
    return F.array_compact(F.array(*[F.when(t, F.lit(code)) for t, code in zip(tests, ISSUES, strict=True)]))


def leaks_answer(prompt: Column, category: Column, color: Column) -> Column:
    """Whether a prompt names the target's category (or its plural), an id, or its colour and category."""
    folded = F.lower(prompt)
    stem = F.regexp_replace(F.lower(category), r"([\\.^$|()\[\]{}*+?])", r"\\$1")
    named = F.regexp_like(folded, F.concat(F.lit(r"\b"), stem, F.lit(r"(s|es)?\b")))
    colored = F.contains(folded, F.concat(F.lower(color), F.lit(" "), F.lower(category)))
    return F.coalesce(named, F.lit(False)) | F.coalesce(folded.rlike(r"#\d+|\bids? \d+\b"), F.lit(False)) | F.coalesce(colored, F.lit(False))


def color_claim(prompt: Column, visible: Column, material: Column, names: list[str]) -> Column:
    """Whether the colour that a prompt names is supported, uncertain or contradicted by what is seen and what is known."""
    said = F.regexp_extract(F.lower(prompt), rf"\b({'|'.join(names)})\b", 1)
    return F.when(said == "", F.lit("no_claim")).when(said == visible, F.lit("supported")).when(visible.isNull() & (said == material), F.lit("uncertain")).when(visible.isNull() & material.isNull(), F.lit("uncertain")).otherwise(F.lit("contradicted"))


def append_cue(question: Column, phrase: Column) -> Column:
    """The phrase before the final punctuation."""
    return F.concat(F.regexp_replace(F.rtrim(question), r"[.?!]+$", ""), F.lit(" "), phrase, F.coalesce(F.nullif(F.regexp_extract(F.rtrim(question), r"([.?!]+)$", 1), F.lit("")), F.lit(".")))


def fill_template(key: Column, templates: list[str], **values: Column) -> Column:
    """One of the templates, chosen by the key's stable index, with {names} replaced."""
    from lodestar.functions.hashing import stable_index

    out = F.element_at(F.array(*map(F.lit, templates)), (stable_index(key, len(templates)) + 1).cast("int"))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out
