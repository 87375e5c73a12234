"""Scalar functions over code texts, ids and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborine.functions.languages import EXTENSIONS, IGNORED_DIRS, extension

LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1; null counts as ''."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def module_qualname(path: Column) -> Column:
    """``a/b/c.py`` as ``a.b.c``; a trailing ``__init__`` is left out."""
    dotted = F.replace(F.regexp_replace(path, r"([^/])\.[^./]*$", "$1"), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def dotted_suffixes(name: Column) -> Column:
    """``a.b.c`` as [a.b.c, b.c, c]; null and '' give an empty array."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))


def clean_import(target: Column) -> Column:
    """An import target without its quotes and brackets."""
    return F.regexp_replace(target, "^[\"'`;<>]+|[\"'`;<>]+$", "")


def doc_summary(doc: Column) -> Column:
    """The first line of a stripped text, cut to 119 characters and an ellipsis beyond 120; null where it is blank."""
    first = F.trim(F.element_at(F.split(F.regexp_replace(doc, r"^\s+|\s+$", ""), LINE_ENDS), 1))
    return F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 119), F.lit("…"))).when(F.length(first) > 0, first)


def docstring_cap(doc: Column, most: int = 500) -> Column:
    """A text of at most ``most`` characters, the last an ellipsis where it was cut."""
    return F.when(F.length(doc) > most, F.concat(F.substring(doc, 1, most - 1), F.lit("…"))).otherwise(doc)


def text_lines(text: Column) -> Column:
    """The lines of a text; an end of line at its end starts none."""
    lines = F.split(text, LINE_ENDS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (1-based, both included) joined by line feeds; '' where the range or the lines are missing."""
    ok = lines.isNotNull() & (start >= 1) & (end >= start)
    return F.when(ok, F.array_join(F.slice(lines, F.when(ok, start).otherwise(1).cast("int"), F.when(ok, end - start + 1).otherwise(0).cast("int")), "\n")).otherwise("")


def source_slice(text: Column, start: Column, end: Column) -> Column:
    """``line_slice`` of the lines of a text."""
    return line_slice(text_lines(text), start, end)


def is_test_file(path: Column) -> Column:
    """Whether a path names a test, by the rule of file reports."""
    return F.lower(path).contains("test")


def is_test_symbol(path: Column) -> Column:
    """Whether a path names a test, by the wider rule of symbol reports."""
    return F.lower(path).rlike("test|spec")


def as_int(value: Column) -> Column:
    """A whole number from a text of digits with or without sign, else 0."""
    return F.coalesce(F.when(value.cast("string").rlike(r"^[+-]?\d+$"), F.try_to_number(value.cast("string"), F.lit("S999999999999999999")).cast("long")), F.lit(0)).cast("long")


def normal_path(path: Column) -> Column:
    """A path without doubled slashes, ``.`` parts and a slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(?<=^|/)\./", ""), r"(?<=.)/$", "")


def discoverable(path: Column) -> Column:
    """Whether discovery takes a path: a known extension and no ignored or hidden folder above it."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda f: f.startswith(".") & (F.length(f) > 1))
    return extension(path).isin(*EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRS))) & ~hidden


def identifier_split(token: Column) -> Column:
    """Lower-cased parts of a camel-case, Pascal-case or acronym identifier."""
    return F.transform(F.regexp_extract_all(token, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), lambda w: F.lower(w))


def text_features(text: Column) -> Column:
    """Word and trigram features of a text: per token its distinct words as ``w:word`` and their ``3:`` trigrams of ``#word#``."""
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    words = F.flatten(F.transform(tokens, lambda t: F.array_distinct(F.concat(F.array(F.lower(t)), identifier_split(t)))))

    def features(w: Column) -> Column:
        padded = F.concat(F.lit("#"), w, F.lit("#"))
        grams = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit("3:"), F.substring(padded, i, 3)))
        return F.concat(F.array(F.concat(F.lit("w:"), w)), grams)

    return F.flatten(F.transform(words, features))
