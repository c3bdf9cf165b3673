"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The space class that both engines agree on, and characters that cleaning removes or replaces.
SPACES = r"[ \t\n\r\f]+"
CURLY, STRAIGHT = "“”„‘’", "\"\"\"''"
INVISIBLE = "​‌‍⁠﻿"


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def terms(text: Column) -> Column:
    """Lower-case alphanumeric words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop, exclamation or question mark before white space."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])" + SPACES, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def scrub(text: Column) -> Column:
    """Text without characters that break graph literals."""
    return F.translate(text, "/{}\\", "")


# Escapes of literals and the characters that an IRI can't hold.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"))
NOT_IN_IRI = "\\ <>\"{}|^`\n\r\t"


def literal(text: Column) -> Column:
    """A quoted literal of a triple, escaped."""
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), text, F.lit('"'))


def unescaped(text: Column) -> Column:
    """A literal's text as it was before literal."""

    def plain(part: Column) -> Column:
        for raw, safe in ESCAPES[1:]:
            part = F.replace(part, F.lit(safe), F.lit(raw))
        return part

    # between two escaped backslashes, each other backslash starts an escape
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def iri(text: Column) -> Column:
    """An IRI in angle brackets; characters that it can't hold are written by their numbers."""
    for c in NOT_IN_IRI:
        text = F.replace(text, F.lit(c), F.lit(f"\\u{ord(c):04X}"))
    return F.concat(F.lit("<"), text, F.lit(">"))


def iri_text(text: Column) -> Column:
    """What iri was given, from what stands between its brackets."""
    for c in reversed(NOT_IN_IRI):
        text = F.replace(text, F.lit(f"\\u{ord(c):04X}"), F.lit(c))
    return text


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table at a time, as a fold over a's characters."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(prev: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.greatest(F.get(prev, j), F.element_at(acc, -1), F.when(ch == F.get(y, j - 1), F.get(prev, j - 1) + 1).otherwise(0))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(x, zero, row), -1))


def ratio(a: Column, b: Column) -> Column:
    """Similarity of 0 to 100 by insertions and deletions; two empty texts are equal, null is similar to nothing."""
    total = F.length(a) + F.length(b)
    score = F.when(total == 0, 100).otherwise(F.bround(200.0 * longest_common(a, b) / F.greatest(total, F.lit(1)), 0).cast("int"))
    return F.coalesce(score, F.lit(0))


def sorted_tokens(text: Column, ascii_only: bool = True) -> Column:
    """Lower-case alphanumeric words in order; with ascii_only, Latin-1 letters beyond ASCII are dropped first."""
    if ascii_only:
        text = F.regexp_replace(text, r"[\x{80}-\x{ff}]", "")
    return F.array_join(F.array_sort(F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{N}]+"), "")), " ")


def token_sort_ratio(a: Column, b: Column, ascii_only: bool = True) -> Column:
    return ratio(sorted_tokens(a, ascii_only), sorted_tokens(b, ascii_only))


def last_word(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), SPACES), -1)


def balanced_object(text: Column) -> Column:
    """The first substring whose braces balance; null without one. A stray closing brace spoils what follows."""
    chars = F.split(text, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        opened = F.when((s["open"] == 0) & (c == "{") & (s["depth"] == 0), s["at"] + 1).otherwise(s["open"])
        done = F.when((s["end"] == 0) & (opened > 0) & (depth == 0) & (c == "}"), s["at"] + 1).otherwise(s["end"])
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), opened.alias("open"), done.alias("end"))

    found = F.aggregate(chars, start, step)
    return F.when(found["end"] > 0, F.substring(text, found["open"], found["end"] - found["open"] + 1))


def outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def between(text: Column, start: Column, stop: Column) -> Column:
    """The characters from start up to stop, counted from 0."""
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


def passage(text: Column) -> Column:
    """A text as the input of a passage encoder."""
    return F.concat(F.lit("Passage: "), text)


def language_vote(text: Column, words: dict[str, list[str]]) -> Column:
    """The language with most of its frequent words in the text, `other` without any; ties go to the first name."""
    seen = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    votes = F.array(*(F.struct(F.size(F.array_intersect(seen, F.array(*map(F.lit, v)))).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("name")) for i, (k, v) in enumerate(sorted(words.items()))))
    best = F.array_max(votes)
    return F.when(best["n"] > 0, best["name"]).otherwise("other")


def clean_json(text: Column) -> Column:
    """A model's almost-JSON made parsable: quotes, invisible characters, trailing commas, Python's names of constants."""
    text = F.translate(text, CURLY + " " + INVISIBLE, STRAIGHT + " ")
    text = F.regexp_replace(text, r",([ \t\n\r]*[}\]])", "$1")
    for word, name in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"\b{word}\b", name)
    return text


def year(text: Column) -> Column:
    """The first run of digits, four at most; empty without one."""
    return F.substring(F.regexp_extract(F.coalesce(text, F.lit("")), r"([0-9]+)", 1), 1, 4)
