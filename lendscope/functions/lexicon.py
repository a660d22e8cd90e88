"""Lexicons as tables: phrases by class, read from files, and which of them a text holds.

A lexicon is a file of a header and one line a phrase, in the order of preference: its classes and, in
the last column, the phrase. Those in lendscope/lexicons hold fixed values; any other file of the same
columns can take their place. A text is searched for each phrase, anywhere in it; the phrases stand in an array,
so that the code generated for a query doesn't grow with the lexicon.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = Path(__file__).resolve().parent.parent / "lexicons"


def read_lexicon(name: str | Path) -> list[tuple[str, ...]]:
    """The lines of a lexicon of this library, or of the file at a path."""
    place = Path(name) if str(name).endswith(".csv") else FOLDER / f"{name}.csv"
    with open(place, newline="", encoding="utf-8") as lines:
        return [tuple(row) for row in csv.reader(lines)][1:]


def by_class(rows: Iterable[tuple[str, ...]]) -> dict[tuple[str, ...], list[str]]:
    """The phrases of each class, classes in the order of their first phrase."""
    out: dict[tuple[str, ...], list[str]] = {}
    for *names, phrase in rows:
        out.setdefault(tuple(names), []).append(phrase)
    return out


def bound(value: Column, use) -> Column:
    """use(value), where value is worked out once however often use, or a lambda in it, names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def array_of(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, words))


def found(text: Column, phrases: Column) -> Column:
    """Those of an array of phrases that text holds."""
    return bound(text, lambda t: F.filter(phrases, lambda p: F.contains(t, p)))


def hits(text: Column, words: Iterable[str]) -> Column:
    """How many of the words text holds."""
    return F.size(found(text, array_of(words)))


def best_class(text: Column, classes: Column) -> Column:
    """n and name of the class with most phrases in text, the first on a tie; classes: array of (name, phrases)."""
    count = lambda t: F.transform(
        classes, lambda c, i: F.struct(F.size(F.filter(c["phrases"], lambda p: F.contains(t, p))).alias("n"), (-i).alias("o"), c["name"].alias("name"))
    )
    return F.array_max(bound(text, count))


def told_after(pieces: Column, name: str, read) -> Column:
    """The first reading, of the pieces of a text that hold name, of what follows it there; null without one."""
    rest = lambda x: F.substr(x, F.instr(x, name) + len(name))
    held = F.filter(pieces, lambda x: F.contains(x, F.lit(name)))
    return F.get(F.filter(F.transform(held, lambda x: read(rest(x))), lambda v: v != ""), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(F.lower(text), "\n")


def number_after(pieces: Column, name: str) -> Column:
    """The first number that follows name in a piece (of lowered text)."""
    return told_after(pieces, name, lambda rest: F.regexp_extract(rest, r"[0-9]+\.?[0-9]*", 0)).try_cast("double")


def percent_after(pieces: Column, name: str) -> Column:
    """The first whole number of up to three digits before a percent sign that follows name in a piece."""
    ends = lambda rest: F.transform(F.split(rest, "%"), lambda x: F.regexp_extract(x, "([0-9]{1,3}) *$", 1))
    signs = lambda rest: F.length(rest) - F.length(F.replace(rest, F.lit("%")))
    first = lambda rest: F.coalesce(F.get(F.filter(F.slice(ends(rest), 1, signs(rest).cast("int")), lambda v: v != ""), F.lit(0)), F.lit(""))
    return told_after(pieces, name, first).try_cast("double")
