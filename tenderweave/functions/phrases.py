"""Which of many phrases a text holds, in one pass over it.

The phrases make a trie, and the trie a pattern that at each place of a text finds the longest phrase that
starts there. All phrases that are beginnings of a found one are there too; they are added from a table. So
a text is read once whatever the number of phrases, and everything stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trie(phrases: list[str]) -> dict:
    top: dict = {}
    for p in phrases:
        at = top
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}
    return top


def _pattern(node: dict) -> str:
    """Of what may follow here: the longest continuation first, nothing at all last, where a phrase ends."""
    branches = [re.escape(c) + _pattern(below) for c, below in node.items() if c]
    if not branches:
        return ""
    inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
    return inner + "?" if "" in node else inner


def trie_pattern(phrases: list[str]) -> str:
    """A pattern without width, whose group 1 is the longest of the phrases that starts at a place."""
    first = "".join(sorted({re.escape(p[0]) for p in phrases}))
    return f"(?=[{first}])(?=({_pattern(_trie(phrases))}))"


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The distinct phrases (lower case, none empty) that the lower-cased text holds; none of a null text."""
    phrases = list(dict.fromkeys(p for p in phrases if p))
    nothing = F.array().cast("array<string>")
    if not phrases:
        return nothing
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(trie_pattern(phrases)), 1))
    begins = {p: [q for q in phrases if q != p and p.startswith(q)] for p in phrases}
    begins = {p: qs for p, qs in begins.items() if qs}
    if not begins:
        return found
    table = F.create_map(*[x for p, qs in begins.items() for x in (F.lit(p), F.array(*map(F.lit, qs)))])
    return F.array_distinct(F.concat(found, F.flatten(F.transform(found, lambda p: F.coalesce(table[p], nothing)))))


def rules_in(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """What the rules say of which the text holds a phrase, in the order of the rules, each saying once."""
    lowered = [([p.lower() for p in phrases], says) for phrases, says in rules]
    by: dict[str, list[int]] = {}
    for k, (phrases, _) in enumerate(lowered):
        for p in phrases:
            by.setdefault(p, []).append(k)
    table = F.create_map(*[x for p, ks in by.items() for x in (F.lit(p), F.array(*map(F.lit, ks)))])
    says = F.array(*[F.lit(s) for _, s in rules])
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(phrases_in(text, list(by)), lambda p: table[p]))))
    return F.array_distinct(F.transform(hit, lambda k: F.element_at(says, k + 1)))


def expanded(title: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The terms of all rules that fit a title, joined by blanks."""
    return F.array_join(rules_in(title, rules), " ")
