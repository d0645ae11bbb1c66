"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from itertools import product

# A query is a conjunction of disjunctions of trigram sets.
Alternatives = frozenset[frozenset[str]]
MOST_STRINGS = 32


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _one_of(strings: set[str]) -> list[Alternatives]:
    """The condition that one of ``strings`` occurs; none if one is too short to have a trigram."""
    if not strings or min(map(len, strings)) < 3:
        return []
    return [frozenset(trigrams(text) for text in strings)]


def _either(queries: list[list[Alternatives]]) -> list[Alternatives]:
    """The condition that one of ``queries`` holds."""
    if not all(queries):
        return []
    joined: set[frozenset[str]] = set()
    for query in queries:
        choices = list(product(*query))
        joined |= {frozenset().union(*choice) for choice in choices} if len(choices) <= MOST_STRINGS else set(query[0])
    return [frozenset(joined)]


def _needs(nodes) -> tuple[set[str] | None, list[Alternatives]]:
    """All strings that ``nodes`` can match, if they are few, and what a match needs besides."""
    strings, query, whole = {""}, [], True
    for node in nodes:
        found, more = _node_needs(*node)
        query += more
        if found is not None and len(strings) * len(found) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in found}
        else:
            query += _one_of(strings)
            strings, whole = found or {""}, False
    if whole:
        return strings, query
    return None, query + _one_of(strings)


def _node_needs(kind, value) -> tuple[set[str] | None, list[Alternatives]]:
    if kind is ops.LITERAL:
        return {chr(value).lower()}, []
    if kind is ops.SUBPATTERN:
        return _needs(value[-1])
    if kind is ops.ATOMIC_GROUP:
        return _needs(value)
    if kind in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        return {""}, []
    if kind is ops.BRANCH:
        branches = [_needs(branch) for branch in value[1]]
        if all(found is not None and not query for found, query in branches):
            return set().union(*(found for found, _ in branches)), []
        return None, _either([query + _one_of(found or set()) for found, query in branches])
    if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        found, query = _needs(inner)
        if found is not None and not query and len(found) ** int(most if most <= 4 else 9) <= MOST_STRINGS and most <= 4:
            return {"".join(c) for n in range(least, most + 1) for c in product(found, repeat=n)}, []
        return (None, query + _one_of(found or set())) if least else (None, [])
    return None, []


def trigram_query(pattern: str) -> list[Alternatives]:
    """What the lower-cased text of every match of ``pattern`` contains; empty if nothing is certain."""
    strings, query = _needs(parser.parse(pattern))
    return query + _one_of(strings or set())
