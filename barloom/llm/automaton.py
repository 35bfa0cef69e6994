"""Aho-Corasick automata that a Python worker builds once for each broadcast list of patterns."""

from __future__ import annotations

import hashlib

import ahocorasick

_built: dict[str, ahocorasick.Automaton] = {}


def automaton(patterns: list[tuple[str, object]]) -> ahocorasick.Automaton:
    """The automaton over (pattern, value) pairs; patterns must not be empty. The last one stays in memory."""
    digest = hashlib.sha256()
    for pattern, value in patterns:
        digest.update(repr((pattern, value)).encode("utf-8", "surrogatepass"))
    key = digest.hexdigest()
    if key not in _built:
        _built.clear()
        machine = ahocorasick.Automaton()
        for pattern, value in patterns:
            machine.add_word(pattern, value)
        machine.make_automaton()
        _built[key] = machine
    return _built[key]
