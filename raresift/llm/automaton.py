"""Levenshtein automata intersected with a lexicon trie, compiled to one deterministic table and run over many words."""

from __future__ import annotations

import numpy as np


def tolerance(term: str) -> int:
    """Edits allowed for a term: none under five letters or for a stem ("ab*": all words that begin so), one under
    nine letters, else two."""
    return 0 if len(term) < 5 or term.endswith("*") else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Finds the closest term within its tolerance; an edit inserts, drops, replaces or swaps neighbouring characters.

    A state is the set of (trie node, edits so far) that the word read so far can stand for, so the walk follows the
    trie and the automata of all terms at once and dies as soon as no term can be reached. States are made once, for
    the characters of the lexicon and one for all others; words are then read in parallel, one character a step.
    """

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        """``strict`` terms are matched without edits."""
        self.terms, self.strict = list(terms), strict
        self._trie()
        self._compile()

    def _edits(self, term: str) -> int:
        return 0 if term in self.strict else tolerance(term)

    def _trie(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.most: list[int] = [0]  # largest tolerance below a node
        self.stem_at: dict[int, int] = {}  # node -> a node that reads anything
        for i, term in enumerate(self.terms):
            node, k = 0, self._edits(term)
            self.most[0] = max(self.most[0], k)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            if term.endswith("*"):
                self.stem_at[node] = len(self.children)
                self.children.append({})
                self.term_at.append(i)
                self.most.append(0)
            else:
                self.term_at[node] = i
        self.anything = set(self.stem_at.values())

    def _closed(self, items: dict[tuple, int]) -> frozenset:
        """With dropped characters followed, and only the fewest edits for a node."""
        best = dict(items)
        for node, waits in items:
            if not waits and best[(node, "")] == 0 and node in self.stem_at:
                best[(self.stem_at[node], "")] = 0
        work = [x for x in best if x[1] == ""]
        while work:
            node, _ = work.pop()
            e = best[(node, "")] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < best.get((child, ""), 99):
                    best[(child, "")] = e
                    work.append((child, ""))
        return frozenset((n, w, e) for (n, w), e in best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out: dict[tuple, int] = {}

        def put(node: int, waits: str, e: int) -> None:
            if e <= self.most[node] and e < out.get((node, waits), 99):
                out[(node, waits)] = e

        for node, waits, e in state:
            if node in self.anything:
                put(node, "", e)
                continue
            if waits:  # the second half of a swap
                if waits == c:
                    put(node, "", e)
                continue
            put(node, "", e + 1)
            for x, child in self.children[node].items():
                put(child, "", e if x == c else e + 1)
                if x != c and c in self.children[child]:
                    put(self.children[child][c], x, e + 1)
        return self._closed(out)

    def _compile(self) -> None:
        letters = sorted({c for t in self.terms for c in t.removesuffix("*")})
        symbols = ["", *letters]  # "" is any other character
        self.symbol = np.zeros(0x110000, np.uint8 if len(symbols) < 256 else np.uint16)
        for i, c in enumerate(symbols[1:], 1):
            self.symbol[ord(c)] = i
        start = self._closed({(0, ""): 0})
        number, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        i = 0
        while i < len(order):
            row = []
            for c in symbols:
                to = self._step(order[i], c) if order[i] else order[i]
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
            i += 1
        self.move = np.array(rows, np.int32)
        self.accept = np.full(len(order), -1, np.int32)
        self.edits = np.zeros(len(order), np.int8)
        for i, state in enumerate(order):
            ends = [(e, self.term_at[n]) for n, w, e in state
                    if not w and self.term_at[n] >= 0 and e <= self._edits(self.terms[self.term_at[n]])]
            if ends:
                self.edits[i], self.accept[i] = min(ends)

    def find(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, term number, edits) of the words chars[start:end] within tolerance of a term."""
        if not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)
        at, state = np.arange(len(start)), np.ones(len(start), np.int32)
        found_at, found_state = [], []
        step = 0
        while len(at):
            done = start[at] + step == end[at]
            if done.any():
                hit = done & (self.accept[state] >= 0)
                found_at.append(at[hit])
                found_state.append(state[hit])
                at, state = at[~done], state[~done]
            state = self.move[state, self.symbol[chars[start[at] + step]]]
            alive = state > 0
            at, state = at[alive], state[alive]
            step += 1
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)
        where, state = np.concatenate(found_at), np.concatenate(found_state)
        order = np.argsort(where)
        where, state = where[order], state[order]
        return where, self.accept[state], self.edits[state]


TABLE = 200  # terms of one table; its states grow a little faster than its terms


class Lexicon:
    """A lexicon of any size as several tables: the closest term of all, of equally close ones the first."""

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        self.parts = [(i, FuzzyLexicon(terms[i:i + TABLE], strict)) for i in range(0, max(len(terms), 1), TABLE)]

    def find(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``FuzzyLexicon.find``."""
        found = []
        for first, part in self.parts:
            where, term, edits = part.find(chars, start, end)
            found.append((where, term + first, edits))
        where, term, edits = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((term, edits, where))
        where, term, edits = where[order], term[order], edits[order]
        best = np.diff(where, prepend=-1) > 0
        return where[best], term[best], edits[best]
