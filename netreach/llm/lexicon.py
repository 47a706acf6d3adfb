"""A lexicon trie met with Levenshtein automata, as table-driven automata of bounded size that read many words at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Letters of words that are held at a time, about.
HELD = 4_000_000
#: Letters of the terms of one automaton, about; a lexicon has as many automata as it needs.
LETTERS = 60


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # a stem matches every word that starts with it
    weight: float


def edits_allowed(term: Term) -> int:
    """Short terms have too many neighbours to be forgiven an edit; a stem's edits fall within the beginning it stands for."""
    if len(term.text) < 5:
        return 0
    return 1 if len(term.text) < 9 else 2


class Matcher:
    """The words within the allowed edits of a term, with a term of the fewest edits.

    Terms are sorted and dealt to automata, so that terms of one beginning share states. A word is read up to three letters
    beyond the longest term: from there on no edits make it a term, and a stem is reached or not.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.longest = max((len(t.text) for t in terms), default=0) + 3
        self.parts: list[tuple[Automaton, np.ndarray]] = []
        own: list[int] = []
        size = 0
        for k in sorted(range(len(terms)), key=lambda k: (terms[k].text, not terms[k].stem)):
            if own and size + len(terms[k].text) > LETTERS:
                self.parts.append((Automaton([terms[x] for x in own]), np.array(own)))
                own, size = [], 0
            own.append(k)
            size += len(terms[k].text)
        if own:
            self.parts.append((Automaton([terms[x] for x in own]), np.array(own)))

    def match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """{word: (term, edits)} of the words that match."""
        if not words or not self.terms:
            return {}
        rows = max(1, HELD // self.longest)
        found: dict[str, tuple[int, int]] = {}
        for k in range(0, len(words), rows):
            found.update(self._match(words[k:k + rows]))
        return found

    def _match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        length = np.array([min(len(w), self.longest) for w in words])
        widest = max(1, int(length.max()))
        points = np.array([w[:widest] for w in words], dtype=f"U{widest}").view(np.uint32).reshape(len(words), widest)
        none = np.iinfo(np.int64).max
        best = np.full(len(words), none)
        for automaton, own in self.parts:
            term, used = automaton.read(points, length)
            hit = np.flatnonzero(term >= 0)
            best[hit] = np.minimum(best[hit], used[hit].astype(np.int64) * len(self.terms) + own[term[hit]])
        return {words[i]: (int(best[i] % len(self.terms)), int(best[i] // len(self.terms))) for i in np.flatnonzero(best < none)}


class Automaton:
    """Deterministic automaton of the words within the allowed edits of a term.

    A state is a set of (trie node, edits so far); edits are insertions, deletions, substitutions. The table has a row
    for each state and a column for each letter of the terms, and one for all others.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[int | None] = [None]
        stems: list[int | None] = [None]
        reach = [0]  # most edits that a term below allows
        for k, term in enumerate(terms):
            at, own = 0, edits_allowed(term)
            reach[0] = max(reach[0], own)
            for letter in term.text:
                if letter not in children[at]:
                    children[at][letter] = len(children)
                    children.append({})
                    ends.append(None)
                    stems.append(None)
                    reach.append(0)
                at = children[at][letter]
                reach[at] = max(reach[at], own)
            (stems if term.stem else ends)[at] = k
        letters = sorted({x for t in terms for x in t.text})
        self.letters = {x: k for k, x in enumerate(letters)}

        def close(pairs) -> frozenset:
            """With what a deletion reaches; of equal nodes the fewest edits; a stem that is reached stays for good.

            Of the stems reached the first with the fewest edits is kept, and nothing that cannot come to fewer.
            """
            best: dict[int, int] = {}
            todo = list(pairs)
            while todo:
                node, used = todo.pop()
                if node < 0:
                    best[node] = min(used, best.get(node, 9))
                    continue
                if used > reach[node] or best.get(node, 9) <= used:
                    continue
                best[node] = used
                end = stems[node]
                if end is not None and used <= edits_allowed(terms[end]):
                    best[-1 - end] = min(used, best.get(-1 - end, 9))
                todo += [(x, used + 1) for x in children[node].values()]
            reached = min(((used, -1 - node) for node, used in best.items() if node < 0), default=None)
            if reached is None:
                return frozenset(best.items())
            return frozenset([(-1 - reached[1], reached[0]), *((n, u) for n, u in best.items() if n >= 0 and u < reached[0])])

        start = close([(0, 0)])
        states = {start: 0}
        todo, table, self.found, self.used = [start], [], [], []
        while todo:
            state = todo.pop(0)
            row = []
            for letter in [*letters, None]:
                to = []
                for node, used in state:
                    if node < 0:
                        to.append((node, used))
                        continue
                    to.append((node, used + 1))
                    for x, child in children[node].items():
                        to.append((child, used + (x != letter)))
                nxt = close(to)
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
                row.append(states[nxt])
            table.append(row)
            hits = [(used, -1 - node) for node, used in state if node < 0]
            hits += [(used, ends[node]) for node, used in state if node >= 0 and ends[node] is not None and used <= edits_allowed(terms[ends[node]])]
            used, term = min(hits, default=(0, -1))
            self.found.append(term)
            self.used.append(used)
        self.table = np.array(table, np.int32)
        self.found, self.used = np.array(self.found, np.int32), np.array(self.used, np.int32)
        # the last place stands for all letters beyond those of the terms
        codes = np.full(max(map(ord, letters), default=0) + 2, len(letters), np.int32)
        for x, k in self.letters.items():
            codes[ord(x)] = k
        self.codes = codes

    def read(self, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term, -1 for none, and edits of each row of letters."""
        points = np.minimum(points, len(self.codes) - 1)
        state = np.zeros(len(points), np.int32)
        for k in range(int(length.max())):
            live = length > k
            state[live] = self.table[state[live], self.codes[points[live, k]]]
        return self.found[state], self.used[state]
