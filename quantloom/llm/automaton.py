"""A generalised suffix automaton over word numbers (Blumer et al. 1985), kept in arrays."""

from __future__ import annotations

from array import array


class SuffixAutomaton:
    """All substrings of the texts added. Almost every state has one way on, so this way is kept in arrays and only
    the other ways in dictionaries. first is the place, over all texts in the order of adding, of the word that ends
    the first occurrence of a state's strings."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.first = array("i", [-1]), array("i", [0]), array("q", [-1])
        self.n_words = 0

    def add(self, words: list[bytes]) -> array:
        """Add a text; returns its word numbers."""
        text, last = array("i", [self.number.setdefault(w, len(self.number)) for w in words]), 0
        for c in text:
            last = self._extend(last, c)
            self.n_words += 1
        return text

    def _next(self, state: int, c: int) -> int:
        """Where c leads from a state; -1 if nowhere."""
        if self.word[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return more.get(c, -1) if more else -1

    def _put(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _new(self, length: int, link: int, first: int, word: int = -1, to: int = 0) -> int:
        self.first.append(first)
        self.word.append(word)
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings that p and c make, taken out of q where q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], self.first[q], self.word[q], self.to[q])
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        self.link[q] = twin
        while p >= 0 and self._next(p, c) == q:
            self._put(p, c, twin)
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if (q := self._next(last, c)) >= 0:
            return self._split(last, c, q)
        state, p = self._new(self.length[last] + 1, 0, self.n_words), last
        while p >= 0 and self._next(p, c) < 0:
            self._put(p, c, state)
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self._next(p, c))
        return state

    def _step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """After one more word: the state and length of the longest suffix that occurs."""
        while (to := self._next(state, c)) < 0:
            if state == 0:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return to, length + 1

    def _of_length(self, state: int, n: int) -> int:
        """The state that holds the suffix of n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state
