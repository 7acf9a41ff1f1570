"""Lower bounds of the edits that a text takes, which keep the search for its repair short.

A finite automaton that accepts all a grammar derives, and more, is run from the end
of a text with its edits counted.  What it tells of a place, how many edits the rest
takes at least after each item of the chart, is never too many, so the chart may
leave out whatever comes to more than the edits allowed: no repair is lost.  The runs
are remembered as transitions between sets of states, one look-up a token.
"""

from __future__ import annotations

#: terminals up to which a symbol that doesn't recur is copied where it is used; the more, the closer the bound
SMALL = 40
#: levels of texts within one another that are told apart
DEEP = 2
REMEMBERED = 20_000


class Bounds:
    """The automaton of some goals of a grammar."""

    def __init__(self, grammar, goals: tuple):
        self.grammar, self.goals = grammar, goals
        self.epsilon: list[list[int]] = []  # by node
        self.reads: list[tuple] = []  # by state: (node it comes from, its terminals, node it leads to)
        self.places: dict[tuple, list[int]] = {}  # nodes of each (production, place)
        self.shared: dict[tuple, tuple[int, int]] = {}
        self.sizes: dict[int, float] = {}
        self.reach: dict[int, set[int]] = {}
        start = {g: self._node() for g in goals}
        end = self._node()
        self.reads.append((end, ("",), end))  # state 0: the text has ended
        for g in goals:
            first, last = self._use(g)
            self.epsilon[start[g]].append(first)
            self.epsilon[last].append(end)
        self._close(start)

    def _node(self) -> int:
        self.epsilon.append([])
        return len(self.epsilon) - 1

    def _size(self, symbol: int) -> float:
        """Terminals of a symbol with all that it is made of; infinite where it recurs."""
        if symbol not in self.sizes:
            self.sizes[symbol] = float("inf")
            prods = [self.grammar.prods[p][1] for p in self.grammar.of[symbol]]
            self.sizes[symbol] = sum(self._size(s) if isinstance(s, int) else 1 for rhs in prods for s in rhs)
        return self.sizes[symbol]

    def _reached(self, symbol: int) -> set[int]:
        """Symbols that one is made of."""
        found = self.reach.get(symbol)
        if found is None:
            agenda = [symbol]
            found = self.reach[symbol] = set()
            for a in agenda:
                more = {s for p in self.grammar.of[a] for s in self.grammar.prods[p][1] if isinstance(s, int)} - found
                found |= more
                agenda += more
        return found

    def _use(self, symbol: int, level: int = 0) -> tuple[int, int]:
        """(first node, last node) of a symbol: a copy of its own, or the one that all uses of its level share."""
        if (symbol, level) in self.shared:
            return self.shared[symbol, level]
        first, last = self._node(), self._node()
        if self._size(symbol) > SMALL:
            self.shared[symbol, level] = (first, last)
        single: dict = {}
        for p in self.grammar.of[symbol]:
            rhs = self.grammar.prods[p][1]
            if len(rhs) == 1 and isinstance(rhs[0], str) and rhs[0] not in ("ASI", "NEVER"):
                single[p] = rhs[0]
                continue
            node = self._node()
            self.epsilon[first].append(node)
            self.places.setdefault((p, 0), []).append(node)
            for d, s in enumerate(rhs, 1):
                after = self._node()
                if isinstance(s, int):
                    # between terms that belong together: what it returns to isn't forgotten
                    inside = level < DEEP and 1 < d < len(rhs) and isinstance(rhs[d], str) and symbol in self._reached(s)
                    a, b = self._use(s, level + inside)
                    self.epsilon[node].append(a)
                    self.epsilon[b].append(after)
                elif s != "NEVER":
                    self.reads.append((node, (s,), after))
                node = after
                self.places.setdefault((p, d), []).append(node)
            self.epsilon[node].append(last)
        if single:  # read alike, so one state
            self.reads.append((first, tuple(single.values()), last))
            for p in single:
                own = self._node()
                self.epsilon[own].append(last)
                self.places.setdefault((p, 1), []).append(own)
                # what begins with it reads that state
                own = self._node()
                self.places.setdefault((p, 0), []).append(own)
                self.reads.append((own, (single[p],), last))
        return first, last

    def _close(self, start: dict) -> None:
        nodes = range(len(self.epsilon))
        # what may be read next from each node, without and with a line break
        direct = [0] * len(nodes)
        through: list[list[int]] = [list(e) for e in self.epsilon]
        for k, (a, terminals, b) in enumerate(self.reads):
            if terminals == ("ASI",):
                through[a].append(b)
            else:
                direct[a] |= 1 << k
        next_ = []
        for edges in (self.epsilon, through):
            mask, changed = list(direct), True
            while changed:
                changed = False
                for a in reversed(nodes):
                    m = mask[a]
                    for b in edges[a]:
                        m |= mask[b]
                    if m != mask[a]:
                        mask[a], changed = m, True
            next_.append(mask)
        # a text ends where a line does
        next_[0] = [a | (b & 1) for a, b in zip(*next_)]
        self.start = {g: tuple(m[a] for m in next_) for g, a in start.items()}
        prods = self.grammar.prods
        self.ahead = tuple([[0] * (len(rhs) + 1) for _, rhs in prods] for _ in range(2))
        for (p, d), at in self.places.items():
            for asi in range(2):
                for a in at:
                    self.ahead[asi][p][d] |= next_[asi][a]
        # states by what may follow them
        self.followed: tuple[dict, dict] = ({}, {})
        for k, (_, terminals, b) in enumerate(self.reads):
            if k and terminals != ("ASI",):
                for asi in range(2):
                    m = next_[asi][b]
                    self.followed[asi][m] = self.followed[asi].get(m, 0) | 1 << k
        self.all = sum(1 << k for k, (_, t, _) in enumerate(self.reads) if k and t != ("ASI",))
        self.reading: dict[frozenset, int] = {}
        self.before: tuple[dict, dict] = ({}, {})
        self.runs: dict[tuple, tuple[list, dict, dict]] = {}
        del self.epsilon, self.places, self.shared

    def _reading(self, key: frozenset) -> int:
        found = self.reading.get(key)
        if found is None:
            found = self.reading[key] = sum(1 << k for k, (_, t, _) in enumerate(self.reads) if k and not key.isdisjoint(t))
        return found

    def _before(self, states: int, asi: bool) -> int:
        """States after which one of ``states`` may be next."""
        found = self.before[asi].get(states)
        if found is None:
            found = 0
            for m, those in self.followed[asi].items():
                if m & states:
                    found |= those
            if len(self.before[asi]) > REMEMBERED:
                self.before[asi].clear()
            self.before[asi][states] = found
        return found

    def _step(self, after: tuple | None, key: frozenset, asi: bool, drop: int, take: int, insert: int, most: int) -> tuple:
        """(what may have been read, what may be read next) with up to 0, 1 ... ``most`` edits still to make, one token earlier."""
        last, next_ = [], []
        for c in range(most + 1):
            if after is None:
                m = 1
            else:
                m = self._reading(key) & after[0][c]
                if c >= take:
                    m |= after[0][c - take]
                if c >= drop:
                    m |= after[1][c - drop]
            if c >= insert:
                m |= last[c - insert]
            x = self._before(m, asi)
            if after is not None and c >= drop:
                x |= after[0][c - drop]
            next_.append(m)
            last.append(x)
        return tuple(last), tuple(next_)

    def run(self, keys: list[frozenset], breaks: list[bool], drops: list[int], takes: list[int], insert: int, most: int, broken: int = -1):
        """What may be read next at each place by edits that the rest takes, or None if the text takes more than ``most``.

        No text can end with the tokens from ``broken`` on.
        """
        sets, numbers, steps = self.runs.setdefault((insert, most), ([], {}, {}))
        if len(sets) > REMEMBERED:
            sets.clear()
            numbers.clear()
            steps.clear()
        n, out, state = len(keys), [], -1

        def number(pair):
            k = numbers.get(pair)
            if k is None:
                k = numbers[pair] = len(sets)
                sets.append(pair)
            return k

        for i in range(n, -1, -1):
            step = (state, keys[i], breaks[i], drops[i], takes[i]) if i < n else (state,)
            new = steps.get(step)
            if new is None:
                if i < n:
                    pair = self._step(sets[state], keys[i], breaks[i], drops[i], takes[i], insert, most)
                else:
                    pair = self._step(None, frozenset(), True, 0, 0, insert, most)
                new = steps[step] = number(pair)
            state = new
            if i == broken:
                last, next_ = sets[state]
                state = number(((0, *last[1:]), (0, *next_[1:])))
            if not sets[state][1][most]:
                return None
            out.append(sets[state][1])
        out.reverse()
        asi, first = n == 0 or breaks[0], out[0][most]
        if not any(first & m[asi] or first & m[1] and n and drops[0] <= most for m in self.start.values()):
            return None
        return out
