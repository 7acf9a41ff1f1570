"""Source files that do not parse: minimum-cost repair by error-correcting chart
parsing.

A file is cut into tokens and its brackets are folded, from the inside out: a
group becomes one symbol that carries every role it can play (block, argument
list, ...).  Texts are thus short and few in kind; each kind is parsed once a
worker by an Earley chart and remembered.  A file that derives costs zero.

Any other file is repaired, and every repair is real: making its edits gives a
file that parses.  An edit inserts, deletes or replaces one token (deleting a
group costs all of its tokens).

- What no token begins with (a stray sign, a malformed number, the marker line of
  a merge conflict) is a symbol of its own, which costs one and which the chart
  may drop or take for any token.  A string, comment or template without an end
  gets it for one edit.
- An opening bracket without its closing one is closed where its text stops to
  parse, or at the end, whichever is cheaper; a closing bracket without its
  opening one is such a symbol too, or takes the place of the one that is wanted,
  as the brackets that follow tell.
- Texts that fail, the innermost first, are cut at statement ends and lines; in
  each part that fails, however long, the chart finds the least number of edits, up
  to ``TOGETHER``; if more are needed, its halves are repaired one by one.
- The place of a single edit is the first symbol of its part, where a change of that
  will do, else where the part stops to parse, else the first place that will do.

The cost is the least one within a part and an upper bound over all ways to
choose brackets and parts.  The places of the edits tell what is wrong: at marker
lines (conflict), at the end alone (truncated), on half of the lines or more
(mismatch: not the language of the extension), elsewhere (syntax).

Work and state are one file's at a time.  Rates are aggregated by Spark.
Null contents are no case; empty and comment-only files are valid; files whose
extension names no known language are left out; repeated rows of (project,
file_path) count once.
"""

from __future__ import annotations

import gc
import heapq
import re
from bisect import bisect_left
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import grammars as G
from codeweft.llm.bounds import Bounds
from codeweft.storage import spread

#: edits that the chart looks for in one part; a part of more is halved
TOGETHER = 2
REMEMBERED = 200_000
#: places at first that a single edit is looked for at; twice as many each time that none will do
WINDOW = 16
#: brackets looked at to choose how to mend one
AHEAD = 12
CLOSING = {"(": ")", "[": "]", "{": "}"}
ENDING = frozenset(CLOSING.values())
MARKER = re.compile(r"(?:<{7}(?: [^\n]*)?|>{7}(?: [^\n]*)?|\|{7}(?: [^\n]*)?|={7})\r?(?=\n|\Z)")
#: symbols that stand for an edit of their own
WILD = ("BAD", "CONFLICT")


class Grammar:
    """Productions of a grammar text, with what prediction needs to know."""

    def __init__(self, text: str, typescript: bool = False):
        self.prods: list[tuple[int, tuple]] = []
        self.of: list[list[int]] = []
        self.beginning: dict = {}
        self.ids: dict[str, int] = {}
        self.bounds: dict[tuple, Bounds] = {}
        for line in text.strip().split("\n") if text else ():
            if line.startswith("ts:"):
                if not typescript:
                    continue
                line = line[3:]
            name, _, body = line.strip().partition(" = ")
            # under TypeScript a rule of the same name adds to the others
            tokens = re.findall(r'"[^"]*"|@?\w+|[()|?*+]', body)
            for alternative in self._alternatives(tokens, 0)[0]:
                self._add(self._id(name), alternative)
        self._close()

    def _id(self, name: str) -> int:
        if name not in self.ids:
            self.ids[name] = len(self.of)
            self.of.append([])
        return self.ids[name]

    def _add(self, lhs: int, rhs) -> None:
        self.of[lhs].append(len(self.prods))
        self.prods.append((lhs, tuple(rhs)))

    def _alternatives(self, tokens, i):
        out, one = [], []
        while i < len(tokens) and tokens[i] != ")":
            t = tokens[i]
            if t == "|":
                out.append(one)
                one, i = [], i + 1
                continue
            if t == "(":
                inner, i = self._alternatives(tokens, i + 1)
                symbol = self._id(f"_{len(self.of)}")
                for a in inner:
                    self._add(symbol, a)
            elif t[0] == '"':
                symbol = t[1:-1]
            elif t[0] == "@" or t.isupper():
                symbol = t
            else:
                symbol = self._id(t)
            i += 1
            if i < len(tokens) and tokens[i] in ("?", "*", "+"):
                repeat = self._id(f"_{len(self.of)}")
                if tokens[i] == "?":
                    self._add(repeat, ())
                    self._add(repeat, (symbol,))
                else:
                    self._add(repeat, () if tokens[i] == "*" else (symbol,))
                    self._add(repeat, (repeat, symbol))
                symbol, i = repeat, i + 1
            one.append(symbol)
        return [*out, one], i

    def _close(self) -> None:
        n = len(self.of)
        self.nullable, first = [False] * n, [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for lhs, rhs in self.prods:
                before = (self.nullable[lhs], len(first[lhs]))
                for s in rhs:
                    if isinstance(s, str):
                        first[lhs].add(s)
                        break
                    first[lhs] |= first[s]
                    if not self.nullable[s]:
                        break
                else:
                    self.nullable[lhs] = True
                changed |= before != (self.nullable[lhs], len(first[lhs]))
        # what a text that goes on from each place of a production may begin with; None if it may be empty
        self.look: list[list] = []
        for _, rhs in self.prods:
            at: list = [None]
            for s in reversed(rhs):
                if isinstance(s, str):
                    at.append((frozenset((s,)), s == "ASI"))
                elif not self.nullable[s]:
                    at.append((frozenset(first[s]), "ASI" in first[s]))
                elif at[-1] is None:
                    at.append(None)
                else:
                    starts = first[s] | at[-1][0]
                    at.append((frozenset(starts), "ASI" in starts))
            self.look.append(at[::-1])

    def begun(self, symbol: int, key: frozenset, asi: bool) -> tuple[int, ...]:
        """Productions of a symbol that can begin with the next token."""
        found = self.beginning.get((symbol, key, asi))
        if found is None:
            found = []
            for q in self.of[symbol]:
                a = self.look[q][0]
                if a is None or not a[0].isdisjoint(key) or (a[1] and asi):
                    found.append(q)
            found = self.beginning[symbol, key, asi] = tuple(found)
        return found

    def alike(self, keywords) -> dict[str, str]:
        """Tokens that the grammar uses in the same places, each with one that stands for all of them."""
        uses: dict[str, set] = {}
        for lhs, rhs in self.prods:
            for k, s in enumerate(rhs):
                if isinstance(s, str) and s[0] != "@":
                    uses.setdefault(s, set()).add((lhs, *rhs[:k], None, *rhs[k + 1 :]))
        first: dict = {}
        return {s: first.setdefault((frozenset(u), s in keywords), s) for s, u in uses.items()}

    def recognise(self, keys: list[frozenset], breaks: list[bool], starts: list[int]) -> set[int]:
        """Those of ``starts`` that derive the whole text."""
        return self.chart(keys, breaks, starts)[0]

    def chart(self, keys: list[frozenset], breaks: list[bool], starts: list[int]) -> tuple[set[int], int]:
        """:meth:`recognise` by an Earley chart, and the first token that continues no parse."""
        prods, of, look, nullable, n = self.prods, self.of, self.look, self.nullable, len(keys)
        waiting: list[dict] = [{} for _ in range(n + 1)]
        current: list[tuple] = []
        found: set[int] = set()
        wanted = set(starts)
        none: frozenset = frozenset()
        for i in range(n + 1):
            key = keys[i] if i < n else none
            asi = i == n or breaks[i]
            wait, following, predicted, done = waiting[i], [], set(), set()
            seen = set(current)
            agenda = current
            if i == 0:
                for s in starts:
                    predicted.add(s)
                    agenda += [(q, 0, i) for q in self.begun(s, key, asi)]
                    if n == 0 and nullable[s]:
                        found.add(s)
            for item in agenda:
                p, d, o = item
                lhs, rhs = prods[p]
                if d == len(rhs):
                    if o == i:
                        if lhs in done:
                            continue
                        done.add(lhs)
                    for w in waiting[o].get(lhs, ()):
                        new = (w[0], w[1] + 1, w[2])
                        a = look[w[0]][w[1] + 1]
                        if new not in seen and (a is None or not a[0].isdisjoint(key) or (a[1] and asi)):
                            seen.add(new)
                            agenda.append(new)
                    if o == 0 and i == n and lhs in wanted:
                        found.add(lhs)
                    continue
                symbol = rhs[d]
                if isinstance(symbol, int):
                    wait.setdefault(symbol, []).append(item)
                    if symbol not in predicted:
                        predicted.add(symbol)
                        agenda += [(q, 0, i) for q in self.begun(symbol, key, asi)]
                    if nullable[symbol] or symbol in done:
                        new = (p, d + 1, o)
                        if new not in seen:
                            seen.add(new)
                            agenda.append(new)
                elif symbol in key:
                    following.append((p, d + 1, o))
                elif symbol == "ASI" and asi:
                    new = (p, d + 1, o)
                    if new not in seen:
                        seen.add(new)
                        agenda.append(new)
            if i < n and not following:
                return found, i
            current = list(dict.fromkeys(following))
        return found, n

    @cached_property
    def backward(self) -> Grammar:
        """The grammar of the texts read from their ends."""
        out = Grammar("")
        out.ids, out.of = self.ids, self.of
        # a repeat stays left-recursive: the other way its chart would grow with the square of the text
        repeats = {p for p, (lhs, rhs) in enumerate(self.prods) if len(rhs) == 2 and rhs[0] == lhs and all(self.prods[q][1] in ((), rhs[1:], rhs) for q in self.of[lhs])}
        out.prods = [(lhs, rhs if p in repeats else rhs[::-1]) for p, (lhs, rhs) in enumerate(self.prods)]
        out._close()
        return out

    def repair(
        self, keys: list[frozenset], breaks: list[bool], starts: list[int], most: int,
        weights: list[int] | None = None, takes: list[int] | None = None, insert: int = 1, at: int | None = None,
    ) -> tuple[int, int, int]:
        """(least cost of edits, place of the first edit, start it leads to), or (most + 1, 0, -1).

        ``weights`` are what dropping each symbol costs, ``takes`` (by default the
        same) what replacing it does; ``insert`` is the cost of an insertion.  With
        ``at``, no edit comes before that place.
        """
        n, over = len(keys), (most + 1, 0)
        drops = weights or [1] * n
        takes = takes or drops
        goals = tuple(starts)
        bounds = self.bounds.get(goals)
        if bounds is None:
            bounds = self.bounds[goals] = Bounds(self, goals)
        broken = -1
        if most and 0 not in drops:  # where no rest derives without an edit
            if bounds.run(keys, breaks, drops, takes, insert, most) is None:
                return *over, -1
            last = self.backward.chart(keys[::-1], [i == n or breaks[i] for i in range(n, 0, -1)], starts)[1]
            broken = n - 1 - last
        left = bounds.run(keys, breaks, drops, takes, insert, most, broken)
        if left is None:
            return *over, -1
        # places that one edit may take are tried from the left: the first is the answer, and there may be very many
        begin, wide = 0, WINDOW if most == 1 and 0 not in drops else n + 1
        if at is not None:
            begin = at
        while True:
            best, begin = self._search(keys, breaks, starts, most, drops, takes, insert, bounds.ahead, left, begin, wide)
            if best[0] <= most or begin > n:
                return best
            wide *= 2

    def _search(self, keys, breaks, starts, most, drops, takes, insert, ahead, left, begin, wide) -> tuple[tuple[int, int, int], int]:
        """:meth:`repair` with edits from ``begin`` on, at the first ``wide`` places that may have one; the place after those."""
        prods, of, n, over = self.prods, self.of, len(keys), (most + 1, 0)
        end = n + 1

        def may(item, total, i):
            """Whether the rest can be mended with the edits left."""
            p, d, _ = item
            asi = i == n or breaks[i]
            if left[i][most - total] & ahead[asi][p][d]:
                return True
            # a line break behind what is dropped
            return not asi and total + drops[i] <= most and left[i + 1][most - total - drops[i]] & ahead[1][p][d]

        waiting: list[dict] = [{} for _ in range(n + 1)]
        wanted, best = set(starts), (*over, -1)
        layers: list[dict] = [{} for _ in range(n + 2)]
        # an item's cost counts from its origin; what the cheapest way there that wants its symbol has cost comes on top
        base: list[dict] = [{} for _ in range(n + 1)]
        for s in starts:
            base[0][s] = 0
            for q in of[s]:
                if may((q, 0, 0), 0, 0):
                    layers[0][(q, 0, 0)] = (0, n)
        for i in range(n + 1):
            key = keys[i] if i < n else frozenset()
            asi = i == n or breaks[i]
            costs, empty, here, predicted = layers[i], {}, base[i], set()
            if not costs:
                return best, end if i >= end else n + 1
            editing, made = begin <= i < end, False
            # the least in all first, so the first to want a symbol is the cheapest
            heap = [(base[x[2]][prods[x[0]][0]] + c[0], c, x) for x, c in costs.items()]
            heapq.heapify(heap)

            def push(item, cost, i=i, costs=costs, heap=heap):
                total = base[item[2]][prods[item[0]][0]] + cost[0]
                if total <= most and cost < costs.get(item, over) and may(item, total, i):
                    costs[item] = cost
                    heapq.heappush(heap, (total, cost, item))
                    return True
                return False

            def forward(item, cost, i=i + 1, ahead=layers[i + 1]):
                total = base[item[2]][prods[item[0]][0]] + cost[0]
                if total <= most and cost < ahead.get(item, over) and may(item, total, i):
                    ahead[item] = cost
                    return True
                return False

            join = lambda a, b: (a[0] + b[0], min(a[1], b[1]))
            while heap:
                total, cost, item = heapq.heappop(heap)
                if costs[item] != cost:
                    continue
                p, d, o = item
                lhs, rhs = prods[p]
                if d == len(rhs):
                    if o == i and cost < empty.get(lhs, over):
                        empty[lhs] = cost
                    for w, c in list(waiting[o].get(lhs, {}).items()):
                        push((w[0], w[1] + 1, w[2]), join(cost, c))
                    if o == 0 and i == n and lhs in wanted:
                        best = min(best, (*cost, lhs))
                    continue
                symbol = rhs[d]
                if isinstance(symbol, int):
                    waiting[i].setdefault(symbol, {})[item] = cost
                    if symbol not in predicted:
                        predicted.add(symbol)
                        here.setdefault(symbol, total)
                        for q in of[symbol]:
                            push((q, 0, i), (0, n))
                    if symbol in empty:
                        push((p, d + 1, o), join(cost, empty[symbol]))
                    continue
                place = min(cost[1], i)
                if symbol == "ASI":
                    if asi:
                        push((p, d + 1, o), cost)
                elif symbol != "NEVER":
                    if i < n and symbol in key:
                        forward((p, d + 1, o), cost)
                    elif editing and i < n:
                        made |= forward((p, d + 1, o), (cost[0] + takes[i], place))
                    if editing:
                        made |= push((p, d + 1, o), (cost[0] + insert, place))
                if editing and i < n:
                    made |= forward(item, (cost[0] + drops[i], place))
            if made:
                end = min(end, i + wide)
            layers[i] = {}
        return best, end


class Token:
    __slots__ = ("key", "line", "at", "inner", "bracket", "weight", "mended")

    def __init__(self, key, line, at, inner=None, bracket=""):
        self.key, self.line, self.at, self.inner, self.bracket = key, line, at, inner, bracket
        # how many tokens it is; what its repair takes, once known
        self.weight = 1 if inner is None else 2 + sum([t.weight for t in inner])
        self.mended = None


class Broken(Exception):
    """The text cannot be cut into tokens or its brackets do not match."""

    def __init__(self, what: str, at: int):
        self.what, self.at = what, at


_SPACE = r"(?P<space>[ \t\r\f\v ﻿]+)|(?P<line>\n| | )|(?P<comment>//[^\n]*|/\*.*?\*/)"
_STRING = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)"


def _punctuation(text: str) -> str:
    return "(?P<sign>" + "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True)) + ")"


class Language:
    """Tokens, folding and roles of one language family."""

    def __init__(self, grammar, roles, items, keywords, pattern, nested=False, kind=""):
        self.grammar, self.kind, self.nested = grammar, kind, nested
        self.keywords = frozenset(keywords.split())
        self.pattern = re.compile(pattern, re.S)
        self.roles = {
            b: [(f"@{r}", nt, grammar.ids.get(nt), items.get(r)) for r, nt in rs.items() if nt in ("ANY", "EMPTY") or nt in grammar.ids]
            for b, rs in roles.items()
        }
        self.items = items
        self.known: dict = {}
        self.same = grammar.alike(self.keywords)
        self.last = 0  # offset of the last token of the file under repair
        self.key_sets: dict[str, frozenset] = {}

    # -- tokens

    def keys(self, key) -> frozenset:
        if isinstance(key, frozenset):
            return key
        found = self.key_sets.get(key)
        if found is None:
            found = self.key_sets[key] = frozenset((key, "KEYWORD")) if key in self.keywords else frozenset((key,))
        return found

    def tokens(self, text: str) -> list[Token]:
        out, end = self.fold(text, 0, "")
        return out

    def fold(self, text: str, at: int, until: str) -> tuple[list[Token], int]:
        """Tokens from ``at`` to the closing bracket ``until`` (or the end)."""
        match, n = self.pattern.match, len(text)
        stack: list[tuple] = []
        out: list[Token] = []
        line = True
        branch = 0
        while True:
            if at >= n:
                if until or stack:
                    raise Broken("unclosed", stack[-1][2] if stack else n)
                return out, at
            if text[at] == " ":
                at += 1
                continue
            m = match(text, at)
            if m is None:
                special = self.special(text, at, out, line)
                if special is None:
                    raise Broken("character", at)
                at = special
                line = False
                continue
            kind, value, start = m.lastgroup, m.group(), at
            at = m.end()
            if kind == "space":
                continue
            if kind == "line":
                line = True
                continue
            if kind == "comment":
                if self.nested and value.startswith("/*"):
                    at = self.comment(text, start)
                line = line or "\n" in value
                continue
            if kind == "directive":
                at = self.directive(text, start, at, value)
                line = True
                continue
            if kind == "sign" and self.kind == "js" and value[0] in "/<":
                other = self.markup(text, start, value, out, line)
                if other is not None:
                    at, line = other, False
                    continue
            if kind == "sign" and value in CLOSING:
                stack.append((value, out, start, line))
                out, line = [], False
                continue
            if kind == "sign" and value in ")]}":
                if not stack:
                    if value == until:
                        return out, at
                    raise Broken("unopened", start)
                bracket, outer, opened, first = stack.pop()
                if CLOSING[bracket] != value:
                    raise Broken("mismatch", start)
                outer.append(Token(self.group(bracket, out), first, opened, out, bracket))
                out, line = outer, False
                continue
            if kind == "number":
                if at < n and (text[at].isalnum() or text[at] in "_$"):
                    raise Broken("number", start)
                key = "NUM"
            elif kind == "string":
                key = "STR"
            elif kind == "name":
                key = value if value in self.keywords else "ID"
                if key == "pragma" and self.kind == "solidity":
                    end = text.find(";", at)
                    body = text[at : end if end >= 0 else n]
                    if end < 0 or "\n" in body or not body.strip():
                        raise Broken("pragma", start)
                    out += [Token("pragma", line, start), Token("PRAGMA", False, at)]
                    at, line = end, False
                    continue
            else:
                key = value if kind == "sign" else kind.upper()
            out.append(Token(key, line, start))
            line = False

    def special(self, text, at, out, line):
        c = text[at]
        if self.kind == "js" and c == "`":
            return self.template(text, at, out, line)
        m = re.compile(r"[^\W\d]\w*").match(text, at)
        if m and not text[at].isascii() and self.kind in ("js", "rust"):
            out.append(Token("ID", line, at))
            return m.end()
        return None

    def comment(self, text: str, at: int) -> int:
        depth, start = 0, at
        for m in re.compile(r"/\*|\*/").finditer(text, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        raise Broken("comment", start)

    def directive(self, text: str, start: int, at: int, value: str) -> int:
        m = re.match(r"[ \t]*#[ \t]*(\w*)[ \t]*(.*)", value, re.S)
        name, rest = m[1], m[2]
        if name not in ("include", "define", "undef", "if", "ifdef", "ifndef", "elif", "else", "endif", "pragma", "error", "line", "warning", "import", ""):
            raise Broken("directive", start)
        if name == "include" and not re.match(r"<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*", rest):
            raise Broken("directive", start)
        if name in ("ifdef", "ifndef", "undef", "define") and not re.match(r"[A-Za-z_]\w*", rest):
            raise Broken("directive", start)
        if name in ("else", "elif"):
            # one branch is enough: the other is its alternative
            depth = 1
            for d in re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|endif)\b[^\n]*", re.M).finditer(text, at):
                depth += -1 if d[1] == "endif" else 1
                if not depth:
                    return d.end()
            raise Broken("unclosed", start)
        return at

    # -- JavaScript: what a sign means depends on what stands before it

    def begins(self, out) -> bool:
        """Whether an expression begins after the tokens of ``out``."""
        if not out:
            return True
        key = out[-1].key
        if isinstance(key, frozenset):
            return False
        if key in ("ID", "NUM", "STR", "TPL", "RE", "this", "super", "null", "true", "false", "++", "--", ")", "]", "}"):
            return False
        return key not in self.keywords or key in (
            "return typeof case do else in instanceof new void delete throw yield await of default extends".split()
        )

    def markup(self, text, at, value, out, line):
        if not self.begins(out):
            return None
        if value[0] == "/":
            m = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*").match(text, at)
            if not m:
                raise Broken("regex", at)
            out.append(Token("RE", line, at))
            return m.end()
        if value == "<" and self.jsx and re.compile(r"<(?:[A-Za-z_$>])").match(text, at):
            end, parts = self.element(text, at, 0)
            ok = all("@jsx" in self.keys(p.key) for p in parts)
            out.append(Token(frozenset(("JSX",)) if ok else frozenset(), line, at, parts, "<"))
            return end
        return None

    jsx = False

    def template(self, text, at, out, line):
        start, parts, i = at, [], at + 1
        piece = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
        while True:
            i = piece.match(text, i).end()
            if i >= len(text):
                raise Broken("template", start)
            if text[i] == "`":
                ok = all("@template" in self.keys(p.key) for p in parts)
                out.append(Token(frozenset(("TPL",)) if ok else frozenset(), line, start, parts, "`"))
                return i + 1
            if text[i] == "\\":
                raise Broken("template", start)
            inner, i2 = self.fold(text, i + 2, "}")
            parts.append(Token(self.group("{", inner), False, i, inner, "{"))
            i = i2

    def element(self, text, at, depth):
        """End and embedded expressions of a JSX element."""
        if depth > 200:
            raise Broken("depth", at)
        name = re.compile(r"[A-Za-z_$][\w$.:-]*")
        space = re.compile(r"(?:\s|/\*.*?\*/)*", re.S)
        parts, i = [], at + 1
        m = name.match(text, i)
        tag = m.group() if m else ""
        i = m.end() if m else i

        def braces(i):
            inner, end = self.fold(text, i + 1, "}")
            parts.append(Token(self.group("{", inner), False, i, inner, "{"))
            return end

        while True:
            i = space.match(text, i).end()
            if text.startswith("/>", i) and tag:
                return i + 2, parts
            if text.startswith(">", i):
                i += 1
                break
            if text.startswith("{", i):
                i = braces(i)
                continue
            m = name.match(text, i)
            if not m or not tag:
                raise Broken("markup", i)
            i = space.match(text, m.end()).end()
            if text.startswith("=", i):
                i = space.match(text, i + 1).end()
                m = re.compile(r"\"[^\"]*\"|'[^']*'").match(text, i)
                if m:
                    i = m.end()
                elif text.startswith("{", i):
                    i = braces(i)
                elif text.startswith("<", i):
                    i, more = self.element(text, i, depth + 1)
                    parts += more
                else:
                    raise Broken("markup", i)
        plain = re.compile(r"[^<>{}]*")
        while True:
            i = plain.match(text, i).end()
            if i >= len(text):
                raise Broken("unclosed", at)
            if text.startswith("</", i):
                m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, i)
                if not m or (m[1] or "") != tag:
                    raise Broken("markup", i)
                return m.end(), parts
            if text[i] == "<":
                i, more = self.element(text, i, depth + 1)
                parts += more
            elif text[i] == "{":
                i = braces(i)
            else:
                raise Broken("markup", i)

    # -- roles

    def shape(self, what, tokens: list[Token]) -> int:
        """Stands for all texts that parse alike: 64 bits, and a fraction of the memory."""
        same = self.same
        return hash((what, tuple([same.get(t.key, t.key) for t in tokens]), tuple([t.line for t in tokens]) if self.kind == "js" else ()))

    def group(self, bracket: str, tokens: list[Token]) -> frozenset:
        shape = self.shape(bracket, tokens)
        found = self.known.get(shape)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[shape] = frozenset(self._roles(bracket, tokens))
        return found

    def _roles(self, bracket, tokens):
        rest = []
        for role, name, nt, items in self.roles[bracket]:
            if name == "ANY" or (name == "EMPTY" and not tokens):
                yield role
            elif name != "EMPTY":
                rest.append((role, nt, items))
        whole = []
        for role, nt, items in rest:
            if items and self.by_items(tokens, nt, *items):
                yield role
            else:
                whole.append((role, nt))
        if whole:
            ok = self.parse(tokens, tuple(sorted({nt for _, nt in whole})))
            for role, nt in whole:
                if nt in ok:
                    yield role

    def by_items(self, tokens, nt, item, separator) -> bool:
        """Whether each item of the group parses alone."""
        if separator == "":
            return False
        pieces = self.pieces(tokens, separator)
        if separator == ",":
            if not pieces[-1]:
                pieces.pop()
            one = self.grammar.ids[item]
            return all(p and one in self.parse(p, (one,)) for p in pieces)
        middle = self.grammar.ids[item]
        return all(middle in self.parse(p, (middle,)) for p in pieces[:-1]) and nt in self.parse(pieces[-1], (nt,))

    STARTS = frozenset("return if for while let const var function class try switch throw async export import do static pub fn struct enum impl trait mod use match loop emit require event modifier constructor contract interface library ID @ #".split())

    ENDS = frozenset("ID NUM STR TPL RE true false null this".split())

    def between(self, last: Token, t: Token) -> bool:
        """Whether a statement surely ends at the line break between two tokens."""
        if last.bracket == "{":
            return t.key in self.STARTS
        return self.kind == "js" and t.key in self.STARTS and (last.key in self.ENDS or last.bracket == "[")

    def pieces(self, tokens, separator):
        out, one = [], []
        for t in tokens:
            if separator == ";" and one and t.line and self.between(one[-1], t):
                out.append(one)
                one = []
            if t.key == separator:
                if separator == ";":
                    one.append(t)
                out.append(one)
                one = []
                continue
            one.append(t)
        if one or separator == "," or not out:
            out.append(one)
        return out

    def parse(self, tokens, starts: tuple) -> set[int]:
        shape = self.shape(starts, tokens)
        found = self.known.get(shape)
        if found is None:
            found = self.grammar.recognise([self.keys(t.key) for t in tokens], [t.line for t in tokens], list(starts))
            self.known[shape] = found
        return found

    # -- whole files

    def check(self, text: str) -> tuple[int, str, int]:
        """(edit cost, kind of error, offset of the first edit) of a file; cost 0 if it is valid."""
        program = self.grammar.ids["program"]
        try:
            tokens = self.tokens(text)
            if all(program in self.parse(p, (program,)) for p in self.pieces(tokens, ";")) or program in self.parse(tokens, (program,)):
                return 0, "", -1
        except (Broken, RecursionError):
            pass
        best = None
        for by_line in (True, False):
            flat, edits, open_ = self.flat(text, by_line)
            self.last = flat[-1].at if flat else 0
            edits += [(1, t.at, t.key) for t in flat if t.key in WILD]
            tokens = self.balanced(flat, len(text), edits)
            edits += self.amend(tokens, (program,), len(text))[0]
            cost = sum(c for c, _, _ in edits)
            if best is None or cost < best[0]:
                best = (cost, kind_of(text, edits, flat), min((at for _, at, _ in edits), default=0))
            if not open_:
                break
        # without an edit nothing else is wrong than what nests too deep
        return max(1, best[0]), *best[1:]

    # -- repair: an edit is (cost, offset, what it mends)

    def flat(self, text: str, by_line: bool) -> tuple[list[Token], list[tuple], bool]:
        """All tokens, brackets among them, of a text that need not have any form; edits of what has no end; whether a comment is such.

        Such a comment ends with its line (``by_line``) or the text.
        """
        out, edits, at, n, line, open_ = [], [], 0, len(text), True, False
        while at < n:
            marker = MARKER.match(text, at) if not at or text[at - 1] == "\n" else None
            if marker:
                out.append(Token("CONFLICT", True, at))
                at, line = marker.end(), True
                continue
            m = self.pattern.match(text, at)
            kind, value = (m.lastgroup, m.group()) if m else ("", "")
            start = at
            try:
                if m is None:
                    at = self.special(text, at, out, line)
                    if at is not None:
                        line = False
                        continue
                    at = start
                elif kind == "sign" and self.kind == "js" and value[0] in "/<" and not text.startswith("/*", at):
                    other = self.markup(text, at, value, out, line)
                    if other is not None:
                        at, line = other, False
                        continue
                elif kind == "comment" and self.nested and value.startswith("/*"):
                    at = self.comment(text, at)
                    line = line or "\n" in text[start:at]
                    continue
                elif kind == "directive":
                    at = self.directive(text, start, m.end(), value)
                    line = True
                    continue
            except (Broken, RecursionError):
                if kind == "directive":
                    edits.append((1, start, ""))
                    at, line = m.end(), True
                    continue
            if text.startswith("/*", start) and kind != "comment" or kind == "comment" and self.nested and value.startswith("/*"):
                open_, end = True, text.find("\n", start) if by_line else -1
                at = n if end < 0 else end
                edits.append((1, at, "end" if at == n else ""))
                continue
            if m is None and text[start] in "\"'":
                end = text.find("\n", start)
                at = n if end < 0 else end
                out.append(Token("STR", line, start))
                edits.append((1, at, "end" if at == n else ""))
                line = False
            elif m is None:
                out.append(Token("BAD", line, start))
                at, line = start + 1, False
            else:
                at = m.end()
                if kind == "space":
                    continue
                if kind in ("line", "comment"):
                    line = line or "\n" in value or kind == "line"
                    continue
                key = value if kind == "sign" else kind.upper()
                if kind == "number":
                    key = "NUM"
                    if at < n and (text[at].isalnum() or text[at] in "_$"):
                        key, at = "BAD", re.compile(r"[\w$]*").match(text, at).end()
                elif kind == "string":
                    key = "STR"
                elif kind == "name":
                    key = value if value in self.keywords else "ID"
                    if key == "pragma" and self.kind == "solidity":
                        body = re.compile(r"[^;\n]*").match(text, at)
                        if not body.group().strip():
                            edits.append((1, at, ""))
                        out += [Token("pragma", line, start), Token("PRAGMA", False, at)]
                        at, line = body.end(), False
                        continue
                out.append(Token(key, line, start))
                line = False
        return out, edits, open_

    def balanced(self, flat: list[Token], n: int, edits: list[tuple]) -> list[Token]:
        """``flat`` with its brackets folded; what that takes is added to ``edits``."""
        signs = [t.key for t in flat if t.key in CLOSING or t.key in ENDING]
        program = ("", [self.grammar.ids["program"]])
        stack: list[tuple] = []  # (opening token, tokens before it)
        out: list[Token] = []
        seen = 0

        def fold(closed: bool, at: int):
            nonlocal out
            opening, outer = stack.pop()
            rest = []
            if not closed:
                edits.append((1, at, "end" if at == n else ""))
                around = stack[-1][0].key if stack else ""
                cut = self.early(opening, out, self.goals(around) if around else program[1], n)
                if cut < 0:  # one too many
                    edits[-1] = (1, opening.at, "")
                    outer += self.stray(opening, out)
                    out = outer
                    return
                if cut < len(out):
                    rest, out = out[cut:], out[:cut]
                    edits[-1] = (1, rest[0].at, "")
            outer.append(Token(self.group(opening.key, out), opening.line, opening.at, out, opening.key))
            outer += rest
            out = outer

        for t in flat:
            if t.key in CLOSING:
                seen += 1
                stack.append((t, out))
                out = []
            elif t.key in ENDING:
                seen += 1
                keys = [x.key for x, _ in stack]
                if keys and CLOSING[keys[-1]] == t.key:
                    fold(True, t.at)
                    continue
                over = next((k for k, x in enumerate(reversed(keys)) if CLOSING[x] == t.key), None)
                ways = [(1 + drift(signs, seen, keys), 1, "drop")]
                if over is not None:
                    ways.append((over + drift(signs, seen, keys[: len(keys) - over - 1]), 0, "close"))
                if keys:
                    ways.append((1 + drift(signs, seen, keys[:-1]), 2, "swap"))
                way = min(ways)[2]
                if way == "close":
                    for _ in range(over):
                        fold(False, t.at)
                    fold(True, t.at)
                elif way == "swap" or not self.opened(out, t):
                    edits.append((1, t.at, ""))
                    if way == "swap":
                        fold(True, t.at)
                    else:
                        out.append(Token("BAD", t.line, t.at))
            else:
                out.append(t)
        while stack:
            fold(False, n)
        return out

    def opened(self, out: list[Token], closing: Token) -> bool:
        """Whether the last stray sign stood for the bracket that ``closing`` wants; its group is folded then."""
        at = max((k for k, t in enumerate(out) if t.key == "BAD"), default=None)
        if at is None:
            return False
        bracket = next(b for b, c in CLOSING.items() if c == closing.key)
        inner = out[at + 1 :]
        group = Token(self.group(bracket, inner), out[at].line, out[at].at, inner, bracket)
        if self.dead([group], 0):
            return False
        out[at:] = [group]
        return True

    def stray(self, opening: Token, after: list[Token]) -> list[Token]:
        """``after`` behind a bracket that is one too many; a run of stray signs is one symbol."""
        return after if after and after[0].key == "BAD" else [Token("BAD", opening.line, opening.at), *after]

    def goals(self, bracket: str) -> list[int]:
        return sorted({nt for _, _, nt, _ in self.roles.get(bracket, []) if nt is not None})

    def dead(self, tokens: list[Token], k: int) -> bool:
        """Whether token k is a group that plays no role but that of any tokens, where that won't do."""
        t = tokens[k]
        if t.inner is None or t.bracket not in self.roles:
            return t.inner is not None and not t.key
        any_ = {role for role, name, _, _ in self.roles[t.bracket] if name == "ANY"}
        if t.key - any_:
            return False
        before = [x.key for x in tokens[max(0, k - 2) : k]]
        return not (any_ & t.key and before and (before[-1] in ("!", "#") or (before[0] == "!" and before[-1] == "ID")))

    def early(self, opening: Token, tokens: list[Token], around: list[int], n: int) -> int:
        """Where to close a bracket that is never closed, of the end, where its text fails and that line; -1 if it is one too many."""
        goals = self.goals(opening.key)
        if not tokens or self.parse(tokens, tuple(goals)):
            return len(tokens)
        place = max(self.fails(tokens, g) for g in goals)
        line = max((k for k in range(min(place, len(tokens) - 1) + 1) if tokens[k].line), default=0)
        whole = sum(c for c, _, _ in self.amend(tokens, tuple(goals), n)[0])
        best = (whole, len(tokens))
        if whole:
            best = min(best, (sum(c for c, _, _ in self.amend(self.stray(opening, tokens), tuple(around), n)[0]), -1))
        for cut in {place, line}:
            if 0 < cut < len(tokens) and self.parse(tokens[:cut], tuple(goals)):
                best = min(best, (sum(c for c, _, _ in self.amend(tokens[cut:], tuple(around), n)[0]), cut))
        return best[1]

    def amend(self, tokens: list[Token], goals: tuple, n: int) -> tuple[list[tuple], set[int]]:
        """(edits, goals that the text derives then); the innermost groups that fail come first."""
        found = self.parse(tokens, goals)
        if found:
            return [], found
        edits, fixed = [], list(tokens)
        for k, t in enumerate(tokens):
            if self.dead(tokens, k):
                inner = self.goals(t.bracket)
                if inner:
                    if t.mended is None:
                        t.mended = self.amend(t.inner, tuple(inner), n)
                    more, met = t.mended
                    role = frozenset(r for r, _, nt, _ in self.roles[t.bracket] if nt in met)
                    fixed[k] = Token(role | t.key, t.line, t.at, t.inner, t.bracket)
                else:  # an element or template: its parts are texts of their own
                    more = [e for p in t.inner if not p.key & {"@jsx", "@template"} for e in self.amend(p.inner, self.inside(t.bracket), n)[0]]
                    fixed[k] = Token(frozenset(("JSX" if t.bracket == "<" else "TPL",)), t.line, t.at)
                edits += more
        found = self.parse(fixed, goals)
        if found and edits:
            return edits, found
        more, found = self.parted(fixed, goals, n)
        return edits + more, found

    def inside(self, bracket: str) -> tuple:
        return (self.grammar.ids["jsx_whole" if bracket == "<" else "template_whole"],)

    def parted(self, tokens: list[Token], goals: tuple, n: int) -> tuple[list[tuple], set[int]]:
        """Edits of a text part by part, where it is a sequence of parts."""
        ways = []
        for goal in goals:
            for items in ({*self.items.values()} if goal != self.grammar.ids["program"] else {("program", ";")}):
                item, separator = items
                if separator == ";" and item in self.grammar.ids and (goal == self.grammar.ids[item] or any(nt == goal and i == items for rs in self.roles.values() for _, _, nt, i in rs)):
                    parts = self.pieces(tokens, ";")
                    middle = self.grammar.ids[item]
                    starts = [middle] * (len(parts) - 1) + [goal]
                    bad = [(p, s) for p, s in zip(parts, starts) if s not in self.parse(p, (s,))]
                    ways.append((sum(len(p) for p, _ in bad), len(ways), bad, goal, middle))
        if not ways:
            return self.searched(tokens, goals, n)
        # the sequence that most of the text fits
        _, _, bad, goal, middle = min(ways)
        edits = []
        for part, start in bad:
            lines = self.lines(part)
            by_line = []
            if len(lines) > 1:
                for k, one in enumerate(lines):
                    s = start if k == len(lines) - 1 else middle
                    if s not in self.parse(one, (s,)):
                        by_line += self.searched(one, (s,), n)[0]
            cost = sum(c for c, _, _ in by_line)
            if cost != 1:
                together = self.searched(part, (start,), n, min(cost - 1, TOGETHER) if by_line else None)[0]
                if together is not None:
                    by_line = together
            edits += by_line
        if not bad:  # each part derives, the whole doesn't
            edits, found = self.searched(tokens, goals, n)
            return edits, found
        return edits, {goal}

    def lines(self, tokens: list[Token]) -> list[list[Token]]:
        out: list[list[Token]] = []
        for t in tokens:
            if t.line or not out:
                out.append([])
            out[-1].append(t)
        return out

    def searched(self, tokens: list[Token], goals: tuple, n: int, most: int | None = None):
        """Edits of one part by the chart, least number first; of its halves beyond ``TOGETHER``.

        With ``most``, None where more edits are needed.
        """
        kept = [t for t in tokens if t.key not in WILD]
        if len(kept) < len(tokens):  # all dropped, or one taken for a token
            found = self.parse(kept, goals)
            if not found:
                cost, _, goal = self.mend(tokens, goals, 1, True)
                found = {goal} if cost <= 1 else found
            if found:
                return [], found
            tokens = kept
        last = tokens[-1].at + 1 if tokens else n
        for limit in range(1, (TOGETHER if most is None else most) + 1):
            cost, place, goal = self.mend(tokens, goals, limit)
            if cost <= limit:
                return [(cost, tokens[place].at, "") if place < len(tokens) else (cost, last, "end" if last > self.last else "")], {goal}
        if most is not None:
            return None, set()
        if len(tokens) > 1:
            half = len(tokens) // 2
            a, _ = self.searched(tokens[:half], goals, n) if not self.parse(tokens[:half], goals) else ([], None)
            b, found = self.searched(tokens[half:], goals, n) if not self.parse(tokens[half:], goals) else ([], set(goals))
            return a + b, found
        return [(max(1, sum(t.weight for t in tokens)), tokens[0].at if tokens else n, "")], set(goals)

    def fails(self, tokens: list[Token], goal: int) -> int:
        """The first token that continues no parse."""
        shape = self.shape(("fails", goal), tokens)
        found = self.known.get(shape)
        if found is None:
            found = self.known[shape] = self.grammar.chart([self.keys(t.key) for t in tokens], [t.line for t in tokens], [goal])[1]
        return found

    def mend(self, tokens, goals, limit, wild=False):
        """What the chart finds with up to ``limit`` edits; ``wild``: stray signs taken for tokens instead."""
        if wild:
            weights = [0 if t.key in WILD else limit + 1 for t in tokens]
            takes, insert = [1 if t.key in WILD else limit + 1 for t in tokens], limit + 1
        else:
            weights = takes = [min(t.weight, TOGETHER + 1) for t in tokens]
            insert = 1
        shape = self.shape((goals, limit, wild, *weights), tokens)
        found = self.known.get(shape)
        if found is None:
            text = [self.keys(t.key) for t in tokens], [t.line for t in tokens]
            found = self.grammar.repair(*text, list(goals), limit, weights, takes, insert)
            cost, place, goal = found
            if cost == 1 == limit and not wild and place:
                # not the first word: where the text stops to parse, if an edit there will do
                stop = self.fails(tokens, goal)
                if stop > place and self.grammar.repair(*text, [goal], 1, weights, takes, insert, stop)[0] == 1:
                    found = (1, stop, goal)
            self.known[shape] = found
        return found


def drift(signs: list[str], i: int, stack: list[str]) -> int:
    """Edits that the next brackets take if each that is open is closed where another one ends."""
    stack, cost = list(stack), 0
    for s in signs[i : i + AHEAD]:
        if s in CLOSING:
            stack.append(s)
        elif not any(CLOSING[x] == s for x in stack):
            cost += 1
        else:
            while CLOSING[stack.pop()] != s:
                cost += 1
    return cost + (len(stack) if i + AHEAD >= len(signs) else 0)


def kind_of(text: str, edits: list[tuple], flat: list[Token]) -> str:
    """What the places of the edits tell."""
    if any(what == "CONFLICT" for _, _, what in edits):
        return "conflict"
    if edits and all(what == "end" for _, _, what in edits):
        return "truncated"
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at)
    touched = {line(at) for _, at, what in edits if what != "end"}
    return "mismatch" if len(touched) * 2 >= len({line(t.at) for t in flat}) > 2 else "syntax"


class JavaScript(Language):
    def __init__(self, typescript: bool, jsx: bool, grammar: Grammar | None = None):
        super().__init__(
            grammar or Grammar(G.JAVASCRIPT, typescript), G.JAVASCRIPT_ROLES, G.JAVASCRIPT_ITEMS, G.JAVASCRIPT_KEYWORDS,
            _SPACE + r"|(?P<string>" + _STRING + r"|'(?:[^'\\\n]|\\.)*')|(?P<number>" + _NUMBER + r"n?)|(?P<name>[A-Za-z_$][\w$]*)|"
            + _punctuation("( ) [ ] { } ; , . ... ?. ? : => = == === != !== < <= >= > + - * / % ** ++ -- << <<= & | ^ ! ~ && || ?? += -= *= /= %= **= &= |= ^= &&= ||= ??= @ #"),
            kind="js",
        )
        self.jsx = jsx


_RUST = (
    r"(?P<space>[ \t\r\f\v﻿]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*)"
    r"|(?P<string>(?:br|cr|r)(?P<h>#*)\".*?\"(?P=h)|(?:b|c)?\"(?:[^\"\\]|\\.)*\")|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,6}\}|.)|[^'\\\n])')"
    r"|(?P<life>'[A-Za-z_]\w*)|(?P<number>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?)"
    r"|(?P<name>(?:r#)?[A-Za-z_]\w*)|"
)


class Rust(Language):
    def __init__(self):
        super().__init__(
            Grammar(G.RUST), G.RUST_ROLES, G.RUST_ITEMS, G.RUST_KEYWORDS,
            _RUST + _punctuation("( ) [ ] { } ; , . .. ... ..= :: : -> => = == != < <= >= > + - * / % & | ^ ! && || += -= *= /= %= &= |= ^= << <<= ? @ # $"),
            nested=True, kind="rust",
        )


class Solidity(Language):
    def __init__(self):
        super().__init__(
            Grammar(G.SOLIDITY), G.SOLIDITY_ROLES, G.SOLIDITY_ITEMS, G.SOLIDITY_KEYWORDS,
            _SPACE + r"|(?P<string>(?:hex|unicode)?(?:" + _STRING + r"))|(?P<number>" + _NUMBER + r")|(?P<name>[A-Za-z_$][\w$]*)|"
            + _punctuation("( ) [ ] { } ; , . ? : => = := == != < <= >= > + - * / % ** ++ -- << <<= & | ^ ! ~ && || += -= *= /= %= &= |= ^= ->"),
            kind="solidity",
        )


class C(Language):
    def __init__(self):
        super().__init__(
            Grammar(G.C), G.C_ROLES, G.C_ITEMS, G.C_KEYWORDS,
            r"(?P<directive>(?:(?<=\n)|(?<![\s\S])|(?<=﻿))[ \t]*#(?:[^\n\\]|\\.|\\\n)*)|(?P<space>(?:[ \t\r\f\v﻿]|\\\r?\n)+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)"
            r"|(?P<string>(?:L|u8|u|U)?\"(?:[^\"\\\n]|\\.)*\")|(?P<char>(?:L|u|U)?'(?:[^'\\\n]|\\.)+')"
            r"|(?P<number>(?:0[xX][0-9a-fA-F]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfF]*)|(?P<name>[A-Za-z_]\w*)|"
            + _punctuation("( ) [ ] { } ; , . ... -> ? : = == != < <= >= > + - * / % ++ -- << <<= >> >>= & | ^ ! ~ && || += -= *= /= %= &= |= ^="),
            kind="c",
        )


class Languages:
    """The languages by extension, built when first used."""

    @cached_property
    def by_extension(self) -> dict[str, Language]:
        c, js, ts = C(), JavaScript(False, True), JavaScript(True, False)
        tsx = JavaScript(True, True, ts.grammar)
        tsx.known = ts.known
        return {"ts": ts, "tsx": tsx, "js": js, "jsx": js, "rs": Rust(), "sol": Solidity(), "c": c, "h": c}


LANGUAGES = Languages()
EXTENSIONS = ("ts", "tsx", "js", "jsx", "rs", "sol", "c", "h")


def check(path: str, text: str) -> tuple[int, str, int]:
    """(edit cost, kind, offset of the first edit) of a file."""
    return LANGUAGES.by_extension[path.rsplit(".", 1)[-1]].check(text)


def syntax(files: DataFrame) -> DataFrame:
    """(project, file_path, language, cost, kind, offset) of every file of a known language."""
    extension = F.regexp_extract("file_path", r"\.(\w+)$", 1)
    files = files.select("project", "file_path", "content", extension.alias("language")).where(
        F.col("content").isNotNull() & F.col("language").isin(*EXTENSIONS)
    )

    def run(batches):
        gc.disable()  # charts are many small tuples, which hold no cycles
        for batch in batches:
            gc.collect()
            out = [
                (project, path, language, *check(path, text))
                for project, path, text, language in zip(batch["project"], batch["file_path"], batch["content"], batch["language"])
            ]
            yield pd.DataFrame(out, columns=["project", "file_path", "language", "cost", "kind", "offset"])

    return spread(files, "project", "file_path").mapInPandas(
        run, "project string, file_path string, language string, cost int, kind string, offset int"
    ).dropDuplicates(["project", "file_path"])


def rates(files: DataFrame) -> DataFrame:
    """(project, language, files, invalid, rate, edits) by project and language."""
    return syntax(files).groupBy("project", "language").agg(
        F.count("*").alias("files"), F.count_if(F.col("cost") > 0).alias("invalid"),
        F.avg((F.col("cost") > 0).cast("double")).alias("rate"), F.sum("cost").alias("edits"),
    )
