"""Minimum-cost repair of token strings, constituent by constituent.

A text is first turned into one sign per token. Its brackets are then reduced from the inside: the
content of each pair is one constituent, a flat string that is parsed
against every nonterminal the pair may stand for, and the pair is replaced by one sign that names the
set of nonterminals found at the least cost. That is a bottom-up chart whose cells are the bracketed
spans; equal strings share a cell, within a text and across the texts of a worker. Without their
brackets the right-hand sides are regular, so each is given as a pattern and compiled to
a position automaton. A string that no nonterminal derives is repaired: the same automaton runs at 0, 1,
2, ... edits side by side (insert, delete or change a token) up to ``MOST`` edits, where the cost of that constituent
is cut off and the result says so. Brackets without a partner are paired at least cost.

The sum is the least under the pairing of brackets that one pass from left to right makes; a group in the place of another
nonterminal, or too many, counts as one edit.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Edits beyond which the cost of one constituent is no longer told apart.
MOST = 4
CACHED = 200_000
PAREN, SQUARE, BRACE = 0xE000, 0xE100, 0xE200
OPEN, CLOSE = "([{", ")]}"
BROKEN = {"(": chr(PAREN), "[": chr(SQUARE), "{": chr(BRACE)}
_BRACKET = re.compile(r"[()\[\]{}]")
#: The bits of nonterminals that ``<p>``, ``<s>`` and ``<b>`` stand for; the others have to be named.
PLAIN = 63


class Automaton:
    """A position automaton for a pattern over token signs, made deterministic as strings need it."""

    def __init__(self, pattern: str) -> None:
        self.signs: list = [None]
        self.follow: list[int] = [0]
        nullable, first, last = self._build(_parser.parse(pattern))
        self.follow[0] = first
        self.final = last | (1 if nullable else 0)
        self._moves: dict[tuple[int, str], int] = {}
        self._masks: dict[str, int] = {}
        self._afters: dict[int, int] = {}

    def _leaf(self, test) -> tuple[bool, int, int]:
        self.signs.append(test)
        self.follow.append(0)
        bit = 1 << (len(self.signs) - 1)
        return False, bit, bit

    def _join(self, ends: int, first: int) -> None:
        while ends:
            low = ends & -ends
            self.follow[low.bit_length() - 1] |= first
            ends ^= low

    def _build(self, tree) -> tuple[bool, int, int]:
        tree = list(tree)
        if tree and tree[-1][0] is K.ASSERT:  # ``X(?=S)`` is a list of X with S between
            nullable, first, last = self._build(tree[:-1])
            gap, start, end = self._build(tree[-1][1][1])
            self._join(last, start | (first if gap else 0))
            self._join(end, first)
            return nullable, first, last
        nullable, first, last = True, 0, 0
        for op, arg in tree:
            n, f, z = self._node(op, arg)
            self._join(last, f)
            first |= f if nullable else 0
            last = z | (last if n else 0)
            nullable &= n
        return nullable, first, last

    def _node(self, op, arg) -> tuple[bool, int, int]:
        if op is K.LITERAL:
            return self._leaf(lambda c, a=arg: ord(c) == a)
        if op is K.NOT_LITERAL:
            return self._leaf(lambda c, a=arg: ord(c) != a)
        if op is K.ANY:
            return self._leaf(lambda c: True)
        if op is K.IN:
            negate = bool(arg) and arg[0][0] is K.NEGATE
            single = frozenset(v for o, v in arg if o is K.LITERAL)
            spans = tuple(v for o, v in arg if o is K.RANGE)
            return self._leaf(lambda c, one=single, s=spans, g=negate: (ord(c) in one or any(a <= ord(c) <= b for a, b in s)) != g)
        if op is K.SUBPATTERN:
            return self._build(arg[3])
        if op is K.BRANCH:
            nullable, first, last = False, 0, 0
            for part in arg[1]:
                n, f, z = self._build(part)
                nullable, first, last = nullable | n, first | f, last | z
            return nullable, first, last
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, part = arg
            parts = [*[("must", part)] * low]
            if high is K.MAXREPEAT:
                n, f, z = self._build(part)
                self._join(z, f)
                if not low:
                    return True, f, z
                nullable, first, last = True, 0, 0
                for _ in range(low - 1):
                    n1, f1, z1 = self._build(part)
                    self._join(last, f1)
                    first |= f1 if nullable else 0
                    last = z1 | (last if n1 else 0)
                    nullable &= n1
                self._join(last, f)
                return nullable & n, first | (f if nullable else 0), z | (last if n else 0)
            parts += [("may", part)] * (high - low)
            nullable, first, last = True, 0, 0
            for how, p in parts:
                n1, f1, z1 = self._build(p)
                n1 |= how == "may"
                self._join(last, f1)
                first |= f1 if nullable else 0
                last = z1 | (last if n1 else 0)
                nullable &= n1
            return nullable, first, last
        raise ValueError(f"unsupported in a grammar: {op}")

    def _after(self, states: int) -> int:
        out = self._afters.get(states)
        if out is None:
            if len(self._afters) > CACHED:
                self._afters.clear()
            out, left = 0, states
            while left:
                low = left & -left
                out |= self.follow[low.bit_length() - 1]
                left ^= low
            self._afters[states] = out
        return out

    def _mask(self, c: str) -> int:
        m = self._masks.get(c)
        if m is None:
            m = self._masks[c] = sum(1 << i for i, t in enumerate(self.signs) if t and t(c))
        return m

    def _step(self, states: int, c: str) -> int:
        got = self._moves.get((states, c))
        if got is None:
            if len(self._moves) > CACHED:
                self._moves.clear()
            got = self._moves[states, c] = self._after(states) & self._mask(c)
        return got

    def accepts(self, s: str) -> bool:
        states, moves = 1, self._moves
        for c in s:
            got = moves.get((states, c))
            states = self._step(states, c) if got is None else got
            if not states:
                return False
        return bool(states & self.final)

    def repair(self, s: str, most: int = MOST) -> tuple[int, int]:
        """Least edits that make ``s`` acceptable, ``most`` + 1 if more are needed, and where the first one falls."""
        row = [1]
        for _ in range(most):
            row.append(row[-1] | self._after(row[-1]))
        at = len(s)
        for i, c in enumerate(s):
            if at == len(s) and not self._step(row[0], c):
                at = i
            new = [self._step(row[0], c)]
            for k in range(1, most + 1):
                new.append(self._step(row[k], c) | row[k - 1] | self._after(row[k - 1]) | self._after(new[k - 1]))
            row = new
        return next((k for k in range(most + 1) if row[k] & self.final), most + 1), at


def pairing_cost(signs: str, most: int = MOST) -> int:
    """Least bracket edits (insert, delete or change one) that balance ``signs``; ``most`` + 1 if more are needed.

    A pass over the brackets stops at the first that does not fit and tries every edit there, so it takes a bounded number of passes.
    """
    known: dict[tuple[str, int], int] = {}

    def least(s: str, left: int) -> int:
        s = _stripped(s)
        closers = 0
        depth = 0
        for c in s:
            if c in OPEN:
                depth += 1
            elif depth:
                depth -= 1
            else:
                closers += 1
        bound = (closers + 1) // 2 + (depth + 1) // 2
        if bound > left or not s:
            return bound
        if (s, left) in known:
            return known[s, left]
        at = next((i for i, c in enumerate(s) if c in CLOSE), len(s))
        if at == len(s) or all(c in CLOSE for c in s):
            return (len(s) + 1) // 2
        tries = [s[:at] + s[at + 1 :], *(s[:at] + c + s[at + 1 :] for c in OPEN)]
        if at:
            tries += [s[: at - 1] + s[at + 1 :], s[: at - 1] + s[at:]]
        if at > 1:
            tries.append(s[: at - 2] + s[at:])
        best = left + 1
        for t in tries:
            best = min(best, 1 + least(t, min(left, best - 1) - 1))
        known[s, left] = best
        return best

    return min(least(signs, most), most + 1)


def _stripped(signs: str) -> str:
    """``signs`` without the pairs that fit, in one pass."""
    kept: list[str] = []
    for c in signs:
        if kept and c in CLOSE and kept[-1] == OPEN[CLOSE.index(c)]:
            kept.pop()
        else:
            kept.append(c)
    return "".join(kept)


class Grammar:
    """Nonterminals of the three kinds of brackets and of the whole text.

    ``rules`` maps "(", "[", "{" to lists of (bit, pattern) and "top" to a pattern. In
    patterns a capturing group ``(X(?=S))`` is one or more X with S between, and ``<xN>`` with x of p, s, b stands for a round, square or curly group that can be nonterminal N (a bit below 256), ``<x>`` for
    any such group that can be one of the ``PLAIN`` nonterminals; ``end`` is a sign put behind the content of curly brackets and
    the whole text.
    """

    def __init__(self, rules: dict) -> None:
        def expand(p: str) -> str:
            def sub(m: re.Match) -> str:
                base = {"p": PAREN, "s": SQUARE, "b": BRACE}[m[1]]
                bit = int(m[2] or 0)
                return "[" + "".join(chr(base + k) for k in range(1, 256) if k & (bit or PLAIN)) + "]"

            return re.sub(r"<([psb])(\d*)>", sub, p)

        self.end = rules.get("end", "")
        self.rules = {k: [(bit, Automaton(expand(p))) for bit, p in v] for k, v in rules.items() if k in OPEN}
        self.top = Automaton(expand(rules["top"])) if "top" in rules else None
        self._cells: dict[str, tuple[str, int]] = {}

    def cell(self, span: str) -> tuple[str, int]:
        """The sign of one bracketed span and its repair cost."""
        got = self._cells.get(span)
        if got is None:
            if len(self._cells) > CACHED:
                self._cells.clear()
            kind, inner = span[0], span[1:-1]
            rules, cost = self.rules[kind], 0
            if kind == "{":
                inner += self.end
            mask = sum(bit for bit, a in rules if a.accepts(inner))
            base = ord(BROKEN[kind])
            if not mask:
                tries = [(a.repair(inner)[0], bit) for bit, a in rules]
                cost = min(c for c, _ in tries)
                mask = sum(bit for c, bit in tries if c == cost)
            got = self._cells[span] = chr(base + mask), cost
        return got

    def reduce(self, signs: str) -> tuple[str, int, bool, bool]:
        """``signs`` with every pair of brackets replaced by its group's sign, the cost of all groups, whether it is exact and whether brackets stay open at the end.

        One pass with a stack. A closing bracket that does not fit closes the nearest that does, if there is one; brackets without a
        partner are left out and cost what ``pairing_cost`` says.
        """
        cost, exact, loose = 0, True, False
        out: list[str] = []
        stack: list[tuple[str, list[str]]] = []
        pos = 0
        for m in _BRACKET.finditer(signs):
            at, c = m.start(), m[0]
            if at > pos:
                out.append(signs[pos:at])
            pos = at + 1
            if c in OPEN:
                stack.append((c, out))
                out = []
                continue
            opener = OPEN[CLOSE.index(c)]
            if not stack or stack[-1][0] != opener:
                loose = True
                if not any(o == opener for o, _ in stack[-8:]):
                    continue
                while stack[-1][0] != opener:
                    _, before = stack.pop()
                    before += out
                    out = before
            _, before = stack.pop()
            sign, extra = self.cell(f"{opener}{''.join(out)}{c}")
            cost += extra
            exact &= extra <= MOST
            before.append(sign)
            out = before
        out.append(signs[pos:])
        still_open = bool(stack) and not loose
        if stack:
            loose = True
            out = [piece for _, before in stack for piece in before] + out
        if loose:
            extra = pairing_cost("".join(_BRACKET.findall(signs)))
            cost += extra
            exact &= extra <= MOST
        return "".join(out), cost, exact, still_open
