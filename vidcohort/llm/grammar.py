"""Re-Pair rules over short sequences, and min-plus transfer matrices with audit ropes for them.

Plain helpers of ``convrepair``: what a task does with the sequences that Spark sends to it.
"""

from __future__ import annotations

from collections import Counter

#: Classes of role initials, faults in the order in which they count, and one letter for each of their pairs.
ROLES, FAULTS = "sua-", ("fine", "blank", "duplicate", "truncated")
LETTERS = "ABCDEFGHIJKLMNOP"
#: Rows that must go are alike to the repair, whatever their role.
GONE = "X"
#: Rules get the characters from here on.
FIRST_RULE = 0x4E00
#: States: nothing yet, after system, after user, after assistant. Where each role leads; the first and last accept.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "-": {}}
STATES, ACCEPTING = 4, (0, 3)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
_LEAF, _BASE, _PRIME = 32, 0x5DEECE66D, (1 << 61) - 1


def letter(role: str, fault: str) -> str:
    return LETTERS[ROLES.index(role if role and role in "sua" else "-") * 4 + FAULTS.index(fault)]


ROLE_OF = {x: ROLES[i // 4] for i, x in enumerate(LETTERS)}
FAULT_OF = {x: FAULTS[i % 4] for i, x in enumerate(LETTERS)}
#: To the sequence that decides the repair.
CANON = str.maketrans({x: GONE for x in LETTERS if FAULT_OF[x] in ("blank", "duplicate")})


class Rope:
    """A string as a tree whose parts are shared; its length and hash are those of the whole."""

    __slots__ = ("n", "hash", "left", "right", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text, self.hash = left, right, text, None
        self.n = len(text) if left is None else left.n + right.n
        if left is not None:
            self.hash = (left.value() * pow(_BASE, right.n, _PRIME) + right.value()) % _PRIME

    def value(self) -> int:
        if self.hash is None:  # a leaf that no node has held yet
            self.hash = 0
            for c in self.text:
                self.hash = (self.hash * _BASE + ord(c)) % _PRIME
        return self.hash

    def __add__(self, other: Rope) -> Rope:
        if not self.n or not other.n:
            return self if self.n else other
        if self.n + other.n <= _LEAF:
            return Rope(self.text + other.text)
        return Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.text)
            else:
                todo += [x.right, x.left]
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """By characters; equal parts are passed over by length and hash."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y:
                continue
            if x.left is None and y.left is None:
                k = min(x.n, y.n)
                if x.text[:k] != y.text[:k]:
                    return x.text < y.text
                if x.n > k:
                    a.append(Rope(x.text[k:]))
                if y.n > k:
                    b.append(Rope(y.text[k:]))
            elif x.n == y.n and x.value() == y.value():
                continue
            elif y.left is None or x.left is not None and x.n >= y.n:
                a += [x.right, x.left]
                b.append(y)
            else:
                b += [y.right, y.left]
                a.append(x)
        return bool(b) and not a


#: A matrix is a dict from (state, state) to the least (cost, audit).
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def put(m: Matrix, at: tuple[int, int], cost: int, audit: Rope) -> None:
    """Lower costs win, then the audit that is less in ASCII.

    Among audits of equal cost over the same rows none starts with another (more insertions cost more), so the lesser
    one stays the lesser one whatever is put before or behind it.
    """
    if at not in m or cost < m[at][0] or cost == m[at][0] and audit < m[at][1]:
        m[at] = (cost, audit)


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, m), (c, x) in a.items():
        for q in range(STATES):
            if (other := b.get((m, q))) is not None and ((p, q) not in out or c + other[0] <= out[p, q][0]):
                put(out, (p, q), c + other[0], x + other[1])
    return out


def insertions() -> Matrix:
    """No, one or two inserted messages; more of them only cost more."""
    none = {(p, p): (0, Rope()) for p in range(STATES)}
    one: Matrix = {(p, STEP[r][p]): (INSERT, Rope("I")) for r in "ua" for p in STEP[r]}
    both = dict(none)
    for step in (one, times(one, one)):
        for at, (c, x) in step.items():
            put(both, at, c, x)
    return both


def edits(x: str) -> Matrix:
    """What can be done with one row: insertions before it, then one edit."""
    out: Matrix = {(p, p): (DELETE, Rope("D")) for p in range(STATES)}
    if x != GONE:
        more = FAULT_OF[x] == "truncated"
        for r, cost, name in ((ROLE_OF[x], KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            for p, q in STEP[r].items():
                put(out, (p, q), cost + more, Rope(name))
    return times(insertions(), out)


def pack(rules: list[tuple[str, str]], sequence: str) -> str:
    for pair, made in rules:
        sequence = sequence.replace(pair, made)
    return sequence


class Grammar:
    """Rules (pair, character), each made of letters and earlier rules; one matrix for each, made once from the two before."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrix = {x: edits(x) for x in {*LETTERS.translate(CANON), GONE}}
        for (a, b), made in rules:
            self.matrix[made] = times(self.matrix[a], self.matrix[b])
        self.end = insertions()

    def repair(self, sequence: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair: the matrices of the packed sequence, multiplied as a balanced tree."""
        row = [self.matrix[x] for x in pack(self.rules, sequence)] + [self.end]
        while len(row) > 1:
            row = [times(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        best: Matrix = {}
        for q in ACCEPTING:
            if (0, q) in row[0]:
                put(best, (0, 0), *row[0][0, q])
        cost, audit = best[0, 0]
        return cost, str(audit)


def pairs(packed: str) -> Counter:
    return Counter(map("".join, zip(packed, packed[1:])))


def choose(counts: list[tuple[str, int]], most: int) -> list[str]:
    """The commonest pairs of which no two can overlap: no character is the first of one and the second of another."""
    out, firsts, seconds = [], set(), set()
    for pair, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        a, b = pair
        if n < 2 or len(out) >= most:
            break
        if a in seconds or b in firsts or (a == b and (a in firsts or b in seconds)):
            continue
        out.append(pair)
        firsts.add(a)
        seconds.add(b)
    return out
