"""Secret scans with one deterministic automaton for all rules.

Every rule is a regular expression. They are parsed together into one nondeterministic
automaton over bytes; subset construction and minimisation turn it into transition arrays,
and one pass over a text's UTF-8 bytes runs all rules at once. Where the automaton accepts
for a rule, that rule's reversed automaton finds the leftmost start and its forward
automaton the longest end. Where that start lies in the match before, the rule's own
automaton goes on from that match's end until it accepts. The time is linear in the text. Rules need to be such
that a match which starts first also accepts first; those below are.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _parser as regex_parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, its least length, and the least length of what follows ``:`` or ``=``."""

    kind: str
    pattern: str
    least: int = 1
    least_value: int = 0

    def holds(self, found: bytes) -> bool:
        if len(found) < self.least:
            return False
        if not self.least_value:
            return True
        at = re.search(rb"[:=]\x20*[\"']?", found)
        return at is not None and len(found) - at.end() >= self.least_value


# The three base kinds, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", least_value=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{6,}", least=24),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class Nfa:
    """Byte edges and empty edges between numbered states."""

    def __init__(self):
        self.edges: list[tuple[int, frozenset, int]] = []
        self.empty: list[tuple[int, int]] = []
        self.count = 0

    def state(self) -> int:
        self.count += 1
        return self.count - 1

    def add(self, pattern: str) -> tuple[int, int]:
        return self._sequence(regex_parser.parse(pattern), False)

    def _sequence(self, items, fold: bool) -> tuple[int, int]:
        first = last = self.state()
        for op, arg in items:
            a, b = self._item(str(op), arg, fold)
            self.empty.append((last, a))
            last = b
        return first, last

    def _item(self, op: str, arg, fold: bool) -> tuple[int, int]:
        if op == "SUBPATTERN":
            return self._sequence(arg[3], fold or bool(arg[1] & re.IGNORECASE))
        a, b = self.state(), self.state()
        if op == "BRANCH":
            for option in arg[1]:
                x, y = self._sequence(option, fold)
                self.empty += [(a, x), (y, b)]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            at = a
            for _ in range(low):
                x, y = self._sequence(inner, fold)
                self.empty.append((at, x))
                at = y
            if high == regex_parser.MAXREPEAT:
                x, y = self._sequence(inner, fold)
                self.empty += [(at, x), (y, at)]
            else:
                for _ in range(high - low):
                    x, y = self._sequence(inner, fold)
                    self.empty += [(at, x), (at, b)]
                    at = y
            self.empty.append((at, b))
        elif op in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            self.edges.append((a, self._bytes(op, arg, fold), b))
        else:
            raise ValueError(f"a rule uses {op}, which has no automaton here")
        return a, b

    @staticmethod
    def _bytes(op: str, arg, fold: bool) -> frozenset:
        if op == "ANY":
            return frozenset(range(256)) - {10}
        found: set[int] = set()
        parts = [(op.removeprefix("NOT_"), arg)] if op != "IN" else [(str(k), v) for k, v in arg]
        for kind, value in parts:
            if kind == "LITERAL":
                found.add(value)
            elif kind == "RANGE":
                found.update(range(value[0], value[1] + 1))
            elif kind != "NEGATE":
                raise ValueError(f"a class holds {kind}, which has no automaton here")
        if fold:
            found |= {ord(chr(x).swapcase()) for x in found if x < 128 and chr(x).isalpha()}
        return frozenset(range(256)) - found if op == "NOT_LITERAL" or parts[0][0] == "NEGATE" else frozenset(found)


@dataclass
class Dfa:
    """``step[state * width + byte class]`` is the next state times ``width``; states from ``accepting`` on accept ``labels[state]``."""

    classes: bytes
    width: int
    step: list
    start: int
    accepting: int
    labels: list
    dead: int


def determinise(nfa: Nfa, starts: Sequence[int], accepts: dict[int, int], everywhere: bool, backwards: bool = False) -> Dfa:
    """Subset construction. ``everywhere``: a match may start at any byte; ``accepts``: label of an accepting state."""
    edges = [(v, s, u) for u, s, v in nfa.edges] if backwards else nfa.edges
    empty: dict[int, list[int]] = {}
    for u, v in nfa.empty:
        empty.setdefault(v if backwards else u, []).append(u if backwards else v)
    # bytes that no edge tells apart share a class
    sets = list({s for _, s, _ in edges})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    numbers = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    classes = bytes(numbers[sig] for sig in signature)
    width = len(numbers)
    of_set = {s: sorted({classes[b] for b in s}) for s in sets}
    out: dict[int, list] = {}
    for u, s, v in edges:
        out.setdefault(u, []).append((of_set[s], v))

    @lru_cache(None)
    def closure(state: int) -> frozenset:
        seen, todo = {state}, [state]
        while todo:
            for v in empty.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return frozenset(x for x in seen if x in out or x in accepts)

    begin = frozenset().union(*(closure(s) for s in starts))
    number, todo, rows = {begin: 0}, [begin], []
    while todo:
        here = todo.pop(0)
        reach: list[set] = [set(begin) if everywhere else set() for _ in range(width)]
        for u in here:
            for cs, v in out.get(u, ()):
                for c in cs:
                    reach[c] |= closure(v)
        row = []
        for r in reach:
            key = frozenset(r)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
        rows.append(row)
    labels = [tuple(sorted({accepts[x] for x in key if x in accepts})) for key in number]
    return _minimise(np.array(rows), labels, classes, width)


def _minimise(step: np.ndarray, labels: list, classes: bytes, width: int) -> Dfa:
    """Partition refinement: split classes of states until all of a class step to the same classes."""
    kinds = {k: i for i, k in enumerate(dict.fromkeys(labels))}
    part = np.array([kinds[x] for x in labels])
    while True:
        _, new = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == part.max():
            break
        part = new
    n = int(part.max()) + 1
    one = np.array([np.flatnonzero(part == p)[0] for p in range(n)])
    # states that accept come last, so that one comparison finds them
    order = sorted(range(n), key=lambda p: (bool(labels[one[p]]), p != part[0], p))
    place = np.empty(n, int)
    place[order] = np.arange(n)
    rows = place[part[step[one[order]]]]
    final = [labels[one[p]] for p in order]
    dead = next((i for i in range(n) if not final[i] and (rows[i] == i).all()), -1)
    return Dfa(classes, width, (rows * width).ravel().tolist(), int(place[part[0]]) * width, sum(not x for x in final) * width, final, dead * width)


class Scanner:
    """Finds the spans of all rules in a text."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = tuple(rules)
        nfa, ends, starts = Nfa(), {}, []
        for i, rule in enumerate(self.rules):
            a, b = nfa.add(rule.pattern)
            starts.append(a)
            ends[b] = i
        self.all = determinise(nfa, starts, ends, everywhere=True)
        self.forward, self.back, self.search = [], [], []
        for rule in self.rules:
            own = Nfa()
            a, b = own.add(rule.pattern)
            self.forward.append(determinise(own, [a], {b: 0}, everywhere=False))
            self.back.append(determinise(own, [b], {a: 0}, everywhere=False, backwards=True))
            self.search.append(determinise(own, [a], {b: 0}, everywhere=True))

    @staticmethod
    def _longest(dfa: Dfa, data) -> int:
        """Bytes of ``data`` that the longest accepted prefix has; -1 for none."""
        state, best = dfa.start, 0 if dfa.start >= dfa.accepting else -1
        for i, b in enumerate(data, 1):
            state = dfa.step[state + dfa.classes[b]]
            if state >= dfa.accepting:
                best = i
            elif state == dfa.dead:
                break
        return best

    def _catches_up(self, r: int, view: memoryview, behind: dict, end: int) -> bool:
        """Whether the rule's own automaton, moved on to ``end``, accepts there."""
        dfa = self.search[r]
        at, state = behind[r]
        for b in view[at:end]:
            state = dfa.step[state + dfa.classes[b]]
        behind[r] = end, state
        return state >= dfa.accepting

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of kept matches: for each rule leftmost, without overlaps; those too short are dropped."""
        dfa = self.all
        step, accepting, labels, width, n = dfa.step, dfa.accepting, dfa.labels, dfa.width, len(data)
        view = memoryview(data)
        last, found = [0] * len(self.rules), []
        behind: dict[int, tuple[int, int]] = {}  # of rules whose accepted match starts in the one before: how far their own automaton is, and its state
        state, it = dfa.start, iter(data.translate(dfa.classes.ljust(256, b"\0")))
        for c in it:
            state = step[state + c]
            if state >= accepting:
                end = n - operator.length_hint(it)
                for r in labels[state // width]:
                    if end <= last[r]:
                        continue
                    if r in behind and not self._catches_up(r, view, behind, end):
                        continue
                    length = self._longest(self.back[r], view[last[r] : end][::-1])
                    if length < 0:
                        behind[r] = last[r], self.search[r].start
                        self._catches_up(r, view, behind, end)
                        continue
                    start = end - length
                    stop = start + self._longest(self.forward[r], view[start:])
                    last[r] = stop
                    behind.pop(r, None)
                    if self.rules[r].holds(data[start:stop]):
                        found.append((start, r, stop))
        return sorted(found)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive, by start and then rule."""
        data = (text or "").encode()
        found = self.byte_spans(data)
        if len(data) == len(text or ""):
            return [(self.rules[r].kind, a, b) for a, r, b in found]
        at = {x: 0 for a, _, b in found for x in (a, b)}
        done = count = 0
        for x in sorted(at):
            count += len(data[done:x].decode())
            done, at[x] = x, count
        return [(self.rules[r].kind, at[a], at[b]) for a, r, b in found]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@lru_cache(4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan_secrets(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, out: str = "spans") -> DataFrame:
    """Append ``out``: all spans of ``rules`` in the whole text, as kind, start, end (code points).

    Null and empty texts have no spans. Repeated rows are scanned each. A column named
    ``out`` is replaced.
    """
    rules = tuple(rules)
    small_batches(df.sparkSession)

    def make() -> Callable:
        scanner = _scanner(rules)
        return lambda texts: [[[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t)] for t in texts]]

    return append_columns(df, text_col, T.StructType([T.StructField(out, SPANS)]), make)


def redact_spans(text_col: str, spans_col: str, mask: str = "[secret]"):
    """A column: the text with every span (overlapping ones together) replaced by ``mask``. Built-in functions only."""
    spans = F.coalesce(F.col(spans_col), F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    text = F.col(text_col)
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
            .otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
