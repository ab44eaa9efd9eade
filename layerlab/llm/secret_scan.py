"""5. Secret scan: all rules in one deterministic automaton, one pass over the bytes.

Rules are compiled to one non-deterministic automaton, which subset construction
and minimisation turn into a transition array over bytes. One pass tells where a
match of any rule ends. An automaton of the reversed rule then finds the leftmost
start of each longest match, not before the end of the match before. A rule's
`check` looks at the matched bytes and may drop the match, which is spent all the
same. All patterns are ASCII, so UTF-8 bytes are scanned; offsets are turned into
code points for the few matches.

A rule fits this scan when, from the first end of a match on, every further byte
of the longest match is an end as well (as for all rules that close with a run).

Defined results: a null text is empty and has no spans; repeated rows are scanned
each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from layerlab.llm.common import as_bytes, documents, map_batches

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

# ---- patterns: ("set", bytes) | ("seq", parts) | ("any", parts) | ("many", part) -------


def one_of(chars: str) -> tuple:
    return ("set", frozenset(chars.encode()))


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def either(*parts: tuple) -> tuple:
    return ("any", parts)


def maybe(part: tuple) -> tuple:
    return ("any", (part, ("seq", ())))


def many(part: tuple, least: int = 0) -> tuple:
    """The part `least` times or more."""
    return ("seq", (*[part] * least, ("many", part)))


def word(text: str, any_case: bool = False) -> tuple:
    return ("seq", tuple(one_of(c.lower() + c.upper() if any_case else c) for c in text))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: tuple
    check: Callable[[bytes], bool] = lambda match: True


_VALUE = one_of(UPPER + LOWER + DIGITS + "+/_.=-")
_SPACES, _QUOTE = many(one_of(" ")), maybe(one_of("\"'"))
_ASSIGNED = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
_NAME = one_of(UPPER + LOWER + DIGITS)
_DASHED, _DOTTED = one_of(UPPER + LOWER + DIGITS + "-"), one_of(UPPER + LOWER + DIGITS + "_.-")

#: in the order in which kinds with the same start are listed
BASE_RULES = (
    Rule(
        "assign",
        seq(
            either(
                *(word(w, True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
            ),
            _QUOTE, _SPACES, one_of(":="), _SPACES, _QUOTE, many(_VALUE, 1),
        ),
        lambda m: len(_ASSIGNED.fullmatch(m)[1]) >= 12,
    ),
    Rule("access", seq(word("AKIA"), many(one_of(UPPER + DIGITS), 1)), lambda m: len(m) >= 18),
    Rule("hex", many(one_of(DIGITS + "abcdef"), 16)),
)
# open runs with a check keep the automaton small: counted runs multiply its states
MORE_RULES = (
    Rule("github", seq(word("gh"), one_of("oprsu"), word("_"), many(_NAME, 1)), lambda m: len(m) >= 40),
    Rule("slack", seq(word("xox"), one_of("abprs"), word("-"), many(_DASHED, 1)), lambda m: len(m) >= 15),
    Rule("jwt", seq(word("eyJ"), many(_DOTTED, 1)), lambda m: all(p := m.split(b".")) and len(p) == 3),
    Rule("pem", seq(word("-----BEGIN "), many(one_of(UPPER + " ")), word("PRIVATE KEY-----"))),
)

# ---- automata ------------------------------------------------------------------------


@dataclass
class Nfa:
    empty: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: tuple, start: int, backwards: bool) -> int:
        """Build `pattern` from `start`; returns where it ends."""
        kind, value = pattern
        if kind == "set":
            end = self.state()
            self.moves[start].append((value, end))
            return end
        if kind == "seq":
            for part in reversed(value) if backwards else value:
                start = self.add(part, start, backwards)
            return start
        if kind == "many":
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(value, loop, backwards)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for part in value:
            first = self.state()
            self.empty[start].append(first)
            self.empty[self.add(part, first, backwards)].append(end)
        return end

    def reach(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton: next state by 256 * state + byte.

    `accepts[state]` are the rules with a match that ends there. States are
    numbered so that the accepting ones come last; `floor` is 256 * the first.
    """

    def __init__(self, patterns: Iterable[tuple], anywhere: bool, backwards: bool = False):
        nfa, ends = Nfa(), {}
        root = nfa.state()
        for k, pattern in enumerate(patterns):
            first = nfa.state()
            nfa.empty[root].append(first)
            ends[nfa.add(pattern, first, backwards)] = k
        kinds, classes = self._classes(nfa)
        start = nfa.reach([root])
        numbers, todo, table, accepts = {start: 0}, [start], [], []
        while todo:  # subset construction
            states = todo.pop(0)
            accepts.append(frozenset(ends[s] for s in states if s in ends))
            to: list[set] = [set(start) if anywhere else set() for _ in kinds]
            for s in states:
                for chars, t in nfa.moves[s]:
                    for c in {classes[b] for b in chars}:
                        to[c].add(t)
            row = []
            for targets in to:
                key = nfa.reach(targets)
                if key not in numbers:
                    numbers[key] = len(numbers)
                    todo.append(key)
                row.append(numbers[key])
            table.append(row)
        self._minimise(np.array(table, np.int32), accepts, np.array(classes))

    @staticmethod
    def _classes(nfa: Nfa) -> tuple[list, list[int]]:
        """Bytes that no set tells apart share a class."""
        sets = list({chars for moves in nfa.moves for chars, _ in moves})
        marks = [tuple(b in s for s in sets) for b in range(256)]
        kinds = sorted(set(marks))
        return kinds, [kinds.index(m) for m in marks]

    def _minimise(self, table: np.ndarray, accepts: list[frozenset], classes: np.ndarray) -> None:
        """Refine the partition by accepted rules until moves agree with it."""
        order = sorted(set(accepts), key=lambda a: (len(a) > 0, sorted(a)))
        part = np.array([order.index(a) for a in accepts])
        while True:
            marks = np.column_stack([part, part[table]])
            _, finer = np.unique(marks, axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        accepting = np.array([len(a) > 0 for a in accepts])
        blocks, first = np.unique(part, return_index=True)
        rank = np.argsort(np.argsort(accepting[first], kind="stable"))  # accepting ones last
        part = rank[np.searchsorted(blocks, part)]
        states = np.empty(len(blocks), np.int64)
        states[part] = np.arange(len(part))
        full = part[table[states]][:, classes]
        self.start = int(part[0]) * 256
        self.accepts = [sorted(accepts[s]) for s in states]
        states = [256 * k for k in range(len(states))]  # one number object for each state
        self.moves = [states[k] for k in full.reshape(-1).tolist()]
        self.floor = 256 * sum(not a for a in self.accepts)
        #: a state that accepts nothing and never leaves
        stuck = [k for k in range(len(states)) if (full[k] == k).all() and not self.accepts[k]]
        self.dead = stuck[0] * 256 if stuck else -1


class Scanner:
    """The combined automaton of all rules and the reversed one of each."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.kinds = [r.kind for r in rules]
        self.forward = Automaton([r.pattern for r in rules], anywhere=True)
        self.back = [Automaton([r.pattern], anywhere=False, backwards=True) for r in rules]

    def ends(self, text: bytes) -> list[tuple[int, int]]:
        """(end, state) wherever a match of some rule ends."""
        state, moves, floor = self.forward.start, self.forward.moves, self.forward.floor
        out = []
        for at, byte in enumerate(text, 1):
            state = moves[state + byte]
            if state >= floor:
                out.append((at, state))
        return out

    def first_start(self, rule: int, text: bytes, end: int, floor: int) -> int | None:
        auto, found = self.back[rule], None
        state, moves = auto.start, auto.moves
        for at in range(end - 1, floor - 1, -1):
            state = moves[state + text[at]]
            if state >= auto.floor:
                found = at
            elif state == auto.dead:
                break
        return found

    def spans(self, text: bytes, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, ordered."""
        ends: dict[int, list[int]] = {}
        for at, state in self.ends(text):
            for rule in self.forward.accepts[state >> 8]:
                own = ends.setdefault(rule, [])
                if own and own[-1] == at - 1:
                    own[-1] = at  # the match goes on
                else:
                    own.append(at)
        out = []
        for rule, own in ends.items():
            floor = 0
            for end in own:
                start = self.first_start(rule, text, end, floor)
                if start is not None:
                    floor = end
                    if rules[rule].check(text[start:end]):
                        out.append((start, rule, end))
        return sorted(out)


def _in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    places, count, last = {}, 0, 0
    for at in sorted({x for s in spans for x in (s[0], s[2])}):
        count += len(text[last:at].decode())
        places[at] = count
        last = at
    return [(places[s], r, places[e]) for s, r, e in spans]


def secret_spans(
    docs: DataFrame,
    rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, spans): array of (kind, start, end), code points, end exclusive.

    Ordered by start, then by the order of the rules.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for text in as_bytes(batch.column("text")):
            spans = scanner.value.spans(text, rules)
            found.append(
                [
                    {"kind": kinds[r], "start": s, "end": e}
                    for s, r, e in _in_code_points(text, spans)
                ]
                if spans
                else []
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.list_(span))], names=["doc_id", "spans"]
        )

    rows = documents(docs, id_col, text_col).select("doc_id", "text")
    return map_batches(rows, scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
