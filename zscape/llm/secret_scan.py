"""Secret scans with one combined automaton.

The rules are regular expressions over bytes. Read from right to left, they make one
non-deterministic automaton that may begin a match anywhere; subset construction turns it into a
deterministic one and partition refinement makes that minimal. Its transition array is walked once,
a step for each byte of the UTF-8 text, and names every byte at which some rule's match begins. From
the leftmost start that is not yet covered, the rule's own minimal automaton runs forwards to the
longest end: leftmost, longest, non-overlapping matches for each rule. A private key goes from its
header to its END line, or over the base64 lines that are there if the END line is not.

Matches that fail a rule's least length are dropped and stay consumed. Null and empty texts have no
match; texts are read whole; repeated rows get equal results; an empty table gives no rows; other
columns are kept apart and never read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces


@dataclass(frozen=True)
class Rule:
    """``pattern`` over bytes; a match counts if it is long enough.

    ``least`` bytes: of the whole match, or, with ``after``, of what follows the first of its bytes,
    spaces and one quote. ``tail`` extends a match of ``pattern`` where it fits; it is optional, so
    it changes where a match ends but not where it begins.
    """

    kind: str
    pattern: str
    tail: str | None = None
    least: int = 1
    after: str | None = None
    any_case: bool = False
    base: bool = True


#: What follows a PEM header: anything up to its END line (five dashes end it otherwise), or where that
#: line is cut off the base64 lines of 16 characters or more, the encryption headers before them and a
#: last shorter line.
_GAP, _B64 = r"([\x20\x09\x0d\x0a\"',>]|\\[nr])", r"[A-Za-z0-9+/=]"
PEM_TAIL = (
    r"((-{0,4}[\x00-\x2c\x2e-\xff])*-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"
    rf"|({_GAP}+(Proc-Type|DEK-Info):[\x20-\x7e]*)*({_GAP}*{_B64}{{16,}})+({_GAP}+{_B64}+)?)"
)
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
RULES = (
    Rule("assign", ASSIGN, least=6, after=r":=", any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", tail=PEM_TAIL, base=False),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", least=40, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40, base=False),
)


class Nfa:
    """Thompson's automaton: ``steps[s]`` has (bytes, target) pairs, ``free[s]`` targets without a byte."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, node: tuple, start: int, backwards: bool) -> int:
        """Adds ``node`` behind ``start``; the state in which it ends."""
        kind = node[0]
        if kind == "bytes":
            end = self.state()
            self.steps[start].append((node[1], end))
        elif kind == "all":
            end = start
            for part in reversed(node[1]) if backwards else node[1]:
                end = self.add(part, end, backwards)
        elif kind == "any":
            end = self.state()
            for part in node[1]:
                self.free[self.add(part, start, backwards)].append(end)
        else:
            _, part, low, high = node
            end = start
            for _ in range(low):
                end = self.add(part, end, backwards)
            if high is None:
                loop = self.state()
                self.free[end].append(loop)
                self.free[self.add(part, loop, backwards)].append(loop)
                end = loop
            else:
                last = self.state()
                for _ in range(high - low):
                    self.free[end].append(last)
                    end = self.add(part, end, backwards)
                self.free[end].append(last)
                end = last
        return end


def parse(pattern: str, any_case: bool = False) -> tuple:
    """Literals, ``\\xNN``, classes, groups, ``|``, and ``? * + {m} {m,} {m,n}``."""
    at = 0

    def one(b: int) -> frozenset[int]:
        return frozenset({b, ord(chr(b).swapcase())} if any_case and chr(b).isalpha() else {b})

    def escaped() -> int:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord(pattern[at - 1])

    def byte() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escaped()
        at += 1
        return ord(pattern[at - 1])

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            members: set[int] = set()
            while pattern[at] != "]":
                low = high = byte()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = byte()
                members |= set().union(*(one(b) for b in range(low, high + 1)))
            at += 1
            return "bytes", frozenset(members)
        return "bytes", one(byte())

    def repeated() -> tuple:
        nonlocal at
        node = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                stop = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : stop].partition(",")
                node = ("times", node, int(low), int(high) if high else None if comma else int(low))
                at = stop + 1
            else:
                node = ("times", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]])
                at += 1
        return node

    def either() -> tuple:
        nonlocal at
        options = [[]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                options.append([])
            else:
                options[-1].append(repeated())
        nodes = [("all", x) for x in options]
        return nodes[0] if len(nodes) == 1 else ("any", nodes)

    return either()


@dataclass
class Dfa:
    """``table[state + column]`` is the next state, where ``columns[byte]`` is a byte's column.

    A state is numbered by its offset in the table, a multiple of ``width``; ``accepts`` has a bit
    for each rule that a state accepts. States from ``first`` on accept, and no way leads from
    ``dead`` to a match.
    """

    table: list[int]
    columns: bytes
    width: int
    accepts: list[int]
    first: int
    start: int
    dead: int


def compiled(rules: list[Rule], backwards: bool, anywhere: bool) -> Dfa:
    nfa = Nfa()
    root = nfa.state()
    ends = {nfa.add(parse(r.pattern, r.any_case), root, backwards): i for i, r in enumerate(rules)}

    def closed(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    # bytes that no rule tells apart share a column while the automaton is built
    classes = np.zeros(256, np.int64)
    for group in {g for s in nfa.steps for g, _ in s}:
        member = np.isin(np.arange(256), list(group))
        classes = np.unique(classes * 2 + member, return_inverse=True)[1]
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    begin = closed({root})
    number, rows, accepts, todo = {begin: 0}, [], [], [begin]
    while todo:
        now = todo.pop(0)
        accepts.append(sum(1 << ends[s] for s in now if s in ends))
        row = []
        for b in sample:
            then = closed({t for s in now for g, t in nfa.steps[s] if b in g} | ({root} if anywhere else set()))
            if then not in number:
                number[then] = len(number)
                todo.append(then)
            row.append(number[then])
        rows.append(row)
    steps, kind = np.array(rows), np.unique(accepts, return_inverse=True)[1]
    while True:  # Moore's refinement: states stay together while no byte tells them apart
        finer = np.unique(np.column_stack([kind, kind[steps]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == kind.max():
            break
        kind = finer
    found, one = np.unique(kind, return_index=True)
    order = sorted(found, key=lambda k: (accepts[one[k]] > 0, k))
    rank = np.argsort(order)
    table = rank[kind[steps[one[order]]]]
    masks = [accepts[one[k]] for k in order]
    dead = next((s for s in range(len(order)) if not masks[s] and (table[s] == s).all()), -1)
    w = len(sample)
    first = next((i for i, m in enumerate(masks) if m), len(masks))
    return Dfa((table * w).ravel().tolist(), bytes(classes.tolist()), w, masks, first * w, int(rank[kind[0]]) * w, dead * w)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.starts = compiled(list(rules), backwards=True, anywhere=True)
        self.own = [compiled([replace(r, pattern=f"({r.pattern})({r.tail})?") if r.tail else r], backwards=False, anywhere=False) for r in rules]

    def longest(self, rule: int, data: bytes, at: int) -> int:
        """The end of the rule's longest match that begins at ``at``."""
        d = self.own[rule]
        table, columns, state, end = d.table, d.columns, d.start, at
        for i in range(at, len(data)):
            state = table[state + columns[data[i]]]
            if state >= d.first:
                end = i + 1
            elif state == d.dead:
                break
        return end

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in code points, by start, then in the order of the rules."""
        data = (text or "").encode("utf-8", "surrogatepass")
        table, state, first = self.starts.table, self.starts.start, self.starts.first
        hits, at = [], len(data)
        for column in reversed(data.translate(self.starts.columns)):
            at -= 1
            state = table[state + column]
            if state >= first:
                hits.append((at, state))
        done, spans = [0] * len(self.rules), []
        for at, state in reversed(hits):
            mask = self.starts.accepts[state // self.starts.width]
            for k, r in enumerate(self.rules):
                if mask >> k & 1 and at >= done[k]:
                    done[k] = end = self.longest(k, data, at)
                    body = data[at:end]
                    if r.after:
                        cut = min(i for i in (body.find(c) for c in r.after.encode()) if i >= 0) + 1
                        body = body[cut:].lstrip(b" ")
                        body = body[1:] if body[:1] in (b'"', b"'") else body
                    if len(body) >= r.least:
                        spans.append((at, k, end))
        if not data.isascii():
            ends = np.unique([x for s, _, e in spans for x in (s, e)]).astype(np.int64)
            begins = np.frombuffer(data, np.uint8) & 0xC0 != 0x80  # a code point's first byte
            steps = [int(np.count_nonzero(begins[a:b])) for a, b in zip([0, *ends[:-1]], ends)]
            place = dict(zip(ends.tolist(), np.cumsum(steps).tolist()))
            spans = [(place[s], k, place[e]) for s, k, e in spans]
        return [(self.rules[k].kind, s, e) for s, k, e in sorted(spans)]


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``."""
    base = [r.kind for r in rules if r.base]

    def run(batches):
        s = scanner(rules)
        for b in pieces(batches):
            found = [s.scan(t) for t in b.column("text").to_pylist()]
            own = [[x for x in f if x[0] in base] for f in found]
            counts = [pa.array([sum(x[0] == k for x in f) for f in own], pa.int64()) for k in base]
            digests = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in own], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digests, pa.array(map(_joined, found), pa.string())], ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    counts = "".join(f"n_{k} long, " for k in base)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}base_sha256 string, spans string")


def redacted(docs: DataFrame, columns: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``columns`` of ``docs`` (``text`` among them), each secret in ``text`` replaced by ``[SECRET]``."""

    def hidden(s: Scanner, text: str | None) -> str | None:
        at, out = 0, []
        for _, start, end in s.scan(text):
            if start > at or (start == at and not out):
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return text if not out else "".join(out) + text[at:]

    def run(batches):
        s = scanner(rules)
        for b in pieces(batches):
            texts = pa.array([hidden(s, t) for t in b.column("text").to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), "text", texts)

    rows = docs.select(*columns)
    return rows.mapInArrow(run, rows.schema)
