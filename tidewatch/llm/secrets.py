"""Secret scan: all rules in one minimal deterministic automaton over bytes, read in one pass.

The combined automaton holds every rule up to its first open repetition (with whole rules, every set
of rules that go on side by side would be a state of its own): it tells behind which bytes a rule's
match may go on.  Of a text where one does, that rule's reversed automaton, read
from the end, gives every byte at which a whole match starts, and its anchored automaton, read from
such a byte, gives the longest match there.
"""

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from re import IGNORECASE, _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import handfuls

KINDS = ("assign", "access", "hex")
Span = tuple[str, int, int]

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]"
#: The scanner's rules as regular expressions over bytes.  The first three are the base
#: kinds, the others are added by the method: prefixes and frames that services publish for their keys.
RULES = {
    "assign": ASSIGN + "+",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "github": r"gh[pousr]_[A-Za-z0-9]{6,}",
    "github_fine": r"github_pat_[A-Za-z0-9_]{8,}",
    "gitlab": r"glpat-[A-Za-z0-9_-]{8,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{8,}",
    "stripe": r"[rs]k_(?:live|test)_[A-Za-z0-9]{8,}",
    "google": r"AIza[A-Za-z0-9_-]{8,}",
    "sendgrid": r"SG\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "npm": r"npm_[A-Za-z0-9]{8,}",
    "pypi": r"pypi-AgEI[A-Za-z0-9_-]{8,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{6,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}",
    "url_password": r"(?:https?|ftp|ssh|postgres|postgresql|mysql|redis|mongodb|amqp)://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@",
    "azure": r"AccountKey=[A-Za-z0-9+/=]{8,}",
    "shopify": r"shp(?:at|ca|pa|ss)_[0-9a-f]{8,}",
    "digitalocean": r"do[opr]_v1_[0-9a-f]{8,}",
    "vault": r"hvs\.[A-Za-z0-9_-]{8,}",
    "databricks": r"dapi[0-9a-f]{8,}",
    "linear": r"lin_api_[A-Za-z0-9]{8,}",
    "planetscale": r"pscale_(?:tkn|pw)_[A-Za-z0-9_-]{8,}",
    "doppler": r"dp\.pt\.[A-Za-z0-9]{8,}",
    "huggingface": r"hf_[A-Za-z]{8,}",
    "newrelic": r"NRAK-[A-Z0-9]{8,}",
    "square": r"sq0(?:atp|csp)-[A-Za-z0-9_-]{8,}",
    "postman": r"PMAK-[0-9a-f]{8,}",
    "grafana": r"glsa_[A-Za-z0-9]{8,}",
    "private_key": r"-----BEGIN [A-Z]{0,10} ?PRIVATE KEY-----",
    "pgp_key": r"-----BEGIN PGP PRIVATE KEY BLOCK-----",
}
#: A match of these rules counts only if this one matches it too: a short one is dropped without a retry.
COUNTS = {"assign": ASSIGN + "{8,}"}


# ---------------------------------------------------------------- from rules to arrays


class Nfa:
    """Thompson construction for literals, sets, groups, alternation, and the repetitions ? * {n} {m,n}."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def build(self, node: tuple, to: int) -> int:
        """The entry of a fragment that recognises ``node`` and goes on at ``to``."""
        kind, *rest = node
        if kind == "set":
            s = self.state()
            self.moves[s] = (rest[0], to)
            return s
        if kind == "seq":
            for part in reversed(rest[0]):
                to = self.build(part, to)
            return to
        if kind == "or":
            s = self.state()
            self.empty[s] = [self.build(part, to) for part in rest[0]]
            return s
        part, low, high = rest
        if high is None:
            loop = self.state()
            self.empty[loop] = [self.build(part, loop), to]
            to = loop
        else:
            for _ in range(high - low):
                s = self.state()
                self.empty[s] = [self.build(part, to), to]
                to = s
        for _ in range(low):
            to = self.build(part, to)
        return to


def parse(pattern: str) -> tuple:
    """A rule's syntax tree, read from the standard library's own parser."""
    c = _constants
    both = lambda i: frozenset({i} | ({ord(chr(i).swapcase())} if chr(i).isalpha() and fold[-1] else set()))
    fold = [False]

    def walk(items) -> tuple:
        out = []
        for op, arg in items:
            if op is c.LITERAL:
                out.append(("set", both(arg)))
            elif op is c.IN:
                chars: set[int] = set()
                for o, a in arg:
                    chars |= set(both(a)) if o is c.LITERAL else set(range(a[0], a[1] + 1))
                out.append(("set", frozenset(chars)))
            elif op is c.BRANCH:
                out.append(("or", [walk(x) for x in arg[1]]))
            elif op is c.SUBPATTERN:
                fold.append(fold[-1] or bool(arg[1] & IGNORECASE))
                out.append(walk(arg[3]))
                fold.pop()
            elif op is c.MAX_REPEAT:
                out.append(("times", walk(arg[2]), arg[0], None if arg[1] is c.MAXREPEAT else arg[1]))
            else:
                raise ValueError(f"a rule may not use {op}")
        return ("seq", out)

    return walk(_parser.parse(pattern))


def backwards(node: tuple) -> tuple:
    """The syntax tree of the reversed language."""
    kind, *rest = node
    if kind == "set":
        return node
    if kind == "times":
        return (kind, backwards(rest[0]), *rest[1:])
    parts = [backwards(x) for x in rest[0]]
    return (kind, parts[::-1] if kind == "seq" else parts)


def opening(node: tuple) -> tuple:
    """The rule up to its first repetition without a bound and with a least count.

    Of that repetition it holds one turn, or the least count if the rule begins with it.  Every match
    begins with a match of the opening, so no match is passed over where openings are looked for first.
    """
    kind, *rest = node
    assert kind == "seq"
    parts: list[tuple] = []
    for part in rest[0]:
        if part[0] == "times" and part[3] is None and part[2]:
            least = 1 if parts else part[2]
            return ("seq", [*parts, ("times", part[1], least, least)])
        parts.append(part)
    return ("seq", parts)


class Automaton:
    """A minimal deterministic automaton of some rules as transition arrays.

    ``step[state * width + byte class]`` is the next state; the states from ``first_hit`` on end a
    match, of the rules in the bits of ``hits``; the start is state 0.  A free automaton finds
    matches that begin anywhere; an anchored one only those that begin where it starts, and from its
    state ``dead`` there is no way to a match.
    """

    def __init__(self, trees: list[tuple], anchored: bool = False):
        nfa = Nfa()
        root = nfa.state()
        ends = {}
        for n, tree in enumerate(trees):
            end = nfa.state()
            ends[end] = n
            nfa.empty[root].append(nfa.build(tree, end))
        # bytes that no rule tells apart share a class
        sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
        marks: dict[tuple[bool, ...], int] = {}
        self.byte_class = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)], np.uint8)
        self.width = len(marks)
        sample = [int(np.flatnonzero(self.byte_class == k)[0]) for k in range(self.width)]

        def closure(state: int) -> frozenset[int]:
            todo, seen = [state], {state}
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.moves[s] or s in ends)

        reach = {m[1]: closure(m[1]) for m in nfa.moves if m}
        moves = [[reach[m[1]] if m and byte in m[0] else None for byte in sample] for m in nfa.moves]
        # subset construction; a free automaton has the start in every subset, since a match may begin anywhere
        start = closure(root)
        again = frozenset() if anchored else start
        index, table, accept, todo = {start: 0}, [], [], [start]
        for now in todo:
            accept.append(sum(1 << ends[s] for s in now if s in ends))
            rows = [moves[s] for s in now]
            row = []
            for k in range(self.width):
                nxt = again.union(*[x for r in rows if (x := r[k]) is not None])
                if nxt not in index:
                    index[nxt] = len(index)
                    todo.append(nxt)
                row.append(index[nxt])
            table.append(row)
        step, hits = np.array(table), np.array(accept)
        # minimisation: classes of states are refined until all members of one go to the same classes
        _, part = np.unique(hits, return_inverse=True)
        while True:
            h = part.astype(np.uint64)
            for k in range(self.width):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + part[step[:, k]].astype(np.uint64)
            _, finer = np.unique(h, return_inverse=True)
            if finer.max() == part.max():
                break
            part = finer
        n = part.max() + 1
        one = np.array([np.flatnonzero(part == k)[0] for k in range(n)])
        order = np.lexsort((np.arange(n) != part[0], hits[one] > 0))  # the start first, states that end a match last
        name = np.empty(n, np.int64)
        name[order] = np.arange(n)
        self.hits = hits[one[order]]
        self.step = name[part[step[one[order]]]].astype(np.int32).ravel()
        self.first_hit = int((self.hits == 0).sum())
        alone = (self.step.reshape(n, self.width) == np.arange(n)[:, None]).all(axis=1) & (self.hits == 0)
        self.dead = int(np.flatnonzero(alone)[0]) if alone.any() else -1

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state behind every byte: one pass in which stretches of equal length move on side by side.

        All stretches but the first begin with a guess, the start.  Where the state before a stretch is
        another one, the stretch is read again from there until it meets what the guess led to; a
        stretch whose end changes by this lets the next be read again.
        """
        n = len(data)
        long = max(64, int(np.sqrt(n) / 2))
        count = -(-n // long)
        cls = np.zeros(count * long, np.int64)
        cls[:n] = self.byte_class[data]
        cls = np.ascontiguousarray(cls.reshape(count, long).T)
        out = np.empty((long, count), np.int32)
        state = np.zeros(count, np.int64)
        for t in range(long):
            state = self.step[state * self.width + cls[t]]
            out[t] = state
        wrong = np.flatnonzero(out[-1, :-1] != 0) + 1
        while len(wrong):
            at, state = wrong, out[-1, wrong - 1].astype(np.int64)
            last = out[-1, at].copy()
            for t in range(long):
                state = self.step[state * self.width + cls[t, at]]
                differ = state != out[t, at]
                if not differ.all():
                    at, state = at[differ], state[differ]
                    if not len(at):
                        break
                out[t, at] = state
            moved = wrong[out[-1, wrong] != last] + 1
            wrong = moved[moved < count]
        return out.T.ravel()[:n]

    def scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of bytes behind which a match ends, and which rules' bits."""
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        states = self.states(data)
        at = np.flatnonzero(states >= self.first_hit)
        return at, self.hits[states[at]]

    def longest(self, data: bytes, start: int) -> int:
        """The end of the longest match that begins at ``start``; -1 if there is none."""
        step, cls, width, first, dead = self.lists()
        state, end = 0, -1
        for at in range(start, len(data)):
            state = step[state * width + cls[data[at]]]
            if state >= first:
                end = at + 1
            elif state == dead:
                break
        return end

    def lists(self) -> tuple:
        if not hasattr(self, "kept"):
            self.kept = self.step.tolist(), self.byte_class.tolist(), self.width, self.first_hit, self.dead
        return self.kept


class Scanner:
    """The combined automaton of some rules' openings, and each rule's reversed and anchored one."""

    def __init__(self, rules: dict[str, str], counts: dict[str, str]):
        trees = {k: parse(p) for k, p in rules.items()}
        self.names = list(rules)
        self.all = Automaton([opening(t) for t in trees.values()])
        self.back = [Automaton([backwards(t)]) for t in trees.values()]
        self.whole = [Automaton([t], anchored=True) for t in trees.values()]
        self.counts = {rules_name: Automaton([parse(p)], anchored=True) for rules_name, p in counts.items()}

    def matches(self, data: bytes, rule: int) -> list[tuple[int, int]]:
        """A rule's leftmost longest non-overlapping matches in a text's bytes; those that do not count are dropped without a retry."""
        found, _ = self.back[rule].scan(np.frombuffer(data, np.uint8)[::-1])
        starts = (len(data) - 1 - found)[::-1].tolist()
        least = self.counts.get(self.names[rule])
        out, i = [], 0
        while i < len(starts):
            a = starts[i]
            b = self.whole[rule].longest(data, a)
            if least is None or least.longest(data, a) == b:
                out.append((a, b))
            i = bisect_left(starts, b, i)
        return out


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner(RULES, COUNTS)


# ---------------------------------------------------------------- spans


def scan_texts(texts: list[str | None], machine: Scanner | None = None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; added ones overlap neither a base span nor each other, earlier rules first."""
    machine = machine or scanner()
    raw = [(t or "").encode() for t in texts]
    where, hits = machine.all.scan(np.frombuffer(b"\0".join(raw), np.uint8))
    stops = np.cumsum([len(r) + 1 for r in raw])
    text = np.searchsorted(stops, where, side="right")
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    if not len(text):
        return out
    new = np.flatnonzero(np.diff(text, prepend=-1))
    for i, bits in zip(text[new].tolist(), np.bitwise_or.reduceat(hits, new).tolist(), strict=True):
        data = raw[i]
        point = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if not data.isascii() else None
        place = (lambda a: a) if point is None else lambda a, p=point: int(p[a - 1]) if a else 0
        taken = bytearray(len(data))
        spans: tuple[list[Span], list[Span]] = ([], [])
        for n, kind in enumerate(machine.names):
            if not bits >> n & 1:
                continue
            base = kind in KINDS
            for a, b in machine.matches(data, n):
                if base or 1 not in taken[a:b]:
                    taken[a:b] = b"\1" * (b - a)
                    spans[not base].append((kind, place(a), place(b)))
        out[i] = sorted(spans[0], key=lambda s: (s[1], KINDS.index(s[0]))), sorted(spans[1], key=lambda s: s[1])
    return out


SPAN_TYPE = "struct<kind:string,start:bigint,end:bigint>"


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, added)`` of every row; both are arrays of ``struct<kind, start, end>`` in code points.

    Null text is empty and has no spans; texts are read whole, at any length; repeated rows and null
    keys stay as they are; other columns are ignored; an empty table gives none.  No shuffle.
    """
    machine = docs.sparkSession.sparkContext.broadcast(scanner())  # compiled once; a few thousand states, set by the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        put = lambda ss: [{"kind": k, "start": a, "end": b} for k, a, b in ss]
        for whole in batches:
            for b in handfuls(whole):
                got = scan_texts(b.column(1).to_pylist(), machine.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([put(x) for x, _ in got], kind), pa.array([put(y) for _, y in got], kind)], names=["key", "base", "added"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, base array<{SPAN_TYPE}>, added array<{SPAN_TYPE}>")
