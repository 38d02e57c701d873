"""Secret scans: all rules in one byte pass over one minimal automaton.

A rule is a regular expression over UTF-8 bytes.  The union of all rules is compiled by subset
construction and minimised (``automaton``).  The pass over a text stops at the first accepting
state; the few texts that have one are read again to find which rules fire and where, and the
spans of a rule are its leftmost-longest, non-overlapping matches (a backward automaton marks
where matches begin, a forward one where they end).

Nulls and empty texts have no spans.  Repeated rows give repeated rows.  Only the id and text
columns are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import compile_rules, linked_rows, parse, reverse
from .common import arrow_schema, small_batches, take_turn, text_buffers


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``measured`` (a pattern whose group 1 is meant; else the whole match) needs."""

    kind: str
    pattern: str
    fold: bool = False
    least: int = 0
    measured: str = ""


BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        fold=True,
        least=8,
        measured=r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further formats that vendors document publicly.
MORE = (
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=36),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]+", least=40),
)
RULES = BASE + MORE


class Scanner:
    """Finds the spans of ``rules`` in bytes; compiled once, sent to the workers as arrays."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nodes = [parse(r.pattern, r.fold) for r in rules]
        self.table, self.accepts = compile_rules(nodes, anywhere=True)
        self._ends = [compile_rules([n], anywhere=False) for n in nodes]
        self._begins = [compile_rules([reverse(n)], anywhere=True) for n in nodes]
        self._all = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("rules", "table", "accepts", "_ends", "_begins")} | {"_all": None}

    def link(self) -> Scanner:
        """Unfold the arrays to linked rows, once in each process."""
        if self._all is not None:
            return self
        self._all = linked_rows(self.table, self.accepts)
        # the stopping pass: every accepting state becomes one that is never left
        hit = [None] * 257
        hit[:256] = [hit] * 256
        hit[256] = frozenset([-1])
        stop = linked_rows(self.table, self.accepts)
        accepting = {id(row) for row in stop if row[256]}
        for row in stop:
            if not row[256]:
                row[:256] = [hit if id(to) in accepting else to for to in row[:256]]
        self._stop, self._hit = stop, hit
        self._begin = [linked_rows(*x) for x in self._begins]
        self._end = [linked_rows(*x) for x in self._ends]
        self._measure = [re.compile(r.measured.encode(), re.I if r.fold else 0) if r.measured else None for r in self.rules]
        return self

    def fires(self, data: bytes) -> bool:
        row, hit = self._stop[0], self._hit
        for b in data:
            row = row[b]
        return row is hit

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order of start and then of rule."""
        if not self.fires(data):
            return []
        row, fired = self._all[0], {}
        for i, b in enumerate(data, 1):
            row = row[b]
            if row[256]:
                for k in row[256]:
                    fired[k] = i
        found = []
        for k, last in fired.items():
            begins, row = [], self._begin[k][0]
            for i in range(last - 1, -1, -1):
                row = row[data[i]]
                if row[256]:
                    begins.append(i)
            at, dead = 0, self._end[k][-1]
            for begin in reversed(begins):
                if begin < at:
                    continue
                row, end = self._end[k][0], -1
                for i in range(begin, len(data)):
                    row = row[data[i]]
                    if row is dead:
                        break
                    if row[256]:
                        end = i + 1
                at = end
                if self._long_enough(k, data[begin:end]):
                    found.append((begin, k, end))
        return sorted(found)

    def _long_enough(self, k: int, match: bytes) -> bool:
        rule, pattern = self.rules[k], self._measure[k]
        value = pattern.fullmatch(match)[1] if pattern else match
        return len(value) >= rule.least


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points; ``spans`` are in order of start."""
    out, at, count = [], 0, 0
    for s, k, e in spans:
        count += len(data[at:s].decode("utf-8", "replace"))
        at = s
        out.append((count, k, count + len(data[s:e].decode("utf-8", "replace"))))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (array of kind, start, end in code points, end exclusive)."""
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    small_batches(docs.sparkSession)
    arrow, compiled = arrow_schema(schema), scanner(rules)

    def scan(batches):
        take_turn("secrets")
        finder = compiled.link()
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            whole = memoryview(data)
            out = []
            for i in range(batch.num_rows):
                text = bytes(whole[off[i] : off[i + 1]])
                found = finder.spans(text)
                out.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in _code_points(text, found)] if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow.field(1).type)], schema=arrow)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(scan, schema)


def digest(found: DataFrame, base: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """The query's columns from the operator's spans (SQL functions only)."""
    from pyspark.sql import functions as F

    listed = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    own = F.transform(
        F.filter("spans", lambda x: x["kind"].isin(*base)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(F.array_join(own, ","), 256).alias("base_sha256"),
        F.array_join(listed, ",").alias("spans"),
    )


def brute_force(text: str) -> list[tuple[int, str, int]]:
    """The base spans by the contract's own words (for tests)."""
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ]
    rank = {kind: i for i, (kind, *_) in enumerate(patterns)}
    found = [(m.start(), kind, m.end()) for kind, p, g, n in patterns for m in p.finditer(text) if len(m[g]) >= n]
    return sorted(found, key=lambda x: (x[0], rank[x[1]]))


def sha256_of(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
