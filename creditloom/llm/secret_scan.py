"""Secret scans: all rules in one automaton, one pass over the bytes of each text.

Matches are the leftmost, non-overlapping, longest ones of each rule. The combined automaton tells at which
bytes a match of which rule can end. Every rule ends in a repeated class, so consecutive ends belong to one
match, and the last of them is its end; the rule's own automaton, read backwards from there and not beyond
the rule's previous match, finds the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import automata
from .batches import pieces


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``keep`` looks at the bytes of a match; a match that it refuses is used up and dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    keep: Callable[[bytes], bool] | None = None


def _long_value(match: bytes) -> bool:
    """Whether the value of an assignment has eight characters: what stands behind the sign, blanks and one quote."""
    sign = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[sign + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 8


_ASSIGN = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"



def _at_least(size: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= size


#: Hexadecimal runs are everywhere, so their least length stands in the pattern: a match is a maximal run anyway.
#: Elsewhere a counter would only multiply states.
BASE = (
    Rule("assign", _ASSIGN, any_case=True, keep=_long_value),
    Rule("access", "AKIA[A-Z0-9]+", keep=_at_least(16)),
    Rule("hex", "[0-9a-f]{32,}"),
)
MORE = (
    Rule("github", "gh[opsu]_[A-Za-z0-9]+", keep=_at_least(40)),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", keep=_at_least(15)),
)
RULES = BASE + MORE


class Scanner:
    """Transition arrays of a set of rules, as plain lists that are sent to the executors."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        nodes = [automata.parse(r.pattern, r.any_case) for r in rules]
        for rule, node in zip(rules, nodes):
            tail = node[1][-1] if node[0] == "cat" and node[1] else node
            while tail[0] == "cat" and len(tail[1]) == 1:
                tail = tail[1][0]
            if tail[0] != "rep" or tail[3] is not None:
                raise ValueError(f"the rule {rule.kind} must end in a repeated class")
        self.all = automata.forward(nodes)
        self.own = [automata.backward(n) for n in nodes]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(byte offset behind, rule) of every maximal run of possible match ends."""
        moves, accepting, state, hits = self.all.moves, self.all.accepting, 0, []
        for at, c in enumerate(data.translate(self.all.classes), 1):
            state = moves[state + c]
            if state >= accepting:
                hits.append((at, state))
        open_at: dict[int, int] = {}
        found = []
        for at, state in hits:
            for rule in self.all.accepts[state]:
                if open_at.get(rule, at) < at - 1:
                    found.append((open_at[rule], rule))
                open_at[rule] = at
        found += [(at, rule) for rule, at in open_at.items()]
        return sorted(found)

    def start(self, data: bytes, rule: int, end: int, floor: int) -> int:
        """Start of the longest match of ``rule`` that ends at ``end`` and begins at ``floor`` or later; -1 if none does."""
        table, state, best = self.own[rule], 0, -1
        for at in range(end - 1, floor - 1, -1):
            state = table.moves[state + table.classes[data[at]]]
            if state == table.dead:
                break
            if state >= table.accepting:
                best = at
        return best

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by the order of the rules."""
        floors = [0] * len(self.rules)
        found = []
        for end, rule in self.ends(data):
            start = self.start(data, rule, end, floors[rule])
            if start < 0:
                continue
            floors[rule] = end
            keep = self.rules[rule].keep
            if keep is None or keep(data[start:end]):
                found.append((start, rule, end))
        if not found:
            return []
        place, seen, points = {}, 0, 0
        for at in sorted({x for s, _, e in found for x in (s, e)}):
            points += len(data[seen:at].decode("utf-8", "replace"))
            seen, place[at] = at, points
        return [(self.rules[r].kind, place[s], place[e]) for s, r, e in sorted(found)]


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text, any other columns).

    spans is an array of (kind, start, end) in code points, the end exclusive; it is empty for texts without
    secrets and for null and empty texts. Spans of different kinds may overlap. Texts are scanned whole;
    repeated rows come back as often as they came; an empty table gives an empty one.
    """
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t.as_py() or b"")]
                for t in batch.column(1).cast(pa.binary())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(
        T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    ))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans become one mask.

    All rows and columns stay; null texts stay null. A column ``n_chars`` is set anew where the text changed.
    """
    scanner = Scanner(rules)
    names = docs.columns
    where = names.index("text")

    def clean(text: str | None) -> str | None:
        spans = scanner.spans(text.encode()) if text else []
        kept, at = [], 0
        for _, start, end in spans:
            if start >= at:
                kept += [text[at:start], mask]
            at = max(at, end)
        return text if not spans else "".join(kept) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, where):
            columns = list(batch.columns)
            columns[where] = pa.array((clean(t.as_py()) for t in columns[where]), pa.string())
            if "n_chars" in names:
                at, old = names.index("n_chars"), batch.column(where)
                new = [
                    n.as_py() if a.as_py() == b.as_py() else len(a.as_py()) for n, a, b in zip(columns[at], columns[where], old)
                ]
                columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans, kinds: Sequence[str] | None = None):
    """Column: kind:start:end of the spans (of these kinds), joined by commas."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
