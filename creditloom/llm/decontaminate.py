"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with up to k edits. Cut into k + 1 pieces, one piece then occurs unchanged, so
exact hits of pieces are looked for in one pass over the text. A hit is verified up a tree: a node over n pieces
may hold n - 1 edits, and of its two halves at least one keeps its own share; so a hit must first match with its
neighbour within one edit, and so on up to the whole item. Each step is a Myers bit-parallel distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .batches import pieces

#: Edits allowed per character of an item.
ERROR_RATE = 0.1
#: Characters of items that are looked for in one pass over the documents.
BLOCK_CHARS = 2 << 20


def normalise(text: str) -> str:
    """Lower case, single blanks between words; case and layout are not edits."""
    return " ".join(_lower(text).split())


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def places(text: str) -> list[int]:
    """For each character of ``normalise(text)`` its offset in ``text``, and the end of the last word."""
    found: list[int] = []
    end = 0
    for word in re.finditer(r"\S+", text):
        if found:
            found.append(end)  # the blank between two words
        found += range(word.start(), word.end())
        end = word.end()
    return [*found, end]


@dataclass
class Pattern:
    """A text in the form Myers' algorithm reads: for each character the places where it stands."""

    text: str
    masks: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, c in enumerate(self.text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(distance, end) of the closest occurrence in ``text``, the first of equals; anchored: it begins at 0."""
        size = len(self.text)
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score = full, 0, size
        best, end, masks = size, 0, self.masks
        for i, c in enumerate(text, 1):
            same = masks.get(c, 0)
            down = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            more = minus | ~(across | plus) & full
            less = plus & across
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            more = more << 1 | anchored
            less <<= 1
            plus = (less | ~(down | more)) & full
            minus = more & down & full
            if score < best:
                best, end = score, i
        return best, end


class Matcher:
    """All pieces of a block of items in one dictionary automaton, and the trees to verify hits."""

    def __init__(self, items: Sequence[tuple[object, str]], rate: float = ERROR_RATE) -> None:
        self.items = [(key, text) for key, text in items if text]
        self.cuts: list[list[int]] = []
        self.patterns: dict[tuple[int, int, int], Pattern] = {}
        self.index = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(self.items):
            n = min(int(rate * len(text)), len(text) - 1) + 1
            cuts = [len(text) * i // n for i in range(n + 1)]
            self.cuts.append(cuts)
            for i in range(n):
                where.setdefault(text[cuts[i] : cuts[i + 1]], []).append((number, i))
        for piece, users in where.items():
            self.index.add_word(piece, (len(piece), users))
        if where:
            self.index.make_automaton()

    def _pattern(self, item: int, low: int, high: int) -> Pattern:
        key = (item, low, high)
        if key not in self.patterns:
            cuts = self.cuts[item]
            self.patterns[key] = Pattern(self.items[item][1][cuts[low] : cuts[high]])
        return self.patterns[key]

    def find(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """Items in a normalised text: number -> (distance, start, end, hits), the closest occurrence, the first of equals."""
        found: dict[int, tuple[int, int, int, int]] = {}
        if not self.items:
            return found
        checked: dict[int, tuple[int, int]] = {}
        for last, (size, users) in self.index.iter(text):
            begin = last + 1 - size
            for item, piece in users:
                # Further hits on the diagonal of an occurrence that has been verified say nothing new.
                origin = begin - self.cuts[item][piece]
                if item in checked and checked[item][0] <= origin <= checked[item][1]:
                    continue
                match = self._verify(text, item, piece, begin)
                if match:
                    checked[item] = (origin - len(self.cuts[item]), origin + len(self.cuts[item]))
                    distance, start, end = match
                    old = found.get(item)
                    if old is None or (distance, start) < old[:2]:
                        found[item] = (distance, start, end, 1 + (old[3] if old else 0))
                    else:
                        found[item] = (*old[:3], old[3] + 1)
        return found

    def _verify(self, text: str, item: int, piece: int, begin: int) -> tuple[int, int, int] | None:
        cuts = self.cuts[item]
        path, low, high = [], 0, len(cuts) - 1
        while high - low > 1:
            path.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if piece < middle else (middle, high)
        for low, high in reversed(path):
            edits = high - low - 1
            left = max(0, begin - (cuts[piece] - cuts[low]) - edits)
            window = text[left : begin + cuts[high] - cuts[piece] + edits]
            distance, end = self._pattern(item, low, high).best(window)
            if distance > edits:
                return None
        if not path:
            return 0, begin, begin + cuts[1]
        # From the end backwards: where the closest occurrence that ends there begins.
        back = Pattern(self.items[item][1][::-1])
        _, length = back.best(window[:end][::-1], anchored=True)
        return distance, left + end - length, left + end


_workers: dict[tuple, Matcher] = {}


def _matcher(items: tuple[tuple[object, str], ...], rate: float) -> Matcher:
    """One per worker and block."""
    key = (rate, hash(items))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Matcher(items, rate)
    return _workers[key]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every row of ``docs`` (doc_id, text) that holds an item of
    ``benchmark`` (item_id, text) with up to ``rate`` edits per character.

    Texts are compared in lower case with single blanks. distance is that of the closest occurrence, the
    first of equals; start and end are its code points in the document as it stands, the end exclusive. Null
    and empty texts match nothing, and so do null and empty items; repeated rows of documents come back as
    often as they came, equal items once each. Items are taken in blocks of bounded size, each block in one
    pass over all documents, so neither side is shuffled and no more than a block is held at once. Empty
    tables give an empty table.
    """
    items = benchmark.select("item_id", "text").filter("length(trim(text)) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
        T.StructField("distance", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    result = None
    for number in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = sorted(((r[0], normalise(r[1])) for r in block.collect()), key=repr)  # BLOCK_CHARS on average
        part = docs.select("doc_id", "text").mapInArrow(_pass(tuple(rows), rate), schema)
        result = part if result is None else result.unionByName(part)
    return result


def _pass(items: tuple[tuple[object, str], ...], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, rate)
        for batch in pieces(batches):
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                own = text.as_py() or ""
                found = matcher.find(normalise(own))
                where = places(own) if found else []
                for item, (distance, start, end, _) in sorted(found.items()):
                    rows.append((key.as_py(), matcher.items[item][0], distance, where[start], where[end - 1] + 1))
            columns = list(zip(*rows)) or [()] * 5
            types = [batch.schema.field(0).type, None, pa.int64(), pa.int64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "distance", "start", "end"]
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of ``benchmark``, with all columns; null texts stay.

    The text of each row decides, in the pass that reads it, so no ids are compared.
    """
    items = benchmark.select("text").filter("length(trim(text)) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    where = docs.columns.index("text")

    def keep(block: tuple[tuple[object, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, rate)
            for batch in pieces(batches, where):
                yield batch.filter(pa.array([not matcher.find(normalise(t.as_py() or "")) for t in batch.column(where)], pa.bool_()))

        return run

    for number in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number)
        rows = sorted((None, normalise(r[0])) for r in block.distinct().collect())  # BLOCK_CHARS on average
        docs = docs.mapInArrow(keep(tuple(rows)), docs.schema)
    return docs
