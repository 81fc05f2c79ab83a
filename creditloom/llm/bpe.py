"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts as one state that reads every symbol. A merge (a, b) -> c is a gadget: the state behind
a is copied without its arc b, arcs a lead to the copy, and wherever a can be read, c can be read too and leads
to where a b would have led. After all merges the automaton reads exactly the token sequences that the merges,
applied in order, can produce, and each word has one of them.

All arcs of a token lead to one state, so a state is named by the token read last. A copy differs from its
original by one missing arc, so only the missing arcs and the time of each gadget are kept; whole rows of
arcs are never copied. An arc c exists where its left part existed when c was made, hence a lookup follows
the left parts of the token to read and the right parts of the token read last.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import pieces

#: States of the byte table that a worker numbers. Further ones are worked out each time, and when those have been
#: PATIENCE times as many, the table starts anew.
REMEMBERED, PATIENCE = 100_000, 20
#: Bytes of words and ids, with what holds them, in each of the two generations of a worker's memory.
GENERATION_BYTES = 40 << 20
_NEVER = 1 << 60


class Automaton:
    """Arcs, labels and special tokens of a tokenizer file with word ends (type BPE, byte level)."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.label = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label.update({i: t for t, i in self.special.items()})
        end = model["end_of_word_suffix"]
        chars = _byte_characters()
        self.inner = [ids[c] for c in chars]
        self.final = [ids[c + end] for c in chars]
        # The gadgets, in the order of the merges. born: time of a token; cut[a][b]: time from which b no longer follows a.
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[int, dict[int, int]] = {}
        for time, (a, b) in enumerate(model["merges"], start=1):
            left, right, made = ids[a], ids[b], ids[a + b]
            if made not in self.parts and self._follows(left, right):
                self.cut.setdefault(left, {})[right] = time
                self.parts[made], self.born[made] = (left, right), time
        # Arcs by the symbols they read: next node of the tree of labels, and the token that ends in a node.
        symbols = {t: (t,) for t in (*self.inner, *self.final)}
        self.step: dict[int, int] = {}
        self.token: list[int] = [-1]
        for made in (*symbols, *self.parts):
            if made in self.parts:
                left, right = self.parts[made]
                symbols[made] = symbols[left] + symbols[right]
            node = 0
            for s in symbols[made]:
                key = node << 20 | s
                node = self.step.get(key, -1)
                if node < 0:
                    node = self.step[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = made
        self.length = {t: len(s) for t, s in symbols.items()}
        self.words = _Words(spec)
        self.forget()

    def _follows(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has an arc ``token``."""
        before = _NEVER  # gadgets of a right part count up to the birth of the token that took over its state
        while True:
            cuts = self.cut.get(last)
            if cuts:
                read, until = token, _NEVER
                while True:
                    at = cuts.get(read, _NEVER)
                    if at < before and at <= until:
                        return False
                    if read not in self.parts:
                        break
                    until = self.born[read]
                    read = self.parts[read][0]
            if last not in self.parts:
                return True
            before = self.born[last]
            last = self.parts[last][1]

    def forget(self) -> None:
        """Only the start of a word, where any arc can begin, is known."""
        self.moves: dict[int, int] = {}
        self.numbers: dict[tuple, int] = {((-1, 0),): 0}
        self.open: list[tuple] = [((-1, 0),)]
        self.ending: list[int] = [-1]
        self.unnumbered = 0

    def _reached(self, arcs: tuple, symbol: int) -> tuple[list[tuple[int, int]], int]:
        """Arcs that ``symbol`` continues, with those that can begin behind it, and the one that it completes (-1: none)."""
        done, ahead, step, tokens = -1, [], self.step, self.token
        for last, node in arcs:
            node = step.get(node << 20 | symbol, -1)
            if node < 0:
                continue
            ahead.append((last, node))
            token = tokens[node]
            if done < 0 <= token and (last < 0 or self._follows(last, token)):
                done = token
        if done >= 0:
            ahead.append((done, 0))
        return ahead, done

    def _move(self, state: int, key: int, symbol: int) -> int:
        """Next state, and a table entry for it; -1 if the table is full."""
        if len(self.open) >= REMEMBERED:
            return -1
        ahead, done = self._reached(self.open[state], symbol)
        reached = (*ahead, done)
        number = self.numbers.get(reached)
        if number is None:
            number = self.numbers[reached] = len(self.open)
            self.open.append(tuple(ahead))
            self.ending.append(done)
        self.moves[key] = number
        return number

    def encode_word(self, word: bytes) -> list[int]:
        """The one path that reads ``word``.

        Read byte by byte, every prefix ends one path only, so a state of the byte table is the set of open
        arcs: where in the tree of labels each stands, and which token stood before it. States and moves are
        entered when a word first needs them. When the table is full, the rest of a word that leaves it is read without.
        """
        if self.unnumbered > PATIENCE * REMEMBERED:
            self.forget()
        state, moves, ending, ends = 0, self.moves, self.ending, []
        final = len(word) - 1
        for at, b in enumerate(word):
            key = state << 9 | b if at < final else state << 9 | 256 | b
            following = moves.get(key, -1)
            if following < 0:
                following = self._move(state, key, self.inner[b] if at < final else self.final[b])
                if following < 0:
                    ends += self._unnumbered_ends(self.open[state], word, at)
                    break
            state = following
            ends.append(ending[state])
        path, at, length = [], len(ends), self.length
        while at:
            token = ends[at - 1]
            path.append(token)
            at -= length[token]
        return path[::-1]

    def _unnumbered_ends(self, arcs: tuple, word: bytes, at: int) -> list[int]:
        """The tokens that end at each place of ``word`` from ``at`` on."""
        ends, final = [], len(word) - 1
        self.unnumbered += len(word) - at
        for i in range(at, len(word)):
            arcs, done = self._reached(arcs, self.inner[word[i]] if i < final else self.final[word[i]])
            ends.append(done)
        return ends

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words.split(text, self.special) for i in ([word] if isinstance(word, int) else self.encode_word(word))]

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, with a blank between; the file names no decoder that would do more."""
        return " ".join(map(self.label.__getitem__, ids))


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte; those without one get the characters from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Words:
    """Normalisation and pre-splitting as the tokenizer file says."""

    _FURTHER = re.compile("[ɐ-\U0010ffff]")

    @classmethod
    def common(cls, text: str) -> bool:
        """Whether all is below U+0250, where letters are composed and case and classes are the same in every
        Unicode version, and without the four separators that libraries do not agree on."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not cls._FURTHER.search(text)

    def __init__(self, spec: dict) -> None:
        self.spec = json.dumps({**spec, "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})
        common = [chr(c) for c in range(0x250)]
        letters = "".join(c for c in common if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in common if unicodedata.category(c)[0] == "N")
        # Lower-casing brings in U+0307, which is neither.
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        self.bytes_of = {c: b for b, c in enumerate(_byte_characters())}
        self.library = None

    def split(self, text: str, special: dict[str, int]) -> Iterator[bytes | int]:
        """Words in UTF-8, and ids for special tokens that the text spells out."""
        for part in self.parts(text, special):
            if isinstance(part, int):
                yield part
            else:
                yield from map(self.bytes_of_word, part)

    def parts(self, text: str, special: dict[str, int]) -> Iterator[list[str] | int]:
        if not any(s in text for s in special):
            yield self.words(text)
            return
        for part in regex.split("(" + "|".join(map(re.escape, special)) + ")", text):
            yield special[part] if part in special else self.words(part)

    def words(self, text: str) -> list[str]:
        if self.common(text):
            return self.find(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        text = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.bytes_of[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in found]

    @staticmethod
    def bytes_of_word(word: str) -> bytes:
        return word.encode("utf-8", "surrogateescape")


class _Known(dict):
    """Words and the ids that ``make`` gave for them, in two generations of bounded size; very long words are not kept.

    When the young generation is full it becomes the old one; words that occur again move to the young one.
    """

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) < 64:
            self.held += 200 + 2 * len(word) + len(value)
            if self.held > GENERATION_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[word] = value
        return value


class Coder:
    """Ids and decoded text of whole texts, with the words seen so far."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.ids = _Known(lambda word: _packed(automaton.encode_word(automaton.words.bytes_of_word(word))))

    def code(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, their decoded text)."""
        ids = []
        for part in self.automaton.words.parts(text, self.automaton.special):
            if isinstance(part, int):
                ids.append(_packed([part]))
            else:
                ids += map(self.ids.__getitem__, part)
        packed = b"".join(ids)
        return packed, self.automaton.decode(np.frombuffer(packed, dtype="<u4").tolist())


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


_loaded: dict[int, Coder] = {}


def _coder(source: str) -> Coder:
    """One per worker and file, which later tasks of the worker go on with."""
    key = hash(source)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Coder(Automaton(source))
    return _loaded[key]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text, any other columns).

    ``tokenizer`` is the path of a tokenizer file on the driver; its content (a vocabulary of fixed size) goes
    to the executors as a broadcast. ids are little-endian unsigned 32-bit integers, decoded is their text.
    Null and empty texts have no ids and an empty text. Texts are encoded whole; repeated rows come back as
    often as they came; an empty table gives an empty one. Memory: pieces of a batch, and a bounded number of
    remembered words.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(source.value)
        for batch in pieces(batches):
            coded = [coder.code(text.as_py() or "") for text in batch.column(1)]
            ids, texts = zip(*coded)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
            )

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)
