"""Periodic runs of words, found on a grid of word pairs with a longest-common-extension structure over a difference cover.

A difference cover of the numbers below v is a set in which every difference modulo v occurs. Only suffixes that start
in the cover are sorted. Two arbitrary places are both moved on by fewer than v words, compared one by one, until both
are in the cover; from there on the extension is a minimum of the common prefixes of sorted neighbours, looked up in a
sparse table. A run of period p and four periods length contains two words p apart, the first at a multiple of 2 p, that
agree for more than p words: all such pairs are n / 2 (1 + 1/2 + 1/3 + ...), and only those whose first words
agree are extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import pieces

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Perfect difference cover: each difference modulo PERIOD but 0 occurs once.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Pairs of the grid, or extensions, that are looked at together.
AT_ONCE = 1 << 20
#: Bytes of text whose words meet in one structure; a longer text is one of its own.
BATCH_BYTES = 2 << 20


def _shifts() -> np.ndarray:
    """By how much two places, given modulo PERIOD, move on until both are in the cover."""
    found = np.full((PERIOD, PERIOD), PERIOD, dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            found[a, b] = min(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return found


_SHIFT = _shifts()
_SLOT = np.full(PERIOD, -1, dtype=np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions of ``words`` (whole numbers from 0), by sorted suffixes of a difference cover."""

    def __init__(self, words: np.ndarray) -> None:
        blocks = len(words) // PERIOD + 2
        high = int(words.max(initial=0)) + 1
        # Behind the end every word is unlike all others, so no extension goes on there.
        self.words = np.concatenate([words, high + np.arange(blocks * PERIOD - len(words) + PERIOD)])
        starts = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).ravel()
        levels = [self._block_ranks(starts)]
        step = len(COVER)
        while levels[-1].max() + 1 < len(starts):
            rank = levels[-1]
            behind = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), dtype=np.int64)])
            levels.append(_dense(rank * (len(rank) + 1) + behind)[0])
            step *= 2
        self.rank = levels.pop()
        self._sparse_table(np.argsort(self.rank), levels, starts)

    def _block_ranks(self, starts: np.ndarray) -> np.ndarray:
        """Ranks of the sampled suffixes by their first PERIOD words, several words in a key."""
        bits = int(self.words.max()).bit_length()
        many = max(1, 63 // bits)
        rank = None
        for k in range(0, PERIOD, many):
            key = np.zeros(len(starts), dtype=np.int64)
            for i in range(k, min(k + many, PERIOD)):
                key = key << bits | self.words[starts + i]
            key = _dense(key)[0]
            rank = key if rank is None else _dense(rank * (len(starts) + 1) + key)[0]
        return rank

    def _sparse_table(self, order: np.ndarray, levels: list[np.ndarray], starts: np.ndarray) -> None:
        """Minima of common prefixes of sorted neighbours over 1, 2, 4, ... of them."""
        left, right = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(left), dtype=np.int64)
        for number in range(len(levels) - 1, -1, -1):
            step = len(COVER) << number
            alike = np.flatnonzero((np.maximum(left, right) < len(starts)) & (levels[number][np.minimum(left, len(starts) - 1)] == levels[number][np.minimum(right, len(starts) - 1)]))
            common[alike] += PERIOD << number
            left[alike] += step
            right[alike] += step
        at, to = starts[order[:-1]] + common, starts[order[1:]] + common
        common += self._word_by_word(at, to, np.full(len(at), PERIOD))
        rows = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            above = rows[-1]
            joined = above.copy()
            joined[: len(above) - width] = np.minimum(above[:-width], above[width:])
            rows.append(joined)
            width *= 2
        self.minima = np.stack(rows)

    def _word_by_word(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from places i and j on, ``limit`` at most."""
        agreed = np.zeros(len(i), dtype=np.int64)
        going = np.flatnonzero(limit > 0)
        for k in range(int(limit.max(initial=0))):
            going = going[limit[going] > k]
            going = going[self.words[i[going] + k] == self.words[j[going] + k]]
            if not len(going):
                break
            agreed[going] += 1
        return agreed

    def length(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from places i and j on; i and j differ and lie inside the words."""
        shift = _SHIFT[i % PERIOD, j % PERIOD]
        found = self._word_by_word(i, j, shift)
        through = np.flatnonzero(found == shift)
        a, b = i[through] + shift[through], j[through] + shift[through]
        a, b = (self.rank[x // PERIOD * len(COVER) + _SLOT[x % PERIOD]] for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found[through] += np.minimum(self.minima[level, low], self.minima[level, high - (1 << level)])
        return found


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from 0 without gaps, equal keys sharing one, and the sorting order."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
    return rank, order


def _grid(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period), in pieces: places at multiples of 2 p that a run of period p inside a text may contain."""
    most = np.where(lengths >= LEAST_WORDS, lengths // LEAST_PERIODS, 0)
    for first in range(0, len(lengths)):
        if most[first]:
            break
    else:
        return
    # Texts are taken together until their pairs (text, period) are AT_ONCE; a long text alone is cut by period below.
    text = at = 0
    while text < len(lengths):
        at = text + max(1, int(np.searchsorted(np.cumsum(most[text:]), AT_ONCE, side="right")))
        here = np.arange(text, at)
        owner = np.repeat(here, most[here])
        period = np.arange(len(owner)) - np.repeat(np.cumsum(most[here]) - most[here], most[here]) + 1
        count = (lengths[owner] - 2 * period - 1) // (2 * period) + 1
        ends = np.cumsum(count)
        done = 0
        while done < len(owner):
            before = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
            n = count[done:upto]
            which = np.repeat(np.arange(done, upto), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield owner[which], starts[owner[which]] + step * 2 * period[which], period[which]
            done = upto
        text = at


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in texts of word numbers, by text, start and period.

    A run is a stretch with smallest period q, words q apart being equal, of max(LEAST_WORDS, LEAST_PERIODS * q) words
    or more, that cannot be extended to either side with that period.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    fresh = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    # A word unlike all others stands behind each text, and some more at the end.
    words = np.concatenate([x for i, t in enumerate(texts) for x in (t, [fresh + i])] + [fresh + len(texts) + np.arange(4)]).astype(np.int64)
    found = []
    for owner, place, period in _grid(starts, lengths):
        good = words[place] == words[place + period]
        for k in (1, 2):  # the pair agrees for more than p words
            at = np.flatnonzero(good)
            at = at[(words[place[at] + k] != words[place[at] + period[at] + k]) & (period[at] >= k)]
            good[at] = False
        found.append((owner[good], place[good], period[good]))
    if not sum(len(o) for o, _, _ in found):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    owner, place, period = (np.concatenate(x) for x in zip(*found))
    # Only texts with such pairs enter the structure.
    kept = np.unique(owner)
    shorter = np.concatenate([np.append(texts[i], fresh + i) for i in kept]).astype(np.int64)
    moved = np.zeros(len(texts), dtype=np.int64)
    moved[kept] = np.cumsum(lengths[kept] + 1) - lengths[kept] - 1
    place += moved[owner] - starts[owner]
    starts = moved
    extensions = Extensions(np.unique(shorter, return_inverse=True)[1].astype(np.int64))
    ahead = _in_pieces(extensions.length, place, place + period)
    good = ahead > period
    owner, place, period, ahead = owner[good], place[good], period[good], ahead[good]
    order = np.lexsort((place, period, owner))
    owner, place, period, ahead = owner[order], place[order], period[order], ahead[order]
    # The first pair of a run, which begins less than two periods before it.
    again = np.zeros(len(owner), dtype=bool)
    again[1:] = (owner[1:] == owner[:-1]) & (period[1:] == period[:-1]) & (place[:-1] + ahead[:-1] >= place[1:])
    owner, place, period, ahead = owner[~again], place[~again], period[~again], ahead[~again]
    back = _before(extensions, place, period, place - starts[owner])
    start, length = place - back - starts[owner], ahead + period + back
    good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    owner, start, length, period = owner[good], start[good], length[good], period[good]
    # A stretch is found with multiples of its period as well: the smallest comes first.
    order = np.lexsort((period, length, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, period = owner[first], start[first], length[first], period[first]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def _in_pieces(function, *columns: np.ndarray) -> np.ndarray:
    """``function`` of columns, AT_ONCE rows at a time."""
    parts = [function(*[c[i : i + AT_ONCE] for c in columns]) for i in range(0, len(columns[0]), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _before(extensions: Extensions, place: np.ndarray, period: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words before ``place`` still agree with those a period later: fewer than two periods, ``room`` at most.

    The last b words agree exactly if the extension from b words earlier is b or more, so b is found by halving.
    """
    low, high = np.zeros(len(place), dtype=np.int64), np.minimum(room, 2 * period)
    while True:
        open_ones = np.flatnonzero(low < high)
        if not len(open_ones):
            return low
        middle = (low[open_ones] + high[open_ones] + 1) // 2
        at = place[open_ones] - middle
        enough = _in_pieces(extensions.length, at, at + period[open_ones]) >= middle
        low[open_ones[enough]] = middle[enough]
        high[open_ones[~enough]] = middle[~enough] - 1


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run repeats: of each run its first period stays. Joined by one space."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change[:-1]) > 0
    return b" ".join(words) if not len(start) else b" ".join(w for w, d in zip(words, dropped.tolist()) if not d)


_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text, any other columns).

    Words are what blanks of ASCII separate, compared byte for byte and numbered from 0. runs holds (start, length,
    period) of all runs of ``find_runs``, by start and period; collapsed is the text without what runs repeat, words
    joined by one space. Null and empty texts have no words, no runs and an empty collapsed text. Texts are taken
    whole, in batches of bounded size; a very long text is a batch of its own and needs memory in proportion to its
    length. Repeated rows come back as often as they came; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, BATCH_BYTES):
            # bytes.split() separates at the six blanks of ASCII only.
            words = [(t.as_py() or b"").split() for t in batch.column(1).cast(pa.binary())]
            numbers: dict[bytes, int] = {}
            texts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), dtype=np.int64, count=len(ws)) for ws in words]
            owner, start, length, period = find_runs(texts)
            bounds = np.searchsorted(owner, np.arange(len(words) + 1))
            flat = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_ARROW_RUN))
            found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
            short = [collapsed(ws, *(x[a:b] for x in (start, length, period))).decode("utf-8", "replace") for ws, a, b in zip(words, bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(ws) for ws in words], pa.int64()), found, pa.array(short, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", run_type), T.StructField("collapsed", T.StringType()),
    ])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
