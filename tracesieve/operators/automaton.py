"""Exact search and replacement of many literals in one reading of the text.

An Aho-Corasick automaton in flat arrays: edges are sorted by (state, byte) and edge ``i`` leads to
state ``i + 1``, so the goto function is a binary search; the states of the first two levels have a
dense table instead. It is built level by level and sent to the executors once.

A batch of texts is read as one Arrow buffer. A bitmap of the literals' first bytes gives the places
where one can start; from there, several thousand lanes step through the buffer together, and a lane
that falls back to the root skips to the next such place. Each byte is read by one lane, or by two
near a border, whatever the literals have in common.

Of occurrences that overlap, those of the longest literal count, from left to right; so no literal is
broken by a part of it. Replacing by place never touches what was put in before.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANES = 2048
SLICE_BYTES = 1 << 22

FOUND = pa.struct([("replacement", pa.string()), ("count", pa.int64())])
REDACTED = pa.struct([("text", pa.string()), ("found", pa.list_(FOUND))])
PRESENT = pa.struct([("value", pa.string()), ("replacement", pa.string())])


class Automaton:
    """Automaton of distinct, non-empty byte strings, the most important first: longer before shorter."""

    def __init__(self, values: Sequence[bytes]):
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.longest = int(self.sizes.max()) if len(values) else 0
        data = np.frombuffer(b"".join(values), np.uint8).astype(np.int64)
        begin = np.cumsum(self.sizes) - self.sizes
        states, levels, total, depth = np.zeros(len(values), np.int64), [], 1, 0
        going, edges = np.arange(len(values)), []
        while len(going):
            keys, back = np.unique(states[going] * 256 + data[begin[going] + depth], return_inverse=True)
            edges.append(keys)
            states[going] = total + back
            levels.append((total, total + len(keys)))
            total += len(keys)
            depth += 1
            going = going[self.sizes[going] > depth]
        #: edge i: state of origin * 256 + byte, ascending
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        #: the literal that ends in a state, or -1
        self.ends = np.full(total, -1, np.int32)
        self.ends[states] = np.arange(len(values))
        self.fail, self.link = np.zeros(total, np.int32), np.zeros(total, np.int32)
        self.shallow = levels[0][1] if levels else 1
        self.dense = np.zeros((self.shallow, 256), np.int32)
        for key, target in zip(self.edges[: self.shallow - 1].tolist(), range(1, self.shallow)):
            self.dense[0, key] = target
        self.dense[1:] = self.dense[0]
        if len(levels) > 1:
            first, last = levels[1]
            keys = self.edges[first - 1 : last - 1]
            self.dense[keys >> 8, keys & 255] = np.arange(first, last)
        for first, last in levels[1:]:
            keys = self.edges[first - 1 : last - 1]
            fail = self._next(self.fail[keys >> 8].astype(np.int64), keys & 255)
            self.fail[first:last] = fail
            self.link[first:last] = np.where(self.ends[fail] >= 0, fail, self.link[fail])
        self.speaks = (self.ends >= 0) | (self.link > 0)
        self.width = min(4, int(self.sizes.min())) if len(values) else 1
        bits = 16
        while bits < 24 and (1 << bits) < 32 * len(values):
            bits += 1
        self.shift = np.uint32(32 - bits)
        self.starts = np.zeros(1 << bits, bool)
        heads = np.frombuffer(b"".join(v[: self.width] for v in values), np.uint8).reshape(-1, self.width)
        self.starts[self._slots([heads[:, k] for k in range(self.width)])] = True

    def _slots(self, columns: list[np.ndarray]) -> np.ndarray:
        code = np.zeros(len(columns[0]), np.uint32)
        for k, column in enumerate(columns):
            code |= column.astype(np.uint32) << np.uint32(8 * k)
        return (code * np.uint32(0x9E3779B1)) >> self.shift

    def _next(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after one more byte, by goto where there is an edge, by fail where there is none."""
        out, here = np.zeros(len(states), np.int64), states.copy()
        left = np.arange(len(states))
        while len(left):
            flat = here[left] < self.shallow
            near = left[flat]
            out[near] = self.dense[here[near], codes[near]]
            left = left[~flat]
            if not len(left):
                break
            keys = here[left] * 256 + codes[left]
            at = np.searchsorted(self.edges, keys)
            hit = self.edges[np.minimum(at, len(self.edges) - 1)] == keys
            out[left[hit]] = at[hit] + 1
            left = left[~hit]
            here[left] = self.fail[here[left]]
        return out

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, literals) of all occurrences that lie within one row, in no order."""
        begins, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low, high = int(offsets[0]), int(offsets[-1])
        for at in range(low, high if len(self.sizes) else low, SLICE_BYTES):
            stop = min(at + SLICE_BYTES, high)
            piece = data[at : min(stop + self.longest - 1, high)]
            n = min(stop - at, len(piece) - self.width + 1)
            if n <= 0:
                continue
            places = np.flatnonzero(self.starts[self._slots([piece[k : n + k] for k in range(self.width)])])
            if len(places):
                found, literals = self._walk(piece, places)
                begins.append(found + at)
                which.append(literals)
        starts, literals = np.concatenate(begins), np.concatenate(which)
        rows = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts + self.sizes[literals] <= offsets[rows + 1] if len(starts) else np.zeros(0, bool)
        return starts[inside], literals[inside]

    def _walk(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that start at one of ``places``. A lane has the starts from its own first place up
        to the next lane's, and goes on beyond that for as long as one of them can last."""
        borders = places[:: -(-len(places) // LANES)]
        limits = np.concatenate((borders[1:], [len(data)]))
        places = np.concatenate((places, [len(data)]))
        at, states, lanes = borders.copy(), np.zeros(len(borders), np.int64), np.arange(len(borders))
        ends, seen, who = [], [], []
        while len(lanes):
            states = self._next(states, data[at].astype(np.int64))
            at = at + 1
            speaking = np.flatnonzero(self.speaks[states])
            if len(speaking):
                ends.append(at[speaking])
                seen.append(states[speaking])
                who.append(lanes[speaking])
            idle = np.flatnonzero(states == 0)
            at[idle] = places[np.searchsorted(places, at[idle])]
            # Whatever is under way when a lane has gone this far started in the next one.
            last = np.where(states == 0, limits[lanes], np.minimum(limits[lanes] + self.longest - 1, len(data)))
            on = at < last
            at, states, lanes = at[on], states[on], lanes[on]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, state, lane = np.concatenate(ends), np.concatenate(seen), np.concatenate(who)
        starts, literals = [], []
        while len(state):
            literal = self.ends[state].astype(np.int64)
            start = end - self.sizes[literal]
            good = (literal >= 0) & (start >= borders[lane]) & (start < limits[lane])
            starts.append(start[good])
            literals.append(literal[good])
            state = self.link[state].astype(np.int64)
            on = state > 0
            end, state, lane = end[on], state[on], lane[on]
        return np.concatenate(starts), np.concatenate(literals)

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, literals) of the occurrences to replace, from left to right. Literals go before others
        by their length in characters, then by their order."""
        starts, literals = self.occurrences(data, offsets)
        order = np.lexsort((literals, starts))
        starts, literals = starts[order], literals[order]
        ends = starts + self.sizes[literals]
        if (ends[:-1] <= starts[1:]).all():
            return starts, literals
        taken = np.zeros(int(offsets[-1] - offsets[0]), bool)
        chosen = []
        # What is taken is at least as long as what comes now, so an overlap shows at one of its ends.
        for k in np.lexsort((starts, literals)).tolist():
            first, last = int(starts[k] - offsets[0]), int(ends[k] - offsets[0])
            if not (taken[first] or taken[last - 1]):
                taken[first:last] = True
                chosen.append(k)
        chosen.sort()
        return starts[chosen], literals[chosen]


def row_offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of the rows in the data buffer, one more than there are rows."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)
    return offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a batch without text has no bytes."""
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8), row_offsets(texts)


def redact(texts: pa.Array, automaton: Automaton, replacements: Sequence[str]) -> pa.Array:
    """``struct<text, found>`` of each text: literals replaced by place, and how often each was. Null
    texts stay null."""
    data, offsets = buffer_of(texts)
    starts, literals = automaton.places(data, offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    raw = [r.encode("utf-8") for r in replacements]
    if len(starts):
        view, pieces, at = memoryview(data), [], int(offsets[0])
        for start, literal, size in zip(starts.tolist(), literals.tolist(), automaton.sizes[literals].tolist()):
            pieces += (view[at:start], raw[literal])
            at = start + size
        pieces.append(view[at : int(offsets[-1])])
        gain = np.array([len(r) for r in raw], np.int64)[literals] - automaton.sizes[literals]
        moved = np.concatenate(([0], np.cumsum(np.bincount(rows, gain, len(texts)).astype(np.int64))))
        ends = offsets - offsets[0] + moved
        valid = pc.is_valid(texts).buffers()[1] if texts.null_count else None
        out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(pieces)), valid)
    else:
        out = texts.cast(pa.string())
    pairs, counts = np.unique(rows * max(len(raw), 1) + literals, return_counts=True)
    owners, which = (pairs // max(len(raw), 1)).astype(np.int64), (pairs % max(len(raw), 1)).astype(np.int64)
    names = pa.array(replacements, pa.string()).take(pa.array(which))
    found = pa.StructArray.from_arrays([names, pa.array(counts.astype(np.int64))], fields=list(FOUND))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(len(texts) + 1)).astype(np.int32)), found)
    return pa.StructArray.from_arrays([out, lists], fields=list(REDACTED))


def present(texts: pa.Array, automaton: Automaton, values: Sequence[str], replacements: Sequence[str]) -> pa.Array:
    """For each text the literals that occur in it, as ``struct<value, replacement>``, in their order."""
    data, offsets = buffer_of(texts)
    starts, literals = automaton.occurrences(data, offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    pairs = np.unique(rows * max(len(values), 1) + literals)
    owners, which = pairs // max(len(values), 1), pa.array((pairs % max(len(values), 1)).astype(np.int64))
    columns = [pa.array(column, pa.string()).take(which) for column in (values, replacements)]
    found = pa.StructArray.from_arrays(columns, fields=list(PRESENT))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(len(texts) + 1)).astype(np.int32)), found)
