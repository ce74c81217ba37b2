"""JSON texts of an Arrow column as arrays of nodes, found by kernels over the bytes of the whole column.

Quotes, brackets, commas and colons are told from the bytes inside strings by running sums; brackets give each token its level
and, level by level, the container it stands in. What each token may follow says which texts are complete JSON. No text is decoded
and no element is walked on its own; only strings with escapes are decoded, those of a column by one call.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of tokens.
OPEN, CLOSE, BEGIN, END, COMMA, COLON, STRING, SCALAR = range(8)
_KIND = np.full(256, -1, np.int8)
_KIND[[ord(c) for c in "{}[],:"]] = [OPEN, CLOSE, BEGIN, END, COMMA, COLON]
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\r\n"]] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
#: Fixed value: what stands in JSON, as the standard decoder takes it, for anything but strings and containers.
_SCALARS = r"^(?:true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+\-]?[0-9]+)?)$"
#: Fixed value: blanks that are none in ASCII alone.
_SPACE = r"\s\v\x1c-\x1f\x{85}\p{Z}"


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans of a buffer as an array of strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def unescape(raw: pa.Array) -> pa.Array:
    """Strings as written between their quotes, with escapes resolved; halves of surrogate pairs are replaced."""
    has = pc.match_substring(raw, "\\")
    if not pc.any(has).as_py():
        return raw
    decoded = json.loads('["' + '","'.join(raw.filter(has).to_pylist()) + '"]')
    return pc.replace_with_mask(raw, has, pa.array([t if t.isascii() else t.encode("utf-8", "replace").decode() for t in decoded], pa.string()))


def says(texts: pa.Array) -> np.ndarray:
    """Which texts are not blank."""
    return np.asarray(pc.match_substring_regex(texts, f"[^{_SPACE}]"), bool)


class Nodes:
    """The tokens of a column of texts without nulls.

    Arrays over tokens, in order: ``kind``, ``start`` and ``end`` (bytes; of strings without quotes), ``row``, ``parent`` (the token that opens
    the container, -1 at the top), ``match`` (the closing token of an opening one), ``value`` (elements and members, not keys), ``key`` (the token of a member's key or -1).
    ``whole`` tells the rows that are complete JSON; tokens of other rows are left out. ``root`` is the token of each row's value or -1.
    """

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data, n = data, len(texts)
        self.whole = np.ones(n, bool)
        row_of = lambda at: np.searchsorted(offsets, at, "right") - 1

        quotes = np.flatnonzero(data == 0x22)
        slash = data == 0x5C
        if slash.any():
            # How many backslashes stand right before each place, none of another row.
            last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
            run = np.where(quotes > 0, quotes - 1 - last[quotes - 1], 0)
            quotes = quotes[np.minimum(run, quotes - offsets[row_of(quotes)]) % 2 == 0]
        row = row_of(quotes)
        counts = np.bincount(row, minlength=n)
        self.whole &= counts % 2 == 0
        # A row with an open string has no strings at all: it is no JSON, and must not shift the rows behind it.
        quotes, row = quotes[self.whole[row]], row[self.whole[row]]
        opened, closed = quotes[0::2], quotes[1::2]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[opened] += 1
        edge[closed + 1] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)  # quotes included
        self._check_strings(inside, slash, row_of)

        kinds = np.where(inside, -1, _KIND[data])
        marks = np.flatnonzero(kinds >= 0)
        other = ~inside & (kinds < 0) & ~_BLANK[data]
        begins = other.copy()
        begins[1:] &= ~other[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        begins[starts] = other[starts]
        stops = other.copy()
        stops[:-1] &= ~other[1:] | begins[1:]
        scalar, scalar_end = np.flatnonzero(begins), np.flatnonzero(stops) + 1

        start = np.concatenate([marks, opened + 1, scalar])
        order = np.argsort(start, kind="stable")
        self.start = start[order]
        self.end = np.concatenate([marks + 1, closed, scalar_end])[order]
        self.kind = np.concatenate([kinds[marks], np.full(len(opened), STRING), np.full(len(scalar), SCALAR)]).astype(np.int8)[order]
        self.row = row_of(self.start - (self.kind == STRING))
        self._levels(n)
        self._grammar(n)
        self._drop()

    def _check_strings(self, inside: np.ndarray, slash: np.ndarray, row_of) -> None:
        """Rows with a control character or a wrong escape in a string are no JSON."""
        data = self.data
        wrong = np.flatnonzero(inside & (data < 0x20))
        at = np.flatnonzero(slash & inside)
        if len(at):
            fresh = np.concatenate([[True], np.diff(at) > 1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            lead = at[(np.arange(len(at)) - first) % 2 == 0]  # every second of a run is itself escaped
            padded = np.concatenate([data, np.zeros(6, np.uint8)])
            bad = ~_ESCAPED[padded[lead + 1]]
            wide = padded[lead + 1] == ord("u")
            for k in range(2, 6):
                bad |= wide & ~_HEX[padded[lead + k]]
            wrong = np.concatenate([wrong, lead[bad]])
        self.whole[row_of(wrong)] = False

    def _levels(self, n: int) -> None:
        """Levels, containers and closing tokens; rows with unequal brackets are no JSON."""
        kind, row = self.kind, self.row
        opens, closes = (kind == OPEN) | (kind == BEGIN), (kind == CLOSE) | (kind == END)
        depth = np.cumsum(opens.astype(np.int64) - closes)
        first = np.searchsorted(row, np.arange(n))
        before = np.concatenate([[0], depth])[first]
        depth = depth - before[row]
        level = depth - opens
        low = np.full(n, 0, np.int64)
        np.minimum.at(low, row, level)
        end = np.searchsorted(row, np.arange(n), "right")
        there = end > first
        last = np.zeros(n, np.int64)
        last[there] = depth[end[there] - 1]
        self.whole &= there & (low >= 0) & (last == 0)
        self.parent, self.match = np.full(len(kind), -1, np.int64), np.full(len(kind), -1, np.int64)
        fine = np.flatnonzero(self.whole[row])
        order = fine[np.argsort(level[fine], kind="stable")]
        cuts = np.searchsorted(level[order], np.arange(level[fine].max(initial=-1) + 2))
        above = np.empty(0, np.int64)
        for at, to in zip(cuts, cuts[1:], strict=False):
            here = order[at:to]
            if len(above):
                self.parent[here] = above[np.searchsorted(above, here) - 1]
            own = here[opens[here]]
            shut = here[closes[here]]
            self.match[own] = shut  # opened and closed in turn
            self.match[shut] = own
            above = own
        self.level = level

    def _grammar(self, n: int) -> None:
        """Rows in which a token stands where it must not are no JSON."""
        kind, row, none = self.kind, self.row, 8
        size = len(kind)
        same = np.zeros(size, bool)
        same[1:] = row[1:] == row[:-1]
        prev = np.where(same, np.concatenate([[none], kind[:-1]]) if size else none, none)
        follows = np.concatenate([same[1:], [False]]) if size else same
        succ = np.where(follows, np.concatenate([kind[1:], [none]]) if size else none, none)
        up = self.parent
        box = np.where(up >= 0, kind[up], none)  # OPEN in an object, BEGIN in an array
        starts = np.isin(kind, (OPEN, BEGIN, STRING, SCALAR))
        ended = np.isin(prev, (CLOSE, END, STRING, SCALAR))
        self.is_key = (kind == STRING) & (box == OPEN) & ((prev == OPEN) | (prev == COMMA))
        key_before = np.concatenate([[False], self.is_key[:-1]]) if size else self.is_key
        right = np.ones(size, bool)
        right &= ~starts | np.where(box == OPEN, self.is_key | (prev == COLON), np.where(box == BEGIN, (prev == BEGIN) | (prev == COMMA), prev == none))
        right &= ~self.is_key | (succ == COLON)
        right &= (kind != COLON) | ((box == OPEN) & key_before)
        right &= (kind != COMMA) | ((box != none) & ended)
        right &= (kind != CLOSE) | (ended | (prev == OPEN))
        right &= (kind != END) | (ended | (prev == BEGIN))
        shut = (kind == CLOSE) | (kind == END)
        right &= ~shut | (self.match < 0) | (kind[self.match] == kind - 1)
        said = np.flatnonzero(kind == SCALAR)
        if len(said):
            words = gather(self.data, self.start[said], self.end[said])
            right[said] &= np.asarray(pc.match_substring_regex(words, _SCALARS), bool)
            self.null = np.zeros(size, bool)
            self.null[said] = np.asarray(pc.equal(words, "null"), bool)
        else:
            self.null = np.zeros(size, bool)
        self.whole[row[~right]] = False
        self.value = starts & ~self.is_key
        top = np.bincount(row[self.value & (up < 0)], minlength=n)
        self.whole &= top == 1

    def _drop(self) -> None:
        """Leaves out the tokens of rows that are no JSON."""
        keep = self.whole[self.row]
        new = np.cumsum(keep) - 1
        for name in ("parent", "match"):
            a = getattr(self, name)[keep]
            setattr(self, name, np.where(a >= 0, new[a], -1))
        for name in ("kind", "start", "end", "row", "value", "is_key", "null"):
            setattr(self, name, getattr(self, name)[keep])
        at = np.arange(len(self.kind))
        member = self.value & (self.parent >= 0) & (self.kind[self.parent] == OPEN)
        self.key = np.where(member, at - 2, -1)
        self.root = np.full(len(self.whole), -1, np.int64)
        top = np.flatnonzero(self.value & (self.parent < 0))
        self.root[self.row[top]] = top
        # Children by container: the values of one list array whose offsets are those of the containers.
        values = np.flatnonzero(self.value & (self.parent >= 0))
        self.children = values[np.argsort(self.parent[values], kind="stable")]
        self.first_child = np.searchsorted(self.parent[self.children], np.arange(len(self.kind) + 1))
        strings = np.flatnonzero(self.kind == STRING)
        self.text_at = np.full(len(self.kind), -1, np.int64)
        self.text_at[strings] = np.arange(len(strings))
        self.texts = unescape(gather(self.data, self.start[strings], self.end[strings]))
        leaf = np.zeros(len(self.kind), bool)
        leaf[strings] = says(self.texts)
        leaf |= (self.kind == SCALAR) & ~self.null
        leaf &= self.value
        self.leaves = np.flatnonzero(leaf)
        self._before = np.concatenate([[0], np.cumsum(leaf)])

    def last(self, nodes: np.ndarray) -> np.ndarray:
        """The last token of each node."""
        return np.where(self.match[nodes] >= 0, self.match[nodes], nodes)

    def leaf_count(self, nodes: np.ndarray) -> np.ndarray:
        """How many strings that aren't blank and scalars that aren't null each node holds; 0 for -1."""
        return np.where(nodes >= 0, self._before[self.last(nodes) + 1] - self._before[nodes], 0)

    def first_leaf(self, nodes: np.ndarray) -> np.ndarray:
        """The first such leaf of each node, -1 without one."""
        if not len(self.leaves):
            return np.full(len(nodes), -1, np.int64)
        at = self._before[np.maximum(nodes, 0)]
        found = self.leaves[np.minimum(at, len(self.leaves) - 1)]
        return np.where(self.leaf_count(nodes) > 0, found, -1)

    def text(self, nodes: np.ndarray) -> pa.Array:
        """What strings and scalars say; null for -1."""
        out = self.texts.take(pa.array(self.text_at[nodes], mask=(nodes < 0) | (self.text_at[nodes] < 0)))
        other = (nodes >= 0) & (self.text_at[nodes] < 0)
        if other.any():
            out = pc.replace_with_mask(out, pa.array(other), gather(self.data, self.start[nodes[other]], self.end[nodes[other]]))
        return out

    def named(self, names: list[str]) -> dict[str, np.ndarray]:
        """For each name, by token: the last member of that name of the object it opens, else -1. A last entry stands for no token."""
        keys = np.flatnonzero(self.key >= 0)
        codes = np.asarray(pc.fill_null(pc.index_in(self.text(self.key[keys]), value_set=pa.array(names, pa.string())), -1))
        out = {}
        for k, name in enumerate(names):
            found = np.full(len(self.kind) + 1, -1, np.int64)
            some = keys[codes == k]
            found[self.parent[some]] = some
            out[name] = found
        return out

    def lists(self, nodes: np.ndarray, boxes: tuple[int, ...] = (BEGIN,), lone: bool = True) -> pa.ListArray:
        """The children of each node as one list array; with ``lone``, another value that isn't null is a list of itself."""
        there = np.maximum(nodes, 0)
        box = (nodes >= 0) & np.isin(self.kind[there], boxes) if len(self.kind) else nodes >= 0
        alone = (nodes >= 0) & ~box & ~self.null[there] if lone and len(self.kind) else np.zeros(len(nodes), bool)
        sizes = np.where(box, self.first_child[there + 1] - self.first_child[there], alone.astype(np.int64)) if len(self.kind) else np.zeros(len(nodes), np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(nodes)), sizes)
        at = np.arange(offsets[-1]) - offsets[owner]
        found = np.where(alone[owner], nodes[owner], self.children[np.minimum(self.first_child[there[owner]] + at, max(len(self.children) - 1, 0))] if len(self.children) else nodes[owner])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int64()))
