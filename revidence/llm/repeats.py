"""Operator 3: repeated passages by a common-prefix interval tree over a distributed, sparse suffix array.

Every stretch of ``LENGTH`` bytes holds ``GRAM``-byte strings; the one with the least hash is its anchor, so equal stretches have equal
anchors at equal places. Only suffixes that start at anchors are sorted, about one in sixteen, and only those whose anchor
occurs in two documents or more:

1. Blocks of documents send the hashes of their anchors, each once; they are told which ones other documents have.
2. For those they send the suffix (up to ``LENGTH`` bytes) and the bytes before it (up to ``LENGTH - GRAM``), equal ones once with their
   smallest and largest document, dealt by the anchor.
3. A bucket sorts its suffixes, computes the common prefix of neighbours and stack-scans it: every interval of the tree is a set of
   suffixes with a common prefix. The bytes before them are sorted and stack-scanned in the same way, so intervals of the second tree
   are the sets that differ in the byte on their left. A pair of intervals whose lengths add up to LENGTH is a repeat that can be
   extended neither way, with all its occurrences. (Repeats longer than the bytes sent are chains of such groups.)
4. A block is told, for each of its suffixes, how far it repeats and the smallest document that has it.

Anchors that more than ``HOT`` documents share skip the tree: their stretches are hashed one by one, reduced to the smallest document in
the block and then over the blocks, so no task holds all their occurrences.

Rows: null and empty texts and those shorter than LENGTH keep all their bytes (0 removed). Null ids neither lose bytes nor make others lose
any. Rows repeated with one id are one document to each other (none is smaller). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revidence.llm import blocks as B
from revidence.llm.common import written

LENGTH, GRAM = 50, 20
BEFORE = LENGTH - GRAM
WIDTH = LENGTH + 1 + BEFORE + 1  # suffix, its length, bytes before it backwards, their length
HOT = 1 << 16
PIECE = 1 << 18
BLOCK_BYTES = 3 << 19
_CODE = B.mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _slide(a: np.ndarray, f) -> np.ndarray:
    """f over every BEFORE + 1 = 31 neighbours."""
    for step in (1, 2, 4, 8):
        a = f(a[:-step], a[step:])
    return f(a[:-15], a[15:])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of every stretch of LENGTH bytes inside a document."""
    places, hashes = [], []
    for a in range(0, len(data), PIECE):
        lo, hi = max(0, a - 2 * LENGTH), min(len(data), a + PIECE + 2 * LENGTH)
        if hi - lo < LENGTH:
            continue
        one = _CODE[data[lo:hi]]
        two = one[:-1] * _power(1) + one[1:]
        four = two[:-2] * _power(2) + two[2:]
        eight = four[:-4] * _power(4) + four[4:]
        sixteen = eight[:-8] * _power(8) + eight[8:]
        h = B.mixed(sixteen[:-4] * _power(4) + four[16:]) | np.uint64(1)
        least = _slide(h, np.minimum)
        first, last = np.searchsorted(offsets, [lo, hi], "right") - 1
        ends = np.repeat(offsets[first + 1:last + 2], np.diff(np.clip(offsets[first:last + 2], lo, hi)))[:len(least)] if last + 2 <= len(offsets) else \
            np.repeat(offsets[first + 1:], np.diff(np.clip(offsets[first:], lo, hi)))[:len(least)]
        least[np.arange(lo, lo + len(least)) + LENGTH > ends] = 0
        side = np.zeros(BEFORE, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([side, least, side]), np.maximum) == h)
        at = at[(at + lo >= a) & (at + lo < a + PIECE)]
        places.append(at + lo)
        hashes.append(h[at])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Block:
    """Texts of one block and their anchors."""

    def __init__(self, t: pa.Table):
        self.data, self.offsets = B.binary(t["text"])
        known = ~np.asarray(t["doc_id"].is_null())
        self.ids = [x if x is not None else None for x in t["doc_id"].to_pylist()]
        self.number = np.array([x or 0 for x in self.ids], np.int64)
        places, hashes = anchors(self.data, self.offsets)
        row = np.searchsorted(self.offsets, places, "right") - 1
        keep = known[row] if len(row) else np.zeros(0, bool)
        self.places, self.hashes, self.row = places[keep], hashes[keep], row[keep]

    def select(self, mask: np.ndarray) -> None:
        self.places, self.hashes, self.row = self.places[mask], self.hashes[mask], self.row[mask]

    def suffixes(self) -> np.ndarray:
        """WIDTH bytes for each anchor: suffix | length | bytes before, backwards | length."""
        out = np.zeros((len(self.places), WIDTH), np.uint8)
        if len(out):
            right = np.minimum(self.offsets[self.row + 1] - self.places, LENGTH)
            left = np.minimum(self.places - self.offsets[self.row], BEFORE)
            for i in range(LENGTH):
                out[:, i] = np.where(i < right, self.data[np.minimum(self.places + i, len(self.data) - 1)], 0)
            for i in range(BEFORE):
                out[:, LENGTH + 1 + i] = np.where(i < left, self.data[np.maximum(self.places - 1 - i, 0)], 0)
            out[:, LENGTH], out[:, -1] = right, left
        return out

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, rows, hashes) of the stretches around the anchors."""
        start = (self.places[:, None] - np.arange(BEFORE, -1, -1)).ravel()
        row = np.repeat(self.row, BEFORE + 1)
        keep = (start >= self.offsets[row]) & (start + LENGTH <= self.offsets[row + 1])
        start, at = np.unique(start[keep], return_index=True)
        row = row[keep][at]
        h = np.zeros(len(start), np.uint64)
        for i in range(LENGTH):
            h = h * np.uint64(_BASE) + _CODE[self.data[start + i]]
        return start, row, B.mixed(h)


def _rows(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m).view(f"V{m.shape[1]}").ravel()


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorting order, first place of each distinct row in it)."""
    order = np.lexsort(np.ascontiguousarray(np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))).view(">u8").T[::-1].astype(np.uint64))
    s = _rows(m)[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))


def common(m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix of neighbouring rows, within their lengths."""
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return np.minimum(first, np.minimum(lengths[1:], lengths[:-1])).astype(np.int64)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, common length) of every interval of the common-prefix tree over len(lcp) + 1 sorted strings: one scan with a stack."""
    stack = [(0, -1)]
    for i, depth in enumerate([*lcp, -1], 1):
        start = i - 1
        while stack[-1][1] > depth:
            start, top = stack.pop()
            yield start, i - 1, top
        if stack[-1][1] < depth:
            stack.append((start, depth))


def repeats(m: np.ndarray, smallest: np.ndarray, least: int = LENGTH) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """Maximal repeat groups among distinct, sorted suffix rows of one anchor: (members, bytes before, bytes after, smallest document)."""
    after = common(m[:, :LENGTH], m[:, LENGTH])
    for a, b, right in intervals(after.tolist()):
        if right < GRAM:
            continue
        before = m[a:b + 1, LENGTH + 1:]
        order, _ = _distinct(before)
        left_common = common(before[order][:, :BEFORE], before[order][:, BEFORE])
        if left_common.max() < least - right:
            continue
        # an interval of the second tree: its members differ in the byte on their left (or reach the end of the bytes sent)
        for c, d, left in intervals(left_common.tolist()):
            if left + right >= least:
                members = a + order[c:d + 1]
                yield members, left, right, int(smallest[members].min())


def _packed(m: np.ndarray) -> bytes:
    return pa.compress(m.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True)


SENT = "bucket long, block long, suffixes binary, number binary, low binary, high binary"
TOLD = "block long, kind long, keys binary, counts binary"


def answers(t: pa.Table) -> pa.Table:
    """For each block: number of its suffix, bytes before, bytes after and smallest document, where larger ones must go."""
    blob = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
    number, low, high = blob("number", np.int32), blob("low", np.int64), blob("high", np.int64)
    m = np.frombuffer(b"".join(_unpacked(x, len(n) // 4 * WIDTH) for x, n in zip(t["suffixes"].to_pylist(), t["number"].to_pylist())), np.uint8).reshape(-1, WIDTH)
    block = np.repeat(t["block"].to_numpy(), [len(x.as_py()) // 4 for x in t["number"]])
    order, first = _distinct(m)
    group = np.empty(len(m), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(m))))
    smallest = np.minimum.reduceat(low[order], first)
    rows = m[order[first]]
    # whole suffixes that a smaller document has, too
    hit = np.flatnonzero(high > smallest[group])
    found = [np.stack([hit, np.full(len(hit), BEFORE), np.full(len(hit), LENGTH), smallest[group[hit]]], 1)]
    # the rest: anchors with several different suffixes. The smallest document of a suffix may meet a smaller one in a shorter string
    owner = np.flatnonzero(low == smallest[group])
    owner = owner[np.argsort(group[owner], kind="stable")]
    begin = np.searchsorted(group[owner], np.arange(len(rows) + 1))
    same = common(rows[:, :LENGTH], rows[:, LENGTH]) >= GRAM
    edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(rows)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a < 2 or smallest[a:b].min() == smallest[a:b].max():
            continue
        # larger documents of a suffix are covered already, so the smallest one needs the longest strings alone
        best: dict[int, dict[int, int]] = {}
        for members, left, right, low_doc in repeats(rows[a:b], smallest[a:b]):
            for i in members[smallest[a:b][members] > low_doc].tolist():
                reach = best.setdefault(i, {})
                reach[left] = max(reach.get(left, 0), right)
        for i, reach in best.items():
            furthest = 0
            for left in sorted(reach, reverse=True):
                if reach[left] > furthest:
                    furthest = reach[left]
                    found += [np.array([[o, left, furthest, smallest[a + i] - 1]]) for o in owner[begin[a + i]:begin[a + i + 1]]]
    found = np.concatenate(found)
    found = found[np.argsort(block[found[:, 0]], kind="stable")]
    out = []
    cut = np.flatnonzero(np.diff(block[found[:, 0]])) + 1 if len(found) else []
    for part in np.split(found, cut) if len(found) else []:
        told = np.stack([number[part[:, 0]], part[:, 1], part[:, 2], part[:, 3]], 1).astype(np.int64)
        out.append((int(block[part[0, 0]]), 1, told.tobytes(), b""))
    return B.table(out, TOLD)


def least_documents(t: pa.Table) -> pa.Table:
    """For each block: the stretches (hash) that a smaller document has, and that document."""
    blob = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
    keys, low, high = blob("suffixes", np.uint64), blob("low", np.int64), blob("high", np.int64)
    block = np.repeat(t["block"].to_numpy(), [len(x.as_py()) // 8 for x in t["low"]])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    smallest = np.empty(len(keys), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(keys))))
    out = []
    for b in np.unique(block):
        at = np.flatnonzero((block == b) & (high > smallest))
        if len(at):
            out.append((int(b), 2, np.stack([keys[at].view(np.int64), smallest[at]], 1).tobytes(), b""))
    return B.table(out, TOLD)


def _ends(rank: np.ndarray, n: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, rank, docs)
    np.maximum.at(high, rank, docs)
    return low, high


RESULT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def without_repeats(docs: DataFrame, *, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed runs, kept (the remaining bytes) for each row."""
    rows, count = B.blocked(docs, block_bytes)
    buckets = max(8, count)

    def first(t: pa.Table) -> pa.Table:
        b = Block(t)
        order = np.lexsort((b.number[b.row], b.hashes))
        h, d = b.hashes[order], b.number[b.row][order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
        return B.table(B.packed(t["block"][0].as_py(), *np.unique(h[new], return_counts=True), buckets), B.KEYS)
    shared = B.totals(rows.groupBy("block").applyInArrow(first, B.KEYS)).select("block", F.lit(0).cast("long").alias("kind"), "keys", "counts")
    shared = written(shared, "repeat-anchors")

    def split(t: pa.Table, more: pa.Table) -> tuple[Block, Block]:
        """The block with its shared anchors, and with its hot ones."""
        known, total = B.sent(more.filter(pa.array(more["kind"].to_numpy() == 0)))
        b, z = Block(t), Block(t.slice(0, 0))
        of = B.look_up(b.hashes, known, total, 0)
        z.__dict__.update(b.__dict__)
        b.select((of > 1) & (of <= hot))
        z.select(of > hot)
        return b, z

    def second(t: pa.Table, more: pa.Table) -> pa.Table:
        out = []
        if len(t):
            block = t["block"][0].as_py()
            b, z = split(t, more)
            if len(b.places):
                m = b.suffixes()
                order, at = _distinct(m)
                rank = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(m))))
                low, high = _ends(rank, len(at), b.number[b.row][order])
                bucket = (((b.hashes[order[at]] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                for k in np.unique(bucket):
                    i = np.flatnonzero(bucket == k)
                    out.append((int(k), block, _packed(m[order[at[i]]]), i.astype(np.int32).tobytes(), low[i].tobytes(), high[i].tobytes()))
            if len(z.places):
                _, row, h = z.stretches()
                keys, rank = np.unique(h, return_inverse=True)
                low, high = _ends(rank, len(keys), z.number[row])
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                for k in np.unique(bucket):
                    i = np.flatnonzero(bucket == k)
                    out.append((-1 - int(k), block, keys[i].tobytes(), b"", low[i].tobytes(), high[i].tobytes()))
        return B.table(out, SENT)

    def third(t: pa.Table) -> pa.Table:
        return answers(t) if t["bucket"][0].as_py() >= 0 else least_documents(t)

    def last(t: pa.Table, more: pa.Table) -> pa.Table:
        if not len(t):
            return B.table([], RESULT)
        b, z = split(t, more)
        blob = lambda kind: b"".join(more.filter(pa.array(more["kind"].to_numpy() == kind))["keys"].to_pylist())
        n = len(b.data)
        mark = np.zeros(n + 1, np.int64)
        told = np.frombuffer(blob(1), np.int64).reshape(-1, 4)
        if len(told):
            m = b.suffixes()
            order, at = _distinct(m)
            sizes = np.diff(np.append(at, len(m)))[told[:, 0]]
            each = np.repeat(np.arange(len(told)), sizes)
            o = order[np.repeat(at[told[:, 0]], sizes) + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            keep = b.number[b.row[o]] > told[each, 3]
            o, each = o[keep], each[keep]
            np.add.at(mark, b.places[o] - np.minimum(told[each, 1], m[o, -1]), 1)
            np.add.at(mark, b.places[o] + np.minimum(told[each, 2], m[o, LENGTH]), -1)
        told = np.frombuffer(blob(2), np.int64).reshape(-1, 2)
        if len(told):
            order = np.argsort(told[:, 0].view(np.uint64))
            start, row, h = z.stretches()
            low = B.look_up(h, told[order, 0].view(np.uint64), told[order, 1], np.iinfo(np.int64).max)
            start = start[z.number[row] > low]
            np.add.at(mark, start, 1)
            np.add.at(mark, start + LENGTH, -1)
        gone = np.cumsum(mark[:n]) > 0
        edge = np.zeros(n + 1, bool)
        edge[b.offsets] = True
        before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
        starts = np.flatnonzero(gone & (~before | edge[:-1])) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(gone & (~after | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        cut = np.searchsorted(starts, b.offsets)
        out = []
        for i, doc_id in enumerate(b.ids):
            x, y = b.offsets[i], b.offsets[i + 1]
            out.append((doc_id, int(y - x), (starts[cut[i]:cut[i + 1]] - x).tolist(), (ends[cut[i]:cut[i + 1]] - x).tolist(), b.data[x:y][~gone[x:y]].tobytes()))
        return B.table(out, RESULT)

    told = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(second, SENT).groupBy("bucket").applyInArrow(third, TOLD)
    return rows.groupBy("block").cogroup(shared.unionByName(told).groupBy("block")).applyInArrow(last, RESULT)
