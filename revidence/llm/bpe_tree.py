"""Operator 8: byte-level BPE by monoid tree reduction.

A text is cut by the tokenizer's pattern; every match is encoded by itself, so that level is a plain concatenation.
Inside a match the tokens of its two halves, found recursively, are joined: a window at the seam is encoded again and grown until
the tokens on its edges are compatible with their neighbours outside. Two neighbours are compatible when encoding their
bytes gives these two tokens again; a sequence of tokens all of whose neighbours are compatible is the encoding of its
bytes, so nothing outside the window can change. Decoding concatenates the tokens' bytes pairwise up a tree.

Rows: null and empty texts have no tokens and decode to nothing. Whole texts are encoded, in pieces; memory per task is one Arrow
batch, and caches of at most ``CACHE`` bytes (matches) and ``PARTS`` entries (short parts and windows). Repeated rows are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from revidence.llm.common import released

#: Bytes of matches and their ids that a worker keeps, with OVERHEAD an entry for the objects; entries of short parts and of windows.
CACHE, OVERHEAD, PARTS = 96 << 20, 240, 200_000
#: Longest part that is kept, in bytes, and longest window, in tokens. Longer ones seldom come again.
PART, WINDOW = 8, 4
#: Longest window that is scanned for its next pair.
SCAN = 48
#: Bytes of output that a task gathers before it hands them on.
CHUNK = 8 << 20


class Tokenizer:
    """Ranks of a rank file (token in base 64, rank) and the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.none = 1 + max(self.bytes_of)                       # above all ranks
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.matches = _Matches(self)

    def merge(self, data: bytes) -> list[int]:
        """BPE of a window: the pair of lowest rank first, the leftmost of equals. A short window is scanned, a long one has a heap."""
        n = len(data)
        if n <= SCAN:
            rank, none = self.ranks, self.none
            parts = [data[i:i + 1] for i in range(n)]
            pairs = [rank.get(data[i:i + 2], none) for i in range(n - 1)]
            while pairs and (r := min(pairs)) < none:
                i = pairs.index(r)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = rank.get(parts[i] + parts[i + 1], none)
                if i:
                    pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            return [rank[p] for p in parts]
        parts = [data[i:i + 1] for i in range(n)]
        after, before, rank = [*range(1, n + 1)], [*range(-1, n - 1)], self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or rank.get(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (s, h))
        return [rank[p] for p in parts if p is not None]

    def window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of these tokens. Two tokens are compatible when it is the tokens themselves."""
        known = self.windows.get(ids)
        if known is None:
            known = tuple(self.merge(b"".join(map(self.bytes_of.__getitem__, ids))))
            if len(ids) <= WINDOW:
                if len(self.windows) >= PARTS:
                    self.windows.clear()
                self.windows[ids] = known
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the concatenation from the encodings of both sides."""
        if not left or not right:
            return left + right
        i = j = 1
        ids = left[-1:] + right[:1]
        window = self.window(ids)
        if window == ids:
            return left + right
        while True:
            left_open = i < len(left) and self.window(pair := (left[-i - 1], window[0])) != pair
            right_open = j < len(right) and self.window(pair := (window[-1], right[j])) != pair
            if not left_open and not right_open:
                return left[:len(left) - i] + window + right[j:]
            i, j = min(len(left), 2 * i if left_open else i), min(len(right), 2 * j if right_open else j)
            window = self.window(left[len(left) - i:] + right[:j])

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Encoding of one match: halves are cut at a power of two, so that long runs keep their beat."""
        n = len(data)
        if n > PART:
            cut = 1 << ((n - 1).bit_length() - 1)
            return self.join(self.tree(data[:cut]), self.tree(data[cut:]))
        known = self.parts.get(data)
        if known is None:
            if n == 1:
                known = (self.ranks[data],)
            else:
                cut = 1 << ((n - 1).bit_length() - 1)
                known = self.join(self.tree(data[:cut]), self.tree(data[cut:]))
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[data] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i:i + 4096].tolist())) for i in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Matches(dict):
    """Match -> its ids; a match that is a token is that token. When half of CACHE is full, what is held becomes the older half: a match found
    there comes back, so that frequent ones stay."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.held, self.older = tokenizer, 0, {}

    def __missing__(self, match: str) -> bytes:
        out = self.older.get(match)
        if out is None:
            data, t = match.encode(), self.tokenizer
            whole = t.ranks.get(data)
            out = np.array(t.tree(data) if whole is None else (whole,), "<u4").tobytes()
            if len(data) > 64:
                return out
        if self.held >= CACHE // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[match] = out
        self.held += OVERHEAD + len(match) + len(out)
        return out


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One a worker process, until the task that uses it ends."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(path, pattern)
    return _loaded[path, pattern]


def _each(batches: Iterator[pa.RecordBatch], column: str, names: list[str], make) -> Iterator[pa.RecordBatch]:
    """Batches with the columns of ``names`` from ``make``(value) added, of about CHUNK bytes."""
    for b in batches:
        values, start, held, rows = b.column(column), 0, 0, []
        for i in range(len(b)):
            rows.append(make(values[i].as_py()))
            held += sum(len(x) for x in rows[-1] if isinstance(x, bytes))
            if held > CHUNK or i == len(b) - 1:
                part = b.slice(start, i + 1 - start)
                made = [pa.array([r[c] for r in rows], pa.binary() if isinstance(rows[0][c], bytes) else pa.int64()) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays(part.columns + made, names=[*part.schema.names, *names])
                start, held, rows = i + 1, 0, []


def encode(docs: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens. ``path`` is read on every executor."""
    def run(batches):
        t = tokenizer(path, pattern)

        def make(text: str | None) -> tuple[bytes, int]:
            ids = t.encode(text or "")
            return ids, len(ids) // 4
        for b in _each(batches, "text", ["ids", "n_tokens"], make):
            yield b.select(["doc_id", "ids", "n_tokens"])
        _loaded.clear()  # the worker process may live on, for other work
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long")


def decode(encoded: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded (binary) from rows with column ids."""
    def run(batches):
        t = tokenizer(path, pattern)
        yield from _each(batches, "ids", ["decoded"], lambda ids: (t.decode(np.frombuffer(ids or b"", "<u4")),))
        _loaded.clear()
    rows = encoded.select("doc_id", "ids", "n_tokens")
    return rows.mapInArrow(released(run), StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded and its ids decoded in one worker, which hands on digests only."""
    def run(batches):
        t = tokenizer(path, pattern)
        for b in batches:
            rows = []
            for text in b.column(1):
                ids = t.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(np.frombuffer(ids, "<u4"))).hexdigest()))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _loaded.clear()
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
