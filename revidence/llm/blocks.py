"""Documents in blocks of bounded size, and exact counts of 64-bit keys over all blocks.

A block is a set of rows dealt by a hash of the id; a block's keys travel packed (sorted arrays, every key once with its count in the
block), dealt by hash range into buckets. So a key that every document holds is one entry a block, and what is told back
to a block are the totals of the keys it sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence.llm.common import released_group

BLOCK_BYTES = 1 << 20
KEYS = "bucket long, block long, keys binary, counts binary"
TOTALS = "block long, keys binary, counts binary"


def block_of(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), doc_id), F.lit(blocks))


def blocked(docs: DataFrame, size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(rows block, doc_id, text as UTF-8 bytes with null as empty; number of blocks of about ``size`` bytes)."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    blocks = max(1, -(-((total.b or 0) + 64 * total.n) // size))
    return docs.select(block_of(F.col("doc_id"), blocks).alias("block"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text")), blocks


def binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets) of a binary column without nulls."""
    values = column.to_pylist() if column.num_chunks != 1 else None
    if values is None:
        a = column.chunk(0)
        wide = pa.types.is_large_binary(a.type)
        offsets = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset:a.offset + len(a) + 1].astype(np.int64)
        data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
        return data[offsets[0]:offsets[-1]], offsets - offsets[0]
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def packed(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple[int, int, bytes, bytes]]:
    """Rows KEYS of a block from its sorted, distinct keys (uint64, dealt by their top bits)."""
    if not len(keys):
        return []
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(bucket[a]), block, keys[a:b].tobytes(), short(counts[a:b])) for a, b in zip([0, *cut], [*cut, len(keys)])]


def short(counts: np.ndarray) -> bytes:
    """A byte a count; those of 255 and more follow in full (uint32) in their order."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def full(data: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of ``short`` (uint32)."""
    counts = np.frombuffer(data, np.uint8, n).astype(np.uint32)
    counts[counts == 255] = np.frombuffer(data[n:], np.uint32)
    return counts


def totals(emitted: DataFrame, at_least: int = 2) -> DataFrame:
    """TOTALS: for each block the keys it sent whose counts add up to ``at_least`` over all blocks."""
    def add(t: pa.Table) -> pa.Table:
        data, ends = binary(t["keys"])
        keys, sizes = data.view(np.uint64), np.diff(ends) // 8
        counts = np.concatenate([full(c, n) for c, n in zip(t["counts"].to_pylist(), sizes)]) if len(sizes) else np.zeros(0, np.uint32)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total = np.zeros(len(k), np.uint32)
        total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(k))))
        out, blocks, at = [], t["block"].to_numpy(), 0
        for block, n in zip(blocks, sizes):
            keep = total[at:at + n] >= at_least
            if keep.any():
                out.append((int(block), keys[at:at + n][keep].tobytes(), total[at:at + n][keep].tobytes()))
            at += n
        return table(out, TOTALS)
    return emitted.select("bucket", "block", "keys", "counts").groupBy("bucket").applyInArrow(released_group(add), TOTALS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32())}


def table(rows: list[tuple], schema: str) -> pa.Table:
    """Arrow table of rows in a flat DDL schema."""
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], _TYPES[kind]) for i, (name, kind) in enumerate(fields)})


def sent(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, totals) from the TOTALS rows of one block."""
    keys, counts = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("keys", np.uint64), ("counts", np.uint32)))
    order = np.argsort(keys)
    return keys[order], counts[order]


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
    """Value of each key, ``missing`` where it is not among the sorted ``known``."""
    if not len(known):
        return np.full(len(keys), missing, values.dtype)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], values.dtype.type(missing))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of uint64 (multiply and shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
