"""Operator 13: phrase collocation mining over Rabin-Karp fingerprints.

Texts are gathered in blocks of one language; a block keeps its words as numbers into its own dictionary, so that equality inside a
block is exact. Words get polynomial fingerprints of their bytes, phrases polynomial fingerprints of their words: numpy prefix sums give
the fingerprint of every n-gram at once. Two rounds, for the lengths of ROUNDS:

1. Blocks send the fingerprints of their distinct n-grams with counts, packed and dealt by fingerprint, and hear back a bit each: does
   it reach ``at_least`` over all blocks? Only those are extended to the next round's lengths (a phrase is never more frequent than its
   parts), so nearly all fingerprints travel once and no text does.
2. Of what is left, blocks send the fingerprint with a second one over other bases and the counts are summed over both, so that phrases
   which share a fingerprint are told apart. Inside a block occurrences are compared word by word. The lowest block that holds a
   phrase has the occurrence pointer and writes its text; where a collision leaves a phrase without a text, a block that holds it is
   asked for it. Only frequent phrases are ever written out.

A phrase is known by its bucket and two 32-bit values; buckets grow in number with the text, and so does the length of what is compared.

Rows: a null text is empty, a null language is ``und``. Very long texts make a block of their own and are never cut; n-grams do not
cross pieces, documents or languages. Ties are ordered by the phrase. Repeated rows count each. Only the named columns are read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revidence.llm.blocks import binary, mixed, table
from revidence.llm.common import released, released_group, written

BLOCK_BYTES = 4 << 20
#: Odd bases modulo 2^64 of the polynomials over bytes and over words, of the fingerprint and of the one that tells collisions apart.
BYTE_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORD_BASES = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Lengths of phrases that are counted in one round.
ROUNDS = (1, 2), (3, 4, 5)
#: One table holds four kinds of rows: a block; its fingerprints of a bucket; what is left of them, with second fingerprints; its phrases.
STATE, KEYS, CHECKS, PHRASES = 0, 1, 2, 3
ROWS = ("kind int, block long, lang string, bucket long, keys binary, counts binary, checks binary, words binary, lengths binary, codes binary, n long, "
        "phrases array<struct<n:int,phrase:string,key:long,check:long>>")
TOLD = "block long, bucket long, size int, enough binary, first binary"
SUMS = "block long, key long, check long, f long"

_WORD, _SPACE, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def fingerprints(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Fingerprint of each values[start:end] (uint64, modulo 2^64): a difference of prefix sums of value * base^-i, shifted to its start."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_inverse(base), len(values)), dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(base, len(values) + 1)[starts]


def numbered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct words, their ends, codes) of UTF-8 bytes: codes are 1 + the word's number, 0 between pieces."""
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == _WORD, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    cuts = np.concatenate([[0], np.cumsum(kind == _CUT)])
    new = np.zeros(len(starts), bool)
    new[1:] = cuts[starts[1:]] != cuts[ends[:-1]]                       # a separator between this word and the one before
    letters = np.ascontiguousarray(_LOWER[data[inside[1:-1]]])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    words, word_ends = binary(pa.chunked_array([coded.dictionary]))
    codes = np.zeros(len(starts) + int(new.sum()), np.uint32)
    codes[np.arange(len(starts)) + np.cumsum(new)] = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + 1
    return words, word_ends[1:], codes


def _prints(words: np.ndarray, lengths: np.ndarray, lang: str, which: int) -> np.ndarray:
    """Fingerprint of each word, seeded by the language; 0 for the code 0."""
    ends = np.cumsum(lengths)
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    h = fingerprints(words.astype(np.uint64) + np.uint64(1), ends - lengths, ends, BYTE_BASES[which])
    return np.concatenate([np.zeros(1, np.uint64), mixed(mixed(h ^ lengths.astype(np.uint64)) ^ seed)])


def _grams(codes: np.ndarray, prints: np.ndarray, at: np.ndarray, n: int, which: int) -> np.ndarray:
    """Fingerprints of the n-grams at the given places."""
    return mixed(fingerprints(prints[codes], at, at + n, WORD_BASES[which]) + np.uint64(n))


def _places(codes: np.ndarray, n: int, good: np.ndarray | None) -> np.ndarray:
    """Where n-grams without a 0 stand; with ``good`` (places of good m-grams, m < n) those all of whose m-grams are good."""
    if len(codes) < n:
        return np.zeros(0, np.int64)
    if good is None:
        free = np.concatenate([[0], np.cumsum(codes == 0)])
        return np.flatnonzero(free[n:] == free[:-n])
    m, marks = good
    seen = np.concatenate([[0], np.cumsum(marks)])
    width = n - m + 1
    return np.flatnonzero(seen[width:len(codes) - m + 2] - seen[:len(codes) - n + 1] == width)


def _dealt(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """bucket << 32 | 32-bit key of fingerprints: top and low half."""
    key = h & np.uint64((1 << bits) - 1)
    return ((((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | key


def _planes(values: np.ndarray) -> bytes:
    """32-bit values as four planes of bytes: the high ones are nearly all zero and compress away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _buckets_of(dealt: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted dealt keys."""
    bucket = (dealt >> np.uint64(32)).astype(np.int64)
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)] if len(bucket) else [0]
    for a, b in zip(cut, cut[1:]):
        yield int(bucket[a]), a, b


def _packed_keys(dealt: np.ndarray) -> bytes:
    """Sorted keys of one bucket as differences."""
    return _planes(np.diff(dealt & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)))


def _keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


def _rows(rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ", 1) for f in ROWS.split(", ")]
    phrase = pa.list_(pa.struct([("n", pa.int32()), ("phrase", pa.string()), ("key", pa.int64()), ("check", pa.int64())]))
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds.get(kind, phrase)) for name, kind in fields})


def _state(block: int, lang: str, words: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> dict:
    return {"kind": STATE, "block": block, "lang": lang, "words": words.tobytes(), "lengths": _planes(lengths), "n": int(np.count_nonzero(codes)),
            "codes": pa.compress(codes.astype("<u4"), "zstd", asbytes=True), "bucket": len(codes)}


def _of_state(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = pa.decompress(row["codes"], 4 * row["bucket"], "zstd", asbytes=True)
    return np.frombuffer(row["words"], np.uint8), _from_planes(row["lengths"]).astype(np.int64), np.frombuffer(codes, "<u4")


def _round(codes: np.ndarray, prints: np.ndarray, lengths: tuple[int, ...], good, buckets: int, bits: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """([(n, places)], dealt keys of all of them in that order)."""
    places = [(n, _places(codes, n, good)) for n in lengths]
    return places, np.concatenate([np.zeros(0, np.uint64), *[_dealt(_grams(codes, prints, at, n, 0), buckets, bits) for n, at in places]])


def _key_rows(block: int, lang: str, dealt: np.ndarray) -> Iterator[dict]:
    keys, counts = np.unique(dealt, return_counts=True)
    for bucket, a, b in _buckets_of(keys):
        yield {"kind": KEYS, "block": block, "lang": lang, "bucket": bucket, "keys": _packed_keys(keys[a:b]), "counts": _planes(counts[a:b])}


def gather(docs: DataFrame, lengths: tuple[int, ...], buckets: int, size: int, bits: int) -> DataFrame:
    """ROWS: texts as blocks of about ``size`` bytes of one language, and the fingerprints of the first round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        bytes_of: dict[str, int] = {}
        task, made = TaskContext.get().partitionId(), 0

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            words, ends, codes = numbered(np.frombuffer(b"\n".join(held.pop(lang)), np.uint8))
            del bytes_of[lang]
            block, made, sizes = (task << 32) + made, made + 1, np.diff(ends, prepend=0)
            dealt = _round(codes, _prints(words, sizes, lang, 0), lengths, None, buckets, bits)[1]
            yield from _rows([_state(block, lang, words, sizes, codes), *_key_rows(block, lang, dealt)]).to_batches()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                name, data = lang.as_py(), text.as_buffer()
                held.setdefault(name, []).append(data.to_pybytes() if data is not None else b"")
                bytes_of[name] = bytes_of.get(name, 0) + len(held[name][-1])
                if bytes_of[name] >= size or sum(bytes_of.values()) >= 4 * size:
                    yield from flush(max(bytes_of, key=bytes_of.get))
        for lang in list(held):
            yield from flush(lang)
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(released(run), ROWS)


def frequent(rows: DataFrame, at_least: int) -> DataFrame:
    """TOLD: a row for each KEYS row, a bit a key: do its counts add up to ``at_least``, and is this the lowest block that has it."""
    def add(t: pa.Table) -> pa.Table:
        sent = sorted(zip(*[t[c].to_pylist() for c in ("block", "bucket", "keys", "counts")]))
        keys, counts = np.concatenate([_keys_of(r[2]) for r in sent]), np.concatenate([_from_planes(r[3]) for r in sent])
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, back, counts.astype(np.int64))
        enough, owns, at, out = (total >= at_least)[back], np.zeros(len(keys), bool), 0, []
        owns[first] = True
        for block, bucket, data, _ in sent:
            n = len(data) // 4
            out.append((block, bucket, n, np.packbits(enough[at:at + n]).tobytes(), np.packbits(owns[at:at + n]).tobytes()))
            at += n
        return table(out, TOLD)
    return rows.where(F.col("kind") == KEYS).select("bucket", "block", "keys", "counts").groupBy("bucket").applyInArrow(released_group(add), TOLD)


def _phrases(words: np.ndarray, lengths: np.ndarray, grams: np.ndarray) -> list[str]:
    """Texts of n-grams of codes, words joined by a space."""
    data, ends = words.tobytes(), np.cumsum(lengths)
    used, back = np.unique(grams, return_inverse=True)
    said = [data[ends[i - 1] - lengths[i - 1]:ends[i - 1]].decode() for i in used]
    return [" ".join([said[j] for j in row]) for row in back.reshape(grams.shape).tolist()]


def _groups(codes: np.ndarray, at: np.ndarray, n: int, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence, count) of each n-gram among those at ``at``: one a key, told apart by their words where keys collide."""
    grams = codes[at[:, None] + np.arange(n)]
    _, first, back, counts = np.unique(dealt, return_index=True, return_inverse=True, return_counts=True)
    if (grams != grams[first[back]]).any():
        _, first, counts = np.unique(grams, axis=0, return_index=True, return_counts=True)
    return first, counts


def advance(rows: DataFrame, told: DataFrame, lengths: tuple[int, ...], good: int | None, after: tuple[int, ...], buckets: int, bits: int) -> DataFrame:
    """ROWS of the next round: CHECKS of what is frequent, PHRASES of it where this block is the lowest, KEYS of the lengths ``after`` all of whose
    parts of max(``lengths``) words are frequent, and the block with its other words set to 0. ``good``: parts of that many words, where they have no 0 inside, were
    frequent in the round before."""
    def step(state: pa.Table, told: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _rows([])
        row = state.to_pylist()[0]
        block, lang = row["block"], row["lang"]
        words, sizes, codes = _of_state(row)
        prints = _prints(words, sizes, lang, 0)
        marked = _marks(row, codes, good)
        places, dealt = _round(codes, prints, lengths, marked, buckets, bits)
        keys, back = np.unique(dealt, return_inverse=True)
        answers = sorted(zip(*[told[c].to_pylist() for c in ("bucket", "size", "enough", "first")]))
        bit = lambda k: np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(x[k], np.uint8), count=x[1]).astype(bool) for x in answers]])
        enough, owns = bit(2), bit(3)
        if len(enough) != len(keys):
            raise RuntimeError(f"block {block}: {len(enough)} answers to {len(keys)} fingerprints")
        second = _prints(words, sizes, lang, 1)
        out, sent, done, top = [], [], 0, None
        for n, at in places:
            mine = back[done:done + len(at)]
            done += len(at)
            hit = enough[mine]
            at, mine = at[hit], mine[hit]
            first, counts = _groups(codes, at, n, mine)
            check = _grams(codes, second, at[first], n, 1) & np.uint64(0xFFFFFFFF)
            sent.append((keys[mine[first]], check, counts))
            owned = owns[mine[first]]
            texts = _phrases(words, sizes, codes[at[first[owned]][:, None] + np.arange(n)])
            out += [{"n": n, "phrase": x, "key": k, "check": c} for x, k, c in zip(texts, keys[mine[first]][owned].astype(np.int64).tolist(), check[owned].astype(np.int64).tolist())]
            top = (n, at)
        made = [{"kind": PHRASES, "block": block, "lang": lang, "phrases": out}] if out else []
        key, check, counts = (np.concatenate([x[i] for x in sent]) for i in range(3))
        order = np.argsort(key, kind="stable")
        key, check, counts = key[order], check[order], counts[order]
        made += [{"kind": CHECKS, "block": block, "bucket": bucket, "keys": _packed_keys(key[a:b]), "counts": _planes(counts[a:b]), "checks": check[a:b].astype("<u4").tobytes()}
                 for bucket, a, b in _buckets_of(key)]
        if after and len(top[1]):
            n, at = top
            marks = np.zeros(len(codes), bool)
            marks[at] = True
            keep = np.zeros(len(codes) + n, bool)
            for p in (_places(codes, after[0], (n, marks))[:, None] + np.arange(after[0])).T:
                keep[p] = True
            left = np.where(keep[:len(codes)], codes, 0)
            marks &= keep[:len(codes)]
            next_dealt = _round(left, prints, after, (n, marks), buckets, bits)[1]
            if len(next_dealt):
                used = np.unique(left[left > 0])
                number = np.zeros(len(sizes) + 1, np.uint32)
                number[used] = np.arange(1, len(used) + 1)
                ends = np.cumsum(sizes)
                data = words.tobytes()
                kept = np.frombuffer(b"".join([data[ends[i - 1] - sizes[i - 1]:ends[i - 1]] for i in used]), np.uint8)
                made.append(_state(block, lang, kept, sizes[used - 1], number[left]) | {"checks": np.packbits(marks).tobytes()})
                made += _key_rows(block, lang, next_dealt)
        return _rows(made)
    state = rows.where(F.col("kind") == STATE).select("block", "lang", "words", "lengths", "codes", "bucket", "checks")
    return state.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(released_group(step), ROWS)


def _marks(row: dict, codes: np.ndarray, good: int | None):
    """(m, places of the frequent m-grams) of a block of a later round."""
    return None if good is None else (good, np.unpackbits(np.frombuffer(row["checks"], np.uint8), count=len(codes)).astype(bool))


def sums(rows: DataFrame, at_least: int) -> DataFrame:
    """SUMS: the phrases whose counts, over both fingerprints, reach ``at_least``, with the lowest block that has each."""
    def add(t: pa.Table) -> pa.Table:
        sent = sorted(zip(*[t[c].to_pylist() for c in ("block", "bucket", "keys", "checks", "counts")]))
        keys, counts = np.concatenate([_keys_of(r[2]) for r in sent]), np.concatenate([_from_planes(r[4]) for r in sent]).astype(np.int64)
        pair = (keys << np.uint64(32)) | np.concatenate([np.frombuffer(r[3], "<u4") for r in sent]).astype(np.uint64)
        both, first, back = np.unique(pair, return_index=True, return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, back, counts)
        blocks = np.repeat(np.array([r[0] for r in sent], np.int64), [len(r[2]) // 4 for r in sent])[first]
        keep = total >= at_least
        key = (np.int64(sent[0][1]) << np.int64(32)) | (both[keep] >> np.uint64(32)).astype(np.int64)
        return pa.table({"block": blocks[keep], "key": key, "check": (both[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64), "f": total[keep]})
    return rows.where(F.col("kind") == CHECKS).select("bucket", "block", "keys", "checks", "counts").groupBy("bucket").applyInArrow(released_group(add), SUMS)


def fetch(rows: DataFrame, wanted: DataFrame, lengths: tuple[int, ...], buckets: int, bits: int) -> DataFrame:
    """lang, n, phrase, key, check of phrases that no lowest block wrote (their fingerprint is shared): looked up in a block that has them."""
    schema = "lang string, n int, phrase string, key long, check long"

    def look(state: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if state.num_rows and wanted.num_rows:
            row = state.to_pylist()[0]
            words, sizes, codes = _of_state(row)
            prints, second = (_prints(words, sizes, row["lang"], i) for i in (0, 1))
            asked = set(zip(wanted["key"].to_pylist(), wanted["check"].to_pylist()))
            some = np.array(sorted({k for k, _ in asked}), np.uint64)
            for n in lengths:
                at = _places(codes, n, None)
                dealt = _dealt(_grams(codes, prints, at, n, 0), buckets, bits)
                at, dealt = at[np.isin(dealt, some)], dealt[np.isin(dealt, some)]
                if not len(at):
                    continue
                grams, first = np.unique(codes[at[:, None] + np.arange(n)], axis=0, return_index=True)
                check = (_grams(codes, second, at[first], n, 1) & np.uint64(0xFFFFFFFF)).tolist()
                out += [(row["lang"], n, x, k, c) for x, k, c in zip(_phrases(words, sizes, grams), dealt[first].tolist(), check) if (k, c) in asked]
        return table(out, schema)
    state = rows.where(F.col("kind") == STATE).select("block", "lang", "words", "lengths", "codes", "bucket").join(wanted.select("block").distinct(), "block", "left_semi")
    return state.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(released_group(look), schema)


def phrase_counts(docs: DataFrame, longest: int = 5, at_least: int = 100, size: int = BLOCK_BYTES, bits: int = 32) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of 1 to ``longest`` words that occur ``at_least`` times, words joined by a space;
    (lang, n) with the number of all words). Both are written tables. Fewer ``bits`` of the keys make more collisions, which cost time
    and change nothing."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // size))
    rounds = [r for r in (tuple(n for n in r if n <= longest) for r in ROUNDS) if r] + ([tuple(range(6, longest + 1))] if longest > 5 else [])
    start = rows = written(gather(docs, rounds[0], buckets, size, bits), "grams-0")
    ns = rows.where(F.col("kind") == STATE).groupBy("lang").agg(F.sum("n").alias("n"))
    parts = []
    for i, lengths in enumerate(rounds):
        good = rounds[i - 1][-1] if i else None
        rows = written(advance(rows, frequent(rows, at_least), lengths, good, rounds[i + 1] if i + 1 < len(rounds) else (), buckets, bits), f"grams-{i + 1}")
        found = written(sums(rows, at_least), f"sums-{i + 1}")
        texts = rows.where(F.col("kind") == PHRASES).select("lang", F.inline("phrases"))
        named = texts.join(found.drop("block"), ["key", "check"])
        lost = written(found.join(texts.select("key", "check"), ["key", "check"], "left_anti"), f"lost-{i + 1}")
        if lost.limit(1).count():
            named = named.unionByName(fetch(start, lost, lengths, buckets, bits).join(lost.drop("block"), ["key", "check"]))
        parts.append(named.select("lang", F.col("n").alias("words"), "phrase", "f"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return written(every, "phrases"), written(ns, "words")


def _small(rows: DataFrame, bound: int = 10_000) -> DataFrame:
    """``rows`` to be broadcast if there are at most ``bound``."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def _sub(words, first, size):
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, top: int = 2000, longest: int = 5, at_least: int = 100, percent: int = 100, size: int = BLOCK_BYTES, bits: int = 32) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of 2 to ``longest`` words by the score of their weakest cut, floor(1000 a n / (l r)).

    A phrase inside a longer candidate that has ``percent`` hundredths of its occurrences is left out; ``top`` are kept a language."""
    counts, ns = phrase_counts(docs, longest, at_least, size, bits)
    many = counts.where(F.col("words") > 1).withColumn("w", F.split("phrase", " "))
    inner = many.where(F.col("words") > 2).select("lang", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _sub(F.col("w"), i, m))))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    kept = many.join(inner, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("f"))).drop("inside")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", _sub(F.col("w"), F.lit(1), F.col("k")).alias("head"), _sub(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    part = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(_small(ns), "lang") \
        .withColumn("over", (big("a") * big("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", (big("l") * big("r")).cast("decimal(38,0)")) \
        .withColumn("score", F.expr("over div under"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return weakest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
