"""Operator 4: toxicity with noisy-channel deobfuscation.

1. Character language model: trigram counts over the letters of all documents, a table of SYMBOLS^3 numbers.
2. Suspicious spans (digits or symbols between letters, letters spelled out one by one, letters repeated three times or more,
   letters of another script that look like Latin ones) become a lattice: each sign may stand for itself, for the letters it is
   used for, or for nothing; a run of one letter may stand for one or two of it; a separator between spelled-out signs may stand
   for nothing or for the end of a word. Viterbi finds the reading of least cost under channel and language model, at any length of
   the span. All its words are scored, together with the plain words, the spelled-out signs as one word, and every
   run of 4 to 12 of them that is a word by itself (their word ends are in doubt). Signs of no width go first.
3. Score: at most ``SAMPLE`` labelled rows (common.labelled_sample) are counted, toxic and clean, for hashed words and word beginnings. A word's
   evidence is the larger of its log odds; a text's score is a logistic function of its strongest words, so that length alone does
   not matter. The logistic part is fitted on the same counts' rows, at most ``SAMPLE`` of them.

Rows: null and empty texts score as texts without evidence. Null labels are not learned from. Without labels every score is the
prior. Repeated rows get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revidence.llm.common import released, written

if TYPE_CHECKING:
    import pandas as pd

SYMBOLS = 64
BUCKETS = 1 << 21
SAMPLE = 40_000    # labelled rows that are learned from
FITTED = 8_000     # of them, those that the logistic part is fitted on
PRIOR = 6.0       # documents at the base rate that are added to every count: rare words are little evidence
TOP = 3            # strongest words that count one by one
CACHE = 100_000
WORD_END = 4.0     # channel cost of a word end among spelled-out signs at another separator than a space
INSIDE = range(4, 13)  # lengths of the words that are looked for inside spelled-out signs, whatever the reading

#: What signs are used for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
        "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "", "&": ""}
#: Letters of other scripts that look like Latin ones (fixed values), and the full-width alphabet.
ALIKE = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "г": "r", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "п": "n", "о": "o",
         "р": "p", "ѕ": "s", "т": "t", "у": "yu", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "uy",
         "χ": "x", **{chr(0xff41 + i): chr(0x61 + i) for i in range(26)}}
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
_ID = {c: i + 1 for i, c in enumerate(_LETTERS)}
_TABLE = np.zeros(0x180, np.int64)
for _c, _i in _ID.items():
    _TABLE[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x180:
        _TABLE[ord(_c.upper())] = _i
_L = "".join(re.escape(c) for c in _LETTERS)
_EDGE = re.compile(rf"^[^{_L}0-9@$!|+(€£¡*#]+|[^{_L}0-9@$]+$")
_JUNK = re.compile(r"([!#$%&*@+|(.,])[!#$%&*@+|(.,]*$|^[\"'(\[]+")
_TAIL = re.compile(r"([@$])\1\1+$")  # decoration, no spelling
_PLAIN = re.compile(rf"^[{_L}]*$")
_RUN = re.compile(rf"([{_L}])\1\1")
_SPELLED = re.compile(rf"(?<![^\W_])(?:[{_L}0-9@$!](?:[ .\-_*]|[ ]?[.\-_*][ ]?)){{3,}}[{_L}0-9@$!](?![^\W_])")
_SIGNS = re.compile(r"[ ]?[.\-_*][ ]?|[ ]|[^ .\-_*]")
_SEPARATORS = re.compile(r"[ .\-_*]+")
_HIDDEN = re.compile("[\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]+")
_ALIKE = re.compile(rf"[{''.join(ALIKE)}]")
_LATIN = re.compile(rf"[{_L}]")
_DOUBT = re.compile(rf"[{_L}][0-9@$!|+(€£¡*#]+[{_L}]|^[0-9@$!|+(€£¡]+[{_L}]|[{_L}][0-9@$]+$")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all documents: one table of SYMBOLS^3 counts a task, then a sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for b in batches:
            for t in b.column("text"):
                s = t.as_py()
                if s:
                    p = np.frombuffer(s.encode("utf-32-le"), np.uint32)
                    i = np.concatenate([[0], np.where(p < len(_TABLE), _TABLE[np.minimum(p, len(_TABLE) - 1)], 0), [0]])
                    total += np.bincount((i[:-2] * SYMBOLS + i[1:-1]) * SYMBOLS + i[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])
    return docs.select("text").mapInArrow(released(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Speller:
    """Viterbi over character lattices; ``cost[a, b, c]`` is the negative log probability of c after a, b."""

    cost: np.ndarray

    @cached_property
    def rows(self) -> list:
        return self.cost.tolist()

    @classmethod
    def of(cls, counts: pd.DataFrame) -> Speller:
        n = np.zeros(SYMBOLS ** 3)
        n[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(float)
        n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = n.sum(0), n.sum((0, 1))
        p1 = (one + 1) / (one + 1).sum()
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (n + 20 * p2[None]) / (n.sum(2, keepdims=True) + 20)
        return cls(-np.log(p3).astype(np.float32))

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each place the readings and their channel costs."""
        out, i = [], 0
        while i < len(token):
            c, run = token[i], 1
            while i + run < len(token) and token[i + run] == c:
                run += 1
            if c in ALIKE:
                out.append([(x * n, 0.1 + 0.3 * (run > 1)) for x in ALIKE[c] for n in range(1, min(run, 2) + 1)])
            elif c in _ID:
                out.append([(c, 0.0 if run == 1 else 0.3), *([(c + c, 0.0 if run == 2 else 0.6)] if run > 1 else [])])
            else:
                out.append([*((x, 0.4 + 0.2 * (run - 1)) for x in LEET.get(c, "")), ("", 12.0 if c.isdigit() else 3.0 if c in LEET else 0.0)])
            i += run
        return out

    @staticmethod
    def spelled_lattice(span: str) -> list[list[tuple[str, float]]]:
        """The same for signs with separators between them: a separator is nothing or a word end."""
        return [[("", 0.0), (" ", 0.0 if x == " " else WORD_END)] if _SEPARATORS.fullmatch(x) else Speller.lattice(x)[0] for x in _SIGNS.findall(span)]

    def decode(self, token: str) -> str:
        """The reading of a token of least cost."""
        return self.viterbi(self.lattice(token))

    def decode_spelled(self, span: str) -> str:
        """The reading of spelled-out signs of least cost, words with a space between them."""
        return self.viterbi(self.spelled_lattice(span))

    def viterbi(self, places: list[list[tuple[str, float]]]) -> str:
        """The path of least cost, between two word ends. A state is the last two symbols; paths are chains of (earlier, reading), and what
        all of them share is put away as soon as one state is left, so that time is linear in the number of places."""
        cost_of = self.rows
        done: list[str] = []
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for place in places:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for reading, channel in place:
                    x, y, total = a, b, cost + channel
                    for c in reading:
                        z = _ID.get(c, 0)
                        total += cost_of[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = total, (path, reading) if reading else path
            if len(new) == 1:
                [(state, (total, path))] = new.items()
                done.append(_along(path))
                new = {state: (total, None)}
            best = new
        _, path = min(((cost + cost_of[a][b][0], path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
        return "".join(done) + _along(path)


def _along(path: tuple | None) -> str:
    out = []
    while path:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out))


class Restorer:
    """Words of a text, each in plain spelling; decoded tokens are remembered."""

    def __init__(self, speller: Speller):
        self.speller, self.known = speller, _Known(self)

    def words(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        if not text.isascii():
            text = _HIDDEN.sub("", text)
        tokens = set(text.split())
        spelled = {m for m in _SPELLED.findall(text) if _LATIN.search(m)}
        tokens.update(_SEPARATORS.sub("", m) for m in spelled)
        if len(self.known) > CACHE:
            self.known.clear()
        out: set[str] = set()
        for readings in map(self.known.__getitem__, tokens):
            out.update(readings)
        for m in spelled:
            read = self.speller.decode_spelled(m).split()
            out.update(read)
            signs = "".join(read)
            out.update("=" + signs[i:i + n] for n in INSIDE for i in range(len(signs) - n + 1))
        return out

    def restored(self, text: str | None) -> str:
        """The text with every suspicious span replaced by its reading."""
        text = _HIDDEN.sub("", text or "")

        def reading(m: re.Match) -> str:
            if m[1]:
                return self.speller.decode_spelled(m[1].lower()) if _LATIN.search(m[1]) else m[1]
            known = self.known[m[0].lower()] or (m[0],)
            return m[0] if known[-1] == m[0].lower().strip(".,;:?!") else known[-1]
        return re.sub(rf"({_SPELLED.pattern})|\S+", reading, text, flags=re.IGNORECASE)


class _Known(dict):
    def __init__(self, restorer: Restorer):
        super().__init__()
        self.restorer = restorer

    def __missing__(self, token: str) -> tuple[str, ...]:
        """Plain word and, for suspicious tokens, the restored one."""
        core = token.strip(".,;:?!")
        if core.isalpha() and not _RUN.search(core) and (core.isascii() or not _ALIKE.search(core) or not _LATIN.search(core)):
            self[token] = out = (core,)
            return out
        if not core.isascii() and _ALIKE.search(core) and _LATIN.search(core):
            return (*re.findall(rf"[{_L}]+", core), self.restorer.speller.decode(core))
        core = _EDGE.sub("", token)
        bare = _JUNK.sub("", core)
        plain = tuple(re.findall(rf"[{_L}]+", bare)) if not _PLAIN.match(bare) else (bare,) if bare else ()
        doubtful = [x for x in dict.fromkeys((bare, core)) if not _TAIL.search(x) and (_DOUBT.search(x) or _RUN.search(x) or "." in x[1:-1] or "-" in x[1:-1] or "_" in x[1:-1])]
        out = (*plain, *(self.restorer.speller.decode(x) for x in doubtful))
        if len(token) <= 64:
            self[token] = out
        return out


def _units(word: str) -> tuple[str, ...]:
    """The word and its beginning; beginnings stand for inflected forms. Signs marked with = count as a word only."""
    if word.startswith("="):
        return (word[1:],)
    return (word, "^" + word[:4], "^" + word[:5]) if len(word) > 5 else (word, "^" + word[:4]) if len(word) > 4 else (word,)


def buckets(words: set[str]) -> np.ndarray:
    units = {u for w in words for u in _units(w)}
    return np.fromiter((zlib.crc32(u.encode()) % BUCKETS for u in units), np.int64, len(units))


@dataclass
class Model:
    speller: Speller
    odds: np.ndarray       # evidence of a bucket
    weights: np.ndarray    # of summary(): bias, strongest words, their number

    def summary(self, words: set[str], memo: Evidence) -> np.ndarray:
        if len(memo) > CACHE:
            memo.clear()
        e = heapq.nlargest(TOP, map(memo.__getitem__, words))
        many = sum(x > 2 for x in map(memo.__getitem__, words)) if e and e[-1] > 2 else sum(x > 2 for x in e)
        return np.array([1.0, *e, *[0.0] * (TOP - len(e)), np.log1p(many)])


class Evidence(dict):
    """Word -> its evidence, remembered."""

    def __init__(self, odds: np.ndarray):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        out = self[word] = max(float(self.odds[zlib.crc32(u.encode()) % BUCKETS]) for u in _units(word))
        return out


def _distinct(labelled: DataFrame) -> DataFrame:
    """Rows (text, label, h); a text counts once with each label, however often it was copied."""
    rows = labelled.select("text", "label", F.xxhash64(F.lit("tox"), "text").alias("h"))
    return rows.groupBy("h", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labelled: DataFrame) -> Model:
    """Language model from all texts of ``docs``, evidence from the rows (doc_id, text, label) of ``labelled``."""
    sc = docs.sparkSession.sparkContext
    speller = Speller.of(trigram_counts(docs).toPandas())  # at most SYMBOLS^3 rows
    shared = sc.broadcast(speller)
    rows = written(_distinct(labelled), "toxicity-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = Restorer(shared.value), np.zeros((2, BUCKETS), np.int32)
        docs_of = np.zeros(2, np.int64)
        for b in batches:
            for t, y in zip(b.column("text"), b.column("label").to_pylist()):
                n[y][np.unique(buckets(r.words(t.as_py())))] += 1
                docs_of[y] += 1
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0][at], docs_of[0])), pa.array(np.append(n[1][at], docs_of[1]))], names=["bucket", "clean", "toxic"])
    got = rows.select("text", "label").mapInArrow(released(count), "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = got.where((F.col("bucket") < 0) | (F.col("toxic") * 8 > F.col("clean"))).toPandas()  # at most BUCKETS + 1 rows
    n, totals = got[got.bucket >= 0], got[got.bucket < 0]
    clean, toxic = (float(totals[c].iloc[0]) if len(totals) else 0.0 for c in ("clean", "toxic"))
    base = (toxic + 1) / (clean + toxic + 2)
    odds = np.zeros(BUCKETS, np.float32)
    odds[n.bucket.to_numpy(np.int64)] = np.maximum(0, np.log((n.toxic.to_numpy(float) + PRIOR * base) / (n.clean.to_numpy(float) + PRIOR * (1 - base))) - np.log(base / (1 - base)))
    model = Model(speller, odds, np.zeros(TOP + 2))
    shared_odds = sc.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, memo = Restorer(shared_odds.value.speller), Evidence(shared_odds.value.odds)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shared_odds.value.summary(r.words(t.as_py()), memo).tolist() for t in b.column("text")], pa.list_(pa.float64())), b.column("label")], names=["x", "label"])
    part = rows.join(F.broadcast(rows.select("h", "label").orderBy("h", "label").limit(FITTED)), ["h", "label"], "left_semi").select("text", "label").mapInArrow(released(sums), "x array<double>, label int").toPandas()
    model.weights = _logistic(np.array(part["x"].tolist(), float).reshape(-1, TOP + 2), part["label"].to_numpy(float))
    return model


def _logistic(X: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(X.shape[1])
    if not len(y):
        w[0] = -4.0
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + 0.05 * w
        w -= np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 0.05 * np.eye(len(w)), g)
    return w


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of ``keep``) and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        r, memo = Restorer(m.speller), Evidence(m.odds)
        for b in batches:
            x = [m.summary(r.words(t.as_py()), memo) @ m.weights for t in b.column("text")]
            out = 1 / (1 + np.exp(-np.clip(np.array(x, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out)], names=[*keep, "score"])
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(released(run), f"{schema}, score double")
