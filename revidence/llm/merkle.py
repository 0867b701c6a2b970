"""Operator 11: Merkle dataset manifest by concatenated-level strings.

Leaves are dealt into aligned blocks of ``FANOUT ** DEPTH`` consecutive positions of their group. A block keeps every level of its
subtree as one string of fixed-width hex digests: fixed-width substrings of a level are the runs whose hashes make the next
level, and the substrings that flank a node inside its run are its siblings. The blocks' roots are the nodes of the next round, until
each group has one; the groups' roots, in order, go through the same rounds. Proofs go down again: a block's path to
the root is joined once a block and handed on to its members, so no row of a hot group ever meets a join by its group alone.

Rows: null fields are hashed as ``-``; a null group is a group of its own and comes first; null ids come first in their group. Rows
with the same id are ordered by their digest; equal rows are interchangeable. A group of one leaf has that leaf as its
root. Texts are hashed whole, once, and never shuffled. Only the named columns are read, so extra columns can't clash. An empty table
has no blocks and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revidence.llm.common import written

FANOUT = 3
#: Levels of a block: FANOUT ** DEPTH leaves, a first level of about 15 kB.
DEPTH = 5
#: Characters of a digest.
WIDTH = 64
EMPTY_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the concatenated values (digests as hex text)."""
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (which must read alike each time) with pos (from 0 in the group, by ``order``) and n (rows of the group).

    One range sort whose tie-break is the row's place, so that neither a hot group nor equal rows land in one task; the
    places of a partition are contiguous in each group, so only (partition, group) counts are summed."""
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie") \
        .sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = written(ordered, "merkle-order").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = Window.partitionBy(group)
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("n", F.sum("_rows").over(w)).withColumnRenamed(group, "_group").withColumnRenamed("_part", "_p")
    return placed.join(before, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))) \
        .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_p", "_group", "_at", "_first", "_rows", "_before")


def _piece(level: Column, at: Column, size: Column | int) -> Column:
    """``size`` digests of a level from digest number ``at``."""
    return F.substring(level, (at * WIDTH + 1).cast("int"), size * WIDTH if isinstance(size, int) else (size * WIDTH).cast("int"))


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / (FANOUT * WIDTH)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(_piece(level, i * FANOUT, FANOUT))), "")


def blocks(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """(grp, block, n, members, levels) from nodes (grp, pos, n, node, payload columns): members in order, levels from the leaves up.

    A block that is its whole group stops at one digest; a block of several goes up DEPTH levels, whatever its size."""
    size = FANOUT ** DEPTH
    out = nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("block")) \
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("members")) \
        .withColumn("l0", F.array_join(F.col("members.node"), ""))
    for i in range(DEPTH):
        below = F.col(f"l{i}")
        out = out.withColumn(f"l{i + 1}", F.when((F.col("n") > size) | (F.length(below) > WIDTH), _parents(below)))
    levels = F.filter(F.array(*[F.col(f"l{i}") for i in range(DEPTH + 1)]), lambda x: x.isNotNull())
    return out.select("grp", "block", "n", "members", levels.alias("levels"))


def _own_path(levels: Column, pos: Column) -> Column:
    """(left, right) siblings of a member at every level of its block but the last, which is the block's root."""
    def at(level: Column, i: Column) -> Column:
        node = F.floor((pos % FANOUT ** DEPTH) / F.pow(F.lit(float(FANOUT)), i)).cast("int")
        inside = node % FANOUT
        return F.struct(_piece(level, node - inside, inside).alias("left"), _piece(level, node + 1, FANOUT - 1 - inside).alias("right"))
    return F.transform(F.slice(levels, 1, F.size(levels) - 1), at)


@dataclass
class Tree:
    """Rounds of blocks from the leaves up, and grp, root (one row a group)."""

    rounds: list[DataFrame]
    roots: DataFrame


def tree(nodes: DataFrame, payload: Sequence[str] = ()) -> Tree:
    """Rounds of blocks until each group has one. Every round is written; their number is the logarithm of the largest group."""
    rounds, done, size = [], [], FANOUT ** DEPTH
    while True:
        made = written(blocks(nodes, payload if not rounds else ()), f"merkle-round{len(rounds)}")
        top = F.element_at("levels", -1)
        rounds.append(made)
        done.append(made.where(F.col("n") <= size).select("grp", top.alias("root")))
        if not (made.agg(F.max("n")).first()[0] or 0) > size:
            break
        nodes = made.where(F.col("n") > size).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), top.alias("node"))
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return Tree(rounds, roots)


def paths(made: Tree, tops: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """A row a leaf: grp, pos, node, payload, path (array of left, right from the leaf up), carry. ``tops`` has grp, path, carry: where each
    group's root goes on from, and what all leaves of the group get."""
    size, above = FANOUT ** DEPTH, None
    for i in range(len(made.rounds) - 1, -1, -1):
        here, cols = made.rounds[i], payload if i == 0 else ()
        ends = here.where(F.col("n") <= size).join(tops, "grp").select("grp", "block", "members", "levels", "path", "carry")
        if above is not None:
            up = above.select("grp", F.col("pos").alias("block"), "path", "carry")
            ends = ends.unionByName(here.where(F.col("n") > size).join(up, ["grp", "block"]).select("grp", "block", "members", "levels", "path", "carry"))
        each = F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["node"].alias("node"), *[m[c].alias(c) for c in cols],
                                                         _own_path(F.col("levels"), m["pos"]).alias("own")))
        above = ends.select("grp", F.col("path").alias("up"), "carry", F.explode(each).alias("m")) \
            .select("grp", "m.pos", "m.node", *[f"m.{c}" for c in cols], F.concat("m.own", "up").alias("path"), "carry")
    return above


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(leaves: DataFrame, group: str, order: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """A row a leaf: grp, leaf, payload, path, subroot, root, from rows (``group``, ``order`` columns, leaf, payload).

    ``leaves`` is read several times and must be a written table. Leaves ascend by ``order`` in their group, equal ones by digest; groups
    ascend bytewise with null first."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = leaves.select(key.alias("grp"), F.col("leaf").alias("node"), *dict.fromkeys([*order, *payload]))
    placed = positions(rows, "grp", [*order, "node"])
    low = tree(placed.select("grp", "pos", "n", "node", *payload), payload)
    roots = written(low.roots, "merkle-roots")
    ranked = positions(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node")), "grp", ["name"])
    high = tree(ranked, ["name"])
    total = high.roots.select("grp", F.expr(EMPTY_PATH).alias("path"), F.col("root").alias("carry"))
    tops = paths(high, total, ["name"]).select(F.col("name").alias("grp"), "path", F.struct(F.col("node").alias("subroot"), F.col("carry").alias("root")).alias("carry"))
    out = paths(low, written(tops, "merkle-tops"), payload)
    return out.select(F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("grp"), F.col("node").alias("leaf"), *payload, "path", "carry.subroot", "carry.root")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of documents by source, with proofs checked against texts of which half (those whose id has an even crc32) lost their line ends:
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A null id is never tampered with."""
    fields = lambda text: [F.col(c) if c != "text" else text for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    rows = docs.select("doc_id", "source", leaf(fields(F.col("text"))).alias("leaf"),
                       F.when(changed, leaf(fields(F.replace("text", F.lit("\n"))))).alias("tampered"))
    out = manifest(written(rows, "merkle-leaves"), "source", ["doc_id"], ["doc_id", "tampered"])
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
                      fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
