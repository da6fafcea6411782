"""A Merkle manifest of a dataset, kept as a postorder append log.

Leaves of a tree are numbered in order. Aligned builders take SPAN consecutive ones each and write every node
at the moment it is complete, so a node follows its whole subtree: postorder. Whatever is built, a node's
place follows from the sizes of the subtrees before it (``position``), so that siblings are addressed in the
log without a search. The last nodes of the builders are the next pass's leaves, until one is left.

Proofs go the other way: from the root's builder down, each builder adds the siblings in its own log to the
path that its own root has above. No task holds more than a builder's log and the leaves of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import sized_broadcast, staged

#: Children of a node, levels that a builder adds, and the leaves that it takes.
FANOUT, LEVELS = 8, 3
SPAN = FANOUT**LEVELS
#: The columns of a document that a leaf stands for, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
STEPS = "array<struct<left: string, right: string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- closed forms -----------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels above n leaves until one node remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def width(level: int, n: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // FANOUT**level)


def position(level: int, index: int, n: int, levels: int) -> int:
    """The place in the log of a node, over n leaves and so many levels.

    A node over a full run of leaves follows the nodes that end at its last leaf or before, up to its own level,
    and those of higher levels that end before. The others, over the last leaves, come at the end, by level.
    """
    end = (index + 1) * FANOUT**level
    if end <= n:
        return sum(end // FANOUT**i for i in range(level + 1)) + sum((end - 1) // FANOUT**i for i in range(level + 1, levels + 1)) - 1
    return sum(n // FANOUT**i for i in range(levels + 1)) + sum(n % FANOUT**i > 0 for i in range(level))


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes over a builder's leaves in the order in which they are complete; the last one is its root."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def done(level: int, node: str) -> None:
        log.append(node)
        if level < levels:
            open_[level].append(node)
            if len(open_[level]) == FANOUT:
                close(level)

    def close(level: int) -> None:
        children, open_[level] = open_[level], []
        done(level + 1, digest(*children))

    for leaf in leaves:
        done(0, leaf)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def siblings(log: list[str], index: int, n: int, levels: int) -> list[tuple[str, str]]:
    """(digests left of it, digests right of it) for a leaf of a builder and each node above it but the root."""
    out = []
    for level in range(levels):
        first = index - index % FANOUT
        run = [(i, log[position(level, i, n, levels)]) for i in range(first, min(first + FANOUT, width(level, n))) if i != index]
        out.append(("".join(d for i, d in run if i < index), "".join(d for i, d in run if i > index)))
        index //= FANOUT
    return out


def folded(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        node = digest(left, node, right)
    return node


# --- building ---------------------------------------------------------------------------------


def indexed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with ``idx``, a row's place in its tree by ``order``, and ``n``, the tree's rows; staged.

    Rows are sorted by ranges, numbered inside a partition, and the counts of the partitions before are added: a tree
    with most of all rows spreads over many partitions. Rows that tie in all columns of ``order`` are in any order.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(tree, *order, "__tie").sortWithinPartitions(tree, *order, "__tie").drop("__tie")
    placed = staged(ranged.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy(F.col(tree).alias("__tree"), part).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    # a tree has at most a row here for each partition
    earlier = Window.partitionBy("__tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("__tree", "__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__tree")).alias("n"))
    told = placed.join(sized_broadcast(staged(sums, f"{name}-counts")), (F.col(tree) == F.col("__tree")) & (F.shiftright("__at", 33) == F.col("__part")))
    return told.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("idx"), "n")


@dataclass
class Built:
    """A forest: roots (tree, root), and for each pass the builders' logs (tree, builder, n, levels, log)."""

    roots: DataFrame
    passes: list[DataFrame]


def _built(group: pa.Table) -> pa.Table:
    rows = group.sort_by("idx")
    n, of = rows.num_rows, rows.column("n")[0].as_py()
    levels = height(of) if of <= SPAN else LEVELS
    log = append_log(rows.column("node").to_pylist(), levels)
    out = {"tree": [rows.column("tree")[0].as_py()], "builder": [rows.column("builder")[0].as_py()], "of": [of], "n": [n], "levels": [levels], "log": ["".join(log)]}
    return pa.table({k: pa.array(v, pa.string() if k in ("tree", "log") else pa.int64()) for k, v in out.items()})


def build(nodes: DataFrame) -> Built:
    """All trees over nodes (tree, idx, n, node): idx counts from 0 in a tree of n nodes."""
    passes: list[DataFrame] = []
    tops = None
    while True:
        grouped = nodes.select("tree", "idx", "n", "node", F.floor(F.col("idx") / SPAN).cast("long").alias("builder")).groupBy("tree", "builder")
        logs = staged(grouped.applyInArrow(_built, "tree string, builder long, of long, n long, levels long, log string"), f"log{len(passes)}")
        passes.append(logs)
        last = logs.select("tree", "of", F.col("builder").alias("idx"), F.substring("log", -64, 64).alias("node"))
        done = last.where(F.col("of") <= SPAN).select("tree", F.col("node").alias("root"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = last.where(F.col("of") > SPAN).withColumn("n", F.ceil(F.col("of") / SPAN).cast("long"))
        if nodes.isEmpty():
            return Built(tops, passes)


def _path(logs: pa.Table) -> tuple[list[str], int, int, list[tuple[str, str]]]:
    """(log, leaves, levels, the path above) of a builder."""
    text, n, levels, above = (logs.column(c)[0].as_py() for c in ("log", "n", "levels", "steps"))
    return [text[i : i + 64] for i in range(0, len(text), 64)], n, levels, [(s["left"], s["right"]) for s in above]


def _steps_of(rows: pa.Table, logs: pa.Table) -> pa.Table:
    log, n, levels, above = _path(logs)
    steps = [[{"left": a, "right": b} for a, b in [*siblings(log, i % SPAN, n, levels), *above]] for i in rows.column("idx").to_pylist()]
    return pa.table({"tree": rows.column("tree"), "idx": rows.column("idx"), "steps": pa.array(steps, _STEPS)})


def above_builders(built: Built, roots: DataFrame) -> DataFrame:
    """The first pass's logs with ``steps``: the siblings of a builder's root and the nodes above it; roots: (tree, steps) above a tree's root."""
    tops = roots.select("tree", "steps")
    out = None
    for p, logs in reversed(list(enumerate(built.passes))):
        own = logs.where(F.col("of") <= SPAN).join(sized_broadcast(tops), "tree")
        if out is not None:
            rest = logs.where(F.col("of") > SPAN).join(out, ["tree", "builder"])
            own = own.unionByName(rest.select(own.columns))
        if p:
            below = built.passes[p - 1].where(F.col("of") > SPAN).select("tree", F.col("builder").alias("idx"), F.floor(F.col("builder") / SPAN).cast("long").alias("builder"))
            found = below.groupBy("tree", "builder").cogroup(own.groupBy("tree", "builder")).applyInArrow(_steps_of, f"tree string, idx long, steps {STEPS}")
            out = staged(found.withColumnRenamed("idx", "builder"), f"path{p}")
        else:
            out = own
    return out


# --- documents --------------------------------------------------------------------------------


def leaf(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, null as a dash."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered) of documents: tampered is the leaf with the text's A-Z lower-cased, null where the row isn't tampered with."""
    columns = [F.col(c) for c in FIELDS]
    other = [*columns[:-1], F.translate("text", UPPER, LOWER)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select("doc_id", "lang", leaf(*columns).alias("leaf"), F.when(hit, leaf(*other)).alias("tampered"))


@dataclass
class Manifest:
    """leaves (doc_id, tree, idx, n, leaf, tampered), their trees, one for each language, those trees' roots
    (tree, lang, node, idx, n) in order, and the tree over these."""

    leaves: DataFrame
    trees: Built
    subroots: DataFrame
    top: Built


def manifest(docs: DataFrame) -> Manifest:
    """The log of a table: a tree for each language, its leaves by doc_id, and one over their roots.

    Null comes before other languages and ids; rows of one id are ordered by their digests, so equal rows tie without
    effect. An empty table has no trees.
    """
    ship(docs.sparkSession)
    rows = leaves(docs).withColumn("tree", F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))).drop("lang")
    placed = staged(indexed(rows, "tree", ["doc_id", "leaf"], "leaves"), "placed")
    trees = build(placed.select("tree", "idx", "n", F.col("leaf").alias("node")))
    roots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("node"))
    subroots = staged(indexed(roots, "tree", ["lang"], "roots"), "subroots")
    return Manifest(placed, trees, subroots, build(subroots.select("tree", "idx", "n", "node")))


def proved(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf of a manifest.

    The proof is a leaf's siblings up to the root; folded_root is what they give with the leaf as it is now.
    """
    none = F.array().cast(STEPS)
    over_roots = above_builders(m.top, m.top.roots.select("tree", none.alias("steps")))
    at = m.subroots.select("tree", "idx", "lang", F.col("node").alias("subroot"), F.floor(F.col("idx") / SPAN).cast("long").alias("builder"))
    paths = at.groupBy("tree", "builder").cogroup(over_roots.groupBy("tree", "builder")).applyInArrow(_steps_of, f"tree string, idx long, steps {STEPS}")
    tops = at.join(paths, ["tree", "idx"]).join(m.top.roots, "tree").select(F.col("lang").alias("tree"), "steps", "subroot", "root")
    tops = staged(tops, "tops")
    logs = above_builders(m.trees, tops).select("tree", "builder", "n", "levels", "log", "steps").join(sized_broadcast(tops.select("tree", "subroot", "root")), "tree")

    def prove(rows: pa.Table, logs: pa.Table) -> pa.Table:
        log, n, levels, above = _path(logs)
        subroot, root = (logs.column(c)[0].as_py() for c in ("subroot", "root"))
        proofs, found = [], []
        for i, own, other in zip(*(rows.column(c).to_pylist() for c in ("idx", "leaf", "tampered")), strict=True):
            steps = [*siblings(log, i % SPAN, n, levels), *above]
            proofs.append(digest(*(d for s in steps for d in s)))
            found.append(folded(other or own, steps))
        size = rows.num_rows
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "leaf": rows.column("leaf"),
                "subroot": pa.array([subroot] * size, pa.string()),
                "root": pa.array([root] * size, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(found, pa.string()),
                "verified": pa.array([f == root for f in found], pa.bool_()),
            }
        )

    rows = m.leaves.select("doc_id", "tree", "idx", "leaf", "tampered", F.floor(F.col("idx") / SPAN).cast("long").alias("builder"))
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("tree", "builder").cogroup(logs.groupBy("tree", "builder")).applyInArrow(prove, kinds)


def verified(docs: DataFrame) -> DataFrame:
    """``proved`` of the documents' own manifest, for every row: null ids, languages and texts, empty and very long texts and
    repeated rows have leaves like any other; other columns are ignored; an empty table gives an empty table."""
    return proved(manifest(docs))
