"""Merkle manifest of a dataset by time-forward processing.

Rows are leaves of one tree per key (a language, a source); the roots of these trees, in key order, are the
leaves of one more tree. Nodes are labelled (level, index), so every child comes before its parent. Digests
are sent forward: a queue ordered by node label holds what has been sent to a node; when the label is reached,
all its children have arrived, the parent's digest is made and sent on. A second sweep runs through the labels
in reverse: a parent hands down the proof of its own position, a child puts its siblings before it, and what
arrives at a leaf is its proof.

The queue is external. Spark's sort by label deals nodes into blocks of ``arity ** HEIGHT`` neighbours; a task
runs the queue of one block in memory and sends one digest per block to the next round, which is that many
times smaller. The reversed sweep takes the same rounds back. A tree of any size, all rows under one key
included, never has more than a block in one task.

Defined results: null values of a leaf are ``-``; the null key is a tree of its own and comes first; null ids
come first in their tree; rows of one id are ordered by their leaf digest; repeated rows are leaves of their
own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewspark.llm.common import stored

ARITY = 2
#: Levels of the queue of one task.
HEIGHT = 12
PATH = "array<struct<left:string,right:string>>"
PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: every value with its length in bytes before it, so that no two rows read alike."""
    def part(v):
        text = v.cast("string")
        return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def levels_of(n: int, arity: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    out = 0
    while n > 1:
        n, out = -(-n // arity), out + 1
    return out


def send_forward(digests: Sequence[str], levels: int, arity: int) -> list[list[str]]:
    """Digests of every level, made in label order from what the queue delivers."""
    queue = [(0, i, 0, d) for i, d in enumerate(digests)]
    heapify(queue)
    made: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        level, index = queue[0][:2]
        arrived = []
        while queue and queue[0][:2] == (level, index):
            arrived.append(heappop(queue)[3])
        made[level].append(arrived[0] if level == 0 else digest(*arrived))
        if level < levels:
            heappush(queue, (level + 1, index // arity, index % arity, made[level][-1]))
    return made


def send_back(made: list[list[str]], top: list[tuple[str, str]], arity: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(index, path) of every leaf: the labels in reverse, each node with the path that its parent sent."""
    levels = len(made) - 1
    queue = [(-levels, -i, top) for i in range(len(made[levels]))]
    heapify(queue)
    while queue:
        level, index, path = heappop(queue)
        level, index = -level, -index
        if level == 0:
            yield index, path
            continue
        run = made[level - 1][index * arity:(index + 1) * arity]
        for k in range(len(run)):
            heappush(queue, (1 - level, -(index * arity + k), [("".join(run[:k]), "".join(run[k + 1:])), *path]))


def fold(start: str, path: Sequence[tuple[str, str]]) -> str:
    for left, right in path:
        start = digest(left, start, right)
    return start


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``pos``: the place of every row in its tree, from 0.

    A range exchange and offsets per partition: a tree may span all partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, tree, *order).sortWithinPartitions(tree, *order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "merkle-order")
    runs = placed.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(tree).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a row per tree and partition
    return placed.join(runs, [tree, "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_n", "_first", "_before")


def rounds_up(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Node tables (tree, pos, digest, n), each ``arity ** height`` times smaller; the last has one node per tree."""
    block = arity**height

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = table.column("pos").to_pylist()
        found = [d for _, d in sorted(zip(at, table.column("digest").to_pylist()))]
        n = table.column("n")[0].as_py()
        levels = levels_of(n, arity) if n <= block else height
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [send_forward(found, levels, arity)[-1][0]], "n": [-(-n // block)]})

    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    out = [stored(nodes.join(sizes, "tree"), "merkle-leaves")]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = out[-1].select("tree", F.expr(f"pos div {block}").alias("block"), "pos", "digest", "n")
        out.append(stored(up.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, digest string, n long"), "merkle-round"))
        most = -(-most // block)
    return out


def rounds_down(rounds: list[DataFrame], paths: DataFrame, arity: int, height: int) -> DataFrame:
    """(tree, pos, path) of the nodes of the first round; ``paths`` (tree, path) are those of the roots."""
    paths = paths.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(rounds[:-1]):
        paths = stored(_hand_down(nodes, paths, arity, height, None), "merkle-paths")
    return paths


def _hand_down(nodes: DataFrame, paths: DataFrame, arity: int, height: int, carried: Sequence[str] | None) -> DataFrame:
    """One round of the reversed sweep; with ``carried`` its nodes are the leaves: proofs and folds instead of paths."""
    block = arity**height

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        n = left.column("n")[0].as_py()
        levels = levels_of(n, arity) if n <= block else height
        top = [(p["left"], p["right"]) for p in right.column("path")[0].as_py()]
        found = left.column("digest").to_pylist()
        made = send_forward(found, levels, arity)
        if carried is None:
            sent = [p for _, p in sorted(send_back(made, top, arity))]
            return pa.table({"tree": left.column("tree"), "pos": left.column("pos"),
                             "path": pa.array([[{"left": a, "right": b} for a, b in p] for p in sent], PATH_ARROW)})
        starts = left.column("start").to_pylist()
        proof, folded = [""] * len(found), [""] * len(found)
        for i, path in send_back(made, top, arity):
            proof[i] = digest(*[s for p in path for s in p])
            folded[i] = fold(starts[i], path)
        return pa.table({**{c: left.column(c) for c in ("tree", *carried)}, "proof_sha256": proof, "folded_root": folded})

    if carried is None:
        schema = f"tree string, pos long, path {PATH}"
    else:
        schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("tree", *carried)) + ", proof_sha256 string, folded_root string"
    here = nodes.withColumn("block", F.expr(f"pos div {block}")).groupBy("tree", "block")
    above = paths.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return here.cogroup(above).applyInArrow(run, schema)


def manifest(leaves: DataFrame, key: str, order: Sequence[str], carried: Sequence[str], arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per leaf: ``carried``, subroot, root, proof_sha256, folded_root.

    ``leaves`` has ``key`` (string), the ``order`` columns, ``digest`` and ``start``: what is folded through the
    leaf's proof, the digest itself or the one of a row to be checked.
    """
    named = leaves.withColumn("tree", F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key))))
    named = stored(named.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    nodes = numbered(named, "tree", [*order, "digest", "_row"]).drop("_row")
    rounds = rounds_up(nodes, arity, height)
    subroots = rounds[-1].select(F.col("tree").alias("name"), "digest")
    top = rounds_up(numbered(subroots.withColumn("tree", F.lit("")), "tree", ["name"]), arity, height)
    empty = top[-1].select("tree", F.from_json(F.lit("[]"), PATH).alias("path"))
    handed = rounds_down(top, empty, arity, height)
    root = top[-1].select("tree", F.col("digest").alias("root"))
    of_trees = top[0].join(handed, ["tree", "pos"]).join(root, "tree")
    of_trees = stored(of_trees.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-trees")
    paths = of_trees.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for level in reversed(rounds[1:-1]):
        paths = stored(_hand_down(level, paths, arity, height, None), "merkle-paths")
    out = _hand_down(rounds[0], paths, arity, height, carried)
    return out.join(of_trees.select("tree", "subroot", "root"), "tree").drop("tree")


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with a tree per language.

    Rows whose id has a checksum divisible by 7 are checked with ``n_chars`` one too large and must not verify.
    A null id is not tampered with.
    """
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    chars = F.col("n_chars").cast("decimal(20,0)")
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaves = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), leaf_digest(*fields, F.col("n_chars"), F.col("text")).alias("digest"),
        F.when(tampered, leaf_digest(*fields, chars + 1, F.col("text"))).alias("other"))
    leaves = leaves.withColumn("start", F.coalesce("other", "digest")).drop("other")
    out = manifest(leaves, "lang", ["doc_id"], ["doc_id", "digest"])
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
