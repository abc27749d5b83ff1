"""Merkle manifest of a dataset by incremental witnesses.

Every row is a leaf; the leaves of a group, in order, make a binary tree, and the groups' roots, in order, the
tree of the dataset. Leaves are appended one by one to a frontier of open subtrees, of which each keeps the
partial witnesses of the leaves below it: when the sibling of a subtree is complete, the witnesses of both get the
other's digest, and the two become one open subtree, one level up. Tasks do so for aligned blocks of ``2 ** bits``
leaves each; the block roots are then appended in the same way, in blocks again, until one root per group
is left, and then the groups' roots. A leaf's witness is that of its block continued by that of the block's
root, so no group of leaves, however large, is in one task, and a lost task appends its block again.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. A node without a sibling at its level
(the last one of an odd number) goes up as the H of itself.

A witness is binary: per level a byte (0: the sibling is on the left, 1: on the right, 2: none) and 32 bytes
of digest. ``fold`` and ``sibling_digests`` read it with Spark's own functions, independently of how it was made.

Cases: a null value counts as ``-`` in its leaf; a null group is a group, the first; null ids come first; rows
that tie in group and id go by their leaf; equal rows are leaves each; long texts are hashed whole; an empty
table gives no rows; further columns are ignored unless named as fields.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcast.operators.numbering import null_safe, numbered
from leafcast.session import materialize

LEFT, RIGHT, ALONE = b"\0", b"\1", b"\2"
#: Bytes of one level of a witness: the side and a digest.
STEP = 33
#: A block holds 2 ** BLOCK_BITS nodes.
BLOCK_BITS = 10


def leaf_digest(*fields: Column) -> Column:
    """Hex digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` if null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def node_digest(*children: bytes) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


class _Subtree:
    """A complete subtree: its digest and the partial witnesses of its leaves, in order."""

    __slots__ = ("digest", "witnesses")

    def __init__(self, digest: bytes, witnesses: list[bytearray]):
        self.digest, self.witnesses = digest, witnesses

    def join(self, right: _Subtree) -> _Subtree:
        """Two siblings become one subtree; the witnesses of each get the other's digest."""
        to_left, to_right = RIGHT + right.digest, LEFT + self.digest
        for w in self.witnesses:
            w += to_left
        for w in right.witnesses:
            w += to_right
        return _Subtree(node_digest(self.digest, right.digest), self.witnesses + right.witnesses)

    def alone(self) -> _Subtree:
        for w in self.witnesses:
            w += ALONE + bytes(32)
        return _Subtree(node_digest(self.digest), self.witnesses)


class Frontier:
    """Open subtrees by height, at most one of each; leaves are appended in order."""

    def __init__(self):
        self.open: dict[int, _Subtree] = {}

    def append(self, digest: bytes) -> None:
        tree, height = _Subtree(digest, [bytearray()]), 0
        while height in self.open:
            tree = self.open.pop(height).join(tree)
            height += 1
        self.open[height] = tree

    def close(self, height: int) -> _Subtree:
        """Completes the tree at ``height``: what stands last in its level goes up alone."""
        tree = None
        for level in range(height + 1):
            left = self.open.pop(level, None)
            if left is not None:
                tree = left if tree is None else left.join(tree)
                if level < height and len(tree.witnesses) <= 1 << level:
                    tree = tree.alone()
            elif tree is not None and level < height:
                tree = tree.alone()
        assert tree is not None and not self.open
        return tree


def _height(n: int, bits: int) -> int:
    """Levels of a block's tree: all ``bits`` where the group has several blocks, else those its nodes need."""
    return bits if n > 1 << bits else (n - 1).bit_length()


def _witnesses(bits: int):
    """Arrow function over rows sorted by (grp, block, pos): adds ``steps``, and ``block_root`` on a block's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        steps: list[bytes] = []
        roots: list[bytes | None] = []
        frontier, key, height = None, None, 0

        def close() -> None:
            tree = frontier.close(height)
            steps.extend(bytes(w) for w in tree.witnesses)
            roots.extend([tree.digest] + [None] * (len(tree.witnesses) - 1))

        def ready() -> Iterator[pa.RecordBatch]:
            """Rows of the blocks that are complete; the others stay held."""
            rows = pa.Table.from_batches(held)
            out = rows.slice(0, len(steps))
            held[:] = rows.slice(len(steps)).to_batches()
            out = out.append_column("steps", pa.array(steps, pa.binary())).append_column("block_root", pa.array(roots, pa.binary()))
            steps.clear()
            roots.clear()
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            columns = (batch.column(c).to_pylist() for c in ("grp", "pos", "n", "digest"))
            for grp, pos, n, digest in zip(*columns, strict=True):
                if (grp, pos >> bits) != key:
                    if frontier is not None:
                        close()
                    frontier, key, height = Frontier(), (grp, pos >> bits), _height(n, bits)
                frontier.append(digest)
            if steps:
                yield from ready()
        if frontier is not None:
            close()
            yield from ready()

    return run


def _trees(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Trees over nodes (grp, pos, n, digest, ...), pos counted from 0 to n - 1 in each group.

    Returns, per round of appends, the nodes with their ``steps`` within their block, and the block roots (grp, pos,
    n, digest) of each round; and the one root (grp, digest) of each group.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, blocks, finished = [], [], None
    while True:
        block = F.shiftright("pos", bits)
        dealt = nodes.withColumn("block", block).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").drop("block")
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, steps binary, block_root binary"
        done = materialize(dealt.mapInArrow(_witnesses(bits), schema), "witnesses")
        rounds.append(done.drop("block_root"))
        roots = done.where(F.col("block_root").isNotNull()).select(
            "grp", block.alias("pos"), F.ceil(F.col("n") / (1 << bits)).cast("bigint").alias("n"), F.col("block_root").alias("digest")
        )
        blocks.append(roots)
        ended = roots.where("n = 1").select("grp", "digest")
        finished = ended if finished is None else finished.union(ended)
        most = -(-most // (1 << bits))
        if most <= 1:
            return rounds, blocks, finished
        nodes = roots.where("n > 1")


def _continued(rounds: Sequence[DataFrame], bits: int) -> DataFrame | None:
    """Rows (grp, pos, steps) of the nodes of the first of ``rounds``, the witnesses continued through the later ones."""
    upper = None
    for nodes in reversed(rounds):
        here = nodes.select("grp", "pos", "steps")
        if upper is not None:
            above = upper.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up_pos"), F.col("steps").alias("up_steps"))
            cond = here["grp"].eqNullSafe(above["up_grp"]) & (F.shiftright(here["pos"], bits) == above["up_pos"])
            here = here.join(above, cond, "left").select("grp", "pos", F.concat("steps", F.coalesce("up_steps", F.lit(b""))).alias("steps"))
        upper = here
    return upper


def manifest(leaves: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows of leaves (grp, doc_id, digest, ...) with ``steps`` (witness up to the dataset's root), ``subroot`` and ``root`` (binary).

    ``leaves`` is to be a table or a written result, ``digest`` 32 bytes; columns other than these are carried along.
    """
    placed = numbered(leaves, ["grp"], ["doc_id", "digest"], "pos", "n")
    rounds, blocks, subroots = _trees(placed, bits)
    tops = numbered(materialize(subroots.select(F.col("grp").alias("name"), "digest"), "subroots"), [], ["name"], "pos", "n")
    top_rounds, _, top_roots = _trees(tops.select(F.lit("").alias("grp"), "pos", "n", "digest", "name"), bits)
    # Which group a subroot stands for, and its witness.
    names = top_rounds[0].select("grp", "pos", "name", F.col("digest").alias("subroot"))
    top = _continued(top_rounds, bits).withColumnRenamed("steps", "top_steps")
    tops = names.join(top, ["grp", "pos"]).select("name", "subroot", "top_steps")
    # What continues the witnesses of a block's leaves, made once per block.
    own = blocks[0].select("grp", "pos")
    upper = _continued(rounds[1:], bits)
    if upper is not None:
        upper = own.join(upper, null_safe(own, upper, ["grp", "pos"]), "left").select(own["grp"], own["pos"], "steps")
    else:
        upper = own.withColumn("steps", F.lit(b""))
    upper = upper.join(tops, upper["grp"].eqNullSafe(tops["name"])).select(
        F.col("grp").alias("up_grp"), F.col("pos").alias("up_pos"), "subroot",
        F.concat(F.coalesce("steps", F.lit(b"")), F.col("top_steps")).alias("up_steps"),
    )
    upper = materialize(upper, "block-witnesses")
    root = top_roots.first()  # one row, or none of an empty table
    low = rounds[0]
    cond = low["grp"].eqNullSafe(upper["up_grp"]) & (F.shiftright(low["pos"], bits) == upper["up_pos"])
    return low.join(upper, cond).select(
        *leaves.columns, F.concat("steps", "up_steps").alias("steps"), "subroot", F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root")
    )


def _step(steps: Column, i: Column) -> tuple[Column, Column]:
    """Side and hex digest of one level of a witness."""
    at = (i * STEP).cast("int")
    return F.substring(steps, at + 1, F.lit(1)), F.lower(F.hex(F.substring(steps, at + 2, F.lit(STEP - 1))))


def _levels(steps: Column) -> Column:
    n = F.octet_length(steps) / STEP
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def fold(leaf: Column, steps: Column) -> Column:
    """Hex root that a hex leaf and its witness lead to."""

    def up(node: Column, i: Column) -> Column:
        side, digest = _step(steps, i)
        return F.sha2(F.when(side == F.lit(LEFT), F.concat(digest, node)).when(side == F.lit(RIGHT), F.concat(node, digest)).otherwise(node), 256)

    return F.aggregate(_levels(steps), leaf, up)


def sibling_digests(steps: Column) -> Column:
    """Array of the hex digests of a witness, from the leaf to the root; a level without a sibling has none."""
    known = F.filter(_levels(steps), lambda i: _step(steps, i)[0] != F.lit(ALONE))
    return F.transform(known, lambda i: _step(steps, i)[1])


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))
