"""A Merkle manifest of a dataset, with a version of the tree for every tampered row.

The tree is persistent: a version copies the ancestors of its one changed leaf and
shares every other node.  Leaves stand in aligned blocks of seven levels of three, each of which is the work of one task; the tops of the blocks are the
leaves of the blocks above, and so on, for each source and then for the list of the
sources.  A version is begun in the block of its leaf and continued upwards over the
nodes that the blocks above have handed down, so versions are made wherever their
leaves are, and no task sees more than one block and the path above it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Children of a node, and levels of a block (of 2187 leaves).
RUN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class BlockTree:
    """The nodes of one aligned block; versions share all of them but those they copy."""

    def __init__(self, leaves: list[bytes], levels: int, whole: bool):
        """``whole``: the block has neighbours, so it climbs all levels; else it climbs to one node."""
        self.levels = [leaves]
        while len(self.levels) <= levels and (whole or len(self.levels[-1]) > 1):
            below = self.levels[-1]
            self.levels.append([digest(*below[k : k + RUN]) for k in range(0, len(below), RUN)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """What stands left and right of the path of leaf ``at`` in each run, from below."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % RUN
            out.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1 : first + RUN])))
            at //= RUN
        return out


def copied_path(leaf: bytes, siblings: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The nodes that a version with ``leaf`` has of its own: the leaf and its ancestors."""
    path = [leaf]
    for left, right in siblings:
        path.append(digest(left, path[-1], right))
    return path


def _encoded(values: list[Column]) -> Column:
    """Each value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaf_digests(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, stratum, leaf, changed``: the digest of each row and of what tampering makes of it.

    ``fields`` name the id, the source, ..., and the text, which comes last.  Rows
    whose id has an even CRC-32 are tampered with: the newlines of their text go.
    ``stratum`` is the source in an order with null first.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    flagged = F.coalesce(F.crc32(columns[0].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    short = F.translate(columns[-1].cast("string"), "\n", "")
    hashed = df.select(
        columns[0].cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), columns[1].cast("string")), F.lit("")).alias("stratum"),
        F.sha2(_encoded(columns).cast("binary"), 256).alias("leaf"),
        F.when(flagged & F.contains(columns[-1].cast("string"), F.lit("\n")), F.sha2(_encoded([*columns[:-1], short]).cast("binary"), 256)).alias("other"),
    )
    return hashed.select("doc_id", "stratum", "leaf", F.coalesce("other", "leaf").alias("changed"))


def _numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in each group, in ``order``, null first) and ``total`` rows of the group.

    The rows are dealt by ranges of group and order, so a group of any size is many
    tasks' work; each task numbers what it has, and the counts before it are added.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "__tie")]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__part", F.spark_partition_id())
    at = dealt.columns.index(group)

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(at)
            begins = np.concatenate([[True], pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(names)), 0))
            place = np.arange(len(names)) - first
            if names[0].as_py() == last:
                place[first == 0] += seen
            last, seen = names[-1].as_py(), int(place[-1]) + 1
            yield batch.append_column("__place", pa.array(place, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    numbered = materialize(dealt.mapInArrow(run, f"{fields}, __place long"), label)
    counts = numbered.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("total"))
    return numbered.join(starts, [group, "__part"]).withColumn("pos", F.col("__start") + F.col("__place")).drop("__part", "__start", "__place")


def _block(nodes: DataFrame, levels: int):
    return nodes.withColumn("block", F.expr(f"pos div {RUN**levels}")).groupBy("stratum", "block")


def _tree(table: pa.Table, levels: int) -> tuple[pa.Table, BlockTree]:
    table = table.sort_by("pos")
    return table, BlockTree([x.encode() for x in table.column("leaf").to_pylist()], levels, table.column("total")[0].as_py() > RUN**levels)


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The tops of the blocks, as the nodes of the next round."""

    def run(key, table):
        _, tree = _tree(table, levels)
        total = -(-table.column("total")[0].as_py() // RUN**levels)
        return pa.table({"stratum": [key[0].as_py()], "pos": [key[1].as_py()], "total": [total], "leaf": [tree.top.decode()]})

    kept = nodes.select("stratum", "pos", "total", "leaf")
    return materialize(_block(kept, levels).applyInArrow(run, "stratum string, pos long, total long, leaf string"), "tops")


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of every round, each the tops of the round before; groups leave when one node is left."""
    rounds = [_tops(nodes, levels)]
    while not rounds[-1].where("total > 1").isEmpty():
        rounds.append(_tops(rounds[-1].where("total > 1"), levels))
    return rounds


_PATH = "stratum string, pos long, left array<string>, right array<string>, subroot string, root string"


def _descend(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The path to the root of every node, from those of the tops of its blocks."""

    def run(key, table, paths):
        table, tree = _tree(table, levels)
        path = paths.to_pylist()[0]
        own = [tree.siblings(k) for k in range(table.num_rows)]
        return pa.table({
            "stratum": table.column("stratum"), "pos": table.column("pos"),
            "left": pa.array([[a.decode() for a, _ in steps] + path["left"] for steps in own], pa.list_(pa.string())),
            "right": pa.array([[b.decode() for _, b in steps] + path["right"] for steps in own], pa.list_(pa.string())),
            "subroot": [path["subroot"]] * len(own), "root": [path["root"]] * len(own),
        })

    kept = nodes.select("stratum", "pos", "total", "leaf")
    return _block(kept, levels).cogroup(above.withColumn("block", F.col("pos")).groupBy("stratum", "block")).applyInArrow(run, _PATH)


def _paths(rounds: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes of the first of ``rounds``; ``ends`` has those of each group's last node."""
    paths = None
    for nodes in reversed(rounds):
        last = nodes.where("total = 1").select("stratum", "pos", F.col("leaf").alias("subroot")).join(ends, "stratum").select("stratum", "pos", "left", "right", "subroot", "root")
        paths = materialize(last if paths is None else last.unionByName(_descend(nodes.where("total > 1"), paths, levels)), "paths")
    return paths


def merkle_manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A row is a leaf, the leaves of a source make a tree with three children a node,
    and the sources' roots make the tree above it.  ``proof_sha256`` is over the
    siblings of the path, ``folded_root`` is the root of the row's own version
    (see :func:`leaf_digests` for the tampering), ``verified`` whether it is the
    same.  ``fields`` name id, source, further fields and text; ``levels`` of three
    make a block, whose size changes no digest.

    Nulls have a mark of their own in a digest; null sources are a source, which
    comes first, and null ids come first in theirs.  Repeated rows are leaves of
    their own, equal ids stand in the order of their leaves; a source of one row is
    its leaf; an empty table gives an empty result; further columns are ignored.
    """
    leaves = materialize(leaf_digests(df, fields), "leaves")
    placed = materialize(_numbered(leaves, "stratum", ["doc_id", "leaf"], "numbered"), "placed")
    rounds = _climb(placed, levels)
    tops = [r.where("total = 1").select(F.col("stratum").alias("name"), "leaf", F.lit("").alias("stratum")) for r in rounds]
    named = tops[0]
    for more in tops[1:]:
        named = named.unionByName(more)
    sources = materialize(_numbered(named, "stratum", ["name"], "sources"), "source-nodes")
    upper = _climb(sources, levels)
    empty = F.array().cast("array<string>")
    whole = upper[-1].where("total = 1").select("stratum", empty.alias("left"), empty.alias("right"), F.col("leaf").alias("root"))
    of_source = _descend(sources, _paths(upper, whole, levels), levels).join(sources.select("pos", "name"), "pos").select(F.col("name").alias("stratum"), "left", "right", "root")
    above = _paths(rounds, materialize(of_source, "source-paths"), levels)

    def run(key, table, paths):
        table, tree = _tree(table, levels)
        path = paths.to_pylist()[0]
        upper_steps = [(a.encode(), b.encode()) for a, b in zip(path["left"], path["right"], strict=True)]
        proofs, roots = [], []
        for k, changed in enumerate(table.column("changed").to_pylist()):
            steps = tree.siblings(k) + upper_steps
            proofs.append(digest(*[x for pair in steps for x in pair]).decode())
            roots.append(copied_path(changed.encode(), steps)[-1].decode())
        same = [path["root"]] * len(roots)
        return pa.table({
            fields[0]: table.column("doc_id"), "leaf": table.column("leaf"), "subroot": pa.array([path["subroot"]] * len(roots)), "root": pa.array(same),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(roots), "verified": pa.array([r == s for r, s in zip(roots, same, strict=True)]),
        })

    schema = f"`{fields[0]}` long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = _block(placed, levels).cogroup(above.withColumn("block", F.col("pos")).groupBy("stratum", "block"))
    return rows.applyInArrow(run, schema)
