"""A Merkle manifest of a data set: every row's proof leads to one root, and a row that was tampered with doesn't.

A leaf is the SHA-256 of a row's values, worked out natively. Leaves of a source are in the order of their ids; three (FAN) successive nodes become one, level by level, until one
is left, the source's subroot; subroots in the order of their sources become the root in the same way.

Rows get their places by a distributed sort. Blocks of FAN**DEPTH successive nodes are then reduced by one task each, so that a source of any size is many blocks; this is repeated until at most TOP nodes
are left, first to one a source, then over the sources. The driver builds the rest of the tree from these, and the paths from them to the root (suffixes) are broadcast. Executors go
through the blocks once more, from the last ones down, and put each row's siblings before its block's suffix: that is the row's proof. Its fold starts from the leaf as it is now.

Defined results: null values of a row are `-` in its leaf, a null source is a source of its own, the first; null ids come first in their source and are not tampered with; rows of one id are in the order of their
leaves, equal rows have places of their own in any order; columns other than those named are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

FAN = 3
#: Levels that a task reduces at once, 6561 nodes a block, and nodes that the driver may finish.
DEPTH, TOP = 8, FAN**9
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as a leaf has it: bytes, colon, value; - for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def climbed(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """The nodes of each level, from these up; by default until one is left."""
    found = [nodes]
    while len(found[-1]) > 1 if levels is None else len(found) <= levels:
        below = found[-1]
        found.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return found


def path(levels: list[list[str]], at: int) -> list[str]:
    """The siblings of a node: those before it in its run and those after it, level by level, each joined."""
    steps = []
    for nodes in levels[:-1]:
        run = at // FAN * FAN
        steps += ["".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN])]
        at //= FAN
    return steps


def folded(node: str, steps: Sequence[str]) -> str:
    for k in range(0, len(steps), 2):
        node = digest(steps[k], node, steps[k + 1])
    return node


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds at, a row's place in its tree from 0, and size, the tree's number of rows: places within the partitions of a sort, plus those of earlier partitions."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            seen = []
            for t in batch.column(batch.schema.get_field_index(tree)).to_pylist():
                n = n + 1 if t == last else 0
                last = t
                seen.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(seen, pa.int64())], [*batch.schema.names, "part", "at"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ordered = stored(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).mapInArrow(counted, f"{names}, part int, at long"), "ordered")
    parts = ordered.groupBy(F.col(tree).alias("its"), F.col("part").alias("in")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("its")  # a row for each partition that has some of the tree
    before = F.coalesce(F.sum("n").over(of.orderBy("in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("its", "in", before.alias("before"), F.sum("n").over(of).alias("size"))
    joined = ordered.join(parts, (F.col(tree) == F.col("its")) & (F.col("part") == F.col("in")))
    return joined.select(*rows.columns, (F.col("at") + F.col("before")).alias("at"), "size")


def reduced(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, at, size, node) of the level that is depth levels up, or of the tree's one node: a block of nodes is one task's group."""

    def block(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "node")), strict=True))
        at, size = rows[0][0], table.column("size")[0].as_py()
        top = climbed([n for _, n in rows], min(depth, height(size)))[-1]
        return pa.table({"tree": table.column("tree").slice(0, 1), "at": pa.array([at // FAN**depth], pa.int64()), "size": pa.array([-(-size // FAN**depth)], pa.int64()), "node": pa.array(top)})

    return nodes.select("tree", "at", "size", "node").groupBy("tree", F.expr(f"at div {FAN**depth}").alias("block")).applyInArrow(block, "tree string, at long, size long, node string")


def finished(nodes: DataFrame, depth: int, schema: str, row: Callable[[dict, list[str]], dict], suffix) -> DataFrame:
    """What row makes of each node (a row of nodes) and its steps to the root: its own in its block, then suffix(tree, block), or those of the column steps, which a block's first node has."""

    def block(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        levels = climbed([r["node"] for r in rows], min(depth, height(rows[0]["size"])))
        rest = suffix(rows[0]["tree"], rows[0]["at"] // FAN**depth) if suffix else next(r["steps"] for r in rows if r["steps"] is not None)
        found = [row(r, [*path(levels, k), *rest]) for k, r in enumerate(rows)]
        return pa.table({name: pa.array([f[name] for f in found], kind) for name, kind in kinds.items()})

    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = {name: arrow[kind] for name, kind in (c.split() for c in schema.split(", "))}
    return nodes.groupBy("tree", F.expr(f"at div {FAN**depth}").alias("block")).applyInArrow(block, schema)


def proven(rows: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) for rows (doc_id, source, leaf, now): leaf as it was when the manifest was made, now as it is (null: unchanged). proof: the siblings, joined."""
    spark = rows.sparkSession
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id", F.col("leaf").alias("node"), "now")
    leaves = stored(placed(leaves, "tree", ["doc_id", "node"]), "leaves")
    # Upwards: each source to one node, then, if these are too many for the driver, all sources' nodes.
    below, nodes, joined = [leaves], stored(reduced(leaves, depth), "nodes"), None
    while nodes.count() > top:
        if nodes.where("size > 1").isEmpty() and joined is None:
            joined = len(below)
            nodes = stored(placed(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), "tree", ["source"]), "subroots")
        below.append(nodes)
        nodes = stored(reduced(nodes, depth), "nodes")
    # The top of the tree, by the driver.
    trees: dict[str, list[str]] = {}
    for r in sorted(nodes.collect(), key=lambda r: (r["tree"].encode(), r["at"])):
        trees.setdefault(r["tree"], []).append(r["node"])
    if not trees:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    each = {t: climbed(n) for t, n in trees.items()}
    whole = climbed([levels[-1][0] for levels in each.values()])
    root, suffixes = whole[-1][0], {}
    for k, (t, levels) in enumerate(each.items()):
        # Where sources are done, their subroot and the path from it; among the sources' nodes there is no subroot yet.
        end = ["^", levels[-1][0]] if joined is None else []
        for at in range(len(levels[0])):
            suffixes[t, at] = [*path(levels, at), *end, *path(whole, k)]
    shared = spark.sparkContext.broadcast((root, suffixes))

    def suffix(tree: str, block: int) -> list[str]:
        return shared.value[1][tree, block]

    # Downwards: the paths of a level's nodes are those of the level below's blocks.
    last = suffix
    for k in range(len(below) - 1, 0, -1):
        source = "source string, " if joined == k else ""

        def step(r: dict, steps: list[str], named: bool = joined == k) -> dict:
            return {"tree": r["source"], "source": r["source"], "at": 0, "steps": ["^", r["node"], *steps]} if named else {"tree": r["tree"], "at": r["at"], "steps": steps}

        paths = finished(below[k], depth, f"tree string, {source}at long, steps array<string>", step, last)
        paths = stored(paths.select("tree", (F.col("at") * FAN**depth).alias("at"), "steps"), "paths")
        below[k - 1] = below[k - 1].join(paths, ["tree", "at"], "left")
        last = None

    def proof(r: dict, steps: list[str]) -> dict:
        cut = steps.index("^")
        lower, subroot, upper = steps[:cut], steps[cut + 1], steps[cut + 2 :]
        top = shared.value[0]
        again = folded(r["now"], [*lower, *upper]) if r["now"] is not None else folded(folded(r["node"], lower), upper)
        return {"doc_id": r["doc_id"], "leaf": r["node"], "subroot": subroot, "root": top, "proof": "".join(lower + upper), "folded_root": again, "verified": again == top}

    return finished(below[0], depth, "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean", proof, last)


def manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """proven() for documents; tampered: their text as it is now, where it isn't what the manifest was made of."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    docs = docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS), *([tampered.cast("string").alias("__now")] if tampered is not None else []))
    known = [F.col(c) for c in COLUMNS]
    now = F.when(F.col("__now").isNotNull() & ~F.col("__now").eqNullSafe(F.col("text")), leaf([*known[:-1], F.col("__now")])) if tampered is not None else F.lit(None).cast("string")
    return proven(stored(docs.select("doc_id", "source", leaf(known).alias("leaf"), now.alias("now")), "hashed"), depth, top)
