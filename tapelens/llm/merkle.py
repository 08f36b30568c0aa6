"""Merkle manifest of a table, its levels kept as concatenated strings.

A leaf is the SHA-256 (lower-case hex) of a row's fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and its value. The leaves of a branch (one value of the branch column) stand in the
order of their ids. They are cut into aligned blocks of ``8 ** LEVELS``; a block keeps each of its
levels as one hex string, so that a node is a fixed-width substring, a parent the hash of eight
neighbouring ones, and a node's siblings the two substrings beside it in its run of eight. What
remains of the blocks is the next round's string of nodes, and so on up to one node, the branch's
root. The roots of the branches, in the order of their names, are the leaves of the tree above.

Places come from one range partitioning on (branch, id, leaf): a row's number in its partition plus
the rows of the branch before that partition, so no task holds a branch, however much of the table
it has. Groups are blocks of at most ``8 ** LEVELS`` nodes.

Nulls: a null field is ``-``; null ids come first in a branch; the null branch comes first. Empty
texts are ``0:``. Rows with equal ids stand in the order of their leaves, and equal rows are leaves
of their own. A branch with one leaf has that leaf as its root; with one branch its root is the
table's. An empty table gives an empty result. A text is hashed whole, in one piece of memory. Only
the named columns are read; names in the input never clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, scratch, stored

ARITY, HEX = 8, 64
#: Levels that a block holds.
LEVELS = 3
BLOCK, RUN = ARITY**LEVELS, ARITY * HEX
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def branch_key(value: Column) -> Column:
    """Name of a branch that is never null and sorts null first."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def placed(rows: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """Rows with their ``place`` in the branch, from 0, and the branch's ``total``.

    The stored table is sorted, so a row's serial number holds its partition and its number there;
    one row per partition and branch says how many leaves come before.
    """
    keys = ["branch", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = stored(ranged.withColumn("serial", F.monotonically_increasing_id()), folder, name)
    numbered = numbered.withColumn("part", F.shiftright("serial", 33))
    runs = numbered.groupBy("branch", "part").agg(F.min("serial").alias("first"), F.count(F.lit(1)).alias("rows"))
    parts = Window.partitionBy("branch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(parts), F.lit(0))
    runs = runs.select("branch", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("branch")).alias("total"))
    joined = numbered.join(runs, ["branch", "part"])
    return joined.select(*rows.columns, (F.col("serial") + F.col("shift")).alias("place"), "total")


def parents(level: Column) -> Column:
    """The next level's string: each run of eight nodes hashed."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * RUN + 1, F.lit(RUN)), 256)), "")


def blocks(nodes: DataFrame, carried: list[str], depth: int, folder: str, name: str) -> DataFrame:
    """One row per block of a round: its members, its levels as strings, and the node it comes to.

    ``nodes``: branch, place, total, leaf and the carried columns. A tree of n leaves has as many
    levels as n - 1 has octal digits; ``steps`` are those that this round climbs.
    """
    height = F.when(F.col("total") > 1, F.length(F.conv((F.col("total") - 1).cast("string"), 10, 8))).otherwise(0)
    member = F.struct("place", "leaf", *carried)
    grouped = nodes.groupBy("branch", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members")
    )
    rows = grouped.select(
        "branch",
        "block",
        "total",
        F.greatest(F.lit(0), F.least(F.lit(LEVELS), height - LEVELS * depth)).alias("steps"),
        F.transform("members", lambda m: F.struct(m["place"].alias("place"), *[m[c].alias(c) for c in carried])).alias("members"),
        F.array_join(F.transform("members", lambda m: m["leaf"]), "").alias("level0"),
    )
    for k in range(LEVELS):
        below = F.col(f"level{k}")
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("steps") > k, parents(below)).otherwise(below))
    return stored(rows.withColumnRenamed(f"level{LEVELS}", "node"), folder, name)


def rounds(nodes: DataFrame, carried: list[str], folder: str, name: str) -> list[DataFrame]:
    """The block tables from the leaves to the roots of the branches."""
    out, most = [], nodes.agg(F.max("total")).first()[0] or 1
    while not out or BLOCK ** len(out) < most:
        out.append(blocks(nodes, carried if not out else [], len(out), folder, f"{name}-{len(out)}"))
        nodes = out[-1].select("branch", F.col("block").alias("place"), "total", F.col("node").alias("leaf"))
    return out


def siblings(rank: Column) -> Column:
    """Of the member with this number in its block: what stands before and after it, level by level."""
    out = []
    for k in range(LEVELS):
        level, at = F.col(f"level{k}"), F.shiftright(rank, 3 * k)
        inside = at.bitwiseAND(F.lit(ARITY - 1))
        before = F.substring(level, (at - inside) * HEX + 1, inside * HEX)
        after = F.substring(level, (at + 1) * HEX + 1, (F.lit(ARITY - 1) - inside) * HEX)
        out.append(F.struct(before.alias("before"), after.alias("after")))
    return F.slice(F.array(*out), F.lit(1), F.col("steps"))


def descend(tables: list[DataFrame], above: DataFrame, carried: list[str], folder: str, name: str) -> DataFrame:
    """Paths from the roots down: every leaf's carried columns, its path, and what its root has.

    ``above``: branch, block (0), path, and further columns of the branch. Blocks meet the paths of
    their own node, one row each; the leaves are opened afterwards.
    """
    extra = [c for c in above.columns if c not in ("branch", "block", "path")]
    for k in reversed(range(len(tables))):
        held = carried if k == 0 else []

        def opened(m: Column, rank: Column) -> Column:
            own = F.substring("level0", rank * HEX + 1, F.lit(HEX))
            return F.struct(m["place"].alias("place"), own.alias("leaf"), siblings(rank).alias("own"), *[m[c].alias(c) for c in held])

        joined = tables[k].join(above, ["branch", "block"])
        rows = joined.select("branch", "path", *extra, F.inline(F.transform("members", opened)))
        path = F.concat("own", "path").alias("path")
        if k:
            above = stored(rows.select("branch", F.col("place").alias("block"), path, *extra), folder, f"{name}-{k}")
    return rows.select("branch", "place", "leaf", path, *held, *extra)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proofs(leaves: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """Branch, place, leaf, path, carried columns, subroot and root of every row.

    ``leaves``: branch (never null), leaf, and the named columns. Both trees are the same work.
    """
    folder = scratch(leaves.sparkSession, "merkle")
    tables = rounds(placed(leaves, order, folder, "leaves"), carried, folder, "tree")
    subroots = tables[-1].select(F.lit("").alias("branch"), F.col("branch").alias("name"), F.col("node").alias("leaf"))
    top = rounds(placed(subroots, ["name"], folder, "subroots"), ["name"], folder, "top")
    root = top[-1].select("branch", "block", F.slice(F.array(F.struct(F.lit("").alias("before"), F.lit("").alias("after"))), 1, 0).alias("path"), F.col("node").alias("root"))
    names = descend(top, root, ["name"], folder, "top-paths")
    above = stored(names.select(F.col("name").alias("branch"), F.lit(0).cast("long").alias("block"), "path", F.col("leaf").alias("subroot"), "root"), folder, "branches")
    return descend(tables, above, carried, folder, "paths")


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", branch_col: str = "lang", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Manifest of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` gives changed values of some columns for the rows that ``where`` holds for; their
    leaves are folded with the original siblings, so ``verified`` tells whether the change shows.
    """
    own = [F.col(quoted(c)) for c in columns]
    changed = [(tampered or {}).get(c, F.col(quoted(c))) for c in columns]
    picked = docs.select(
        branch_key(F.col(quoted(branch_col))).alias("branch"),
        F.col(quoted(id_col)).cast("long").alias("doc_id"),
        leaf(own).alias("leaf"),
        (F.when(where, leaf(changed)) if where is not None else F.lit(None).cast("string")).alias("changed"),
    )
    rows = proofs(stored(picked, scratch(docs.sparkSession, "merkle"), "hashed"), ["doc_id", "leaf"], ["doc_id", "changed"])
    fold = folded(F.coalesce("changed", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)
