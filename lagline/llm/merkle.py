"""A Merkle manifest of a table: one tree a group, one over the groups' roots, and a proof of every row.

Every level is a table. A level's nodes have the index that their order gives
them; nodes whose index floor-divides by the fanout to the same number are a
run, whose sorted child array is hashed into their parent. Levels repeat until
each group has one node, its subroot; the subroots are the leaves of one more
tree. Proofs are made on the way back: a level's runs are joined with their
nodes' paths by (group, index), and every child of a run appends its siblings
and then the run's own path. A level has half the nodes of the one below, so all
levels together move each leaf about twice, whatever the height.

Indices come from positions(): a group that holds most rows is cut into ranges,
not sorted in one task. A run has fanout children at most, and keys of joins are
unique, so nothing is skewed. Every level is written to the shared folder, and
deleted once the next one's paths are.

Digests are lowercase hex sha256; children are concatenated as hex text. A node's
path is an array of steps from its level to the root, each with the siblings
before and after it: folding a leaf with its path gives the root.

Defined results: null groups are a group, ordered first, the others by their
UTF-8 bytes; null ids stand first in their group; of rows with one id the
smaller digest stands first; rows equal in all leaf columns have equal digests
and neighbouring places; a null column enters as "-", an empty text as "0:", long
texts whole; a lone leaf is its group's subroot and a lone subroot the root, with
no siblings; an empty table has no rows and no root; other columns of the table
play no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, positions, stored

FANOUT = 2
#: Steps of a path: digests of a run's other children, as one text each.
PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """A value as it enters a digest: its UTF-8 byte count, a colon and the value; "-" for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def _grow(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """nodes: g, at, n (nodes of g on this level), h, item. The stored runs of each level: g, at, n, h of the parent, and kids in order."""
    tallest = nodes.agg(F.max("n")).first()[0]
    runs, level = [], nodes
    while tallest > 1:
        kids = F.array_sort(F.collect_list(F.struct("at", "h", "item")))  # fanout at most
        run = level.where("n > 1").groupBy("g", F.floor(F.col("at") / fanout).alias("at")).agg(F.ceil(F.first("n") / fanout).alias("n"), kids.alias("kids"))
        run = run.select("g", "at", "n", F.sha2(F.concat_ws("", "kids.h"), 256).alias("h"), "kids")
        runs.append(stored(run, "merkle-runs"))
        level = runs[-1].select("g", "at", "n", "h", F.lit(None).cast("int").alias("item"))
        tallest = -(-tallest // fanout)
    return runs


def _tops(nodes: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """g and h of the node that remains of each group."""
    return reduce(DataFrame.union, [level.where("n = 1").select("g", "h") for level in (nodes, *runs)])


def _paths(nodes: DataFrame, runs: list[DataFrame], start: DataFrame) -> DataFrame:
    """start: g, top, path of each group's remaining node. Returns g, top, h, item, path of every node. Deletes the runs."""
    lone = lambda level: level.where("n = 1").join(start, "g")
    above: DataFrame | None = None  # g, at, top, path of the parents
    for k, run in reversed(list(enumerate(runs))):
        here = lone(run.select("g", "at", "n")).select("g", "at", "top", "path")
        here = here if above is None else here.unionByName(above)
        run = run.select("g", "at", "kids").join(here, ["g", "at"])
        others = lambda keep: F.concat_ws("", F.transform(F.filter("kids", keep), lambda c: c["h"]))
        kid = F.explode(F.transform("kids", lambda me: F.struct(me["at"].alias("at"), me["h"].alias("h"), me["item"].alias("item"), others(lambda c: c["at"] < me["at"]).alias("before"), others(lambda c: c["at"] > me["at"]).alias("after"))))
        kids = run.select("g", "top", kid.alias("kid"), "path")
        path = F.concat(F.array(F.struct("kid.before", "kid.after")), F.col("path")).cast(PATH)
        if not k:
            rows = kids.select("g", "top", "kid.h", "kid.item", path.alias("path"))
            return rows.unionByName(lone(nodes).select("g", "top", "h", "item", "path"))
        below = stored(kids.select("g", "kid.at", "top", path.alias("path")), "merkle-paths")
        if above is not None:
            discard(above)
        above = below
        discard(runs[k])
    return lone(nodes).select("g", "top", "h", "item", "path")


def merkle_manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """leaves: g (text, null: a group of its own), place (its order), h (digest), item (a struct carried along). Returns item, leaf, subroot, root, path."""
    group = F.coalesce(F.concat(F.lit("="), "g"), F.lit(""))  # orders as the groups do, null first
    placed = positions(leaves.select(group.alias("g"), "place", "h", "item"), ["g"], ["place", "h"], "merkle-leaves")
    sizes = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    nodes = stored(placed.join(sizes, "g").select("g", F.col("position").alias("at"), "n", "h", "item"), "merkle-nodes")
    discard(placed)
    none = F.array().cast(PATH)
    if nodes.isEmpty():
        return nodes.select("item", F.col("h").alias("leaf"), F.col("h").alias("subroot"), F.col("h").alias("root"), none.alias("path"))
    runs = _grow(nodes, fanout)
    # the tree over the groups' roots: a row a group
    tops = positions(_tops(nodes, runs).withColumnRenamed("g", "item"), [], ["item"], "merkle-tops")
    count = tops.agg(F.count(F.lit(1)).alias("n"))
    upper = stored(tops.join(F.broadcast(count), F.lit(True)).select(F.lit("").alias("g"), F.col("position").alias("at"), "n", "h", "item"), "merkle-tops")  # one row
    upper_runs = _grow(upper, fanout)
    root = _tops(upper, upper_runs).first().h
    start = _paths(upper, upper_runs, _only(upper, root))
    start = stored(start.select(F.col("item").alias("g"), F.col("h").alias("top"), "path"), "merkle-starts")
    discard(tops)
    rows = _paths(nodes, runs, start)
    return rows.select("item", F.col("h").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).alias("root"), "path")


def _only(df: DataFrame, root: str) -> DataFrame:
    """The upper tree's only group, its root and an empty path."""
    return df.sparkSession.range(1).select(F.lit("").alias("g"), F.lit(root).alias("top"), F.array().cast(PATH).alias("path"))


#: Columns of a document that its leaf is made of, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaf(n_chars: Column | None = None) -> Column:
    """The digest of a document's row; with another n_chars, that of a tampered one."""
    return digest(*(field(n_chars if n_chars is not None and c == "n_chars" else F.col(c)) for c in LEAF))


def document_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root and path of every document: the manifest to keep. fold(leaf, path) proves a row."""
    item = F.struct("doc_id", document_leaf().alias("now"))
    return merkle_manifest(docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("place"), document_leaf().alias("h"), item.alias("item")), fanout).select("item.doc_id", "leaf", "subroot", "root", "path")


def audit_documents(docs: DataFrame, n_chars_now: Column, fanout: int = FANOUT) -> DataFrame:
    """The manifest of docs, and what folding each row's present leaf, with n_chars as it is now, gives."""
    item = F.struct("doc_id", document_leaf(n_chars_now).alias("now"))
    kept = merkle_manifest(docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("place"), document_leaf().alias("h"), item.alias("item")), fanout)
    folded = fold(F.col("item.now"), F.col("path"))
    return kept.select("item.doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
