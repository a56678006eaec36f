"""A Merkle manifest of a table of documents: one digest for all of it, and for each document a proof that it is in there.

A document's leaf is the SHA-256 of its fields, each ``-`` if null, else its length in UTF-8 bytes, a colon and its value.
The leaves of a language, ascending by doc_id, are joined in runs of ``fanout`` (the last run may be shorter, even one
node) until one node is left, the language's subroot; the subroots, ordered by language (null first, bytewise), are
joined likewise into the root. A lone leaf is its own subroot, a lone subroot the root. Digests are joined as hex text.

**Cogrouped subtree exchange.** A superblock is a run of ``fanout ** levels`` nodes that stand under one node. Upwards,
every superblock sends that one node to the layer above, so a layer is smaller by that factor and a few layers reach the
root. Downwards, a node's outer nodes (its siblings from there to the root) go back to the superblock it stands for: nodes
and outer nodes are cogrouped by superblock, and one pass over the group redoes the local reduction, joins local and outer
siblings into each proof, and at the leaves folds it. No group has more than a superblock of rows, whatever the language.

Tampering stands for a change after the manifest was made: documents for whose doc_id ``tampered`` holds are folded with
another leaf, and so must not verify.

Empty and null texts are values like any other (``0:`` and ``-``). Rows that share a doc_id, null being the first, are
ordered by their leaves; rows alike in all fields are leaves of their own. Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.ranks import numbered
from exposure.llm.shared import small, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def every_seventh(doc_id: Column) -> Column:
    """Whether 7 divides the crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame, tampered=every_seventh) -> DataFrame:
    """doc_id, lang, leaf and bent (the leaf with one more in n_chars where ``tampered`` holds, else null), as bytes."""
    own = {name: F.col(name) for name in FIELDS} | {"doc_id": F.col("doc_id").cast("long")}
    more = own | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    bent = F.when(tampered(own["doc_id"]), F.unhex(digest(list(more.values()))))
    return docs.select(own["doc_id"].alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.unhex(digest(list(own.values()))).alias("leaf"), bent.alias("bent"))


def joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def climb(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """``nodes`` and the nodes of each of the ``levels`` above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([joined(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(tree: list[list[str]], place: int, fanout: int) -> list[str]:
    """For each level below the top, what stands before and after the node in its run, with a colon between."""
    out = []
    for level in tree[:-1]:
        first = place - place % fanout
        out.append("".join(level[first:place]) + ":" + "".join(level[place + 1 : first + fanout]))
        place //= fanout
    return out


def fold(node: str, proof: list[str]) -> str:
    """The root that ``node`` and its siblings give."""
    for step in proof:
        before, after = step.split(":")
        node = joined([before, node, after])
    return node


def _local(group: pd.DataFrame, size: int, levels: int, fanout: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock's nodes in order, and its part of the tree."""
    group = group.sort_values("pos", kind="stable")
    n = int(group["n"].iloc[0])
    return group, climb([bytes(x).hex() for x in group["node"]], levels if n > size else height(n, fanout), fanout)


class Tree:
    """Trees of stored nodes: ``layers[0]`` has (tree, pos, n, node, ...), each layer above has the tops of its superblocks."""

    def __init__(self, nodes: DataFrame, fanout: int, levels: int):
        size = self.size = fanout**levels
        self.fanout, self.levels, self.layers = fanout, levels, [nodes.withColumn("block", F.expr(f"pos div {size}"))]

        def top(group: pd.DataFrame) -> pd.DataFrame:
            group, tree = _local(group, size, levels, fanout)
            first = group.iloc[0]
            return pd.DataFrame({"tree": [first["tree"]], "pos": [first["block"]], "n": [-(-first["n"] // size)], "node": [bytes.fromhex(tree[-1][0])]})

        for _ in range(max(1, -(-height(nodes.agg(F.max("n")).first()[0] or 0, fanout) // levels))):
            above = self.layers[-1].select("tree", "block", "pos", "n", "node").groupBy("tree", "block")
            above = stored(above.applyInPandas(top, "tree long, pos long, n long, node binary"), "superblocks")
            self.layers.append(above.withColumn("block", F.expr(f"pos div {size}")))

    def roots(self) -> DataFrame:
        """(tree, node)."""
        return self.layers[-1].select("tree", "node")

    def outer(self, roots: DataFrame) -> DataFrame:
        """Per superblock of the leaves: tree, block, path (the siblings of its top up to the root) and what else ``roots`` (tree, path,
        more columns) has for the tree."""
        carried = [c for c in roots.columns if c not in ("tree", "path")]
        schema = "tree long, block long, path array<string>, " + ", ".join(f"{c} string" for c in carried)
        now = roots.withColumn("block", F.lit(0).cast("long"))
        size, levels, fanout = self.size, self.levels, self.fanout

        def down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            nodes, tree = _local(nodes, size, levels, fanout)
            above = outer.iloc[0]
            paths = [siblings(tree, i, fanout) + list(above["path"]) for i in range(len(nodes))]
            return pd.DataFrame({"tree": nodes["tree"].to_numpy(), "block": nodes["pos"].to_numpy(), "path": paths, **{c: above[c] for c in carried}})

        for layer in reversed(self.layers[1:-1]):
            nodes = layer.select("tree", "block", "pos", "n", "node").groupBy("tree", "block")
            now = stored(nodes.cogroup(now.groupBy("tree", "block")).applyInPandas(down, schema), "outer")
        return now


def manifest(docs: DataFrame, fanout: int = 2, levels: int = 12, tampered=every_seventh, proofs: bool = False) -> DataFrame:
    """Per document row: doc_id, leaf, subroot, root, proof_sha256 (of its siblings, from the leaf to the root), folded_root (from
    the tampered leaf, if there is one, and the siblings), verified, and with ``proofs`` the siblings of each level."""
    # an id goes to the tasks as a number and a flag, so that pandas never makes a float of it
    known = F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id")
    found = stored(leaves(docs, tampered).select("lang", *known, "leaf", "bent", F.monotonically_increasing_id().alias("row")), "leaves")
    langs = stored(found.select("lang").distinct().select(F.lit(0).cast("long").alias("top"), "lang"), "langs")
    langs = stored(numbered(langs, "top", [F.col("lang").isNotNull(), "lang"], "lang-order").select(F.col("pos").alias("tree"), F.col("lang").alias("_lang")), "lang-numbers")
    keyed = found.join(small(langs), found["lang"].eqNullSafe(langs["_lang"])).select("tree", "has_id", "id", "leaf", "bent", "row")
    placed = numbered(stored(keyed, "keyed"), "tree", ["has_id", "id", "leaf", "row"], "leaf-order")
    own = Tree(placed.withColumnRenamed("leaf", "node"), fanout, levels)

    subroots = own.roots().select(F.lit(0).cast("long").alias("top"), "tree", "node")
    over = numbered(stored(subroots, "subroots"), "top", ["tree"], "subroot-order").select(F.col("top").alias("tree"), "pos", "n", "node", F.col("tree").alias("own"))
    top = Tree(over, fanout, levels)
    start = top.roots().select("tree", F.array().cast("array<string>").alias("path"), F.lower(F.hex("node")).alias("root"))
    size = own.size

    def of_subroots(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, tree = _local(nodes, size, levels, fanout)
        above = outer.iloc[0]
        paths = [siblings(tree, i, fanout) + list(above["path"]) for i in range(len(nodes))]
        return pd.DataFrame({"tree": nodes["own"].to_numpy(), "path": paths, "subroot": tree[0], "root": above["root"]})

    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, tree = _local(nodes, size, levels, fanout)
        above = outer.iloc[0]
        beyond, rows = list(above["path"]), []
        for i, (leaf, bent) in enumerate(zip(tree[0], nodes["bent"])):
            proof = siblings(tree, i, fanout) + beyond
            folded = fold(leaf if bent is None else bytes(bent).hex(), proof)
            rows.append((leaf, joined([step.replace(":", "") for step in proof]), folded, folded == above["root"], proof))
        leaf, sums, folded, verified, proof = zip(*rows)
        out = {"doc_id": pd.arrays.IntegerArray(nodes["id"].to_numpy(), ~nodes["has_id"].to_numpy()), "leaf": leaf, "subroot": above["subroot"], "root": above["root"], "proof_sha256": sums, "folded_root": folded, "verified": verified}
        return pd.DataFrame(out | {"proof": proof} if proofs else out)

    roots = over.withColumn("block", F.expr(f"pos div {size}")).groupBy("tree", "block").cogroup(top.outer(start).groupBy("tree", "block"))
    roots = stored(roots.applyInPandas(of_subroots, "tree long, path array<string>, subroot string, root string"), "roots")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * proofs
    return own.layers[0].groupBy("tree", "block").cogroup(own.outer(roots).groupBy("tree", "block")).applyInPandas(finish, schema)
