"""Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf; the leaves of a group, in key order, are hashed together
in runs of ``fanout`` until one node, the group's subroot, remains; the
subroots, in the order of their groups (null first, UTF-8 bytewise), are
hashed together likewise into the root.

A tree is climbed in strides of ``HEIGHT`` levels.  Within a stride the nodes
are dealt out in chunks of ``fanout ** HEIGHT`` consecutive ones, and one
window over (group, chunk) does all its levels.  A node's digest stands in the
row of its first leaf, so the nodes of level l are ``fanout ** l`` rows apart:
``lead`` and ``lag`` by fixed offsets, masked by the node's slot in its run
and by the run's length, give its siblings, and first-child rows hash their
run into the parent.  A second climb with the same windows hands the siblings
down again by ``lag``: the way from a leaf to the root is an array of (left,
right) texts, one for each level.

Scale: of a row only its keys and digest move, never its content.  Positions
come from range partitions over (group, key) and their counts, so a group that
holds a third of all rows, or all, is ranked and hashed by many tasks; no
window is larger than a chunk.  There is one stride for every ``HEIGHT``
levels, each on a table ``fanout ** HEIGHT`` times smaller than the last.

Defined results: null fields are hashed as ``-``, texts as their UTF-8 length,
``:`` and themselves; a null group is a group like any other; null keys come
first; rows with equal keys are ordered by their leaf, so repeated rows give
the same tree in any order; a lone leaf is its own subroot, a lone subroot the
root; an empty table gives no rows.  Extra columns play no part unless they are
named in ``fields``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

FANOUT = 2
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WAY = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field so written that no two lists of fields look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (with ``grp``, ``key`` and ``node``) plus ``pos``, the rank in
    the group, and ``n``, the group's size.

    The rows are sorted into ranges of (group, key, node) and written; a row's
    rank is its number in its partition plus the rows of its group in earlier
    partitions (a table of at most partitions + groups rows).
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "key", "node"]
    staged = written(
        leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()),
        "merkle-leaves",
    ).withColumn("part", F.shiftright("id", 33))
    counted = staged.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        counted.select(
            "part", "grp", "first_id", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"), F.sum("rows").over(whole).alias("n")
        ),
        "merkle-offsets",
    )
    placed = staged.join(offsets, ["part", "grp"])
    return placed.withColumn("pos", F.col("earlier") + F.col("id") - F.col("first_id")).drop("id", "part", "first_id", "earlier")


class Stride:
    """The levels inside one chunk of nodes (``grp, pos, n, node`` and others)."""

    def __init__(self, nodes: DataFrame, fanout: int, height: int):
        self.fanout, self.height, self.size = fanout, height, fanout**height
        self.nodes = nodes.withColumn("chunk", F.floor(F.col("pos") / F.lit(self.size)).cast("long"))
        self.window = Window.partitionBy("grp", "chunk").orderBy("pos")
        self.near = range(1, fanout)

    def _climbed(self, nodes: DataFrame, siblings: bool = False) -> DataFrame:
        """``nodes`` plus every level's digests, ``node0`` .. ``node{height}``,
        null in rows that hold no node of the level; with ``siblings`` also
        the texts left and right of the node in its run, ``left{l}`` and
        ``right{l}``."""
        out = nodes.withColumnRenamed("node", "node0")
        for level in range(self.height):
            node, step = f"node{level}", self.fanout**level
            slot = self._slot(level)
            out = out.withColumns({f"after{j}": F.lead(node, j * step).over(self.window) for j in self.near})
            # a run ends with its last slot, or with the level's last node
            after = [
                F.when((slot + j < self.fanout) & (F.col("pos") + j * step < F.col("n")), F.col(f"after{j}")).otherwise(F.lit(""))
                for j in self.near
            ]
            right = F.concat(*after)
            parent = F.when(F.col("n") > step, digest(F.col(node), right)).otherwise(F.col(node))
            made = {f"node{level + 1}": F.when(F.pmod("pos", F.lit(step * self.fanout)) == 0, parent)}
            if siblings:
                out = out.withColumns({f"before{j}": F.lag(node, j * step).over(self.window) for j in self.near})
                before = [F.when(slot >= j, F.col(f"before{j}")).otherwise(F.lit("")) for j in reversed(self.near)]
                made |= {f"left{level}": F.concat(*before), f"right{level}": right}
            out = out.withColumns(made).drop(*[f"{side}{j}" for side in ("after", "before") for j in self.near])
        return out

    def _slot(self, level: int) -> Column:
        """The place in its run of the node that the row holds at this level."""
        return F.pmod(F.floor(F.col("pos") / F.lit(self.fanout**level)), F.lit(self.fanout))

    def parents(self) -> DataFrame:
        """The nodes of the next stride."""
        top = self._climbed(self.nodes).filter(F.pmod("pos", F.lit(self.size)) == 0)
        return top.select(
            "grp",
            F.col("chunk").alias("pos"),
            F.ceil(F.col("n") / F.lit(self.size)).cast("long").alias("n"),
            F.col(f"node{self.height}").alias("node"),
        )

    def ways(self, above: DataFrame) -> DataFrame:
        """The nodes with ``way``, the (left, right) texts of every level from
        the node to the root.  ``above`` has the ways of the chunks (``grp,
        pos, way``) and columns to hand down."""
        kept = [c for c in above.columns if c not in ("node", "n")]
        chunks = above.select(*kept).withColumnsRenamed({"pos": "chunk", "way": "above"})
        joined = self.nodes.join(chunks, ["grp", "chunk"])
        out = self._climbed(joined, siblings=True).withColumn("way", F.array().cast(_WAY))
        for level in reversed(range(self.height)):
            step, slot = self.fanout**level, self._slot(level)
            out = out.withColumns({f"way{j}": F.lag("way", j * step).over(self.window) for j in self.near})
            parent = F.when(slot == 0, F.col("way"))
            for j in self.near:
                parent = parent.when(slot == j, F.col(f"way{j}"))
            here = F.array(F.struct(F.col(f"left{level}").alias("left"), F.col(f"right{level}").alias("right"))).cast(_WAY)
            way = F.when(F.col("n") > step, F.concat(here, parent)).otherwise(parent)
            out = out.withColumn("way", F.when(F.pmod("pos", F.lit(step)) == 0, way)).drop(*[f"way{j}" for j in self.near])
        same = [c for c in joined.columns if c not in ("chunk", "n", "node", "above")]
        return out.select(*same, F.col("node0").alias("node"), F.concat("way", "above").alias("way"))


def _strides(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """Written tables of nodes, from the leaves to where every group has one."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(written(Stride(out[-1], fanout, height).parents(), "merkle-nodes"))
    return out


def _ways(levels: list[DataFrame], top: DataFrame, fanout: int, height: int) -> DataFrame:
    """The lowest table of ``levels`` with its ways; ``top`` (``grp, pos, way``
    and columns to hand down) has those of the highest."""
    if len(levels) == 1:
        return levels[0].join(top, ["grp", "pos"])
    for i in reversed(range(len(levels) - 1)):
        top = Stride(levels[i], fanout, height).ways(top)
        if i:
            top = written(top, "merkle-ways")
    return top


def manifest(
    rows: DataFrame, key: str, group: str, leaf: Column, carry: dict[str, Column] | None = None, fanout: int = FANOUT, height: int = HEIGHT
) -> DataFrame:
    """One row per row of ``rows``: ``grp`` (the group as text, an ``=`` in
    front; empty for null), ``key``, ``node`` (the leaf), ``subroot``, ``root``
    and ``way``, plus the ``carry`` columns.  ``way`` lists, level by level
    from the leaf to the root, the texts of the siblings to the ``left`` and
    ``right`` (both empty where a node is alone in its run)."""
    more = carry or {}
    own = written(
        rows.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
            F.col(key).alias("key"),
            leaf.alias("node"),
            *[c.alias(name) for name, c in more.items()],
        ),
        "merkle-rows",
    )
    leaves = written(numbered(own), "merkle-numbered")
    levels = _strides(leaves, fanout, height)
    subroots = levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("key"), "node")
    crown = _strides(written(numbered(subroots), "merkle-subroots"), fanout, height)
    root = crown[-1].first()
    no_way = crown[-1].select("grp", "pos", F.array().cast(_WAY).alias("way"))
    tops = _ways(crown, no_way, fanout, height).select(
        F.col("key").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "way"
    )
    down = _ways(levels, written(tops, "merkle-tops"), fanout, height)
    return down.select("grp", "key", "node", "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "way", *more)


def proof_digest(way: Column) -> Column:
    """Digest of all siblings, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its way lead to."""
    return F.aggregate(way, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def verified_documents(spark, sf_dir: str, tampered_by: int = 7) -> DataFrame:
    """The manifest of ``documents`` by ``lang``, each row checked against the
    root; where ``tampered_by`` divides the id's crc32, with one more in
    ``n_chars`` than was hashed."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % tampered_by == 0
    seen = F.when(hit, leaf_digest(changed))
    out = manifest(docs, "doc_id", "lang", leaf_digest(fields), {"changed": seen})
    fold = folded(F.coalesce("changed", "node"), F.col("way"))
    return out.select(
        F.col("key").alias("doc_id"),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("way")).alias("proof_sha256"),
        fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
