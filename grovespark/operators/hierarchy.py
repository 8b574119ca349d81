"""Parent-child links to full hierarchies, by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.session import cut


def pack(c: Column) -> Column:
    """A shorter, reversible form of an id for joins: `kind:<32 hex>` becomes 16 bytes and the kind, any other text itself."""
    hexed = F.substring_index(c, ":", -1)
    fits = c.rlike(r"^[a-z_]+:[0-9a-f]{32}\z")  # $ would let a line break at the end through
    return F.when(fits, F.concat(F.lit(b"\x01"), F.unhex(hexed), F.encode(F.substring_index(c, ":", 1), "UTF-8"))).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8")))


def unpack(c: Column) -> Column:
    body = F.decode(F.substring(c, 18, 1 << 20), "UTF-8")
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.concat(body, F.lit(":"), F.lower(F.hex(F.substring(c, 2, 16))))).otherwise(F.decode(F.substring(c, 2, 1 << 30), "UTF-8"))


def _parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(c, p), packed: each child with its least parent. The least is taken of the ids themselves; packed ones sort otherwise."""
    e = links.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(pack(F.col(child)).alias("c"), F.col(parent).alias("p"))
    return cut(e.groupBy("c").agg(F.min("p").alias("p")).select("c", pack(F.col("p")).alias("p")))


def resolve(links: DataFrame, child: str = "target", parent: str = "source", path: bool = False) -> DataFrame:
    """(node, root, depth[, path]) of every child in `links`.

    Only nodes that are both child and parent ("inner" nodes) take part in the doubling; leaves join their parent's
    result once at the end. Each round joins every unresolved inner node's pointer with the pointer of its ancestor, so
    the jump doubles: after k rounds all nodes with at most 2^k steps to a root are resolved. Depths along a chain have
    no holes, so a round that resolves nothing proves that the rest is on a cycle or below one, however many it is.

    `root` is the id reached by going up until an id that is no child; `depth` the number of steps; `path` the ids from
    the root down to the node. On a cycle or below one: root '', depth -1, path null. Null ends are no links; repeated
    links count once; a child with several parents keeps the least, so the result is the same in every run. No links:
    no rows. A parent's own row is not needed. A link of a node to itself is a cycle.
    """
    e = _parents(links, child, parent)
    inner = e.join(e.select(F.col("p").alias("c")).distinct(), "c", "left_semi")

    seg = [F.array(F.col("c")).alias("way")] if path else []
    way = ["way"] if path else []
    # way: the ids from just below `a` down to the node itself.
    open_ = cut(inner.select("c", F.col("p").alias("a"), F.lit(1).alias("d"), *seg))
    settled: list[DataFrame] = []
    while True:
        ptr = open_.select(F.col("c").alias("a"), F.col("a").alias("a2"), F.col("d").alias("d2"), F.lit(False).alias("end"), *([F.col("way").alias("way2")] if path else []))
        if settled:
            known = reduce(DataFrame.unionByName, settled)
            ptr = ptr.unionByName(known.select(F.col("c").alias("a"), F.col("root").alias("a2"), F.col("d").alias("d2"), F.lit(True).alias("end"), *([F.col("way").alias("way2")] if path else [])))
        step = open_.join(ptr, "a", "left")
        longer = [F.when(F.col("a2").isNull(), F.col("way")).otherwise(F.concat("way2", "way")).alias("way")] if path else []
        step = cut(
            step.select(
                "c",
                F.coalesce("a2", "a").alias("a"),
                (F.col("d") + F.coalesce("d2", F.lit(0))).cast("int").alias("d"),
                F.coalesce("end", F.lit(True)).alias("done"),
                *longer,
            )
        )
        # Ancestors that are no inner nodes are roots: a parent that is also a child is inner by definition.
        n_done, n_open = step.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        settled.append(step.where("done").select("c", F.col("a").alias("root"), "d", *way))
        open_ = step.where("not done").drop("done")
        if not n_open or not n_done:
            break
    known = reduce(DataFrame.unionByName, settled)
    rest = open_.select("c", F.lit(b"").alias("root"), F.lit(-1).alias("d"), *([F.lit(None).cast("array<binary>").alias("way")] if path else []))
    known = known.unionByName(rest).withColumnRenamed("c", "p").withColumnRenamed("d", "pd")
    out = e.join(known, "p", "left")
    up = F.col("pd")
    res = out.select(
        unpack(F.col("c")).alias("node"),
        F.when(up == -1, F.lit("")).otherwise(unpack(F.coalesce("root", "p"))).alias("root"),
        F.when(up == -1, F.lit(-1)).otherwise(F.coalesce(up, F.lit(0)) + 1).cast("int").alias("depth"),
        *(
            [
                F.when(up.isNull(), F.array("p", "c")).when(up != -1, F.concat(F.array("root"), F.col("way"), F.array("c"))).alias("_way")
            ]
            if path
            else []
        ),
    )
    return res.select("node", "root", "depth", F.transform("_way", unpack).alias("path")) if path else res


def descendants(links: DataFrame, child: str = "target", parent: str = "source", cyclic: bool = False) -> DataFrame:
    """(ancestor, node, distance): every ancestor of every node outside cycles. The pairs come from the nodes' paths, so
    no ancestor's descendants are ever gathered in one task. Nodes on or below a cycle have none; with `cyclic` each of
    them has one row that says so: ancestor '', distance -1."""
    r = resolve(links, child, parent, path=True)
    r = r if cyclic else r.where("path is not null")
    pairs = r.select("node", "depth", F.posexplode_outer("path").alias("_at", "ancestor")).where("depth = -1 or _at < depth")
    return pairs.select(F.coalesce("ancestor", F.lit("")).alias("ancestor"), "node", F.coalesce(F.col("depth") - F.col("_at"), F.lit(-1)).alias("distance"))


def subtree_sizes(links: DataFrame, child: str = "target", parent: str = "source") -> DataFrame:
    """(ancestor, n_descendants, height) of every parent outside cycles, without a pair per ancestor and node.

    Each inner node starts with the number of its children; in round k it adds what the inner nodes 2^k steps below it have
    gathered, and its pointer jumps on, so after logarithmic rounds each holds the sum of its subtree. Sums are combined
    before the shuffle, so no ancestor's descendants meet in one task. Children on or below a cycle count for nobody.
    """
    e = _parents(links, child, parent)
    sound = resolve(e.select(unpack(F.col("c")).alias("target"), unpack(F.col("p")).alias("source"))).where("depth > 0").select(pack(F.col("node")).alias("c"))
    e = cut(e.join(sound, "c", "left_semi"))
    own = e.groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("s"))
    state = cut(own.join(e.select(F.col("c").alias("v"), F.col("p").alias("a")), "v", "left").select("v", "a", "s", F.lit(1).alias("h")))
    jump = 1
    while not state.where("a is not null").isEmpty():
        more = state.where("a is not null").groupBy(F.col("a").alias("v")).agg(F.sum("s").alias("s2"), (F.max("h") + jump).alias("h2"))
        ptr = state.select(F.col("v").alias("a"), F.col("a").alias("a2"))
        state = cut(state.join(more, "v", "left").join(ptr, "a", "left").select("v", F.col("a2").alias("a"), (F.col("s") + F.coalesce("s2", F.lit(0))).alias("s"), F.greatest("h", F.coalesce("h2", F.lit(0))).alias("h")))
        jump *= 2
    return state.select(unpack(F.col("v")).alias("ancestor"), F.col("s").alias("n_descendants"), F.col("h").cast("int").alias("height"))
