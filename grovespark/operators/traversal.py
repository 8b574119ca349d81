"""Level-by-level traversal of the graph for many seeds at once."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.operators.relational import REFERRING
from grovespark.session import cut

CONTAINERS = ["class", "interface", "struct", "trait", "protocol", "module", "enum"]


def hops(edges: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """(a, b): distinct steps along edges ('out'), against them ('in') or either way ('both'), without steps to itself."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    out = e.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = e.select(F.col("target").alias("a"), F.col("source").alias("b"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return both.where("a <> b").distinct()


def _merged(levels: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """The same rows in fewer tables once there are many, so that neither plans nor file lists grow with the depth."""
    return [cut(reduce(DataFrame.unionByName, levels))] if len(levels) > most else levels


def reach(seeds: DataFrame, steps: DataFrame, max_depth: int | None, absorbing: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(seed, id, depth): everything within `max_depth` steps of each seed at its least depth; the seed itself at 0.
    Without a `max_depth`, until nothing new is reached.

    One join a level: the frontier meets the steps, new pairs are told from old ones by a left anti join, and the state is
    written out, so the plan of a level never grows. Nodes in `absorbing` (id) are reached but not left again. `limit` is
    the traversal's own cap on nodes per seed: nearer nodes first, then the least ids. Minimum depth makes the outcome free
    of row order, where a depth-first walk with a shared visited set depends on it. Null ids are no nodes; a seed without
    steps reaches itself.
    """
    steps = cut(steps)
    seen = cut(seeds.where("seed is not null").select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")).distinct())
    front, levels = seen, [seen]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(steps, front["id"] == steps["a"]).select("seed", F.col("b").alias("id")).distinct()
        new = step.join(reduce(DataFrame.unionByName, levels).select("seed", "id"), ["seed", "id"], "left_anti")
        new = cut(new.select("seed", "id", F.lit(depth).alias("depth")))
        if new.isEmpty():
            break
        levels = _merged([*levels, new])
        front = new if absorbing is None else new.join(absorbing.select("id"), "id", "left_anti").select("seed", "id", "depth")
    out = reduce(DataFrame.unionByName, levels)
    if limit is not None:
        from grovespark.operators.relational import capped

        out = capped(out, "seed", [F.asc("depth"), F.asc("id")], limit)
    return out


def callers(seeds: DataFrame, edges: DataFrame, max_depth: int = 1) -> DataFrame:
    return reach(seeds, hops(edges, "in", REFERRING), max_depth).where("depth > 0")


def callees(seeds: DataFrame, edges: DataFrame, max_depth: int = 1) -> DataFrame:
    return reach(seeds, hops(edges, "out", REFERRING), max_depth).where("depth > 0")


def type_hierarchy(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth): supertypes at positive depth, subtypes at negative."""
    kinds = ["extends", "implements"]
    up, down = reach(seeds, hops(edges, "out", kinds), max_depth), reach(seeds, hops(edges, "in", kinds), max_depth)
    return up.where("depth > 0").unionByName(down.where("depth > 0").withColumn("depth", -F.col("depth")))


def impact(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(seed, id, depth): what depends on each seed, against all edges but containment. A container brings its members along
    at no cost: its containment closure is entered at the same depth before the next level starts. Depth is the least
    number of dependency steps."""
    inside = hops(edges, "out", ["contains"]).join(nodes.where(F.col("kind").isin(CONTAINERS)).select(F.col("id").alias("a")), "a", "left_semi")
    inside = cut(inside)
    # Few members are containers themselves: their nesting is closed once, so a level needs no rounds of its own.
    nested = closure(inside.join(inside.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    back = cut(hops(edges.where("kind <> 'contains'"), "in"))
    front = seeds.where("seed is not null").select("seed", F.col("seed").alias("id")).distinct()
    seen: list[DataFrame] = []
    for depth in range(max_depth + 1):
        fresh = lambda df: df.join(reduce(DataFrame.unionByName, [x.select("seed", "id") for x in seen]), ["seed", "id"], "left_anti") if seen else df
        front = cut(fresh(front))
        if front.isEmpty():
            break
        boxes = front.unionByName(front.join(nested, front["id"] == nested["a"]).select("seed", F.col("b").alias("id"))).distinct()
        members = boxes.join(inside, boxes["id"] == inside["a"]).select("seed", F.col("b").alias("id"))
        now = cut(fresh(front.unionByName(members).distinct()))
        seen.append(now.withColumn("depth", F.lit(depth)))
        if depth < max_depth:
            front = now.join(back, now["id"] == back["a"]).select("seed", F.col("b").alias("id")).distinct()
    return reduce(DataFrame.unionByName, seen) if seen else front.withColumn("depth", F.lit(0))


def closure(links: DataFrame) -> DataFrame:
    """(a, b): everything that each vertex reaches over links (a, b) in one step or more; ways double in length each round."""
    r, n = cut(links.select("a", "b").distinct()), -1
    while (k := r.count()) != n:
        n = k
        r = cut(r.unionByName(r.select("a", F.col("b").alias("_m")).join(r.select(F.col("a").alias("_m"), "b"), "_m").select("a", "b")).distinct())
    return r


def reach_of_many(seeds: DataFrame, steps: DataFrame, max_depth: int, goals: DataFrame, absorbing: DataFrame | None = None) -> DataFrame:
    """(seed, id, depth) as `reach` gives for the goals (id) only, where seeds meet most vertices: 64 seeds are the bits of a
    number, so a row says of a vertex which of them reach it. Seeds (seed) and vertices are numbers, each row of seeds and
    goals another one; what else these two tables hold comes along, joined before the bits become rows."""
    names = cut(seeds.where("seed is not null").withColumn("_n", F.monotonically_increasing_id()))
    names = names.select(*seeds.columns, F.shiftright("_n", 6).alias("c"), (F.col("_n") % 64).cast("int").alias("bit"))
    steps = cut(steps.select("a", "b"))
    seen = cut(names.select(F.col("seed").alias("id"), "c", F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("id", "c").agg(F.bit_or("bits").alias("bits")))
    front, levels = seen, [seen.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        step = front.join(steps, front["id"] == steps["a"]).groupBy(F.col("b").alias("id"), "c").agg(F.bit_or("bits").alias("bits"))
        both = step.withColumn("_new", F.lit(True)).unionByName(seen.withColumn("_new", F.lit(False))).groupBy("id", "c").agg(F.bit_or(F.when(F.col("_new"), F.col("bits"))).alias("_s"), F.bit_or(F.when(~F.col("_new"), F.col("bits"))).alias("_o"))
        both = cut(both.select("id", "c", F.expr("coalesce(_s, 0L) | coalesce(_o, 0L)").alias("_all"), F.expr("coalesce(_s, 0L) & ~coalesce(_o, 0L)").alias("bits")))
        new = both.where("bits <> 0").select("id", "c", "bits")
        if new.isEmpty():
            break
        levels.append(new.withColumn("depth", F.lit(depth)))
        seen = both.select("id", "c", F.col("_all").alias("bits"))
        front = new if absorbing is None else new.join(absorbing.select("id"), "id", "left_anti")
    got = reduce(DataFrame.unionByName, levels).join(goals, "id")
    sets = names.groupBy("c").agg(F.collect_list(F.struct("bit", *seeds.columns)).alias("_seeds"))
    on = F.filter("_seeds", lambda x: F.call_function("getbit", F.col("bits"), x["bit"]) == 1)
    return got.join(sets, "c").withColumn("_s", F.explode(on)).select("_s.*", *goals.columns, "depth").drop("bit")


def tree(seeds: DataFrame, steps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth, pred): as `reach`, with the least of the nodes that lead to each one from a step nearer; null at the
    seed. The state is a tree per seed, not a set of paths."""
    steps = cut(steps)
    seen = cut(seeds.where("seed is not null").select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("pred")).distinct())
    front, levels = seen, [seen]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(steps, front["id"] == steps["a"]).groupBy("seed", F.col("b").alias("id")).agg(F.min(front["id"]).alias("pred"))
        new = step.join(reduce(DataFrame.unionByName, levels).select("seed", "id"), ["seed", "id"], "left_anti")
        new = cut(new.select("seed", "id", F.lit(depth).alias("depth"), "pred"))
        if new.isEmpty():
            break
        levels = _merged([*levels, new])
        front = new
    return reduce(DataFrame.unionByName, levels)


def shortest_paths(starts: DataFrame, goals: DataFrame, steps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, end, length, path): one shortest way from each start (start) to each goal (end) that it reaches; of several the
    one whose ids are least, read from the end. Starts and goals are never paired before a way is known: each start grows
    its tree, goals are a filter on it, and ways are read off backwards, all at once. Without a `max_depth` the search
    goes on until nothing new is reached. Null ends are none."""
    t = cut(tree(starts.select(F.col("start").alias("seed")), steps, max_depth))
    way = t.join(goals.select(F.col("end").alias("id")).where("id is not null").distinct(), "id", "left_semi").select("seed", F.col("id").alias("end"), F.col("depth").alias("length"), F.col("pred").alias("at"), F.array("id").alias("way"))
    done = []
    while True:
        way = cut(way)
        done.append(way.where("at is null"))
        way = way.where("at is not null")
        if way.isEmpty():
            break
        up = t.select("seed", F.col("id").alias("at"), "pred")
        way = way.join(up, ["seed", "at"]).select("seed", "end", "length", F.col("pred").alias("at"), F.concat(F.array("at"), "way").alias("way"))
        done = _merged(done)
    return reduce(DataFrame.unionByName, done).select(F.col("seed").alias("start"), "end", "length", F.array_join("way", " > ").alias("path"))


def subgraph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, direction: str = "out", kinds: list[str] | None = None, node_kinds: list[str] | None = None, max_depth: int | None = None, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """A breadth-first traversal from each seed with all that belongs to it: nodes (seed, id, depth), at most `limit` a seed,
    nearer ones first, then those reached by containment, then by calls, then the least ids; and every distinct edge
    (seed, source, target, kind) between two kept nodes of a seed. With `node_kinds` only nodes of these kinds are
    entered (and kept); the seed always is. Edges to ids without a node lead nowhere."""
    n = nodes.where(F.col("kind").isin(node_kinds)) if node_kinds else nodes
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    e = cut(e.where("source <> target").select("source", "target", "kind").distinct())
    inner = n.select(F.col("id").alias("b"))
    steps = hops(e, direction).join(inner, "b", "left_semi").select("a", "b")
    got = cut(reach(seeds, steps, max_depth))
    rank = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)
    by = e.select(F.col("target").alias("id"), rank.alias("r")).unionByName(e.select(F.col("source").alias("id"), rank.alias("r"))).groupBy("id").agg(F.min("r").alias("_r"))
    from grovespark.operators.relational import capped

    kept = cut(capped(got.join(by, "id", "left").select("seed", "id", "depth", F.coalesce("_r", F.lit(3)).alias("_r")), "seed", [F.asc("depth"), F.asc("_r"), F.asc("id")], limit).select("seed", "id", "depth"))
    ends = lambda c: kept.select("seed", F.col("id").alias(c))
    return kept, e.join(ends("source"), "source").join(ends("target"), ["seed", "target"]).select("seed", "source", "target", "kind")


def call_paths(entries: DataFrame, edges: DataFrame, most_hops: int = 6) -> DataFrame:
    """(start, path, length): chains of calls among the entry symbols (id), longest first: ways from one entry to another over
    calls, of which those that are part of another, in order, are left out."""
    e = entries.select("id").distinct()
    ways = shortest_paths(e.select(F.col("id").alias("start")), e.select(F.col("id").alias("end")), hops(edges, "out", ["calls"]), most_hops).where("length > 0")
    return maximal_chains(ways.select("start", "path", "length"))


def maximal_chains(chains: DataFrame) -> DataFrame:
    """Chains (start, path, length) whose path is no part of a longer chain's, in one piece. Chains are compared only with
    those that hold their first id, so no two unrelated ones meet; equal paths count once."""
    c = cut(chains.dropDuplicates(["path"]))
    held = c.select(F.explode(F.array_distinct(F.split("path", " > "))).alias("start"), F.col("path").alias("_long"), F.col("length").alias("_l"))
    part = c.join(held, "start").where((F.col("_l") > F.col("length")) & F.contains(F.concat(F.lit(" > "), "_long", F.lit(" > ")), F.concat(F.lit(" > "), "path", F.lit(" > ")))).select("path").distinct()
    return c.join(part, "path", "left_anti").select("start", "path", "length")


def named_flow(named: DataFrame, edges: DataFrame, most_hops: int = 7, bridge: int = 1, best: int = 3) -> DataFrame:
    """(path, n_named, length): the longest chains of calls among named symbols (id), with at most `bridge` others in a row
    between two of them, `most_hops` calls long at most; ends are named and no symbol comes twice. Chains with most named
    symbols first, then shorter ones, then by ids."""
    n = cut(named.select("id").where("id is not null").distinct())
    steps = hops(edges, "out", ["calls"]).join(n.select(F.col("id").alias("b"), F.lit(True).alias("_n")), "b", "left").select("a", "b", F.coalesce("_n", F.lit(False)).alias("known"))
    steps = cut(steps)
    front = n.select("id", F.array("id").alias("way"), F.lit(0).alias("gap"), F.lit(1).alias("n_named"))
    found = []
    for _ in range(most_hops):
        step = front.join(steps, front["id"] == steps["a"]).where(~F.array_contains("way", F.col("b")))
        gap = F.when(F.col("known"), 0).otherwise(F.col("gap") + 1)
        front = cut(step.select(F.col("b").alias("id"), F.concat("way", F.array("b")).alias("way"), gap.alias("gap"), (F.col("n_named") + F.col("known").cast("int")).alias("n_named")).where(F.col("gap") <= bridge))
        if front.isEmpty():
            break
        found.append(front.where("gap = 0"))
    if not found:
        return n.where("false").select(F.col("id").alias("path"), F.lit(1).alias("n_named"), F.lit(0).alias("length"))
    every = reduce(DataFrame.unionByName, found).select(F.array_join("way", " > ").alias("path"), "n_named", (F.size("way") - 1).alias("length"))
    return every.orderBy(F.desc("n_named"), "length", "path").limit(best)


def polymorphic_families(nodes: DataFrame, edges: DataFrame, least: int = 8) -> DataFrame:
    """(name, supertype, n_members, n_classes): methods of one name in at least `least` classes that share a supertype. Classes
    are counted per name and supertype before anything is listed, so a frequent name makes no pairs."""
    from grovespark.operators.calls import owner

    m = nodes.where("kind = 'method'").select("id", "name", owner(F.col("qualified_name")).alias("cls"), "language").where("cls is not null")
    n = nodes.select("id", "name", "language")
    up = edges.where("kind in ('extends', 'implements')").select("source", "target").distinct()
    up = up.join(n.select(F.col("id").alias("source"), F.col("name").alias("cls"), "language"), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("supertype")), "target").select("cls", "language", "supertype").distinct()
    per = m.groupBy("name", "cls", "language").agg(F.count(F.lit(1)).alias("k")).join(up, ["cls", "language"])
    return per.groupBy("name", "supertype").agg(F.sum("k").alias("n_members"), F.count_distinct("cls").alias("n_classes")).where(F.col("n_classes") >= least)


def depth_first(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, direction: str = "out", max_depth: int | None = None, limit: int = 1000) -> DataFrame:
    """(seed, place, id, parent, depth): a depth-first walk from each seed over its nearest `limit` nodes, neighbours by id; each
    node once, by the edge that reached it first. A seed's walk is bounded by the limit and runs in one task."""
    import pandas as pd

    kept, inside = subgraph(seeds, nodes, edges, direction, max_depth=max_depth, limit=limit)
    e = inside.select("seed", F.col("source").alias("a"), F.col("target").alias("b"))
    back = inside.select("seed", F.col("target").alias("a"), F.col("source").alias("b"))
    e = {"out": e, "in": back, "both": e.unionByName(back)}[direction].distinct()
    rows = e.unionByName(kept.select("seed", F.col("id").alias("a"), F.lit(None).cast("string").alias("b")))

    def walk(d: pd.DataFrame) -> pd.DataFrame:
        seed, to = d["seed"].iloc[0], {}
        for a, b in d[d["b"].notna()].sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
            to.setdefault(a, []).append(b)
        out, seen, stack = [], set(), [(seed, None, 0)]
        while stack:
            x, parent, depth = stack.pop()
            if x in seen:
                continue
            seen.add(x)
            out.append((seed, len(out), x, parent, depth))
            if max_depth is None or depth < max_depth:
                stack += [(y, x, depth + 1) for y in reversed(to.get(x, [])) if y not in seen]
        return pd.DataFrame(out, columns=["seed", "place", "id", "parent", "depth"])

    return rows.groupBy("seed").applyInPandas(walk, "seed string, place int, id string, parent string, depth int")


def lifted_navigation(edges: DataFrame, screens: DataFrame, most_hops: int = 3, most_sources: int = 4) -> DataFrame:
    """(source, target): screens from which code leads to another screen: from each edge into a screen, callers are followed
    backwards for `most_hops` steps until a screen is met; edges that more than `most_sources` screens lead to are left
    out, as they are shared helpers. screens: (id)."""
    s = cut(screens.select("id").distinct())
    into = edges.where("kind <> 'contains'").join(s.select(F.col("id").alias("target")), "target", "left_semi").where("source <> target").select("source", "target").distinct()
    back = hops(edges.where("kind in ('calls', 'references', 'contains')"), "in")
    got = reach(into.select(F.col("source").alias("seed")).distinct(), back, most_hops, absorbing=s)
    hit = got.join(s, "id", "left_semi").select(F.col("seed").alias("source"), F.col("id").alias("screen"))
    pair = into.join(hit, "source").where("screen <> target").select("source", "target", "screen").distinct()
    few = pair.groupBy("source", "target").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most_sources)
    return pair.join(few, ["source", "target"], "left_semi").select(F.col("screen").alias("source"), "target").distinct()
