"""Planning over condensed graphs: packing, ledgers, snapshots, contracts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions import names
from grovespark.session import cut

#: Status of a unit, in order, and the moves that are allowed.
STATUS = ["pending", "in_progress", "migrated", "verified"]
MOVES = [("pending", "in_progress"), ("in_progress", "migrated"), ("in_progress", "pending"), ("migrated", "verified"), ("migrated", "in_progress"), ("verified", "in_progress")]


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): 'added', 'removed' or 'changed' between two snapshots; null values are equal to each other."""
    b, a = before.select(key, F.col(value).alias("_b"), F.lit(1).alias("_x")), after.select(key, F.col(value).alias("_a"), F.lit(1).alias("_y"))
    j = b.join(a, key, "full_outer")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def coverage(source: DataFrame, target: DataFrame, group: str, key: str) -> DataFrame:
    """(group, matched, missing, extra, coverage): set comparison of keys per group; coverage 1 where nothing is wanted."""
    s, t = source.select(group, key).distinct().withColumn("_s", F.lit(1)), target.select(group, key).distinct().withColumn("_t", F.lit(1))
    g = s.join(t, [group, key], "full_outer").groupBy(group).agg(
        F.count_if(F.col("_s").isNotNull() & F.col("_t").isNotNull()).alias("matched"), F.count_if(F.col("_t").isNull()).alias("missing"), F.count_if(F.col("_s").isNull()).alias("extra")
    )
    want = F.col("matched") + F.col("missing")
    return g.withColumn("coverage", F.when(want == 0, 1.0).otherwise(F.round(F.col("matched") / want, 2)))


def illegal_moves(log: DataFrame) -> DataFrame:
    """Rows of a ledger log (unit, from_status, to_status) whose move is not allowed; a first entry may only be pending."""
    ok = log.sparkSession.createDataFrame([*MOVES, ("", "pending")], "from_status string, to_status string")
    return log.withColumn("_f", F.coalesce("from_status", F.lit(""))).join(F.broadcast(ok.withColumnRenamed("from_status", "_f")), ["_f", "to_status"], "left_anti").drop("_f")


def ledger_remap(old_units: DataFrame, new_units: DataFrame) -> DataFrame:
    """(old_unit, new_unit, overlap): for each old unit the new one with the same members, else the one that shares most;
    ties to fewer other members, then the name. Units: (unit, member). Units that share nothing are left out."""
    o, n = old_units.select(F.col("unit").alias("old_unit"), "member").distinct(), new_units.select(F.col("unit").alias("new_unit"), "member").distinct()
    size = n.groupBy("new_unit").agg(F.count(F.lit(1)).alias("size"))
    shared = o.join(n, "member").groupBy("old_unit", "new_unit").agg(F.count(F.lit(1)).alias("overlap")).join(size, "new_unit")
    top = F.min_by(F.struct("new_unit", "overlap"), F.struct((-F.col("overlap")).alias("a"), (F.col("size") - F.col("overlap")).alias("b"), "new_unit"))
    return shared.groupBy("old_unit").agg(top.alias("t")).select("old_unit", "t.new_unit", "t.overlap")


def furthest_status(entries: DataFrame) -> DataFrame:
    """(unit, status): the furthest status of each unit among several entries."""
    rank = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    return entries.groupBy("unit").agg(F.max_by("status", rank).alias("status"))


def next_fit(files: DataFrame, group: str, order: str, size: str, most: int, most_files: int) -> DataFrame:
    """(group, order, slice): files of each group in order, packed into slices of at most `most` in size and `most_files` in
    number; a file that is larger by itself gets its own slice. Next-fit depends on all choices before, so a group is
    streamed in order; only running totals are kept."""

    def pack(batches):
        key, n, used, k = None, 0, 0, 0
        for b in batches:
            out = []
            for g, s in zip(b[group], b[size]):
                if g != key:
                    key, n, used, k = g, 0, 0, 0
                elif n and (used + s > most or k >= most_files):
                    n, used, k = n + 1, 0, 0
                n, used, k = max(n, 1), used + s, k + 1
                out.append(n - 1)
            yield pd.DataFrame({group: b[group], order: b[order], "slice": out})

    return files.select(group, order, size).repartition(group).sortWithinPartitions(group, order).mapInPandas(pack, f"{group} string, {order} string, slice int")


def merge_small(units: DataFrame, deps: DataFrame, least: int, most: int) -> DataFrame:
    """(unit, merged): units smaller than `least` that the same other units depend on are put together, in order of size and
    name, until `most` is reached. units: (unit, size); deps: (a, b), a depends on b. Units nobody depends on stay alone.
    The grouping is a join; the packing walks the small units of one group of dependants, which is a plan's list."""
    by = deps.where("a <> b").groupBy(F.col("b").alias("unit")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("a")), ","), 256).alias("who"))
    u = units.join(by, "unit", "left")
    small = u.where((F.col("size") < least) & F.col("who").isNotNull())

    def pack(batches):
        key, used, head = None, 0, None
        for b in batches:
            out = []
            for w, unit, s in zip(b["who"], b["unit"], b["size"]):
                if w != key or used + s > most:
                    key, used, head = w, 0, unit
                used += s
                out.append(head)
            yield pd.DataFrame({"unit": b["unit"], "merged": out})

    packed = small.select("who", "unit", F.col("size").cast("long").alias("size")).repartition("who").sortWithinPartitions("who", F.desc("size"), "unit").mapInPandas(pack, "unit string, merged string")
    return packed.unionByName(u.join(packed.select("unit"), "unit", "left_anti").select("unit", F.col("unit").alias("merged")))


def checks(symbols: DataFrame) -> DataFrame:
    """(check_id, kind, module, subject): acceptance checks for exported members of modules."""
    return symbols.select(names.hashed_id(F.lit("check"), "kind", "module", "subject").alias("check_id"), "kind", "module", "subject").distinct()


def evaluate(checks_: DataFrame, target: DataFrame, renames: DataFrame) -> DataFrame:
    """(check_id, status, match): 'qualified' by a rename of (module, subject), 'bare' by the only rename of the subject,
    'same' by name; else failed. target: (name); renames: (module, subject, new_name)."""
    t = target.select(F.lower("name").alias("_t")).distinct().withColumn("_hit", F.lit(True))
    rn = renames.select("module", F.lower("subject").alias("_s"), F.lower("new_name").alias("_q"))
    bare = rn.groupBy("_s").agg(F.count_distinct("_q").alias("_k"), F.min("_q").alias("_b")).where("_k = 1").drop("_k")
    c = checks_.withColumn("_s", F.lower("subject")).join(rn, ["module", "_s"], "left").join(bare, "_s", "left")
    way = lambda col, tag: c.select("check_id", F.col(col).alias("_t"), F.lit(tag).alias("match"))
    every = way("_q", "1 qualified").unionByName(way("_b", "2 bare")).unionByName(way("_s", "3 same")).join(t, "_t")
    hit = every.groupBy("check_id").agg(F.min("match").alias("match"))
    return checks_.select("check_id").join(hit, "check_id", "left").select("check_id", F.when(F.col("match").isNull(), "fail").otherwise("pass").alias("status"), F.substring(F.coalesce("match", F.lit("")), 3, 20).alias("match"))


# Interfaces and bindings against a target.


def binding_gaps(bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """(iface, impl, missing_ends): bindings of which the target lacks an end, by name in any case; those whose both ends are
    there have an empty array. bindings: (iface, impl); exports: (name)."""
    t = exports.select(F.lower("name").alias("_n")).where("_n is not null").distinct().withColumn("_in", F.lit(True))
    b = bindings.select("iface", "impl").distinct()
    b = b.join(t.select(F.col("_n").alias("_a"), F.col("_in").alias("_ia")), F.lower("iface") == F.col("_a"), "left").join(t.select(F.col("_n").alias("_b"), F.col("_in").alias("_ib")), F.lower("impl") == F.col("_b"), "left")
    return b.select("iface", "impl", F.array_compact(F.array(F.when(F.col("_ia").isNull(), F.col("iface")), F.when(F.col("_ib").isNull(), F.col("impl")))).alias("missing_ends"))


def interface_fidelity(members: DataFrame, exports: DataFrame, renames: DataFrame, target_paths: DataFrame) -> DataFrame:
    """(module, scope, source_count, matched_count, missing): how much of each module's interface the target exports.

    members: (module, name); exports: (file, name); renames: (module, name, new_name); target_paths: (module, prefix). A module
    with target paths is looked for under these ('ledger-paths'); else in files whose path holds its name, if any does
    ('module-path'); else everywhere ('global'). Names match in any case, as they are or renamed. missing: names in order,
    which a module's interface bounds. Pairs of module and file are made by equality of path parts, never all with all.
    """
    squeezed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    e = cut(exports.select(F.translate("file", "\\", "/").alias("file"), F.lower("name").alias("_n")).where("_n is not null").distinct().withColumn("_s", squeezed("file")))
    members = cut(members.select("module", "name").distinct())
    mods = cut(members.select("module", squeezed("module").alias("_k")).distinct())
    paths = target_paths.select("module", F.regexp_replace("prefix", "/+$", "").alias("_p")).distinct()
    # A prefix may start at any part of a path: files are cut into runs of as many parts as prefixes have.
    counts = [r.n for r in paths.where("_p is not null").select(F.size(F.split("_p", "/")).alias("n")).distinct().collect()]
    by_path = None
    if counts:
        under = e.select("file").distinct().select("file", F.explode(_runs(F.split("file", "/"), counts)).alias("_p"))
        by_path = under.join(paths, "_p").select("module", "file").distinct()
    named = mods.join(paths.select("module").distinct(), "module", "left_anti").where("_k <> ''").select("_k").distinct()
    by_name = cut(_holding(e.select("_s").distinct(), cut(named)))
    scope = mods.join(paths.select("module", F.lit("ledger-paths").alias("_l")).distinct(), "module", "left").join(by_name.select("_k", F.lit("module-path").alias("_m")).distinct(), "_k", "left")
    scope = cut(scope.select("module", "_k", F.coalesce("_l", "_m", F.lit("global")).alias("scope")))
    rn = renames.select("module", F.lower("name").alias("_s"), F.lower("new_name").alias("_r")).distinct()
    want = members.select("module", "name", F.lower("name").alias("_s")).join(rn, ["module", "_s"], "left")
    want = cut(want.select("module", "name", F.explode(F.array_distinct(F.array_compact(F.array("_s", "_r")))).alias("_n")).join(scope, "module"))
    e = cut(e.join(want.select("_n").distinct(), "_n", "left_semi"))
    named_n = by_name.join(e.select("_s", "_n").distinct(), "_s").select("_k", "_n").distinct()
    hits = [want.where("scope = 'module-path'").join(named_n, ["_k", "_n"], "left_semi"), want.where("scope = 'global'").join(e.select("_n").distinct(), "_n", "left_semi")]
    if by_path is not None:
        hits.append(want.where("scope = 'ledger-paths'").join(by_path.join(e, "file").select("module", "_n").distinct(), ["module", "_n"], "left_semi"))
    hit = reduce(DataFrame.unionByName, [h.select("module", "name") for h in hits]).distinct().withColumn("_hit", F.lit(True))
    m = members.join(hit, ["module", "name"], "left").join(scope.drop("_k"), "module")
    return m.groupBy("module", "scope").agg(F.count(F.lit(1)).alias("source_count"), F.count("_hit").alias("matched_count"), F.array_sort(F.collect_set(F.when(F.col("_hit").isNull(), F.col("name")))).alias("missing"))


def _runs(parts, counts: list[int]):
    """All runs of neighbouring parts, joined again, that have one of the numbers of parts."""
    def of(n: int):
        runs = F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, n), "/"))
        return F.when(F.size(parts) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(of, counts))))


def _holding(texts: DataFrame, keys: DataFrame, lead: int = 8) -> DataFrame:
    """(_k, _s): keys (_k), none of them empty, and the texts (_s) that hold them anywhere.

    Keys are looked for by their first `lead` letters (shorter ones as a whole). These are few, as names begin alike. A place
    of a text that starts so is cut to the lengths of the keys that do, and only those pieces meet the keys, by equality."""
    n = F.least(F.length("_k"), F.lit(lead))
    leads = keys.groupBy(F.substring(F.col("_k"), F.lit(1), n).alias("_g")).agg(F.collect_set(F.length("_k")).alias("_lengths"))
    sizes = [r.n for r in keys.select(n.alias("n")).distinct().collect()]
    if not sizes:
        return texts.crossJoin(keys.where("false")).select("_k", "_s")

    def starts(k: int):
        at = F.transform(F.sequence(F.lit(1), F.length("_s") - k + 1), lambda i: F.struct(F.substring(F.col("_s"), i, F.lit(k)).alias("g"), i.alias("i")))
        return F.when(F.length("_s") >= k, at).otherwise(F.array().cast("array<struct<g:string,i:int>>"))

    places = texts.select("_s", F.explode(F.flatten(F.array(*map(starts, sizes)))).alias("p")).select("_s", F.col("p.g").alias("_g"), F.col("p.i").alias("_i"))
    # Only hashes of these beginnings go to all tasks, eight bytes each; names and lengths are joined to what is left.
    h = leads.select(F.xxhash64("_g").alias("_h"))
    found = places.withColumn("_h", F.xxhash64("_g")).join(F.broadcast(h), "_h", "left_semi").join(leads, "_g").select("_s", "_i", F.explode("_lengths").alias("_l"))
    return found.select("_s", F.substring(F.col("_s"), F.col("_i"), F.col("_l")).alias("_k")).distinct().join(keys, "_k").select("_k", "_s")


def name_collisions(checks_: DataFrame) -> DataFrame:
    """(name, n): subjects of checks that several share, in any case."""
    return checks_.groupBy(F.lower("subject").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def literal_hits(files: DataFrame, literals: list[str], sql: bool = False) -> DataFrame:
    """(literal, n_files, first_file): files (path, content) that hold each literal; as SQL, white space and case do not matter.
    Literals in no file come with 0. The literals are a plan's list, so they are conditions on one scan."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")) if sql else c
    text = norm(F.col("content"))
    hit = F.array_compact(F.array(*[F.when(text.contains(norm(F.lit(x))), F.lit(x)) for x in literals]))
    found = files.select("path", F.explode(hit).alias("literal")).groupBy("literal").agg(F.count_distinct("path").alias("n_files"), F.min("path").alias("first_file"))
    every = files.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(literals)], "literal string")
    return every.join(found, "literal", "left").select("literal", F.coalesce("n_files", F.lit(0)).alias("n_files"), "first_file")


def scoped_exports(exports: DataFrame, prefixes: list[str] = (), names_: list[str] = ()) -> DataFrame:
    """Exports (file, ...) under any of the folders, or with any of the names in their path, squeezed to letters and digits."""
    path = F.translate("file", "\\", "/")
    squeezed = F.regexp_replace(F.lower(path), "[^a-z0-9]+", "")
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | (path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/") | path.contains("/" + p.strip("/") + "/")
    for n in names_:
        cond = cond | squeezed.contains("".join(c for c in n.lower() if c.isalnum()))
    return exports.where(cond)


# Units.


def unit_tokens(n_symbols):
    """Tokens that a unit is worth: thirty a symbol."""
    return n_symbols * 30


def unit_dependencies(units: DataFrame, deps: DataFrame) -> DataFrame:
    """(a, b): units that depend on others through their modules. units: (unit, module); deps: (a, b) between modules."""
    at = lambda c: units.select(F.col("module").alias(c), F.col("unit").alias(f"u{c}")).distinct()
    return deps.select("a", "b").join(at("a"), "a").join(at("b"), "b").where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct()


def order_units(units: DataFrame, deps: DataFrame) -> DataFrame:
    """(unit, place, wave): units (unit, size) in an order in which each comes after what it depends on: cycles are condensed,
    waves of the condensed graph come one after the other, larger units first, then by name. `place` counts from 0: waves
    are counted and ranked apart, so only a wave's own units are ordered together."""
    from pyspark.sql import Window as W

    from grovespark.operators.algorithms import strong_components, waves

    v = units.select(F.col("unit").alias("id"))
    scc = strong_components(v, deps)
    to = lambda c: scc.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    between = deps.select("a", "b").join(to("a"), "a").join(to("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    w = waves(scc.select(F.col("label").alias("id")).distinct(), between)
    u = units.select("unit", "size").join(scc.select(F.col("id").alias("unit"), "label"), "unit").join(w.select(F.col("id").alias("label"), "wave"), "label")
    before = u.groupBy("wave").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(W.partitionBy().orderBy("wave")) - F.col("n")).select("wave", "before")
    place = F.row_number().over(W.partitionBy("wave").orderBy(F.desc("size"), "unit")) - 1
    return u.withColumn("_p", place).join(before, "wave").select("unit", (F.col("before") + F.col("_p")).cast("int").alias("place"), "wave")


def split_by_feature(files: DataFrame) -> DataFrame:
    """(unit, slice, file): units split into one slice per feature of their files and one for the rest, which is slice ''.
    files: (unit, file, feature); a unit with one feature or none stays whole."""
    many = files.where("feature is not null").groupBy("unit").agg(F.count_distinct("feature").alias("k")).where("k > 1").select("unit", F.lit(True).alias("_m"))
    f = files.join(many, "unit", "left")
    return f.select("unit", F.when(F.col("_m"), F.coalesce("feature", F.lit(""))).otherwise("").alias("slice"), "file")


def dominant_feature(members: DataFrame) -> DataFrame:
    """(module, feature): the feature with most of a module's files, the least of those that tie. members: (module, feature, file)."""
    n = members.where("feature is not null").groupBy("module", "feature").agg(F.count_distinct("file").alias("n"))
    return n.groupBy("module").agg(F.min_by("feature", F.struct((-F.col("n")).alias("k"), "feature")).alias("feature"))


def merge_to_fixpoint(units: DataFrame, deps: DataFrame, least: int, most: int) -> DataFrame:
    """(unit, merged): `merge_small` again and again until no two units go together. In a graph without cycles units with the
    same dependants never depend on one another, directly or not (the last step of such a way would be a dependant of
    both, and close a cycle), so a merge leaves the graph without cycles."""
    from grovespark.session import cut

    to = cut(merge_small(units, deps, least, most))
    while True:
        size = units.join(to, "unit").groupBy("merged").agg(F.sum("size").alias("size")).select(F.col("merged").alias("unit"), "size")
        m = lambda c: to.select(F.col("unit").alias(c), F.col("merged").alias(f"m{c}"))
        d = deps.join(m("a"), "a").join(m("b"), "b").where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct()
        step = cut(merge_small(size, d, least, most))
        if step.where("unit <> merged").isEmpty():
            return to
        to = cut(to.join(step.select(F.col("unit").alias("merged"), F.col("merged").alias("_m")), "merged").select("unit", F.col("_m").alias("merged")))


def same_members(a: DataFrame, b: DataFrame, group: str, member: str) -> DataFrame:
    """(group, same): groups of either side whose sets of members are equal. Members are compared one by one, no set is built."""
    x, y = a.select(group, member).distinct().withColumn("_x", F.lit(1)), b.select(group, member).distinct().withColumn("_y", F.lit(1))
    return x.join(y, [group, member], "full_outer").groupBy(group).agg((F.count_if(F.col("_x").isNull() | F.col("_y").isNull()) == 0).alias("same"))


def module_briefs(facts: DataFrame, per_facet: int = 50) -> DataFrame:
    """(module, facet, place, subject, detail): facts (module, facet, subject, detail) in order, the first `per_facet` of each
    facet, which is what a brief shows; the numbers left out are in `n_facet`."""
    from pyspark.sql import Window as W

    f = facts.select("module", "facet", "subject", "detail").distinct()
    total = f.groupBy("module", "facet").agg(F.count(F.lit(1)).alias("n_facet"))
    k = f.withColumn("place", F.row_number().over(W.partitionBy("module", "facet").orderBy("subject", "detail"))).where(F.col("place") <= per_facet)
    return k.join(total, ["module", "facet"]).select("module", "facet", "place", "subject", "detail", "n_facet")


def find_unit(units: DataFrame, query: str) -> DataFrame:
    """The unit (unit, place, label, module) a query means: by place, else id, else label, else one of its modules, in any case."""
    q = query.strip().lower()
    rank = F.when(F.col("place").cast("string") == q, 0).when(F.lower("unit") == q, 1).when(F.lower("label") == q, 2).when(F.lower("module") == q, 3)
    return units.withColumn("_r", rank).where("_r is not null").orderBy("_r", "unit").limit(1).drop("_r")
