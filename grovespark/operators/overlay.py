"""The overlay of modules, capabilities and features over the symbol graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.functions import names
from grovespark.operators.relational import longest_prefix


def overlay_nodes(rows: DataFrame) -> DataFrame:
    """(id, platform, kind, match_key, name): overlay nodes with their derived ids. rows: (platform, kind, match_key, name)."""
    return rows.select(names.hashed_id("platform", "kind", "match_key").alias("id"), "platform", "kind", "match_key", "name")


def overlay_edges(rows: DataFrame) -> DataFrame:
    """(id, kind, from, to) with derived ids; the same edge once."""
    return rows.select(names.hashed_id("kind", "from", "to").alias("id"), "kind", "from", "to").distinct()


def merge_parts(parts: list[DataFrame], last_wins: bool = True) -> DataFrame:
    """Rows of stages by id: of nodes the last stage's row stays, of edges the first's."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [p.withColumn("_k", F.lit(i if last_wins else -i)) for i, p in enumerate(parts)])
    rest = [c for c in every.columns if c not in ("id", "_k")]
    return every.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("_k", *[F.col(c).cast("string") for c in rest])).alias("r")).select("id", "r.*")


def capabilities(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, capability): imports (id, fqn) by the longest rule (prefix, capability) that is a prefix at a dot."""
    r = rules.select(F.translate("prefix", ".", "/").alias("folder"), "capability")
    i = imports.withColumn("_p", F.concat(F.translate("fqn", ".", "/"), F.lit("/")))
    return longest_prefix(i, "_p", r).join(r, "folder").select("id", "capability").distinct()


def role(name: Column, supertypes: Column, decorators: Column) -> Column:
    """A class's role by supertypes, then decorators, then the ending of its name; null for none."""
    by = {"view-model": ("ViewModel", None), "repository": ("Repository", "Repository"), "service": ("Service", "Service|Injectable"), "controller": ("Controller", "RestController|Controller"), "entity": ("Entity", "Entity|Table"), "adapter": ("Adapter", None)}
    c = F.lit(None).cast("string")
    for r, (suffix, mark) in reversed(by.items()):
        hit = F.coalesce(F.array_join(supertypes, " "), F.lit("")).rlike(rf"{suffix}\b")
        if mark:
            hit = hit | F.coalesce(F.array_join(decorators, " "), F.lit("")).rlike(rf"\b({mark})\b")
        c = F.when(hit | name.endswith(suffix), r).otherwise(c)
    return c


def declared_and_lifted(declared: DataFrame, lifted: DataFrame) -> DataFrame:
    """(a, b, weight, origin, reversed): declared dependencies with the weight of the code's, and those only the code has;
    `reversed` marks one whose opposite is declared."""
    d, l_ = declared.select("a", "b", F.lit(1).alias("_d")).distinct(), lifted.select("a", "b", "weight")
    both = d.join(l_, ["a", "b"], "full_outer").select("a", "b", F.coalesce("weight", F.lit(0)).alias("weight"), F.when(F.col("_d").isNull(), "lifted").otherwise("declared").alias("origin"))
    back = d.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("_r"))
    return both.join(back, ["a", "b"], "left").select("a", "b", "weight", "origin", (F.coalesce("_r", F.lit(False)) & (F.col("origin") == "lifted")).alias("reversed"))


def features(parts: DataFrame, modules: DataFrame) -> DataFrame:
    """(community, size, n_modules, primary_module, fingerprint): communities (id, community) of files with their modules (id,
    module); the primary module is the commonest, the least of those that tie."""
    m = parts.join(modules, "id")
    top = m.groupBy("community", "module").agg(F.count(F.lit(1)).alias("n")).groupBy("community").agg(F.min_by("module", F.struct((-F.col("n")).alias("k"), "module")).alias("primary_module"), F.count(F.lit(1)).alias("n_modules"))
    # A fingerprint that adds up member by member, so no community's members are gathered in one place.
    mark = parts.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.lower(F.hex(F.bit_xor(F.xxhash64("id")))).alias("fingerprint"))
    return mark.join(top, "community", "left").select("community", "size", "n_modules", "primary_module", "fingerprint")
