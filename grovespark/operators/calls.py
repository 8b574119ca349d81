"""Method calls, receivers and member values: linking `x.m` to the method of x's type.

The name side is always reduced before it meets the references: methods by (owner, name), names by their number. So a
name that stands for very many symbols, or in very many references, never makes a pair per symbol and reference.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.functions import names, paths
from grovespark.functions.kinds import same_family
from grovespark.session import cut

TYPES = ["class", "struct", "interface"]
#: Supertypes are walked so far up, as by the engine whose results this follows.
MOST_LEVELS = 4


def _extract(text: Column, pattern: Column, group: int) -> Column:
    """`regexp_extract` with a pattern that is a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def _first_of(patterns: list[Column]) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(*[F.nullif(_extract(x, p, 1), F.lit("")) for p in patterns])


def owner(qualified: Column) -> Column:
    """Simple name of what contains a symbol, from its qualified name: the part before the last; null for a bare name."""
    parts = F.split(qualified, r"::|\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def split_calls(refs: DataFrame) -> DataFrame:
    """References of the form receiver.method, Type::method (receiver:method in Lua, receiver$method in R), with `receiver`
    and `member`; what has another form is left out. A receiver may have dots, its last part counts then."""
    name, lang = F.col("reference_name"), F.col("language")
    dot, colon, lua, dollar = r"^([\w.]+)\.(\w+:?(?:\w+:)*)$", r"^(\w+)::(\w+)$", r"^([\w.]+):(\w+)$", r"^([\w.]+)\$(\w+)$"
    rx = F.when(name.rlike(dot), F.lit(dot)).when(name.rlike(colon), F.lit(colon)).when(lang.isin("lua", "luau") & name.rlike(lua), F.lit(lua)).when((lang == "r") & name.rlike(dollar), F.lit(dollar))
    return refs.withColumn("_rx", rx).where("_rx is not null").withColumn("receiver", _extract(name, F.col("_rx"), 1)).withColumn("member", _extract(name, F.col("_rx"), 2)).drop("_rx")


def methods(nodes: DataFrame) -> DataFrame:
    """(type, member, language, file, id): methods by the simple name of their type; one row per type, name and file."""
    m = nodes.where("kind = 'method'").select(owner(F.col("qualified_name")).alias("type"), F.col("name").alias("member"), "language", F.col("file_path").alias("file"), "id")
    return m.where("type is not null").groupBy("type", "member", "language", "file").agg(F.min("id").alias("id"))


def on_type(wants: DataFrame, nodes: DataFrame, edges: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """(ref, id): the method `member` of `type`, in the reference's language; one in its own file first, then the least id.
    If the type has none, its supertypes are asked level by level, the nearest wins. wants: (ref, type, member, language,
    file_path). Types are told by name, as references only have names. Types that extend each other end: a reference does
    not ask a type twice."""
    by = cut(methods(nodes))
    here = by.groupBy("type", "member", "language").agg(F.min("id").alias("any"))
    near = by.withColumnRenamed("file", "file_path").withColumnRenamed("id", "own")
    n = nodes.select("id", F.col("name"), "language")
    up = edges.where("kind in ('extends', 'implements')").select("source", "target").distinct()
    up = up.join(n.select(F.col("id").alias("source"), F.col("name").alias("type"), "language"), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("super")), "target")
    up = cut(up.select("type", "language", "super").where("type <> super").distinct())
    front = cut(wants.select("ref", "type", "member", "language", "file_path").distinct())
    seen, out = [front.select("ref", "type")], []
    for _ in range(levels + 1):
        hit = front.join(here, ["type", "member", "language"]).join(near, ["type", "member", "language", "file_path"], "left")
        hit = cut(hit.groupBy("ref").agg(F.min_by(F.coalesce("own", "any"), F.struct(F.col("own").isNull().alias("o"), F.coalesce("own", "any").alias("i"))).alias("id")))
        out.append(hit)
        front = front.join(hit.select("ref"), "ref", "left_anti").join(up, ["type", "language"]).select("ref", F.col("super").alias("type"), "member", "language", "file_path").distinct()
        front = cut(front.join(reduce(DataFrame.unionByName, seen), ["ref", "type"], "left_anti"))
        if front.isEmpty():
            break
        seen.append(front.select("ref", "type"))
    return reduce(DataFrame.unionByName, out)


def _on_class(calls: DataFrame, nodes: DataFrame, name: Column) -> DataFrame:
    """(ref, id): the method in the file of a class of that name whose qualified name holds the class; own file first."""
    cls = nodes.where(F.col("kind").isin(TYPES)).select(F.col("name").alias("type"), "language", F.col("file_path").alias("file")).distinct()
    m = nodes.where("kind = 'method'").select(F.col("name").alias("member"), "language", F.col("file_path").alias("file"), "id", "qualified_name")
    # Within a file a method belongs to few types, so this is one row per type, member and file.
    both = cls.join(m, ["file", "language"]).where(F.contains(F.col("qualified_name"), F.col("type"))).groupBy("type", "member", "language", "file").agg(F.min("id").alias("id"))
    both = cut(both)
    first = both.groupBy("type", "member", "language").agg(F.min_by("id", F.struct("file", "id")).alias("any"))
    near = both.select("type", "member", "language", F.col("file").alias("file_path"), F.col("id").alias("own"))
    c = calls.withColumn("type", name)
    return c.join(first, ["type", "member", "language"]).join(near, ["type", "member", "language", "file_path"], "left").select("ref", F.coalesce("own", "any").alias("id"))


def by_method_call(refs: DataFrame, nodes: DataFrame, edges: DataFrame, types: DataFrame | None = None, ceiling: int = 500) -> DataFrame:
    """(ref, id, confidence, method, priority): calls through a receiver.

    .9 on the receiver's type where `types` (ref, type) knows it; .85 if the receiver names a class; .8 if it does with a
    capital; .7 if only one method of the language has that name; .65 for the method whose qualified name shares most words
    with the receiver, two points at least, of which one is for the language; names with more than `ceiling` symbols are
    declined for the last two. Repeated references are one; null names have no receiver; no methods, no rows.
    """
    calls = cut(split_calls(refs).select("ref", "receiver", "member", "language", "file_path"))
    capital = F.concat(F.upper(F.substring("receiver", 1, 1)), F.substring("receiver", 2, 1 << 20))
    tiers = [
        (1, 0.85, "qualified-name", _on_class(calls, nodes, F.col("receiver"))),
        (2, 0.8, "instance-method", _on_class(calls.where(capital != F.col("receiver")), nodes, capital)),
    ]
    if types is not None:
        tiers.append((0, 0.9, "instance-method", on_type(calls.join(types, "ref"), nodes, edges)))
    few = nodes.groupBy(F.col("name").alias("member")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= ceiling).select("member")
    m = nodes.where("kind = 'method'").select(F.col("name").alias("member"), F.col("language").alias("lang"), "id", "qualified_name", F.col("file_path").alias("file")).join(few, "member", "left_semi")
    count = m.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    own = m.groupBy("member", F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n_own"), F.min("id").alias("only"))
    c = calls.join(count, "member").join(own, ["member", "language"], "left")
    tiers.append((3, 0.7, "instance-method", c.where("n_own = 1").select("ref", F.col("only").alias("id"))))
    many = c.where("coalesce(n_own, n) > 1")
    words = lambda x: F.transform(names.camel_words(x), F.lower)
    pair = many.join(m, "member").where(F.col("n_own").isNull() | (F.col("lang") == F.col("language")))
    overlap = F.size(F.filter(words(F.col("receiver")), lambda w: F.array_contains(words(F.col("qualified_name")), w)))
    pair = pair.withColumn("score", overlap + (F.col("lang") == F.col("language")).cast("int")).where("score >= 2")
    best = pair.groupBy("ref").agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), (F.col("file") != F.col("file_path")).alias("f"), "id")).alias("id"))
    tiers.append((4, 0.65, "instance-method", best))
    every = reduce(DataFrame.unionByName, [df.select("ref", "id", F.lit(conf).alias("confidence"), F.lit(how).alias("method"), F.lit(t).alias("t")) for t, conf, how, df in tiers])
    top = every.groupBy("ref").agg(F.min_by(F.struct("id", "confidence", "method"), F.struct("t", "id")).alias("b"))
    return top.select("ref", "b.id", "b.confidence", "b.method", F.lit(3).alias("priority"))


#: How a local name gets its type, by family of languages; {0} stands for the name, the first group is the type.
DECLARED = {
    "typescript javascript tsx jsx arkts svelte vue": [r"\b{0}\s*(?::\s*[\w.<>\[\]| ]+)?=\s*(?:await\s+)?new\s+([\w.]+)", r"\b{0}\s*[?!]?:\s*([A-Z][\w.]*)"],
    "python": [r"\b{0}\s*(?::\s*[\w.\[\]]+)?=\s*(?:await\s+)?([A-Z]\w*(?:\.[A-Z]\w*)*)\s*\(", r"\b{0}\s*:\s*['\"]?([A-Z][\w.]*)"],
    "java csharp cpp c objc dart php": [r"\b{0}\s*=\s*new\s+([\w.:\\]+)", r"\b([A-Z][\w.:]*)(?:<[^<>]*>)?[*&\s]+\$?{0}\s*[=;,)({{]"],
    "kotlin scala swift": [r"\b{0}\s*:\s*([A-Z][\w.]*)", r"\b{0}\s*=\s*(?:new\s+)?([A-Z][\w.]*)\s*[(<]"],
    "go": [r"\b{0}\s*:?=\s*&?([A-Za-z][\w.]*)\{{", r"\b(?:var\s+)?{0}\s+\*?([A-Z][\w.]*)\b", r"\b{0}\s*(?:,\s*\w+)?\s*:?=\s*(?:\w+\.)?New([A-Z]\w*)\("],
    "rust": [r"\b{0}\s*(?::\s*[^=]+)?=\s*([A-Z]\w*)(?:::<[^>]*>)?(?:::\w+\(|\s*\{{)", r"\b{0}\s*:\s*&?(?:mut\s+)?([A-Z]\w*)"],
    "ruby": [r"\b{0}\s*=\s*([A-Z][\w:]*)\.new\b"],
    "lua luau": [r"\b{0}\s*=\s*([A-Z][\w.]*)(?:[.:]new)?\s*\("],
}


def receiver_types(refs: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, type): the type of a call's receiver, from its declaration in the source (files: path, content): the last line
    at or above the call, not above the start of the function it is in, that declares or fills a variable of that name; else
    the field of that name of the function's own class, by its return type or signature. Generic arguments, namespaces and
    pointer marks are dropped from the type; receivers without such a line are left out."""
    calls = split_calls(refs).where(~F.col("receiver").contains(".")).select("ref", "from_node_id", "receiver", "language", "file_path", "line")
    inside = nodes.select(F.col("id").alias("from_node_id"), F.col("start_line").alias("_from"), owner(F.col("qualified_name")).alias("_class"))
    c = calls.join(inside, "from_node_id", "left").join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    lines = F.split("content", r"\r?\n")
    start = F.greatest(F.coalesce("_from", F.lit(1)), F.lit(1))
    above = F.reverse(F.slice(lines, start, F.greatest(F.least(F.col("line"), F.size(lines)) - start + 1, F.lit(0))))
    name = F.regexp_replace("receiver", r"([$])", r"\\$1")
    found = F.lit(None).cast("string")
    for langs, patterns in DECLARED.items():
        rx = [F.concat(*[x for i, p in enumerate(p_.replace("{{", "{").split("{0}")) for x in ([name] if i else []) + [F.lit(p)]]) for p_ in patterns]
        found = F.when(F.col("language").isin(langs.split()), F.get(F.filter(F.transform(above, _first_of(rx)), lambda t: t.isNotNull()), F.lit(0))).otherwise(found)
    last = lambda t: F.element_at(F.split(t, r"::|\.|\\"), -1)
    local = cut(c.select("ref", "receiver", "language", "_class", "file_path", last(found).alias("type")))
    field = nodes.where(F.col("kind").isin("field", "property", "variable")).select(owner(F.col("qualified_name")).alias("_class"), F.col("name").alias("receiver"), "file_path", F.coalesce(F.nullif("return_type", F.lit("")), F.regexp_extract("signature", r"([A-Z][\w.]*)", 1)).alias("_type"))
    field = field.where("_type <> ''").groupBy("_class", "receiver", "file_path").agg(F.min(last(F.regexp_replace("_type", r"<.*$", ""))).alias("_type"))
    out = local.join(field, ["_class", "receiver", "file_path"], "left").select("ref", F.coalesce("type", "_type").alias("type"))
    return out.where("type is not null")


def by_call_chain(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, id, confidence, method, priority): `A.f().g` and `A::f().g` by the type that the inner call returns, .85; an inner
    constructor call `A().g` by the class itself. Chains of one inner call; a return type that is no known name gives nothing."""
    rx = r"^([\w.:]+?)\((?:.*)\)(?:\.|::|->|\?\.)(\w+)$"
    c = refs.where(F.col("reference_name").rlike(rx)).select("ref", "language", "file_path", F.regexp_extract("reference_name", rx, 1).alias("inner"), F.regexp_extract("reference_name", rx, 2).alias("member"))
    parts = F.split("inner", r"::|\.")
    c = cut(c.withColumn("f", F.element_at(parts, -1)).withColumn("of", F.when(F.size(parts) > 1, F.element_at(parts, -2))))
    simple = F.element_at(F.split(F.regexp_replace("return_type", r"[<\[(].*$|^[*&]+|[?*&]+$", ""), r"::|\."), -1)
    fn = nodes.where(F.col("kind").isin("function", "method") & F.col("return_type").isNotNull()).select(F.col("name").alias("f"), "language", owner(F.col("qualified_name")).alias("of"), simple.alias("type"))
    fn = fn.where("type <> ''")
    exact = c.join(fn.where("of is not null").groupBy("f", "of", "language").agg(F.min("type").alias("type")), ["f", "of", "language"]).select("ref", "type")
    only = fn.groupBy("f", "language").agg(F.min("type").alias("type"), F.count_distinct("type").alias("k")).where("k = 1")
    bare = c.where("of is null").join(only, ["f", "language"]).select("ref", "type")
    made = c.where("of is null").join(nodes.where(F.col("kind").isin(TYPES)).select(F.col("name").alias("f"), "language").distinct(), ["f", "language"]).select("ref", F.col("f").alias("type"))
    every = exact.unionByName(bare).unionByName(made).groupBy("ref").agg(F.min("type").alias("type"))
    got = on_type(c.join(every, "ref"), nodes, edges)
    return got.select("ref", "id", F.lit(0.85).alias("confidence"), F.lit("call-chain").alias("method"), F.lit(3).alias("priority"))


def by_this_member(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, id, confidence, method, priority): `this.m`, `self.m` and `@m` by the class that the reference is in, then by its
    supertypes: .9. References from outside of a class give nothing."""
    rx = r"^(?:this|self|\$this)(?:\.|->)(\w+)$"
    r = refs.where(F.col("reference_name").rlike(rx)).withColumn("member", F.regexp_extract("reference_name", rx, 1))
    n = nodes.select(F.col("id").alias("from_node_id"), F.when(F.col("kind").isin(TYPES), F.col("name")).otherwise(owner(F.col("qualified_name"))).alias("type"))
    got = on_type(r.join(n, "from_node_id").where("type is not null"), nodes, edges)
    return got.select("ref", "id", F.lit(0.9).alias("confidence"), F.lit("this-member").alias("method"), F.lit(0).alias("priority"))


def by_file_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, id, confidence, method, priority): names that are paths or end in a short extension, to file nodes.

    .95 for the path itself, .85 for a file whose path ends in the name, .7 for the only file of that base name. Of several
    the one in the reference's folder, then the nearest, own family first, then the least id.
    """
    r = refs.where(F.col("reference_name").contains("/") | F.col("reference_name").rlike(r"\.[A-Za-z][A-Za-z0-9]{0,3}$")).withColumn("base", paths.basename(F.col("reference_name"))).where("base <> ''")
    f = nodes.where("kind = 'file'").select("id", F.col("name").alias("base"), "qualified_name", F.col("file_path").alias("file"), F.col("language").alias("f_language"))
    count = f.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    j = r.join(f, "base").join(count, "base")
    name = F.col("reference_name")
    exact = (F.col("qualified_name") == name) | (F.col("file") == name)
    ends = F.endswith(F.col("qualified_name"), name) | F.endswith(F.col("file"), name)
    conf = F.when(exact, 0.95).when(ends, 0.85).when(F.col("n") == 1, 0.7)
    near = paths.proximity(F.col("file_path"), F.col("file")) + F.when(same_family(F.col("f_language"), F.col("language")), 5).otherwise(0)
    rank = F.struct((-F.col("confidence")).alias("c"), (paths.dirname(F.col("file")) != paths.dirname(F.col("file_path"))).alias("d"), (-near).alias("p"), "id")
    best = j.withColumn("confidence", conf).where("confidence is not null").groupBy("ref").agg(F.min_by(F.struct("id", "confidence"), rank).alias("b"))
    return best.select("ref", "b.id", "b.confidence", F.lit("file-path").alias("method"), F.lit(2).alias("priority"))
