"""Imports: from the text of a file to the symbol or file that a name stands for.

mappings (local name -> specifier) -> candidate paths, ranked -> files -> exported symbols, through re-exports. Every step
is a join on a path or a name; texts are read once, by patterns that run in the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.functions import builtins, paths
from grovespark.session import cut

#: Chains of re-exports are followed so many hops, as by the engine whose results this follows.
MOST_HOPS = 8
CONTAINERS = ["class", "struct", "interface", "enum", "trait", "protocol"]


def without_comments(text: Column, hash_comments: bool = False) -> Column:
    """A text without its comments; strings are kept as they are, also where they hold the marks of one."""
    string = r"\"(?:\\[\s\S]|[^\"\\\n])*+\"|'(?:\\[\s\S]|[^'\\\n])*+'|`(?:\\[\s\S]|[^`\\])*+`"
    comment = r"#[^\n]*+" if hash_comments else r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
    return F.regexp_replace(text, f"({string})|{comment}", "$1")


def _hits(text: Column, pattern: str, *groups: int) -> Column:
    """Array of (g1, g2, ...): groups of every match, '' where a group took no part."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), g).alias(f"g{g}") for g in groups])


def _names(braces: Column, between: str) -> Column:
    """Array of (exported, local) of a list such as `a, b as c`."""
    item = F.filter(F.transform(F.split(braces, ","), lambda x: F.regexp_replace(x, r"^\s*(?:type\s+)?|\s+$|[()\\]", "")), lambda x: x.rlike(r"^[\w$*]+"))
    pair = rf"^([\w$]+){between}([\w$]+)"
    return F.transform(item, lambda x: F.struct(F.regexp_extract(x, r"^([\w$*]+)", 1).alias("exported"), F.when(x.rlike(pair), F.regexp_extract(x, pair, 2)).otherwise(F.regexp_extract(x, r"^([\w$*]+)", 1)).alias("local")))


def mappings(files: DataFrame) -> DataFrame:
    """(path, language, local, exported, source, form): what each import of a file (path, language, content) binds. form:
    'default', 'named' or 'namespace'; `exported` is 'default' or '*' for the others. Null contents import nothing; other
    languages than those below give no rows."""
    code = without_comments(F.col("content"))

    def rows(where: Column, text: Column, pattern: str, source: Column, each: Column) -> DataFrame:
        n = re.compile(pattern).groups
        hit = files.where(where).select("path", "language", F.explode(_hits(text, pattern, *range(1, n + 1))).alias("h"))
        hit = hit.select("path", "language", *[F.col(f"h.g{i}").alias(f"g{i}") for i in range(1, n + 1)])
        return hit.select("path", "language", source.alias("source"), F.explode(each).alias("m")).select("path", "language", "m.local", "m.exported", "source", "m.form")

    one = lambda exported, local, form: F.struct(exported.alias("exported"), local.alias("local"), F.lit(form).alias("form"))
    g1, g2, g3 = F.col("g1"), F.col("g2"), F.col("g3")
    named = lambda braces, between: F.transform(_names(braces, between), lambda x: F.struct(x["exported"].alias("exported"), x["local"].alias("local"), F.lit("named").alias("form")))
    script = F.col("language").isin(builtins.SCRIPT)
    default, star = F.regexp_extract(g1, r"^\s*(?:type\s+)?([\w$]+)\s*(?:,|$)", 1), F.regexp_extract(g1, r"\*\s+as\s+([\w$]+)", 1)
    clause = F.array_compact(F.concat(
        F.array(F.when(default != "", one(F.lit("default"), default, "default")), F.when(star != "", one(F.lit("*"), star, "namespace"))),
        named(F.regexp_extract(g1, r"\{([^}]*)\}", 1), r"\s+as\s+"),
    ))
    last = lambda c, sep: F.element_at(F.split(c, sep), -1)
    alias = lambda a, b: F.when(a != "", a).otherwise(b)
    python = F.filter(named(F.regexp_replace(g2, r"#[^\n]*|[()]", ""), r"\s+as\s+"), lambda x: x["exported"] != "*")
    parts = [
        rows(script, code, r"\bimport\s+([\w$\s{},*]+?)\s*\bfrom\s*['\"]([^'\"]+)['\"]", g2, clause),
        rows(script, code, r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", g2, F.array(one(F.lit("default"), g1, "default"))),
        rows(script, code, r"\b(?:const|let|var)\s+\{([^}]+)\}\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", g2, named(g1, r"\s*:\s*")),
        rows(F.col("language") == "python", F.col("content"), r"(?m)^\s*from\s+([\w.]+)\s+import\s+(\([^)]*\)|[^\n]+)", g1, python),
        rows(F.col("language") == "python", F.col("content"), r"(?m)^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", g1, F.array(one(F.lit("*"), alias(g2, last(g1, r"\.")), "namespace"))),
        rows(F.col("language") == "go", F.concat_ws("\n", F.regexp_extract_all(code, F.lit(r"\bimport\s*\(([^)]*)\)|\bimport\s+((?:[\w.]+\s+)?\"[^\"]+\")"), 0)), r"(?:([\w.]+)\s+)?\"([^\"]+)\"", g2, F.array(one(F.lit("*"), alias(F.when(g1 == "import", "").otherwise(g1), last(g2, "/")), "namespace"))),
        rows(F.col("language").isin("java", "kotlin", "scala"), code, r"(?m)^\s*import\s+(?:static\s+)?([\w.]+\w)(?:\s+as\s+(\w+))?\s*;?\s*$", g1, F.array(one(last(g1, r"\."), alias(g2, last(g1, r"\.")), "named"))),
        rows(F.col("language") == "php", code, r"\buse\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", g1, F.array(one(last(g1, r"\\"), alias(g2, last(g1, r"\\")), "named"))),
        rows(F.col("language").isin("c", "cpp", "objc"), F.col("content"), r"(?m)^\s*#\s*(?:include|import)\s+[<\"]([^>\"]+)[>\"]", g1, F.array(one(F.lit("*"), F.regexp_replace(last(g1, "/"), r"\.(h|hpp|hxx|hh|inl|ipp|cxx|cc|cpp)$", ""), "namespace"))),
        rows(F.col("language") == "rust", code, r"\buse\s+([\w:]+\w)(?:\s+as\s+(\w+))?\s*;", g1, F.array(one(last(g1, "::"), alias(g2, last(g1, "::")), "named"))),
        rows(F.col("language").isin("lua", "luau"), F.col("content"), r"\blocal\s+(\w+)\s*=\s*require\s*\(?\s*[\"']([^\"']+)[\"']", g2, F.array(one(F.lit("*"), g1, "namespace"))),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def re_exports(files: DataFrame) -> DataFrame:
    """(path, language, exported, original, source): what a file of a script language passes on from another; both names are
    '*' for everything. `export {a as b} from` passes on a as b."""
    f = files.where(F.col("language").isin(builtins.SCRIPT)).withColumn("_c", without_comments(F.col("content")))
    every = f.select("path", "language", F.explode(F.regexp_extract_all("_c", F.lit(r"\bexport\s*\*(?:\s+as\s+\w+)?\s*from\s*['\"]([^'\"]+)['\"]"), 1)).alias("source")).select("path", "language", F.lit("*").alias("exported"), F.lit("*").alias("original"), "source")
    some = f.select("path", "language", F.explode(_hits(F.col("_c"), r"\bexport\s*\{([^}]+)\}\s*from\s*['\"]([^'\"]+)['\"]", 1, 2)).alias("h"))
    some = some.select("path", "language", F.col("h.g2").alias("source"), F.explode(_names(F.col("h.g1"), r"\s+as\s+")).alias("m"))
    return every.unionByName(some.select("path", "language", F.col("m.local").alias("exported"), F.col("m.exported").alias("original"), "source")).distinct()


def normal(path: Column) -> Column:
    """A path without '.', '..' and empty parts; null if it leads out of the tree."""
    empty = F.array().cast("array<string>")
    fold = F.aggregate(
        F.split(path, "/"),
        F.struct(empty.alias("at"), F.lit(False).alias("out")),
        lambda a, x: F.when(x.isin("", "."), a)
        .when(x == "..", F.struct(F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["out"] | (F.size(a["at"]) == 0)).alias("out")))
        .otherwise(F.struct(F.concat(a["at"], F.array(x)).alias("at"), a["out"].alias("out"))),
        lambda a: F.when(~a["out"], F.array_join(a["at"], "/")),
    )
    return F.when(path.isNotNull(), fold)


def locate(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = (), packages: list[tuple[str, str]] = (), include: list[str] = (), go_module: str | None = None) -> DataFrame:
    """The rows of `imports` (path, language, source, ...) that lead to a file of the tree, with `file`.

    Candidate paths are made from a row alone and ranked: relative to the importing file; by the project's rules for
    aliases (prefix, replacement; '*' stands for the rest), longest prefix first; by workspace packages (name, folder);
    by common conventions; from the root; by include folders; each with the language's endings in order, then as it is.
    Dots of Python are levels, dots of Java, `::` of Rust and `\\` of PHP are folders. One join with the paths decides
    and the least rank wins. Imports of external packages and of files that are not there are left out.
    """
    s, lang = F.col("source"), F.col("language")
    folder = paths.dirname(F.col("path"))
    level = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    python = F.concat_ws("/", folder, F.repeat(F.lit("../"), F.greatest(level - 1, F.lit(0))), F.translate(F.expr("substring(source, length(regexp_extract(source, '^([.]*)', 1)) + 1)"), ".", "/"))
    slashed = F.when(lang.isin("java", "kotlin", "scala", "python", "lua", "luau"), F.translate(s, ".", "/")).when(lang == "rust", F.regexp_replace(F.regexp_replace(s, "^(crate|self|super)::", ""), "::", "/")).when(lang == "php", F.translate(s, "\\", "/")).otherwise(s)
    bases: list[Column] = [F.when(s.startswith("."), F.when(lang == "python", python).otherwise(F.concat_ws("/", folder, s)))]
    bases.append(F.when(lang.isin("c", "cpp", "objc", "php", "nix") & ~s.startswith("."), F.concat_ws("/", folder, slashed)))
    for prefix, to in sorted(aliases, key=lambda a: -len(a[0])):
        rest = F.substring(s, F.lit(len(prefix.rstrip("*")) + 1), F.length(s))
        bases.append(F.when(s.startswith(prefix.rstrip("*")) if prefix.endswith("*") else s == prefix, F.concat(F.lit(to.split("*")[0]), rest) if "*" in to else F.lit(to)))
    for name, to in sorted(packages, key=lambda a: -len(a[0])):
        bases.append(F.when((s == name) | s.startswith(f"{name}/"), F.concat(F.lit(to), F.substring(s, F.lit(len(name) + 1), F.length(s)))))
    for prefix, to in builtins.CONVENTIONS:
        bases.append(F.when(lang.isin(builtins.SCRIPT) & s.startswith(prefix), F.concat(F.lit(to), F.substring(s, F.lit(len(prefix) + 1), F.length(s)))))
    bases.append(F.when(~s.startswith("."), slashed))
    if go_module:
        bases.append(F.when((lang == "go") & s.startswith(f"{go_module}/"), F.substring(s, F.lit(len(go_module) + 2), F.length(s))))
    bases += [F.when(lang.isin("c", "cpp"), F.concat(F.lit(f"{d}/"), s)) for d in include]
    endings = F.create_map(*[x for k, v in builtins.EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v + [""])))])
    own = [a.rstrip("*") for a, _ in aliases] + [n for n, _ in packages]
    i = imports.where(s.isNotNull() & ~builtins.is_external(s, lang, own, go_module)).withColumn("_row", F.sha2(F.to_json(F.struct(*imports.columns)), 256))
    base = i.select("_row", "language", F.posexplode(F.array(*bases)).alias("_b", "_base")).where("_base is not null")
    base = base.select("_row", "_b", normal(F.col("_base")).alias("_base"), F.coalesce(F.try_element_at(endings, F.col("language")), F.array(F.lit(""))).alias("_ends")).where("_base is not null")
    tried = base.select("_row", "_b", "_base", F.posexplode("_ends").alias("_e", "_end")).select("_row", "_b", "_e", F.concat("_base", "_end").alias("file"))
    found = tried.join(files.select(F.col("path").alias("file")).distinct(), "file").groupBy("_row").agg(F.min_by("file", F.struct("_b", "_e", "file")).alias("file"))
    return i.join(found, "_row").select(*imports.columns, "file")


def exported(wants: DataFrame, nodes: DataFrame, passed_on: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """(want, id): the symbol that a file exports under a name. wants: (want, file, name); name 'default' for the default.

    A file's own exported symbol of that name comes first, then what it passes on by name, then what it passes on whole
    (passed_on: path, exported, original, file). A want goes from file to file, all wants at once, for `hops` hops; a want
    does not enter a file twice under one name, so rings of files end. Of several ways the shortest wins, then the least id.
    """
    n = nodes.where(F.coalesce("is_exported", F.lit(False)) & ~F.col("kind").isin("file", "import")).select("id", "kind", "name", F.col("file_path").alias("file"))
    own = n.groupBy("file", "name").agg(F.min("id").alias("id"))
    whole = n.where(F.col("kind").isin("component", "function", "class")).groupBy("file").agg(F.min_by("id", F.struct((F.col("kind") != "component").alias("k"), "id")).alias("id"))
    there = cut(own.unionByName(whole.select("file", F.lit("default").alias("name"), "id")))
    step = cut(passed_on.select(F.col("path").alias("file"), "exported", "original", F.col("file").alias("to")).where("file <> `to`"))
    front = cut(wants.select("want", "file", "name").distinct())
    seen, out = [front], []
    for _ in range(hops + 1):
        hit = cut(front.join(there, ["file", "name"]).groupBy("want").agg(F.min("id").alias("id")))
        out.append(hit)
        rest = front.join(hit.select("want"), "want", "left_anti")
        named = rest.join(step.where("exported <> '*'"), (rest["file"] == step["file"]) & (rest["name"] == F.col("exported"))).select("want", F.col("to").alias("file"), F.col("original").alias("name"))
        every = rest.where("name <> 'default'").join(step.where("exported = '*'"), "file").select("want", F.col("to").alias("file"), "name")
        front = named.unionByName(every).distinct().join(reduce(DataFrame.unionByName, seen), ["want", "file", "name"], "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        seen.append(front)
    return reduce(DataFrame.unionByName, out)


def by_imports(refs: DataFrame, located: DataFrame, nodes: DataFrame, passed_on: DataFrame) -> DataFrame:
    """(ref, id, confidence, method, priority): references whose first name an import of their file binds.

    located: `mappings` with `file`. The bound symbol is found by `exported`; `ns.member` of a namespace by the member.
    `Class.member` of an imported class is that member if the class has it, a callable one for a call; else the class.
    An import that names a file (an include, a module) gives the file's node. refs: keyed (ref, file_path, reference_name,
    reference_kind). Names that no import of the file binds are left to others.
    """
    head = F.regexp_extract("reference_name", r"^([^.:/\\]+)", 1)
    r = refs.where("file_path <> ''").withColumn("local", head).withColumn("member", F.regexp_extract("reference_name", r"^[^.:/\\]+(?:\.|::|\\)([^.:\\]+)", 1))
    m = located.select(F.col("path").alias("file_path"), "local", "exported", "form", "file")
    j = r.join(m, ["file_path", "local"]).select("ref", "reference_kind", "member", "form", "file", F.when(F.col("form") == "namespace", F.col("member")).otherwise(F.col("exported")).alias("name"))
    j = cut(j)
    sym = exported(j.where("name <> ''").select(F.col("ref").alias("want"), "file", "name"), nodes, passed_on)
    n = nodes.select("id", F.col("kind").alias("_k"), "qualified_name", "file_path")
    box = j.where("form <> 'namespace' and member <> ''").join(sym.select(F.col("want").alias("ref"), "id"), "ref").join(n.where(F.col("_k").isin(CONTAINERS)), "id")
    box = box.select("ref", "reference_kind", "file_path", F.explode(F.array(F.concat_ws("::", "qualified_name", "member"), F.concat_ws(".", "qualified_name", "member"))).alias("qualified_name"))
    call = (F.col("reference_kind") == "calls") & F.col("_k").isin("method", "function")
    static = box.join(n.withColumnRenamed("id", "member_id"), ["qualified_name", "file_path"]).groupBy("ref").agg(F.min_by("member_id", F.struct((~call).alias("c"), F.col("member_id").alias("m"))).alias("member_id"))
    whole = j.where("name = '' or reference_kind = 'imports'").join(n.where("_k = 'file'").select("id", F.col("file_path").alias("file")), "file").groupBy(F.col("ref").alias("want")).agg(F.min("id").alias("file_id"))
    got = sym.join(static.withColumnRenamed("ref", "want"), "want", "left").join(whole, "want", "full_outer")
    return got.select(F.col("want").alias("ref"), F.coalesce("member_id", "id", "file_id").alias("id"), F.when(F.col("id").isNotNull(), 0.9).otherwise(0.92).alias("confidence"), F.lit("import").alias("method"), F.lit(1).alias("priority"))
