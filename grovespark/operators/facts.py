"""Facts read from source texts and symbols: tables, constants, bindings, entities, resources, capabilities, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovespark.functions import paths
from grovespark.operators.relational import longest_prefix

TEST_SET_RE = r"(?i)/src/[^/]*test[^/]*/"


def is_test_set(path: Column) -> Column:
    """True for files of a test source set."""
    return path.rlike(TEST_SET_RE)


def _zip(text: Column, pattern: str, **groups: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), g).alias(k) for k, g in groups.items()])


def created_tables(files: DataFrame) -> DataFrame:
    """(path, table, place, column, type): columns of every CREATE TABLE in a text (path, content). Constraints are no columns;
    quotes around names go; commas inside brackets do not end a column; a statement that is cut off gives what is there."""
    rx = r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)[\"`\]]?\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)"
    text = F.regexp_replace("content", r"--[^\n]*|/\*[\s\S]*?\*/", " ")
    t = files.select("path", F.explode(_zip(text, rx, table=1, body=2)).alias("t")).select("path", "t.table", F.col("t.body").alias("body"))
    flat = F.regexp_replace("body", r"\(([^()]*),([^()]*)\)", "($1;$2)")
    c = t.select("path", "table", F.posexplode(F.split(flat, ",")).alias("place", "_c")).withColumn("_c", F.regexp_replace("_c", r"^\s+|\s+$", ""))
    c = c.where(~F.col("_c").rlike(r"(?i)^(primary|foreign|unique|check|constraint|key|index)\b") & (F.col("_c") != ""))
    return c.select("path", "table", "place", F.regexp_extract("_c", r"^[\"`\[]?(\w+)", 1).alias("column"), F.regexp_replace(F.upper(F.regexp_extract("_c", r"^[\"`\[]?\w+[\"`\]]?\s+(\w+(?:\s*\([^)]*\))?)", 1)), ";", ",").alias("type"))


def constants(files: DataFrame) -> DataFrame:
    """(path, name, value): named literals in capitals or declared constant, with numbers and strings as written."""
    rx = r"(?m)^\s*(?:(?:export|public|private|internal|protected|static|final|const|val|let|var|readonly|#define)\s+)*(?:[\w<>\[\]]+\s+)?([A-Z][A-Z0-9_]{2,})\s*(?::\s*[\w<>\[\]]+\s*)?(?:=\s*|\s)(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\d[\w.]*)"
    return files.select("path", F.explode(_zip(F.col("content"), rx, name=1, value=2)).alias("c")).select("path", "c.name", "c.value").distinct()


def enum_values(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(enum, place, value): members of enums in the order they are written."""
    inside = edges.where("kind = 'contains'").select(F.col("source").alias("enum"), F.col("target").alias("id")).distinct()
    m = nodes.where("kind = 'enum_member'").select("id", "name", "start_line", "start_column").join(inside, "id").join(nodes.where("kind = 'enum'").select(F.col("id").alias("enum")), "enum", "left_semi")
    return m.withColumn("place", F.row_number().over(W.partitionBy("enum").orderBy("start_line", "start_column", "id"))).select("enum", "place", F.col("name").alias("value"))


#: How interfaces are bound to implementations: language, pattern, group of the interface and of the implementation.
BINDINGS = [
    (["kotlin"], r"@Binds\b[\s\S]{0,200}?\bfun\s+\w+\(\s*\w+\s*:\s*(\w+)\s*\)\s*:\s*(\w+)", 2, 1),
    (["java"], r"@Binds\b[\s\S]{0,200}?\b(\w+)\s+\w+\(\s*(?:final\s+)?(\w+)\s+\w+\s*\)\s*;", 1, 2),
    (["java", "kotlin"], r"\bbind\((\w+)(?:\.class|::class(?:\.java)?)\)\s*\.to\((\w+)", 1, 2),
    (["kotlin"], r"\b(?:single|factory|scoped)<(\w+)>\s*\{\s*(\w+)\(", 1, 2),
    (["csharp"], r"\.Add(?:Scoped|Singleton|Transient)<\s*(\w+)\s*,\s*(\w+)", 1, 2),
    (["typescript", "tsx"], r"\bprovide\s*:\s*(\w+)\s*,\s*useClass\s*:\s*(\w+)", 1, 2),
    (["typescript", "tsx"], r"\.bind<(\w+)>\([^)]*\)\s*\.to\((\w+)", 1, 2),
    (["php"], r"->(?:bind|singleton)\(\s*\\?(?:\w+\\)*(\w+)::class\s*,\s*\\?(?:\w+\\)*(\w+)::class", 1, 2),
]


def bindings(files: DataFrame) -> DataFrame:
    """(path, iface, impl): which implementation an interface is bound to, from a text (path, language, content)."""
    out = None
    for langs, rx, a, b in BINDINGS:
        f = files.where(F.col("language").isin(langs)).select("path", F.explode(_zip(F.col("content"), rx, iface=a, impl=b)).alias("b")).select("path", "b.iface", "b.impl")
        out = f if out is None else out.unionByName(f)
    return out.distinct()


def entities(nodes: DataFrame, edges: DataFrame, marks: tuple[str, ...] = ("Entity", "Table", "Document", "Serializable", "dataclass")) -> DataFrame:
    """(entity, name, place, field, type): fields of the classes that carry one of the marks as a decorator."""
    c = nodes.where((F.col("kind").isin("class", "struct")) & F.arrays_overlap(F.transform("decorators", lambda d: F.regexp_extract(d, r"(\w+)", 1)), F.array(*map(F.lit, marks)))).select(F.col("id").alias("entity"), F.col("name"))
    inside = edges.where("kind = 'contains'").select(F.col("source").alias("entity"), F.col("target").alias("id")).distinct().join(c, "entity")
    m = inside.join(nodes.where(F.col("kind").isin("field", "property")).select("id", F.col("name").alias("field"), F.coalesce("return_type", F.regexp_extract("signature", r":\s*([\w<>\[\]?.]+)", 1)).alias("type"), "start_line"), "id")
    return m.withColumn("place", F.row_number().over(W.partitionBy("entity").orderBy("start_line", "id"))).select("entity", "name", "place", "field", "type")


def test_contract(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, n_files, n_cases): test files and test functions of each module. modules: (folder)."""
    t = nodes.where(paths.is_test(F.col("file_path")) & F.col("kind").isin("function", "method"))
    a = longest_prefix(t.select("id", "file_path"), "file_path", modules)
    return a.where("folder is not null").groupBy(F.col("folder").alias("module")).agg(F.count_distinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_cases"))


def resources(files: DataFrame) -> DataFrame:
    """(path, type, name, value): entries of XML resource files."""
    rx = r"<(string|color|dimen|integer|bool|style|array|string-array)\s+[^>]*?\bname\s*=\s*[\"']([\w.]+)[\"'][^>]*?>([^<]*)"
    return files.where(F.col("path").rlike(r"(^|/)res/[^/]+/[^/]+\.xml$")).select("path", F.explode(_zip(F.col("content"), rx, type=1, name=2, value=3)).alias("r")).select("path", "r.type", "r.name", F.trim("r.value").alias("value"))


def navigation(files: DataFrame) -> DataFrame:
    """(path, screen, target): actions of XML navigation graphs, from the destination they stand in."""
    block = r"(?s)<(?:fragment|activity|dialog)\b[^>]*?android:id\s*=\s*\"@\+?id/(\w+)\"(?:[^>]*/>|.*?</(?:fragment|activity|dialog)>)"
    b = files.where(F.col("path").rlike(r"(^|/)res/navigation/[^/]+\.xml$")).select("path", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(block), 1).alias("screen"), F.regexp_extract_all("content", F.lit(block), 0).alias("body"))).alias("b"))
    return b.select("path", "b.screen", F.explode(F.regexp_extract_all("b.body", F.lit(r"app:destination\s*=\s*\"@\+?id/(\w+)\""), 1)).alias("target")).distinct()


def composable_screens(code: DataFrame) -> DataFrame:
    """(id, screen, routes): functions (id, code) that are screens by annotation and name, with the routes they register."""
    screen = F.regexp_extract("code", r"@Composable\b[\s\S]{0,200}?\bfun\s+(\w*(?:Screen|Page|Route))\s*\(", 1)
    return code.select("id", screen.alias("screen"), F.array_sort(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\bcomposable\(\s*(?:route\s*=\s*)?\"([^\"]+)\""), 1))).alias("routes")).where("screen <> '' or size(routes) > 0")


def flows(nodes: DataFrame) -> DataFrame:
    """(id, name, holder, item): fields that hold a stream of values, by their type."""
    t = F.coalesce(F.nullif("return_type", F.lit("")), F.col("signature"))
    rx = r"\b((?:Mutable)?(?:StateFlow|SharedFlow|LiveData)|Flow|Observable|Flowable|Publisher|BehaviorSubject|Subject)<\s*([\w.<>?]+?)\s*>"
    return nodes.where(F.col("kind").isin("field", "property", "variable", "constant")).select("id", "name", F.regexp_extract(t, rx, 1).alias("holder"), F.regexp_extract(t, rx, 2).alias("item")).where("holder <> ''")


def module_capabilities(entries: DataFrame, rules: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, capability): manifest permissions (path, tag, name) by rules (key, capability), in the module whose folder is
    nearest above the manifest. A permission's key is its last part, letters and digits only."""
    from grovespark.functions.names import permission_key

    p = entries.where("tag in ('uses-permission', 'uses-feature')").select("path", permission_key(F.col("name")).alias("key"))
    got = p.join(F.broadcast(rules.select("key", "capability")), "key")  # a fixed table of rules
    return longest_prefix(got, "path", modules).where("folder is not null").select(F.col("folder").alias("module"), "capability").distinct()


def used_frameworks(imports: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(framework, n_files): frameworks whose import prefix files use; rules: prefix to name. imports: (path, source)."""
    hit = F.array_compact(F.array(*[F.when(F.col("source").startswith(p), F.lit(n)) for p, n in rules.items()]))
    return imports.select("path", F.explode(F.array_distinct(hit)).alias("framework")).groupBy("framework").agg(F.count_distinct("path").alias("n_files"))


def symbol_facts(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, place, facet, detail): facts (name, facet, detail) of the overlay that bear a symbol's name, three a symbol."""
    j = symbols.select("id", F.lower("name").alias("_n")).join(facts.select(F.lower("name").alias("_n"), "facet", "detail").distinct(), "_n")
    return j.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("facet", "detail"))).where("place <= 3").select("id", "place", "facet", "detail")
