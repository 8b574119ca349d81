"""Source trees as tables: scanning, ignore rules, languages, manifests and build files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions.kinds import lookup

#: Language by extension.
LANGUAGES = {
    "arkts": ["ets"], "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "hpp"], "csharp": ["cs"], "dart": ["dart"], "go": ["go"], "java": ["java"], "javascript": ["cjs", "js", "mjs"], "jsx": ["jsx"],
    "kotlin": ["kt", "kts"], "lua": ["lua"], "luau": ["luau"], "objc": ["m", "mm"], "php": ["inc", "php", "phtml"], "python": ["py", "pyi", "pyw"], "ruby": ["rake", "rb"], "rust": ["rs"], "scala": ["sc", "scala"],
    "svelte": ["svelte"], "swift": ["swift"], "tsx": ["tsx"], "typescript": ["cts", "mts", "ts"], "vue": ["vue"],
}
BY_EXTENSION = {e: k for k, es in LANGUAGES.items() for e in es}
MAX_BYTES = 1 << 20


def language_of(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """Language of a path by its extension, or null; `overrides` come first."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return lookup(BY_EXTENSION | (overrides or {}), ext)


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression over paths, whether it takes paths back in) of one line of an ignore file."""
    back, p = pattern.startswith("!"), pattern.lstrip("!").strip()
    folder, anchored = p.endswith("/"), "/" in p.strip("/") or p.startswith("/")
    body = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m.group(0)) or re.escape(m.group(0)), p.strip("/"))
    return f"{'^' if anchored else '(?:^|/)'}{body}{'/' if folder else '(?:/|$)'}", back


def ignored(path: Column, patterns: list[str]) -> Column:
    """True for paths that the last matching line of an ignore file shuts out; blank lines and comments are none."""
    c = F.lit(False)
    for line in patterns:
        if line.strip() and not line.startswith("#"):
            rx, back = ignore_regex(line)
            c = F.when(path.rlike(rx), F.lit(not back)).otherwise(c)
    return c


#: What only C++ and only Objective-C headers hold.
CPP_HEADER_RE = r"(?m)^\s*(?:class\s+\w+[^;]*\{|class\s+\w+\s*:|namespace\s+\w*|template\s*<|using\s+\w|(?:public|private|protected)\s*:)|\bstd::|\bvirtual\b|\bconstexpr\b|\bnullptr\b"
OBJC_HEADER_RE = r"(?m)^\s*@(?:interface|protocol|class|property|end)\b|^\s*#\s*import\b"


def language_by_content(path: Column, content: Column, overrides: dict[str, str] | None = None) -> Column:
    """As `language_of`; a `.h` file is C++ or Objective-C if its text is, and a file without a known extension has the
    language of its first line's interpreter. Null contents leave it to the path."""
    by = language_of(path, overrides)
    header = path.rlike(r"(?i)\.h$") & (by == "c")
    shell = F.regexp_extract(F.coalesce(content, F.lit("")), r"^#!\s*\S*/(?:env\s+)?(python|ruby|node|lua|php)", 1)
    return F.when(header & content.rlike(CPP_HEADER_RE), "cpp").when(header & content.rlike(OBJC_HEADER_RE), "objc").otherwise(F.coalesce(by, F.when(shell == "node", "javascript").otherwise(F.nullif(shell, F.lit("")))))


def ignore_files(spark: SparkSession, root: str, name: str = ".gitignore") -> DataFrame:
    """(path, content) of a tree's ignore files. File sources leave hidden files out, so the file system lists them; only
    their own paths and lines are kept."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = re.sub(r"^\w+:/*", "/", fs.makeQualified(at).toString()).rstrip("/") + "/"
    found, it = [], fs.listFiles(at, True)
    while it.hasNext():
        p = it.next().getPath()
        if p.getName() == name:
            stream = fs.open(p)
            found.append((re.sub(r"^\w+:/*", "/", p.toString()).removeprefix(base), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(found, "path string, content string")


def nested_rules(files: DataFrame) -> DataFrame:
    """(folder, place, pattern, back): the lines of all ignore files (path, content) as regular expressions over paths below
    their folder; `back` marks those that take paths back in. Blank lines and comments are none."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "").alias("folder")
    lines = files.select(folder, F.posexplode(F.split("content", r"\r?\n")).alias("place", "_l")).where("trim(_l) <> '' and not startswith(_l, '#')")
    rule = F.udf(lambda line: ignore_regex(line), "struct<pattern:string,back:boolean>")  # lines that people wrote, not a hot path
    return lines.select("folder", "place", rule("_l").alias("r")).select("folder", "place", "r.pattern", "r.back")


def not_ignored(paths_: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of `paths_` (path, ...) that the ignore files of their own and all outer folders leave in: of the lines that match,
    the last one of the innermost file decides. A path meets only the rules of folders above it."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("folder"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("below"), i.alias("depth")))
    each = paths_.select("path").distinct().select("path", F.explode(up).alias("u")).select("path", "u.folder", "u.below", "u.depth")
    hit = each.join(F.broadcast(rules), "folder").where(F.call_function("regexp_like", F.col("below"), F.col("pattern")))  # rules are lines that people wrote
    last = hit.groupBy("path").agg(F.max_by("back", F.struct("depth", "place")).alias("back")).where("not back").select("path")
    return paths_.join(last, "path", "left_anti")


def scan(spark: SparkSession, root: str, ignore: list[str] = (), overrides: dict[str, str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, size, modified_at, content_hash, content) of a tree's source files: known languages, not ignored, no
    larger than `max_bytes`. The size filter is applied before contents are read. Files of no bytes are not listed by the
    underlying source; an empty tree gives no rows."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    f = raw.withColumn("path", F.when(rel.startswith(base), F.substring(rel, F.lit(len(base) + 1), F.length(rel))).otherwise(rel))
    f = f.withColumn("language", language_of(F.col("path"), overrides)).where(F.col("language").isNotNull() & ~ignored(F.col("path"), list(ignore)))
    return f.select("path", "language", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def embedded_roots(paths: DataFrame) -> DataFrame:
    """(root): folders that hold a repository of their own."""
    return paths.where(F.col("path").rlike(r"/\.git/")).select(F.regexp_extract("path", r"^(.*?)/\.git/", 1).alias("root")).where("root <> ''").distinct()


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """(path, configuration, module): project dependencies of build files."""
    rx = r"(?mi)^\s*(\w*(?:implementation|api|compileOnly|runtimeOnly|kapt|ksp)\w*)\s*\(?\s*project\s*\(\s*(?:path\s*[:=]\s*)?[\"']:?([^\"']+)[\"']"
    hits = F.arrays_zip(F.regexp_extract_all("content", F.lit(rx), 1).alias("configuration"), F.regexp_extract_all("content", F.lit(rx), 2).alias("module"))
    return files.where(F.col("path").rlike(r"\.gradle(\.kts)?$")).select("path", F.explode(hits).alias("h")).select("path", "h.configuration", F.translate("h.module", ":", "/").alias("module")).distinct()


def manifest_entries(files: DataFrame) -> DataFrame:
    """(path, tag, name): named elements of XML manifests; what is no XML gives no rows."""
    rx = r"<(activity|service|receiver|provider|uses-permission|uses-feature)\b[^>]*?\bandroid:name\s*=\s*[\"']([^\"']+)[\"']"
    hits = F.arrays_zip(F.regexp_extract_all("content", F.lit(rx), 1).alias("tag"), F.regexp_extract_all("content", F.lit(rx), 2).alias("name"))
    return files.where(F.col("path").endswith("Manifest.xml")).select("path", F.explode(hits).alias("h")).select("path", "h.tag", "h.name").distinct()


def tolerant_json(text: Column, schema: str) -> Column:
    """A JSON text with comments, single quotes, bare keys and trailing commas; null if it still is none."""
    tidy = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    return F.from_json(tidy, schema, {"allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "mode": "PERMISSIVE"})
