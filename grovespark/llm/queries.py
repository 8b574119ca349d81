"""Queries of this package with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm import docpairs, handwritten, layout, leaks, mojibake, parsing, tokens, validity
from grovespark.sources import read, spread

_FILE = ["path", "content_hash", "language", "size", "modified_at", "indexed_at", "node_count", "errors"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_by_hand(read(spark, d, "files"), read(spark, d, "nodes"))


def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    """Number of files per language and origin."""
    return handwritten.origins(read(spark, d, "files"), read(spark, d, "nodes")).groupBy("language", "origin").agg(F.count(F.lit(1)).alias("n_files"))


def p2_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Layout of all fenced code in documents, by language: blocks, minified ones, longest line, means of the statistics."""
    b = layout.judge(parsing.code_blocks(spread(read(spark, d, "documents").select("doc_id", "text"))), "code")
    stat = lambda k, digits: F.round(F.avg(f"layout.{k}"), digits).alias(k)
    return b.groupBy("language").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("origin") == "minified").alias("n_minified"), F.max("layout.max_line").alias("max_line"), stat("mean_line", 4), stat("space", 6), stat("alnum", 6))


def p2_channels(spark: SparkSession, d: str) -> DataFrame:
    """What decided that files are not hand-written, by origin: layout, place or comment."""
    return handwritten.origins(read(spark, d, "files"), read(spark, d, "nodes")).where("origin <> 'source'").groupBy("channel", "origin").agg(F.count(F.lit(1)).alias("n_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.invalid(read(spark, d, "files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(read(spark, d, "files"))


def p3_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All fenced code in documents, parsed: blocks, invalid ones, acceptance and the commonest first cause per language."""
    b = parsing.code_blocks(spread(read(spark, d, "documents").select("doc_id", "text")))
    e = b.select("language", parsing.errors_of(F.col("code"), F.col("language")).alias("e"))
    return e.groupBy("language").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.size("e") > 0).alias("n_invalid"), F.round(F.count_if(F.size("e") == 0) / F.count(F.lit(1)), 6).alias("accepted"), F.mode(F.get("e.cause", F.lit(0))).alias("top_cause"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(read(spark, d, "nodes")).select("node_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code-description pairs, with descriptions inherited from overridden methods."""
    return docpairs.pairs(read(spark, d, "nodes"), read(spark, d, "edges").select("source", "target", "kind"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", tokens.encode(F.col("text")).alias("ids"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items per document with the cosine that led there, the share of words found and the answers given away."""
    return leaks.leaked(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.detect(read(spark, d, "documents").select("doc_id", "text")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with what was found and the restored text."""
    return mojibake.detect(read(spark, d, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_origins, p2_layouts, p2_channels, p3_found, p3_rates, p3_code_blocks, p5_found, p5_pairs, p7_ids, p8_found, p8_leaks, p9_found, p9_restored)}


# The twins state thresholds and patterns on their own, so that they check the operators' constants too.

_F = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, modified_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)"
_NORM = r"regexp_replace(replace({0}, chr(92), '/'), '^(\./)+', '')"
_NAMED = {
    "ts mts cts": "typescript", "tsx": "tsx typescript", "js": "javascript jsx", "mjs cjs": "javascript", "jsx": "jsx javascript", "py pyi pyw": "python", "go": "go", "java": "java", "kt kts": "kotlin", "rs": "rust", "c": "c", "h": "c cpp objc",
    "cc cpp cxx hpp hh hxx": "cpp", "inl": "c cpp", "m mm": "objc", "cs": "csharp", "swift": "swift", "dart": "dart", "ets": "arkts typescript", "rb rake": "ruby", "php phtml": "php", "inc": "php c cpp", "lua": "lua", "luau": "luau lua", "vue": "vue", "svelte": "svelte", "scala sc": "scala",
}
_FITS = "CASE " + " ".join(f"WHEN ext IN {tuple(k.split() + [''])} THEN language IN {tuple(v.split() + [''])}" for k, v in _NAMED.items()) + " ELSE true END"
_BAD = """(NOT regexp_matches(m, '^(parser worker|parse timed out|failed to read|path traversal|tree walk|worker restarted|file exceeds|no grammar|unused|deprecated|duplicate|conflicting|end of line|syntax highlighting|unexpected byte|expected manifest|merge of [0-9])')
AND (contains(m, '<<<<<<<') OR contains(m, '>>>>>>>') OR contains(m, '=======') OR contains(m, '|||||||') OR contains(m, '(head)') OR contains(m, 'conflict marker') OR regexp_matches(m, '(both|two) (sides|versions) of')
 OR contains(m, 'eof') OR regexp_matches(m, 'end of (file|input)|(input|file) (ends|stops)|premature|(never|not) (closed|ends)|unterminated|unclosed|missing closing|still open|incomplete')
 OR regexp_matches(m, 'grammar (mismatch|recogni)|error nodes?|not legal in|unexpected (token|character|symbol|input)')))"""
_STATE = rf"""{_F}, x AS (SELECT path, language, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext, unnest(CASE WHEN len(errors) > 0 THEN errors ELSE [NULL] END) AS e FROM f), y AS (SELECT path, language, ext, lower(trim(e.message)) AS m, e.file_path AS whose FROM x),
s AS (SELECT path, any_value(language) AS language, bool_or(coalesce({_BAD} AND (whose IS NULL OR {_NORM.format('whose')} = {_NORM.format('path')}), false)) OR coalesce(any_value(language) <> 'unknown' AND NOT bool_and({_FITS}), false) AS invalid FROM y GROUP BY path)"""

_BY = "CASE WHEN language IN ('javascript', 'js', 'jsx', 'mjs', 'typescript', 'ts', 'tsx', 'arkts') THEN {js} WHEN language IN ('vue', 'svelte') THEN {vue} WHEN language = 'php' THEN {php} WHEN language = 'html' THEN {html} WHEN language = 'css' THEN {css} WHEN language IN ('python', 'py', 'ruby', 'rb') THEN {py} WHEN language IN ('c', 'cpp', 'objc') THEN {c} ELSE {rest} END"
_LIM = {
    "wide": _BY.format(js=1000, vue=2000, php=2000, html=3000, css=1500, py=1500, c=1000, rest=1000), "mean": _BY.format(js=160, vue=300, php=300, html=400, css=250, py=200, c=200, rest=200),
    "space": _BY.format(js=0.08, vue=0.05, php=0.05, html=0.04, css=0.07, py=0.06, c=0.06, rest=0.06), "alnum": _BY.format(js=0.5, vue=0.4, php=0.4, html=0.35, css=0.4, py=0.4, c=0.4, rest=0.45),
    "numeric": _BY.format(js=0.45, vue=0.45, php=0.45, html=0.5, css=0.5, py=0.4, c=0.5, rest=0.45), "encoded": _BY.format(js=400, vue=1500, php=800, html=3000, css=1500, py=400, c=300, rest=400),
}
_DIRS = "string_split(p, '/')[:-2]"
_NAME = "string_split(p, '/')[-1]"
_ORIGIN = rf"""{_F}, g AS (SELECT {_NORM.format('file_path')} AS p, max(end_line) AS lines, max(end_column) AS wide, arg_max(coalesce(docstring, ''), updated_at) FILTER (WHERE kind = 'file') AS doc, sum(length(signature)) AS n, sum(length(signature) - length(regexp_replace(signature, '[ \t\r\n]', '', 'g'))) AS sp, sum(length(signature) - length(regexp_replace(signature, '[\p{{L}}\p{{N}}]', '', 'g'))) AS an FROM nodes GROUP BY 1),
x AS (SELECT path, {_NORM.format('path')} AS p, language, size / greatest(lines, 1) AS mean, wide, lines, size / greatest(coalesce(node_count, 1), 1) AS per, CASE WHEN n >= 40 THEN sp / n END AS sp, CASE WHEN n >= 40 THEN an / n END AS an, coalesce(trim(regexp_replace(regexp_replace(lower(doc), '(?m)^\s*(/\*+|\*+/|\*|//+!?|#+!?|--+|;+|%+|\"\"\"||<!--)|\*+/\s*$|-->\s*$', ' ', 'g'), '\s+', ' ', 'g')), '') AS head FROM f LEFT JOIN g ON g.p = {_NORM.format('path')}),
z AS (SELECT *, coalesce(wide >= {_LIM['wide']}, false) AS broad, coalesce(sp < {_LIM['space']} / 4 AND an < {_LIM['alnum']}, false) AS dense FROM x),
w AS (SELECT path, language, CASE WHEN coalesce(per >= 20000 AND mean >= 50 AND mean < 1000 AND NOT broad AND NOT dense OR lines IS NULL AND per >= 200000, false) THEN 'layout:data' WHEN broad OR dense OR coalesce(mean >= {_LIM['mean']}, false) THEN 'layout:minified'
WHEN list_has_any({_DIRS}, ['node_modules', 'bower_components', 'jspm_packages', 'vendor', '_vendor', 'vendored', 'third_party', 'third-party', 'thirdparty', '3rdparty', '3rd_party', 'external', 'deps', 'Pods', 'site-packages', 'dist-packages']) OR len(list_filter({_DIRS}, lambda s: regexp_full_match(lower(s), 'third[-_]?party'))) > 0 OR regexp_matches('/' || p, '/(Carthage/Checkouts|Godeps/_workspace)/') THEN 'place:vendored'
WHEN regexp_matches({_NAME}, '([.](min|prod|bundle|chunk)|[-_]min)[.][cm]?js$') THEN 'place:minified'
WHEN list_has_any({_DIRS}, ['generated', '__generated__', '_generated', 'autogen', 'codegen_out', 'generated-sources', 'generated_sources', 'gen-src']) OR regexp_matches('/' || p, '/(build|target)/classes/|/build/generated/|/obj/(Release|Debug)/') OR regexp_matches({_NAME}, '[.](generated|gen|g|g[.]i|pb|pb-c|pulsar|tab|freezed|[Dd]esigner|auto|tmh|mocks|gr)[.][A-Za-z]+$|(_generated|_gen|_pb|_pb2|_pb2_grpc|_grpc_pb|Grpc|OuterClass)[.][A-Za-z]+$|^zz_generated[.]') THEN 'place:generated'
WHEN regexp_matches(head, '\b(verbatim|upstream|vendored?)\b|third.party|bundled copy|(copy|snapshot|fork) of \S+ v?[0-9]+[.][0-9]|copyright.{{0,60}}contributors') THEN 'comment:vendored'
WHEN regexp_matches(head, '@generated|<auto-?generated|auto-?generated|^(this (file|code) (was|is) )?(automatically |machine[- ])?generated (by|from|with)|(code|file|source) (was |is )?((automatically|machine) )?generated (by|from|with)|was automatically generated|^machine[- ](written|generated)|do not (edit|modify)( this file)?( by hand)?\s*([.!]?\s*$|[-—–]+\s*(re)?(built|generated))|^output of \w+[;,.]|g[ée]n[ée]r[ée] (par|automatiquement)|(erzeugt|generiert) (aus|mit|von|durch)|nicht von hand|genera?do (por|autom)|gerado (por|autom)|сгенерирован|自动生成|自動生成|wygenerowan') THEN 'comment:generated' ELSE ':source' END AS w FROM z), o AS (SELECT path, language, split_part(w, ':', 2) AS origin, split_part(w, ':', 1) AS channel FROM w)"""
_BLOCK = r"""b AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)(?:^|\n)```[\w+#-]*[^\n]*\n.*?(?:\n```|\z)')) AS b FROM documents WHERE contains(text, '```')), k AS (SELECT lower(regexp_extract(b, '```([\w+#-]*)', 1)) AS language, regexp_replace(regexp_replace(b, '^\s*```[^\n]*\n', ''), '\n```\s*$', '') AS code FROM b),
l AS (SELECT language, code, length(code) AS n, list_transform(list_filter(string_split_regex(code, '\r\n|\r|\n'), lambda x: trim(x, ' ') <> ''), lambda x: length(x)) AS w FROM k),
v AS (SELECT language, n, coalesce(list_max(w), 0) AS wide, coalesce(list_sum(w), 0) / greatest(len(w), 1) AS mean, (n - length(regexp_replace(code, '\s', '', 'g'))) / greatest(n, 1) AS sp, (n - length(regexp_replace(code, '[\p{L}\p{N}]', '', 'g'))) / greatest(n, 1) AS an FROM l)"""

_SPACES = "[\\u00a0\\u200b-\\u200d\\u2060\\ufeff\\u2000-\\u200a\\u202f\\u3000\\t]".encode().decode("unicode_escape")
#: Lines of a comment that describe nothing, said again without look-around: tags, directives, licences, stand-ins, rulers, code.
_IDLE = [
    r"^(@\p{L}|\\(param|returns?|brief|throws|see|deprecated)\b|:(param|type|returns?|rtype|raises|arg|keyword|var|ivar|meta|cvar)\b|\{@\w+\s*[^}]*\}\s*\.?$|-\s*parameters?\b|(args|arguments|parameters|returns|raises|yields):\s*$)",
    r"(?i)^@?(eslint|tslint|jshint|jslint|jscs|prettier|stylelint|biome|deno|istanbul|c8|v8|webpack\w*|noinspection|noqa|nosec|nosonar|nolint|lint|pylint|mypy|pyright|ruff|flake8|isort|yapf|fmt|black|pragma|type|swiftlint|swiftformat|rubocop|steep|sorbet|typed|frozen_string_literal|ktlint|detekt|checkstyle|spotless|phpstan|psalm|phpcs|codingstandardsignore\w*|clang-(format|tidy)|cppcheck|coverity|go|cgo|rustfmt|clippy|scalafmt|scalastyle|dart|luacheck|selene|stylua|suppress\w*|ts-(ignore|expect-error|nocheck)|vim?|emacs|editorconfig|nocov|coverage)(\s*:|-(disable|enable|ignore|next)|\s+(ignore|off|on|no cover)\b|$)|^(noqa|nolint|nosec|nosonar)\b|^#?(end)?region\b",
    r"(?i)^(spdx-license-identifier|copyright\b|\(c\)|©|all rights reserved|licen[cs]ed under|permission is hereby granted|this (file|program|source code) is (free|licen[cs]ed|part of)|redistribution and use)",
    r"(?i)^[\[<({]*\s*(to-?do|fixme|xxx+|tbd|wip|hack|n/?a|none|null|placeholder|undocumented|no (description|documentation|docs?)( (yet|available|provided))?|missing (description|documentation|docs?|docstring)|(add|insert|write|put)( a| some)? (description|documentation|docs?|docstring|comment)s?( here)?|description( goes)? here|description|describe( this)?( function| method)?|(auto-?generated|generated)( method| function)? stub|stub|document( me| this)?|see (above|below)|same as above|ditto|not documented|lorem ipsum.*|coming soon|internal|private|summary|foo|bar|test|asdf)\s*[\])}>]*[\s.:!?…]*$",
    r"(?i)^(todo|fixme|xxx|tbd|wip|hack)\b\s*($|[:(\-—]|add|document|write|describe|fill|implement)",
    r"^[^\p{L}\p{N}]*$|[-=*#~_+]{3,}\s*$|^[-=*#~_+]{3,}",
    r"[;{}]\s*$|^[\p{L}_$][\w.$:\->]*\s?\([^()]*(\([^()]*\))?[^()]*\)\s*$|^(const|let|var|val|final|auto|return|import|from|def|func|fn|fun|function|class|raise|throw|yield|await|elif|else|if|for|while|switch|case|end|using|namespace|package|public|private|protected|static)\b.*[=(){};:]\s*$|^(const|let|var|val|local|final|auto|int|string|bool)\s+[\w$]+\s*=|^[\p{L}_$][\w.$\[\]]*\s*([-+*/|&:]?=)\s*\S|^(return|raise|throw|yield)\s+[\w.$]+\(|^(import|from|require|include)\s+[\w.\"'/]+$|^(elif|if|for|while)\s*\(",
]
_SKIP = "['a', 'an', 'the', 'this', 'that', 'function', 'method', 'func', 'fn', 'routine', 'procedure', 'helper', 'will', 'of', 'to', 'is', 'for', 'on', 'in', 'it', 'and', 'by', 'with', 'from', 'does', 'do', 'its', 'call', 'calls', 'implementation', 'name', 'def', 'used', 'can', 'be']"
_PARTS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '(\\p{{Ll}}|\\p{{N}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}}+)(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"
_ROOT = "CASE WHEN regexp_matches({0}, '\\p{{L}}{{2}}(bb|dd|ff|gg|mm|nn|pp|rr|tt)(ing|ed|er)$') THEN regexp_replace({0}, '.(ing|ed|er)$', '') WHEN regexp_matches({0}, '\\p{{L}}{{2}}(ies|ied|ying|y)$') THEN regexp_replace({0}, '(ies|ied|ying|y)$', 'i') WHEN regexp_matches({0}, '\\p{{L}}{{2}}(ing|ed|es|s|er)$') THEN regexp_replace({0}, '(ing|ed|es|s|er)$', '') ELSE {0} END"
_STEM = f"regexp_replace({_ROOT}, '(\\p{{{{L}}}}{{{{2}}}})e$', '\\1')"


def _idle(c: str) -> str:
    return " OR ".join("regexp_matches({0}, '{1}')".format(c, r.replace("'", "''")) for r in _IDLE)


_TRIM = "regexp_replace(regexp_replace({0}, '^ +', ''), ' +$', '')"
_P5 = f"""n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM nodes) WHERE rn = 1), k AS (SELECT id, name, regexp_replace(regexp_replace(coalesce(docstring, ''), '\\r\\n?', chr(10), 'g'), '{_SPACES}', ' ', 'g') AS t FROM n WHERE kind IN ('function', 'method') AND regexp_matches(signature, '[^\\s\u00a0\u200b-\u200d\u2060\ufeff\u2000-\u200a\u202f\u3000]')),
l AS (SELECT id, name, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM k), a AS (SELECT id, name, i, regexp_replace({_TRIM.format('x')}, '^(/\\*+!?|<!--|\\(\\*|\"\"\"||=begin)|(\\*+/|-->|\\*\\)|\"\"\"||=end)$', '', 'g') AS x FROM l),
b AS (SELECT id, name, i, {_TRIM.format("regexp_replace(regexp_replace(" + _TRIM.format('x') + ", '^(///?/?|//!|--|#!?|;+|%+)( |$)', ' '), '(\\*+/|\"\"\"|)$', '')")} AS x FROM a), c AS (SELECT id, name, i, CASE WHEN starts_with(x, '***') THEN x ELSE regexp_replace(x, '^\\*{{1,2}}', '') END AS x FROM b), e AS (SELECT id, name, i, {_TRIM.format("regexp_replace(" + _TRIM.format('x') + ", '^(///?|//!|#)\\s*', '')")} AS x FROM c),
d AS (SELECT id, any_value(name) AS name, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT ({_idle('x')})), '') AS doc FROM e GROUP BY id), w AS (SELECT id, trim(regexp_replace(doc, '\\{{@\\w+\\}}|\\s+', ' ', 'g')) AS doc, list_transform({_PARTS.format("coalesce(name, '')")}, lambda w: {_STEM.format('w')}) AS own FROM d),
r AS (SELECT id, doc, list_distinct(list_filter(list_transform(list_filter({_PARTS.format('doc')}, lambda w: NOT list_contains({_SKIP}, w)), lambda w: {_STEM.format('w')}), lambda w: NOT list_contains(own, w) AND regexp_matches(w, '\\p{{L}}'))) AS rest FROM w)"""
_P5_OWN = "own AS (SELECT id, doc FROM r WHERE doc <> '' AND (len(rest) >= 2 OR length(regexp_replace(doc, '[^\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}\\p{Hangul}]', '', 'g')) >= 4))"

SQL: dict[str, str] = {
    "p5_found": f"WITH {_P5}, {_P5_OWN} SELECT id AS node_id FROM own",
    "p5_pairs": f"""WITH RECURSIVE {_P5}, {_P5_OWN}, m AS (SELECT target AS id, min(source) AS cls FROM edges WHERE kind = 'contains' GROUP BY 1), up AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE kind IN ('extends', 'implements') AND source <> target),
o AS (SELECT k.id, m.cls FROM k JOIN m USING (id) WHERE k.id NOT IN (SELECT id FROM own)), h(id, cls, depth) USING KEY (id, cls) AS (SELECT id, cls, 0 FROM o UNION SELECT h.id, up.b, min(h.depth + 1) FROM h JOIN up ON up.a = h.cls WHERE NOT EXISTS (SELECT 1 FROM recurring.h q WHERE q.id = h.id AND q.cls = up.b) GROUP BY 1, 2),
inh AS (SELECT h.id, own.doc, row_number() OVER (PARTITION BY h.id ORDER BY h.depth, own.id) AS i FROM h JOIN n ON n.id = h.id JOIN m ON m.cls = h.cls JOIN own ON own.id = m.id JOIN n p ON p.id = own.id AND p.name = n.name WHERE h.depth > 0)
SELECT n.id AS node_id, n.name, n.signature, own.doc AS description, 'own' AS origin FROM own JOIN n USING (id) UNION ALL SELECT n.id, n.name, n.signature, inh.doc, 'inherited' FROM inh JOIN n USING (id) WHERE i = 1""",
    "p2_found": f"WITH {_ORIGIN} SELECT path FROM o WHERE origin <> 'source'",
    "p2_origins": f"WITH {_ORIGIN} SELECT language, origin, count(*) AS n_files FROM o GROUP BY 1, 2",
    "p2_channels": f"WITH {_ORIGIN} SELECT channel, origin, count(*) AS n_files FROM o WHERE origin <> 'source' GROUP BY 1, 2",
    "p2_layouts": f"WITH {_BLOCK} SELECT language, count(*) AS n_blocks, count(*) FILTER (WHERE wide >= {_LIM['wide']} OR n >= 200 AND (mean >= {_LIM['mean']} OR sp < {_LIM['space']} AND an < {_LIM['alnum']} + 0.35)) AS n_minified, max(wide) AS max_line, round(avg(mean), 4) AS mean_line, round(avg(sp), 6) AS space, round(avg(an), 6) AS alnum FROM v GROUP BY 1",
    "p3_found": f"WITH {_STATE} SELECT path FROM s WHERE invalid",
    "p3_rates": f"WITH {_STATE} SELECT split_part(path, '/', 1) AS repository, language, count(*) AS n_files, count(*) FILTER (WHERE invalid) AS n_invalid, round(1 - count(*) FILTER (WHERE invalid) / count(*), 6) AS accepted FROM s GROUP BY 1, 2",
}
