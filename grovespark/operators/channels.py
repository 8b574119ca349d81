"""Edges that only show at run time: who registers under a key, joined with who dispatches to it.

A rule has two patterns over code, one for either side; the first group of each is the key: an event's or job's name, a
route, a type. Keys are counted on both sides before anything is paired, and keys with too many sides are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.operators.linking import event_channels
from grovespark.operators.relational import enclosing

#: Rules by tag: languages, pattern of the registering side, pattern of the dispatching side, most sides of a key.
RULES: dict[str, tuple[list[str], str, str, int]] = {
    "event-emitter": (["javascript", "typescript", "tsx", "jsx"], r"\.(?:on|once|addListener|addEventListener)\(\s*['\"]([\w:./-]+)['\"]", r"\.(?:emit|dispatchEvent)\(\s*['\"]([\w:./-]+)['\"]", 6),
    "celery-dispatch": (["python"], r"@(?:\w+\.)*(?:shared_)?task\b[^\n]*\n\s*(?:async\s+)?def\s+(\w+)", r"\b(\w+)\.(?:delay|apply_async|s|si)\(", 6),
    "sidekiq-dispatch": (["ruby"], r"class\s+([\w:]+)[^\n]*\n(?:(?!\bend\b)[^\n]*\n)*?\s*include\s+Sidekiq::(?:Worker|Job)", r"\b([A-Z][\w:]*)\.perform_(?:async|in|at)\b", 6),
    "laravel-event": (["php"], r"function\s+handle\s*\(\s*\\?(?:[\w\\]*\\)?(\w+)\s+\$", r"\bevent\(\s*new\s+\\?(?:[\w\\]*\\)?(\w+)|\b\\?(?:[\w\\]*\\)?(\w+)::dispatch\(", 6),
    "spring-event": (["java", "kotlin"], r"@(?:Transactional)?EventListener\b[^\n]*\n[^(\n]*\(\s*(?:final\s+)?(?:\w+\s*:\s*)?(\w+)", r"\.publishEvent\(\s*(?:new\s+)?(\w+)\s*\(", 6),
    "mediatr-dispatch": (["csharp"], r"\b(?:IRequestHandler|INotificationHandler)<\s*(\w+)", r"\.(?:Send|Publish)\(\s*new\s+(\w+)", 6),
    "redux-thunk": (["javascript", "typescript", "tsx", "jsx"], r"\b(?:export\s+)?const\s+(\w+)\s*=\s*(?:createAsyncThunk\(|\([^)]*\)\s*=>\s*(?:async\s*)?\(\s*dispatch\b)", r"\bdispatch\(\s*(\w+)\(", 6),
    "rtk-query": (["javascript", "typescript", "tsx", "jsx"], r"\b(\w+)\s*:\s*\w+\.(?:query|mutation)\b", r"\buse([A-Z]\w*?)(?:Query|Mutation)\(", 6),
    "vuex-dispatch": (["javascript", "typescript", "vue"], r"\b(?:async\s+)?(\w+)\s*\(\s*\{\s*(?:commit|dispatch|state)\b", r"(?:\$store|store)\.dispatch\(\s*['\"](?:[\w/]*/)?(\w+)['\"]", 6),
    "pinia-store": (["javascript", "typescript", "vue"], r"\bconst\s+(use\w+Store)\s*=\s*defineStore\(", r"\b(use\w+Store)\(\s*\)", 40),
    "compose-route": (["kotlin"], r"\bcomposable(?:<[^>]*>)?\(\s*(?:route\s*=\s*)?\"([^\"{?]+)", r"\.navigate\(\s*\"([^\"{?]+)", 6),
    "android-intent": (["kotlin", "java"], r"\bclass\s+(\w+)[^{\n]*(?::|\bextends\b)\s*[\w.]*(?:Activity|Service|BroadcastReceiver)\b", r"\bIntent\([^,()]*,\s*(\w+)(?:::class\.java|\.class)", 6),
    "android-fragment": (["kotlin", "java"], r"\bclass\s+(\w+)[^{\n]*(?::|\bextends\b)\s*[\w.]*Fragment\b", r"\.(?:replace|add)\([^,()]*,\s*(?:new\s+)?(\w+)\(", 6),
    "arkui-route": (["arkts"], r"@Entry\b[^{]*struct\s+(\w+)", r"\brouter\.(?:pushUrl|replaceUrl)\(\s*\{\s*url:\s*['\"](?:[\w-]+/)*(\w+)['\"]", 6),
    "arkui-emitter": (["arkts"], r"\bemitter\.on\(\s*\{?\s*(?:eventId:\s*)?['\"]?([\w.]+)", r"\bemitter\.emit\(\s*\{?\s*(?:eventId:\s*)?['\"]?([\w.]+)", 6),
    "rn-event-channel": (["objc", "java", "kotlin", "swift", "javascript", "typescript"], r"\.addListener\(\s*['\"](\w+)['\"]", r"(?:sendEventWithName:\s*@|sendEvent\(withName:\s*|\.emit\(\s*)\"(\w+)\"", 6),
    "gin-route": (["go"], r"func\s+(?:\([^)]*\)\s*)?(\w+)\(\s*\w+\s+\*gin\.Context\s*\)", r"\.(?:GET|POST|PUT|DELETE|PATCH|Use)\([^)\n]*?\b(?:\w+\.)?(\w+)\s*\)", 6),
    "request-handler": (["go"], r"func\s+\([^)]*\)\s*\w+\([^)]*\*(?:\w+\.)?(\w+Req)\b", r"type\s+(\w+Req)\s+struct\b", 6),
    "field-pointer": (["c", "cpp"], r"\.(\w+)\s*=\s*&?[A-Za-z_]\w*\s*[,;}]", r"(?:->|\.)(\w+)\)?\s*\(", 40),
    "state-holder": (["kotlin"], r"\bclass\s+(\w+(?:ViewModel|State|StateHolder))\b", r"\b(?:hiltViewModel|viewModel|koinViewModel)<(\w+)>|:\s*(\w+(?:ViewModel|StateHolder))\s*=", 6),
}


def _keys(code: DataFrame, pattern: str) -> DataFrame:
    """(id, channel): what the pattern's groups find in each piece of code."""
    import re

    groups = re.compile(pattern).groups
    every = F.flatten(F.array(*[F.regexp_extract_all("code", F.lit(pattern), g) for g in range(1, groups + 1)]))
    return code.where(F.col("code").isNotNull()).select("id", F.explode(F.array_distinct(F.filter(every, lambda x: x != ""))).alias("channel"))


def _key_of(tag: str, c: Column) -> Column:
    """Both sides' spelling of a key: hooks of generated endpoints begin with a capital."""
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20)) if tag == "rtk-query" else c


def dispatch_edges(code: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(source, target, channel, tag): dispatchers to registered handlers. code: (id, language, code), one row a function, class
    or other symbol; a symbol is not linked to itself. Null code and other languages have no channels."""
    out = []
    for tag in tags or RULES:
        langs, register, dispatch, most = RULES[tag]
        own = code.where(F.col("language").isin(langs))
        sides = [_keys(own, p).withColumn("channel", _key_of(tag, F.col("channel"))) for p in (register, dispatch)]
        out.append(event_channels(*sides, most).withColumn("tag", F.lit(tag)))
    return reduce(DataFrame.unionByName, out)


def literal_sites(files: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """(id, channel, line): the innermost function or class around each hit of a pattern in a file (path, content)."""
    lines = files.select(F.col("path").alias("file_path"), F.posexplode(F.split("content", "\n")).alias("_i", "_l"))
    hit = lines.where(F.col("_l").rlike(pattern)).select("file_path", (F.col("_i") + 1).alias("line"), F.explode(F.regexp_extract_all("_l", F.lit(pattern), 1)).alias("channel"))
    inside = enclosing(hit, nodes.where(F.col("kind").isin("function", "method", "class", "struct")), ["file_path", "line", "channel"])
    return inside.select(F.col("range_id").alias("id"), "channel", "line")
