"""Symbols of many languages from their declarations: one line-based reader, told by a table how each language writes them.

Strings and comments are blanked first, place for place, so that what they hold is never read. A declaration begins where
its pattern matches; its end is the bracket that closes its body, the `end` of its block, or its own line. Symbols are
nested by their spans. Calls, imports and supertypes are references of the innermost symbol around them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|open|sealed|async|export|default|declare|readonly|virtual|partial|suspend|inline|data|const|unsafe|pub(?:\([\w:]+\))?|extern|fileprivate|mutating|external|implicit|lazy|case)\s+)*"
_TYPE = r"[\w.:<>\[\],?*& ]+?[\s*&]"


@dataclass
class Spec:
    """How a language declares: (kind, pattern with the group `name`), imports (group 1 is the name), supertypes after a class
    (pattern over its head, group 1), and how blocks end: 'brace', 'end' or 'line'."""

    declarations: list[tuple[str, str]]
    imports: list[str] = field(default_factory=list)
    extends: str = r"(?:\bextends\b|\bimplements\b|:)\s*([\w.,\s<>]+)"
    blocks: str = "brace"
    comments: tuple[str, ...] = ("//", "/*")


_SCRIPT = Spec(
    [
        ("class", rf"^\s*{_MODS}class\s+(?P<name>[\w$]+)"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>[\w$]+)"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>[\w$]+)"), ("type_alias", rf"^\s*{_MODS}type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*="),
        ("namespace", rf"^\s*{_MODS}(?:namespace|module)\s+(?P<name>[\w$.]+)\s*\{{"), ("function", rf"^\s*{_MODS}function\s*\*?\s*(?P<name>[\w$]+)"), ("function", rf"^\s*{_MODS}(?:let|var)?\s*(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::\s*[\w<>\[\]| ]+)?\s*=>|[\w$]+\s*=>)"),
        ("method", rf"^\s*{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>#?(?!(?:if|for|while|switch|catch|return|function|with)\b)[\w$]+)\s*(?:<[^>()]*>)?\([^()]*\)\s*(?::\s*[^{{}};=]+)?\{{"),
        ("constant", r"^\s*(?:export\s+)?const\s+(?P<name>[\w$]+)\s*(?::[^=]+)?="),
    ],
    [r"^\s*import\s+(?:type\s+)?([\w$]+)\s*(?:,|from)", r"^\s*import\s*\{\s*([\w$]+)", r"\brequire\(\s*['\"]([^'\"]+)"],
)
_C = [("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)"), ("function", rf"^(?!\s*(?:return|else|typedef|struct|enum|if|for|while|switch|case|using|namespace|class)\b)\s*(?:[\w:<>,]+[\s*&]+)+(?P<name>~?[\w:]+)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:->\s*[\w:<>&* ]+)?\{{")]
#: Specifications by language.
SPECS: dict[str, Spec] = {
    "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT, "jsx": _SCRIPT,
    "arkts": Spec([("struct", r"^\s*(?:export\s+)?struct\s+(?P<name>\w+)"), *_SCRIPT.declarations], _SCRIPT.imports),
    "go": Spec([("struct", r"^\s*(?:type\s+)?(?P<name>\w+)\s+struct\s*\{"), ("interface", r"^\s*(?:type\s+)?(?P<name>\w+)\s+interface\s*\{"), ("method", r"^func\s+\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("type_alias", r"^type\s+(?P<name>\w+)\s+(?!struct|interface)\S")], [r"^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", r"^\s*(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$"]),
    "rust": Spec([("struct", rf"^\s*{_MODS}struct\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>\w+)"), ("trait", rf"^\s*{_MODS}trait\s+(?P<name>\w+)"), ("module", rf"^\s*{_MODS}mod\s+(?P<name>\w+)\s*\{{"), ("class", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)"), ("function", rf"^\s*{_MODS}fn\s+(?P<name>\w+)"), ("constant", rf"^\s*{_MODS}(?:static\s+)?(?P<name>[A-Z][A-Z0-9_]+)\s*:")], [r"^\s*(?:pub\s+)?use\s+([\w:]+)"], r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b"),
    "java": Spec([("class", rf"^\s*{_MODS}(?:class|record)\s+(?P<name>\w+)"), ("interface", rf"^\s*{_MODS}@?interface\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>\w+)"), ("method", rf"^\s*(?!(?:return|new|else|throw)\b){_MODS}(?:synchronized\s+|native\s+)*(?:<[^>]+>\s*)?(?:{_TYPE})?(?P<name>(?!(?:if|for|while|switch|catch)\b)\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?[{{;]"), ("field", rf"^\s*(?:(?:public|private|protected|static|final|volatile|transient)\s+)+{_TYPE}(?P<name>\w+)\s*[=;]")], [r"^\s*import\s+(?:static\s+)?([\w.]+)"], r"\b(?:extends|implements)\s+([\w.,\s<>]+)"),
    "csharp": Spec([("class", rf"^\s*{_MODS}(?:class|record|struct)\s+(?P<name>\w+)"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>\w+)"), ("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), ("property", rf"^\s*{_MODS}{_TYPE}(?P<name>\w+)\s*\{{\s*(?:get|set|init)\b"), ("method", rf"^\s*(?!(?:return|new|else|throw|using|await)\b){_MODS}(?:{_TYPE})?(?P<name>(?!(?:if|for|foreach|while|switch|catch|lock|using)\b)\w+)\s*(?:<[^>]*>)?\([^()]*\)\s*(?:where[^{{]*)?(?:\{{|=>|$)")], [r"^\s*using\s+([\w.]+)\s*;"]),
    "kotlin": Spec([("interface", rf"^\s*{_MODS}interface\s+(?P<name>\w+)"), ("class", rf"^\s*{_MODS}(?:enum\s+|annotation\s+)?(?:class|object)\s+(?P<name>\w+)"), ("function", rf"^\s*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)"), ("property", rf"^\s*{_MODS}(?:val|var)\s+(?P<name>\w+)")], [r"^\s*import\s+([\w.]+)"], r":\s*([\w.,\s<>]+)"),
    "swift": Spec([("class", rf"^\s*{_MODS}(?:class|actor|extension)\s+(?P<name>\w+)"), ("struct", rf"^\s*{_MODS}struct\s+(?P<name>\w+)"), ("protocol", rf"^\s*{_MODS}protocol\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODS}(?:indirect\s+)?enum\s+(?P<name>\w+)"), ("function", rf"^\s*(?:@\w+\s+)*{_MODS}func\s+(?P<name>\w+)"), ("property", rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:let|var)\s+(?P<name>\w+)")], [r"^\s*import\s+(\w+)"]),
    "dart": Spec([("class", rf"^\s*{_MODS}(?:class|mixin|extension)\s+(?P<name>\w+)"), ("enum", r"^\s*enum\s+(?P<name>\w+)"), ("function", rf"^\s*(?!(?:return|new|else|throw|await|if|for|while|switch)\b){_MODS}(?:{_TYPE})(?P<name>\w+)\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{{|=>)")], [r"^\s*import\s+['\"]([^'\"]+)"], r"\b(?:extends|with|implements)\s+([\w.,\s<>]+)"),
    "php": Spec([("class", rf"^\s*{_MODS}class\s+(?P<name>\w+)"), ("interface", r"^\s*interface\s+(?P<name>\w+)"), ("trait", r"^\s*trait\s+(?P<name>\w+)"), ("function", rf"^\s*{_MODS}function\s+&?(?P<name>\w+)"), ("constant", rf"^\s*{_MODS}(?P<name>[A-Z][A-Z0-9_]+)\s*=")], [r"^\s*use\s+([\w\\]+)"], r"\b(?:extends|implements)\s+([\w\\,\s]+)", "brace", ("//", "/*", "#")),
    "c": Spec(_C, [r"^\s*#\s*include\s+[<\"]([^>\"]+)"]),
    "cpp": Spec([("namespace", r"^\s*namespace\s+(?P<name>[\w:]+)\s*\{"), ("class", r"^\s*(?:template\s*<[^{]*>\s*)?class\s+(?P<name>\w+)[^;]*$"), *_C], [r"^\s*#\s*include\s+[<\"]([^>\"]+)"], r":\s*((?:public|private|protected|virtual|\s|[\w:<>,])+)"),
    "objc": Spec([("class", r"^\s*@(?:interface|implementation)\s+(?P<name>\w+)"), ("protocol", r"^\s*@protocol\s+(?P<name>\w+)"), ("method", r"^\s*[-+]\s*\([^)]*\)\s*(?P<name>\w+)"), *_C], [r"^\s*#\s*import\s+[<\"]([^>\"]+)"]),
    "scala": Spec([("class", rf"^\s*{_MODS}(?:class|object)\s+(?P<name>\w+)"), ("trait", rf"^\s*{_MODS}trait\s+(?P<name>\w+)"), ("function", rf"^\s*{_MODS}def\s+(?P<name>\w+)")], [r"^\s*import\s+([\w.]+)"], r"\b(?:extends|with)\s+([\w.]+)"),
    "ruby": Spec([("module", r"^\s*module\s+(?P<name>[\w:]+)"), ("class", r"^\s*class\s+(?P<name>[\w:]+)"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)"), ("constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]+)\s*=")], [r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)"], r"<\s*([\w:]+)", "end", ("#",)),
    "lua": Spec([("function", r"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?(?P<name>\w+)"), ("function", r"^\s*(?:local\s+)?(?:[\w.]+\.)?(?P<name>\w+)\s*=\s*function\b")], [r"\brequire\s*\(?\s*['\"]([^'\"]+)"], r"(?!x)x", "end", ("--",)),
}
SPECS["luau"] = SPECS["lua"]
#: Words before a bracket that call nothing.
NO_CALLS = frozenset("if for foreach while switch catch return function fn func fun def match when sizeof typeof await new throw print echo assert super elif elsif unless until with lock using synchronized defer go and or not in is as class struct".split())
CONTAINERS = frozenset("class interface struct enum trait protocol module namespace".split())


def blanked(text: str, comments: tuple[str, ...]) -> str:
    """The text with strings and comments blanked, every character else at its place; line breaks stay."""
    parts = [r"\"(?:\\.|[^\"\\\n])*\"?", r"'(?:\\.|[^'\\\n])*'" if "--" not in comments else r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*`?"]
    parts += [r"/\*[\s\S]*?(?:\*/|\Z)"] * ("/*" in comments) + [r"//[^\n]*"] * ("//" in comments) + [r"#(?!\s*include|\s*import|\s*define)[^\n]*"] * ("#" in comments) + [r"--[^\n]*"] * ("--" in comments)
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m.group(0)) if m.group(0)[0] not in "\"'`" else m.group(0)[0] + re.sub(r"[^\n]", " ", m.group(0)[1:-1]) + m.group(0)[-1:], text)


def _end(lines: list[str], at: int, spec: Spec) -> int:
    """Index of the last line of what is declared at a line."""
    if spec.blocks == "end":
        depth = 0
        for i in range(at, len(lines)):
            depth += len(re.findall(r"^\s*(?:class|module|def|if|unless|while|until|for|case|begin)\b|\bdo\b|\bfunction\b", lines[i])) - len(re.findall(r"\bend\b", lines[i]))
            depth -= len(re.findall(r"^\s*(?:while|until|for)\b.*\bdo\b", lines[i]))
            if depth <= 0:
                return i
        return len(lines) - 1
    depth, opened, round_ = 0, False, 0
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i
            elif c == ";" and not opened and not round_:
                return i
            elif c in "()":
                round_ += 1 if c == "(" else -1
        # Without a bracket so far, a head goes on in brackets or where the next line says so.
        if not opened and round_ <= 0 and not re.match(r"\s*(\{|where\b|throws\b|extends\b|implements\b|with\b|:|->|\))", lines[i + 1] if i + 1 < len(lines) else ""):
            return i
    return len(lines) - 1


def _doc(raw: list[str], at: int) -> str | None:
    """The comment right above a line, without annotations between."""
    i, out = at - 1, []
    while i >= 0 and re.match(r"\s*@\w", raw[i]):
        i -= 1
    while i >= 0 and re.match(r"\s*(//|/\*|\*|#(?!\s*include|\s*define)|--)|.*\*/\s*$", raw[i]) and raw[i].strip():
        out.append(raw[i].strip())
        i -= 1
    return "\n".join(reversed(out)) or None


def _id(kind: str, path: str, name: str, line: int) -> str:
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


def rows_of(path: str, text: str, language: str) -> list[dict]:
    """Nodes, edges, references and errors of a file, with the columns of `extraction.ROW`."""
    spec, base = SPECS[language], path.rsplit("/", 1)[-1]
    raw, lines = text.split("\n"), blanked(text, spec.comments).split("\n")
    file = _id("file", path, base, 1)
    out = [{"row": "node", "id": file, "kind": "file", "name": base, "qualified_name": path, "start_line": 1, "end_line": len(raw)}]
    if blanked(text, spec.comments).count("{") != blanked(text, spec.comments).count("}") and spec.blocks == "brace":
        out.append({"row": "error", "line": len(raw), "message": "brackets do not match at end of file"})
    rules = [(k, re.compile(p)) for k, p in spec.declarations]
    found: list[tuple[int, int, str, str]] = []
    for i, line in enumerate(lines):
        for kind, rx in rules:
            if m := rx.match(line):
                found.append((i, _end(lines, i, spec), kind, m.group("name").split("::")[-1]))
                break
    stack: list[tuple[int, int, str, str, str]] = []
    owner = [file] * len(lines)
    heads: set[tuple[int, str]] = set()
    plain: set[int] = set()
    for a, b, kind, name in sorted(found, key=lambda x: (x[0], -x[1])):
        while stack and stack[-1][1] < a:
            stack.pop()
        parent = stack[-1] if stack else None
        inside = parent is not None and parent[3] in CONTAINERS
        if kind == "method" and not inside and language not in ("go", "objc"):
            continue
        kind = "method" if kind == "function" and inside and parent[3] not in ("module", "namespace") else kind
        qualified = f"{parent[4]}.{name}" if parent else name
        x = _id(kind, path, name, a + 1)
        head = " ".join(raw[a : min(b, a + 3) + 1])
        signature = re.search(re.escape(name) + r"\s*(?:<[^>]*>)?(\([^)]*\)[^{=;]*)", head)
        out.append({"row": "node", "id": x, "kind": kind, "name": name, "qualified_name": f"{path}::{qualified}", "start_line": a + 1, "end_line": b + 1, "docstring": _doc(raw, a), "message": signature.group(1).strip() if signature and kind in ("function", "method") else None})
        out.append({"row": "edge", "source": parent[2] if parent else file, "target": x, "edge_kind": "contains", "line": a + 1})
        heads.add((a, name))
        if kind in CONTAINERS:
            plain.add(a)
        if kind in CONTAINERS and (m := re.search(spec.extends, re.sub(r"\([^()]*\)", "", lines[a][lines[a].find(name) + len(name) :] if language != "rust" else lines[a]))):
            names = re.findall(r"[A-Za-z_][\w.:]*", re.sub(r"<[^<>]*>|\([^()]*\)|\b(?:public|private|protected|virtual|implements|with)\b", " ", m.group(1)))
            out += [{"row": "ref", "source": x, "name": s, "edge_kind": "extends", "line": a + 1} for s in dict.fromkeys(names)]
        for i in range(a, b + 1):
            owner[i] = x
        stack.append((a, b, x, kind, qualified))
    imports = [re.compile(p) for p in spec.imports]
    for i, line in enumerate(lines):
        got = [m.group(1) for rx in imports for m in rx.finditer(raw[i])] if line.strip() else []
        out += [{"row": "ref", "source": owner[i], "name": s, "edge_kind": "imports", "line": i + 1} for s in dict.fromkeys(got)]
        if not got and i not in plain:
            calls = re.findall(r"(?<![\w.:>])((?:[A-Za-z_$][\w$]*(?:\.|::|->|\?\.))*[A-Za-z_$][\w$]*[!?]?)\s*(?:<[\w, ]*>)?\(", line)
            out += [{"row": "ref", "source": owner[i], "name": re.sub(r"->|\?\.", ".", c), "edge_kind": "calls", "line": i + 1} for c in calls if c not in NO_CALLS and (i, re.split(r"[.:]+", c)[-1]) not in heads]
    return out


#: Files that hold another language between tags: language of the file to how a script block begins.
EMBEDDED = {"vue": r"<script\b([^>]*)>", "svelte": r"<script\b([^>]*)>", "astro": r"\A---(\s*)\n"}


def embedded_rows(path: str, text: str, language: str) -> list[dict]:
    """Rows of a component file: the component itself, its scripts at the places they stand, and the components that its
    markup uses as references."""
    base = path.rsplit("/", 1)[-1]
    name = base.rsplit(".", 1)[0]
    file, comp, n = _id("file", path, base, 1), _id("component", path, name, 1), text.count("\n") + 1
    out = [{"row": "node", "id": file, "kind": "file", "name": base, "qualified_name": path, "start_line": 1, "end_line": n}]
    out += [{"row": "node", "id": comp, "kind": "component", "name": name, "qualified_name": f"{path}::{name}", "start_line": 1, "end_line": n}, {"row": "edge", "source": file, "target": comp, "edge_kind": "contains", "line": 1}]
    markup, close = text, r"\n---" if language == "astro" else r"</script\s*>"
    for m in re.finditer(EMBEDDED[language], text):
        end = re.compile(close).search(text, m.end())
        body = text[m.end() : end.start() if end else len(text)]
        skip = text.count("\n", 0, m.end())
        kind = "typescript" if language == "astro" or re.search(r"lang\s*=\s*['\"]?ts", m.group(1) or "") else "javascript"
        for r in rows_of(path, "\n" * skip + body, kind)[1:]:
            if r["row"] == "error":
                out.append(r)
                continue
            out.append({k: comp if v == file else v for k, v in r.items()})
        markup = markup.replace(text[m.start() : end.end() if end else len(text)], "\n" * text.count("\n", m.start(), end.end() if end else len(text)))
    for m in re.finditer(r"<([A-Z]\w*)", markup):
        out.append({"row": "ref", "source": comp, "name": m.group(1), "edge_kind": "references", "line": markup.count("\n", 0, m.start()) + 1})
    return out


def mapper_rows(path: str, text: str) -> list[dict]:
    """Rows of an XML mapper: a method for each statement, under the type that the mapper's namespace names."""
    base, n = path.rsplit("/", 1)[-1], text.count("\n") + 1
    file = _id("file", path, base, 1)
    out = [{"row": "node", "id": file, "kind": "file", "name": base, "qualified_name": path, "start_line": 1, "end_line": n}]
    space = re.search(r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([\w.]+)", text)
    if not space:
        return out
    short = space.group(1).rsplit(".", 1)[-1]
    for m in re.finditer(r"<(select|insert|update|delete|sql)\b[^>]*?\bid\s*=\s*[\"'](\w+)[\"'][^>]*>([\s\S]*?)</\1>", text):
        line = text.count("\n", 0, m.start()) + 1
        x = _id("method", path, m.group(2), line)
        out.append({"row": "node", "id": x, "kind": "method", "name": m.group(2), "qualified_name": f"{short}::{m.group(2)}", "start_line": line, "end_line": line + m.group(0).count("\n")})
        out.append({"row": "edge", "source": file, "target": x, "edge_kind": "contains", "line": line})
        out += [{"row": "ref", "source": x, "name": f"{short}::{r}", "edge_kind": "references", "line": line} for r in dict.fromkeys(re.findall(r"<include\b[^>]*\brefid\s*=\s*[\"'](\w+)", m.group(3)))]
    return out


def function_values(path: str, text: str, language: str) -> list[dict]:
    """References to functions that are passed or assigned by name instead of being called: `on(x, handler)`, `.run = run`.
    Names that are no function are dropped when they are linked."""
    spec = SPECS[language]
    rows = rows_of(path, text, language)
    spans = [(r["start_line"], r["end_line"], r["id"]) for r in rows if r["row"] == "node"]
    out = []
    for i, line in enumerate(blanked(text, spec.comments).split("\n"), 1):
        found = re.findall(r"[(,]\s*&?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\s*(?=[,)])", line) if re.search(r"\w\s*\(", line) and not any(r["row"] == "node" and r["start_line"] == i and r["kind"] in ("function", "method") for r in rows) else []
        found += re.findall(r"\.\w+\s*=\s*&?([A-Za-z_$][\w$]*)\s*[,;}]", line)
        own = min((e - s, x) for s, e, x in spans if s <= i <= e)[1]
        out += [{"row": "ref", "source": own, "name": n, "edge_kind": "function_ref", "line": i} for n in dict.fromkeys(found) if n not in NO_CALLS and n not in ("true", "false", "null", "None", "nil", "undefined")]
    return out
