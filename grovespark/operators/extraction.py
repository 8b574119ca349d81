"""From files to rows: a parser plug-in per language behind one mapInPandas, and edges from literals that pair up."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.operators import declarations

ROW = "path string, row string, id string, kind string, name string, qualified_name string, start_line int, end_line int, docstring string, source string, target string, edge_kind string, line int, message string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _id(kind: str, path: str, name: str, line: int) -> str:
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


def python_rows(path: str, text: str) -> list[dict]:
    """Nodes, edges, references and errors of a Python file, by the language's own parser."""
    file = _id("file", path, path.rsplit("/", 1)[-1], 1)
    out = [{"row": "node", "id": file, "kind": "file", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "start_line": 1, "end_line": text.count("\n") + 1}]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [*out, {"row": "error", "line": getattr(e, "lineno", None), "message": str(e)}]
    stack: list[tuple[ast.AST, str, str, bool]] = [(n, file, "", False) for n in tree.body]
    while stack:
        n, parent, scope, in_class = stack.pop()
        inner, now, cls = parent, scope, in_class
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "method" if in_class else "function"
            now, cls = f"{scope}.{n.name}".lstrip("."), kind == "class"
            inner = _id(kind, path, n.name, n.lineno)
            out.append({"row": "node", "id": inner, "kind": kind, "name": n.name, "qualified_name": f"{path}::{now}", "start_line": n.lineno, "end_line": n.end_lineno, "docstring": ast.get_docstring(n)})
            out.append({"row": "edge", "source": parent, "target": inner, "edge_kind": "contains", "line": n.lineno})
            out += [{"row": "ref", "source": inner, "name": ast.unparse(d.func if isinstance(d, ast.Call) else d), "edge_kind": "decorates", "line": n.lineno} for d in n.decorator_list]
            if kind == "class":
                out += [{"row": "ref", "source": inner, "name": ast.unparse(b), "edge_kind": "extends", "line": n.lineno} for b in n.bases]
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            out += [{"row": "ref", "source": parent, "name": a.name, "edge_kind": "imports", "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            out.append({"row": "ref", "source": parent, "name": ast.unparse(n.func), "edge_kind": "calls", "line": n.lineno})
        stack += [(c, inner, now, cls if inner != parent else in_class and not isinstance(n, ast.expr)) for c in ast.iter_child_nodes(n)]
    return out


#: Parsers by language; register more with the same rows.
PARSERS: dict[str, Callable[[str, str], list[dict]]] = {k: partial(declarations.rows_of, language=k) for k in declarations.SPECS} | {k: partial(declarations.embedded_rows, language=k) for k in declarations.EMBEDDED} | {"python": python_rows, "mybatis": declarations.mapper_rows}


def extract(files: DataFrame) -> DataFrame:
    """Rows of all files (path, language, content) whose language has a parser. A file that does not parse gives its file
    node and an error; null contents count as empty; a file's rows depend on nothing but the file."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p} | r for p, lang, t in zip(b["path"], b["language"], b["content"]) for r in parsers[lang](p, t or "")]
            yield pd.DataFrame(rows, columns=COLUMNS).astype(object).where(lambda x: x.notna(), None)

    return files.where(F.col("language").isin(list(parsers))).select("path", "language", "content").mapInPandas(run, ROW)


def literal_channels(code: DataFrame, register: str, dispatch: str, most: int = 6) -> DataFrame:
    """(source, target, channel): pieces of code (id, code) that dispatch a literal, to those that register it: routes,
    events, intents. Each pattern's first group is the literal; literals with more than `most` sides are skipped."""
    from grovespark.operators.linking import event_channels

    found = lambda rx: code.select("id", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(rx), 1))).alias("channel"))
    return event_channels(found(register), found(dispatch), most)


def dynamic_sites(code: DataFrame) -> DataFrame:
    """(id, form): calls whose target only shows at run time."""
    forms = {"reflection": r"\b(getattr|getMethod|invoke|forName)\s*\(", "computed": r"\w\[[^\]\d'\"][^\]]*\]\s*\(", "dispatch table": r"\b(handlers|registry|routes|dispatch)\s*[\[.]\s*\w+", "event": r"\.(emit|on|publish|subscribe)\s*\("}
    return code.select("id", F.explode(F.array_compact(F.array(*[F.when(F.col("code").rlike(rx), f) for f, rx in forms.items()]))).alias("form"))
