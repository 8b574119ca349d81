"""A tolerant parser for source text: recursive descent over statements, precedence climbing over expressions, panic-mode
recovery. It has the statements' keywords of each language and knows which of them put words side by side without an
operator; what only another language writes that way is reported, as are text that is cut off, merge leftovers and
brackets that do not match. All errors are kept, the first is the cause."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Families of languages by how blocks are written.
INDENT = ["python"]
ENDS = ["ruby", "lua", "luau"]
#: Names that documents and tables use for languages.
ALIASES = {"py": "python", "rb": "ruby", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "arkts": "typescript", "kt": "kotlin", "rs": "rust", "cs": "csharp", "c++": "cpp", "objc": "c", "golang": "go", "sh": "shell", "bash": "shell"}
#: Words of each language that may stand beside another word without an operator between them.
_SCRIPT = "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield as"
WORDS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT + " abstract accessor any asserts boolean declare enum implements infer interface is keyof module namespace never number object override private protected public readonly require satisfies string symbol type unique unknown struct",
    "python": "and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try type while with yield print",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type union unsafe use where while",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public record return sealed short static strictfp super switch synchronized this throw throws transient try var void volatile while permits non",
    "csharp": "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern finally fixed float for foreach get if implicit in init int interface internal is lock long nameof namespace new object operator out override params partial private protected public readonly record ref return sbyte sealed set short sizeof static string struct switch this throw try typeof uint ulong unsafe using value var virtual void volatile when where while yield select from orderby",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "cpp": "auto bool break case catch char class concept const consteval constexpr continue co_await co_return co_yield decltype default delete do double else enum explicit export extern final float for friend goto if inline int long mutable namespace new noexcept operator override private protected public requires return short signed sizeof static struct switch template this throw try typedef typename union unsigned using virtual void volatile while",
    "dart": "abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export extends extension external factory final finally for get hide if implements import in interface is late library mixin new on operator part required return sealed set show static super switch this throw try typedef var void when while with yield",
    "kotlin": "abstract actual annotation as break by catch class companion const constructor continue crossinline data do else enum expect external final finally for fun get if import in infix init inline inner interface internal is lateinit noinline null object open operator out override package private protected public reified return sealed set suspend tailrec this throw try typealias val value var vararg when where while",
    "swift": "actor any as associatedtype async await break case catch class continue convenience default defer deinit do else enum extension fallthrough fileprivate final for func get guard if import in indirect infix init inout internal is lazy let mutating nonisolated open operator optional override postfix precedencegroup prefix private protocol public repeat required rethrows return self set some static struct subscript super switch throw throws try typealias unowned var weak where while willSet didSet",
    "php": "abstract and array as break case catch class clone const continue declare default do echo else elseif enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface match namespace new or print private protected public readonly require require_once return static switch throw trait try use var while xor yield from",
    "lua": "and break do else elseif end false for function goto if in local nil not or repeat return then true until while",
    "luau": "and break continue do else elseif end export false for function if in local nil not or repeat return then true type until while",
}
#: Words that may come after a name, in any of these languages.
AFTER = frozenset("as and by import do else end extends for from if implements in instanceof interface is not of or satisfies struct then where while with chan func map".split())
#: Languages that declare `Type name`; those that call without brackets or put a word between operands write words side by
#: side anywhere.
TYPED, FREE = ["java", "csharp", "c", "cpp", "dart"], ["ruby", "kotlin", "scala", "shell", "swift", "vue", "svelte"]
#: Binding strength of binary operators, weakest first.
LEVELS = [["=", "+=", "-=", "*=", "/=", ":=", "=>", "->", "<-"], ["?", ":"], ["||", "or", "??"], ["&&", "and"], ["==", "!=", "===", "!==", "<", ">", "<=", ">=", "in", "is", "instanceof"], ["|", "^", "&"], ["<<", ">>"], ["+", "-", ".."], ["*", "/", "%", "//"], ["**"]]
POWER = {op: k for k, ops in enumerate(LEVELS) for op in ops}
PREFIX = ["!", "-", "+", "~", "*", "&", "not", "await", "new", "typeof", "return", "throw", "yield", "raise", "delete", "@", "#", "..."]
OPEN = {"(": ")", "[": "]", "{": "}"}
#: How comments begin, by language; preprocessor lines and attributes of C and Rust are read as comments too.
_COMMENT = {"slash": r"/\*[\s\S]*?\*/|//[^\n]*", "hash": r"#(?![\[!])[^\n]*", "dash": r"--\[\[[\s\S]*?\]\]|--[^\n]*", "tag": r"<\?(?:php|=)?|\?>"}
_STYLES = {"python": ["hash"], "ruby": ["hash"], "shell": ["hash"], "lua": ["dash"], "luau": ["dash"], "php": ["slash", "hash", "tag"]}


def _pattern(styles: list[str]) -> re.Pattern:
    opened = r"|(?P<open_comment>/\*[\s\S]*)" if "slash" in styles else ""
    return re.compile(
        r"(?P<mark>(?m:^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t].*)?$))|(?P<comment>" + "|".join(_COMMENT[x] for x in styles) + ")" + opened
        + r"|(?P<string>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<open_string>\"[^\n]*|`[\s\S]*)"
        r"|(?P<number>\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<newline>\n[ \t]*)|(?P<space>[ \t\r\f\v]+)|(?P<op>\*\*|===|!==|==|!=|<=|>=|=>|->|<-|:=|\+=|-=|\*=|/=|&&|\|\||\?\?|\.\.\.|\.\.|::|<<|>>|//|\+\+|--|[^\w\s])"
    )


_TOKENS = {"": _pattern(["slash", "hash"])} | {k: _pattern(v) for k, v in _STYLES.items()}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int


def tokenize(text: str, language: str) -> list[Token]:
    out, line, start = [], 1, 0
    for m in _TOKENS.get(language, _TOKENS[""]).finditer(text):
        kind, s = m.lastgroup, m.group(0)
        if kind not in ("space", "comment"):
            out.append(Token(kind, s, line, m.start() - start))
        n = s.count("\n")
        if n:
            line, start = line + n, m.start() + s.rfind("\n") + 1
    out.append(Token("end", "", line, 0))
    return out


class Parser:
    def __init__(self, text: str, language: str):
        language = ALIASES.get(language, language)
        self.language = language
        self.family = "indent" if language in INDENT else "ends" if language in ENDS else "braces"
        self.words = frozenset(WORDS[language].split()) if language in WORDS and language not in FREE else None
        self.toks, self.i, self.errors, self.depth, self.beside, self.round = tokenize(text, language), 0, [], 0, 0, 0

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def fail(self, cause: str, message: str, tok: Token | None = None) -> None:
        t = tok or self.tok
        self.errors.append({"line": t.line, "col": t.col, "cause": cause, "message": message})

    def next(self) -> Token:
        t = self.tok
        self.i = min(self.i + 1, len(self.toks) - 1)
        return t

    def panic(self) -> None:
        """Skip to where a statement may begin."""
        while self.tok.kind not in ("end", "newline") and self.tok.text not in (";", "}"):
            self.next()
        if self.tok.text == ";" or self.tok.kind == "newline":
            self.next()

    def program(self) -> list[dict]:
        while self.tok.kind != "end":
            at = self.i
            self.statement()
            if self.i == at:
                self.fail("foreign", f"unexpected {self.tok.text!r}")
                self.next()
                self.panic()
        if self.family == "ends":
            self.balance_ends()
        return self.errors

    def balance_ends(self) -> None:
        """Blocks that close with `end`: openers at the head of a line, or `do` and `function` anywhere."""
        head, stack = True, []
        for t in self.toks:
            if t.kind == "newline" or t.text == ";":
                head = True
                continue
            if t.kind == "word":
                if t.text in ("do", "function") or head and t.text in ("def", "class", "module", "begin", "case", "unless", "if", "while", "until", "for", "repeat"):
                    if not (t.text == "do" and stack and stack[-1].text in ("while", "until", "for") and stack[-1].line == t.line):
                        stack.append(t)
                elif t.text == "end" or t.text == "until" and stack and stack[-1].text == "repeat":
                    if stack:
                        stack.pop()
                    else:
                        self.fail("foreign", "'end' without a block", t)
            head = False
        if stack:
            self.fail("cut", f"block opened at line {stack[-1].line} never ends", stack[-1])

    def stray(self, before: Token, t: Token) -> bool:
        """True if two words side by side, outside of round and square brackets, are nothing that the language writes.
        Words that may be followed or preceded by another, texts, and one declared name after a type are."""
        if self.words is None or self.inside or t.kind != "word" or before.kind != "word" or before.line != t.line:
            return False
        if before.text in self.words:
            return False
        if t.text in self.words:
            return self.language not in TYPED and t.text not in AFTER
        self.beside += 1
        return not (self.language in TYPED and self.beside <= 2 or self.language == "go" and self.depth)

    @property
    def inside(self) -> bool:
        return bool(self.round)

    def statement(self) -> None:
        t, self.beside = self.tok, 0
        if t.kind == "newline" or t.text in (";", ","):
            self.next()
        elif t.kind == "mark":
            self.fail("merge", f"conflict marker {t.text[:7]!r}")
            self.next()
        elif t.text == "{":
            self.block()
        elif t.text in (")", "]", "}"):
            self.fail("foreign", f"unexpected {t.text!r}")
            self.next()
        else:
            self.expression(0)

    def block(self) -> None:
        opener = self.next()
        if self.depth > 200:
            self.fail("foreign", "nested too deeply")
            self.panic()
            return
        self.depth += 1
        outer, self.round = self.round, 0 if opener.text == "{" else 1
        while self.tok.text != OPEN[opener.text]:
            if self.tok.kind == "end":
                self.fail("cut", f"expected {OPEN[opener.text]!r} for line {opener.line}, found <EOF>", opener)
                break
            if self.tok.text in (")", "]", "}"):
                self.fail("foreign", f"expected {OPEN[opener.text]!r}, found {self.tok.text!r}")
                break
            at = self.i
            self.statement()
            if self.i == at:
                self.next()
        else:
            self.next()
        self.depth, self.round = self.depth - 1, outer

    def expression(self, power: int) -> None:
        if not self.primary():
            return
        while True:
            t = self.tok
            op = t.text if t.kind in ("op", "word") else ""
            if op in POWER and POWER[op] >= power:
                self.next()
                while self.tok.kind == "newline":
                    self.next()
                if self.tok.kind == "end" and op not in (":", "?", "*", "&"):
                    self.fail("cut", f"expression ends after {op!r}", t)
                    return
                self.expression(POWER[op] + (0 if POWER[op] == 0 or op == "**" else 1))
            elif power == 0 and t.kind in ("word", "number", "string", "open_string"):
                if self.stray(self.toks[self.i - 1], t):
                    self.fail("foreign", f"unexpected {t.text!r} after {self.toks[self.i - 1].text!r}")
                    self.panic()
                    return
                self.primary()  # juxtaposition: declarations, keywords, command calls
            elif power == 0 and t.text in ("@", "$", "!", "~", "#", "\\", "::", "'", "++", "--"):
                self.next()
            else:
                return

    def primary(self) -> bool:
        while self.tok.text in PREFIX and self.tok.kind in ("op", "word") or self.tok.text in ("++", "--", "$", "::"):
            self.next()
        t = self.tok
        if t.kind in ("word", "number", "string"):
            self.next()
        elif t.kind == "open_string":
            self.fail("cut", f"string opened at {t.line}:{t.col} never ends")
            self.next()
        elif t.kind == "open_comment":
            self.fail("cut", f"comment opened at line {t.line} never ends")
            self.next()
        elif t.text in OPEN:
            self.block()
        else:
            return False
        while True:
            t = self.tok
            if t.text in OPEN:
                self.block()
            elif t.text in (".", "?.", "::", "->") and t.kind == "op":
                self.next()
                if self.tok.kind in ("word", "number"):
                    self.next()
            elif t.text in ("++", "--", "!", "?") and self.toks[self.i + 1 if self.i + 1 < len(self.toks) else self.i].text in (")", ";", ".", ",", "]"):
                self.next()
            else:
                return True


def parse(text: str | None, language: str | None) -> list[dict]:
    """Errors of a text, in order of place: line, col, cause ('cut', 'merge', 'foreign') and message. Null, empty and blank
    texts have none; languages of no known family are read as one with braces."""
    if not text or not text.strip():
        return []
    return sorted(Parser(text, (language or "").lower()).program(), key=lambda e: (e["line"], e["col"]))


_ERRORS = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("cause", T.StringType()), T.StructField("message", T.StringType())]))


@F.pandas_udf(_ERRORS)
def _parse_all(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, language in batches:
        yield pd.Series([parse(t, x) for t, x in zip(text, language)], dtype=object)


def errors_of(text: Column, language: Column) -> Column:
    return _parse_all(text, language)


def code_blocks(docs, key: str = "doc_id", text: str = "text"):
    """(key, language, code) of each fenced block of a document. A fence that is never closed runs to the end."""
    b = docs.where(F.col(text).contains("```")).select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(?:^|\n)```([\w+#-]*)[^\n]*\n(.*?)(?:\n```|\z)"), 0)).alias("b"))
    return b.select(key, F.lower(F.regexp_extract("b", r"```([\w+#-]*)", 1)).alias("language"), F.regexp_replace(F.regexp_replace("b", r"^\s*```[^\n]*\n", ""), r"\n```\s*$", "").alias("code"))
