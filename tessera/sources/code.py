"""Symbols and relations of TypeScript and JavaScript files, and of exported C# analyses.

A file is one row and is parsed by itself; a file that cannot be parsed becomes a row with an error.
The scanner reads tokens, not a grammar: it knows comments, strings, templates, regular expressions,
brackets, class and interface bodies, functions, arrow functions in variables, heritage, imports and
calls. Symbols in namespaces and blocks count, those within functions do not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import suffix
from tessera.schema import CONFIDENCE, CSHARP_RESULT, PARSED

_TOKEN = re.compile(r"""
    (?P<space>\s+) | (?P<comment>//[^\n]*|/\*.*?\*/) | (?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
  | (?P<word>[A-Za-z_$][\w$]*) | (?P<arrow>=>) | (?P<mark>[{}()\[\];,.=:<>?@]) | (?P<other>[^\s\w])|(?P<number>\d[\w.]*)""", re.X | re.S)
# Words that are followed by parentheses or a block without being names.
_KEYWORDS = frozenset("if for while switch catch return function new typeof await do else try finally throw delete void in of instanceof case default yield super import export const let var class interface extends implements async static".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override async get set declare".split())
_PAIRS = {"(": ")", "{": "}", "[": "]"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words after which a slash opens a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof await yield".split())


def _template_end(text: str, at: int) -> int:
    """The place behind the template literal that opens at `at`, whatever its substitutions hold."""
    i, depths = at + 1, [0]  # one entry for each template around; braces open in its substitution
    while i < len(text):
        c = text[i]
        if depths[-1] == 0:  # in the template's text
            if c == "\\":
                i += 1
            elif c == "`":
                depths.pop()
                if not depths:
                    return i + 1
            elif text.startswith("${", i):
                depths[-1], i = 1, i + 1
        elif c == "`":
            depths.append(0)
        elif m := _TOKEN.match(text, i):
            if m.lastgroup in ("comment", "string"):
                i = m.end() - 1
            else:
                depths[-1] += (c == "{") - (c == "}")
        i += 1
    return len(text)


def _scanned(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of the tokens and comments of a file."""
    out, i, last = [], 0, None
    while i < len(text):
        if text[i] == "`":
            kind, end = "string", _template_end(text, i)
        elif text[i] == "/" and (last is None or last[1] in _BEFORE_REGEX or last[0] not in ("word", "number", "string", "regex") and last[1] not in (")", "]")) and (m := _REGEX.match(text, i)):
            kind, end = "regex", m.end()
        elif m := _TOKEN.match(text, i):
            kind, end = m.lastgroup, m.end()
        else:
            i += 1
            continue
        if kind != "space":
            out.append((kind, text[i:end], i, end))
            last = out[-1] if kind != "comment" else last
        i = end
    return out


class _File:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        every = _scanned(text)
        self.comments = [x for x in every if x[0] == "comment"]
        self.comment_ends = [x[3] for x in self.comments]
        self.line_ends = [m.start() for m in re.finditer("\n", text)]
        self.toks = [x for x in every if x[0] != "comment"]
        self.close = self._brackets()
        self.entities: list[dict] = []
        self.relations: list[dict] = []
        self.language = "typescript" if re.search(r"\.[mc]?tsx?$", path) else "javascript"

    def _brackets(self) -> dict[int, int]:
        stack, close = [], {}
        for i, (_, v, _, _) in enumerate(self.toks):
            if v in _PAIRS:
                stack.append(i)
            elif v in _PAIRS.values() and stack and _PAIRS[self.toks[stack[-1]][1]] == v:
                close[stack.pop()] = i
        return close

    def value(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def line(self, at: int) -> int:
        return bisect_left(self.line_ends, at) + 1

    def docstring(self, start: int) -> str | None:
        """The nearest /** comment with nothing but comments and white space between it and the symbol."""
        at = start
        for i in range(bisect_right(self.comment_ends, start) - 1, -1, -1):
            _, v, a, b = self.comments[i]
            if re.sub(r"(?://[^\n]*|/\*.*?\*/|\s)", "", self.text[b:at], flags=re.S):
                return None
            if v.startswith("/**"):
                return v
            at = a
        return None

    def add(self, kind: str, name: str, first: int, last: int, signature: str | None, parent: str | None = None) -> str:
        a, b = self.toks[first][2], self.toks[last][3]
        qn = f"{self.path}::{parent}.{name}" if parent else f"{self.path}::{name}"
        self.entities.append({
            "qualified_name": qn, "name": name, "symbol_type": kind, "file_path": self.path, "line_start": self.line(a), "line_end": self.line(b), "content": self.text[a:b],
            "signature": signature, "docstring": self.docstring(a), "parent_class": parent, "language": self.language})
        return qn

    def relate(self, source: str, name: str, kind: str, confidence: float) -> None:
        self.relations.append({"from_qn": source, "to_name": name, "rel_type": kind, "confidence": confidence, "resolution_type": "heuristic", "to_qn": None})

    def source(self, a: int, b: int) -> str:
        """Text of the tokens a to b - 1 with single spaces."""
        return re.sub(r"\s+", " ", self.text[self.toks[a][2] : self.toks[b - 1][3]]) if b > a else ""

    def calls(self, qn: str, first: int, last: int) -> None:
        """Calls within tokens first to last, without those in functions nested there."""
        i = first
        while i < last:
            v = self.value(i)
            if v == "function":
                while i < last and self.value(i) != "{":
                    i += 1
                i = self.close.get(i, last) + 1
                continue
            if v == "=>":
                i += 1
                if self.value(i) != "{":
                    while i < last and self.value(i) not in (";", ",", ")", "}", "]"):
                        i = self.close.get(i, i) + 1
                    continue
                i = self.close.get(i, i) + 1
                continue
            if self.toks[i][0] == "word" and self.value(i + 1) == "(" and v not in _KEYWORDS and v != "this" and self.value(i - 1) not in ("new", "function"):
                member = self.value(i - 1) == "."
                self.relate(qn, v, "CALLS", CONFIDENCE["call_member"] if member else CONFIDENCE["call_name"])
            i += 1

    def past_type_parameters(self, i: int) -> int:
        """The token behind `<...>` if that opens at token i, else i."""
        if self.value(i) != "<":
            return i
        depth, at = 1, i + 1
        while at < len(self.toks) and depth:
            if self.value(at) in (";", "{", "}") and at not in self.close:
                return i
            depth += (self.value(at) == "<") - self.value(at).count(">") * (self.value(at) != "=>")
            at = self.close.get(at, at) + 1
        return at if depth <= 0 else i

    def function(self, kind: str, name: str, first: int, opened: int, parent: str | None = None) -> int:
        """A function whose parameters open at token `opened`; the token after its body or signature."""
        end = self.close.get(opened, opened)
        i = end + 1
        while i < len(self.toks) and self.value(i) not in ("{", ";", "}"):
            i += 1
        body = i if self.value(i) == "{" else None
        last = self.close.get(i, i) if body is not None else max(end, i - (self.value(i) == "}"))
        returns = self.source(end + 1, i) if i > end + 1 else ""
        qn = self.add(kind, name, first, last, " ".join(x for x in (name, self.source(opened, end + 1), returns) if x), parent)
        if body is not None:
            self.calls(qn, body + 1, last)
        return last + 1

    def heritage(self, qn: str, i: int, body: int) -> None:
        kind = None
        while i < body:
            v = self.value(i)
            if v in ("extends", "implements"):
                kind = "EXTENDS" if v == "extends" else "IMPLEMENTS"
            elif v == "<":
                depth = 1
                while depth and i + 1 < body:
                    i += 1
                    depth += (self.value(i) == "<") - (self.value(i) == ">")
            elif kind and self.toks[i][0] == "word" and self.value(i + 1) != ".":
                self.relate(qn, v, kind, CONFIDENCE["heritage"])
            i += 1

    def type_body(self, kind: str, name: str, first: int, at: int) -> int:
        body = at
        while body < len(self.toks) and self.value(body) != "{":
            body += 1
        end = self.close.get(body, len(self.toks) - 1)
        start = self.toks[first][2]
        stop = self.text.find("\n", start)
        qn = self.add(kind, name, first, end, self.text[start : stop if stop >= 0 else len(self.text)].strip())
        if kind == "class":
            self.heritage(qn, at, body)
        i = body + 1
        while i < end:
            start = i
            while self.value(i) in _MODIFIERS and self.value(i + 1) not in ("(", "=", ":", ";"):
                i += 1
            word = self.toks[i][0] == "word"
            opened = self.past_type_parameters(i + 1 + (self.value(i + 1) in ("?", "!")))
            if word and self.value(opened) == "(" and self.value(i) not in _KEYWORDS:
                i = self.function("method", self.value(i), start, opened, name)
                continue
            while i < end and self.value(i) not in (";", "{", "(", "["):
                if self.value(i) in ("}",):
                    break
                i += 1
            i = self.close.get(i, i) + 1
        return end + 1

    def ends(self, at: int) -> bool:
        """Whether a line ends behind token `at` that closes its statement."""
        if at + 1 >= len(self.toks) or "\n" not in self.text[self.toks[at][3] : self.toks[at + 1][2]]:
            return False
        return self.value(at + 1) not in (".", "?", ":", "=>", "=", ",", "|", "&") and self.value(at) not in ("=", "=>", ".", "?", ":", ",", "|", "&")

    def variables(self, first: int) -> int:
        """const, let and var: arrow functions and function expressions in them are functions."""
        i = first + 1
        while i < len(self.toks) and self.toks[i][0] == "word":
            name_at = i
            while i < len(self.toks) and self.value(i) not in ("=", ";", ",", ")", "]", "}"):
                after = self.close.get(i, i)
                i = after + 1
                if self.ends(after):
                    return i
            if self.value(i) == "=":
                at = i + 1 + (self.value(i + 1) == "async")
                generic = self.past_type_parameters(at)
                opened = generic if self.value(generic) == "(" else at
                if self.value(at) == "function":
                    opened = at + 1 + (self.toks[at + 1][0] == "word")
                    self.function("function", self.value(name_at), name_at, opened)
                elif self.value(opened) == "(" or (self.toks[at][0] == "word" and self.value(at + 1) == "=>"):
                    arrow = self.close.get(opened, opened) + 1
                    while arrow < len(self.toks) and self.value(arrow) not in ("=>", ";", ",", "{"):
                        arrow += 1
                    if self.value(arrow) == "=>":
                        last = self.close.get(arrow + 1, arrow + 1)
                        while self.value(arrow + 1) != "{" and last + 1 < len(self.toks) and self.value(last + 1) not in (";", ",") and "\n" not in self.text[self.toks[last][3] : self.toks[last + 1][2]]:
                            last = self.close.get(last + 1, last + 1)
                        qn = self.add("function", self.value(name_at), name_at, last, self.source(opened, arrow))
                        self.calls(qn, arrow + 1, last + 1)
            while i < len(self.toks) and self.value(i) not in (";", ",", ")", "]", "}"):
                after = self.close.get(i, i)
                i = after + 1
                if self.ends(after):
                    return i
            if self.value(i) != ",":
                return i + (self.value(i) == ";")
            i += 1
        return i

    def parse(self) -> None:
        self.entities.append({
            "qualified_name": self.path, "name": self.path.rsplit("/", 1)[-1], "symbol_type": "module", "file_path": self.path, "line_start": 1, "line_end": self.text.count("\n") + 1,
            "content": "", "signature": None, "docstring": None, "parent_class": None, "language": self.language})
        for i, (kind, v, _, _) in enumerate(self.toks):
            if kind == "string" and (self.value(i - 1) == "from" or self.value(i - 1) == "import"):
                self.relate(self.path, v.strip("'\"`"), "IMPORTS", CONFIDENCE["import"])
        i = 0
        while i < len(self.toks):
            v, start = self.value(i), i
            while self.value(i) in ("export", "default", "async", "declare", "abstract"):
                i += 1
            v = self.value(i)
            if v == "class" and self.toks[i + 1][0] == "word":
                i = self.type_body("class", self.value(i + 1), start, i + 2)
            elif v == "interface" and i + 1 < len(self.toks) and self.toks[i + 1][0] == "word":
                i = self.type_body("interface", self.value(i + 1), start, i + 2)
            elif v == "function" and i + 1 < len(self.toks) and self.toks[i + 1][0] == "word":
                opened = i + 2
                while opened < len(self.toks) and self.value(opened) != "(":
                    opened += 1
                i = self.function("function", self.value(i + 1), start, opened)
            elif v in ("const", "let", "var"):
                i = self.variables(i)
            else:
                i = max(i, start) + 1


def parse_file(path: str, text: str) -> dict:
    out = {"file_path": path, "language": None, "entities": [], "relations": [], "error": None}
    if not re.search(r"\.(ts|tsx|js|jsx|mts|cts)$", path):
        return out | {"error": f"unsupported file type: {path}"}
    try:
        f = _File(path, text or "")
        f.parse()
    except (IndexError, ValueError, RecursionError) as e:
        return out | {"error": f"{type(e).__name__}: {e}"[:2000]}
    return out | {"language": f.language, "entities": f.entities, "relations": f.relations}


def parse_sources(files: DataFrame) -> DataFrame:
    """(file_path, content) of files as (file_path, language, entities, relations, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_file(p, c) for p, c in zip(batch["file_path"], batch["content"], strict=True)], columns=[f.name for f in PARSED])

    return files.select("file_path", "content").mapInPandas(run, PARSED)


def entities_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.posexplode("entities").alias("ordinal", "e")).select("ordinal", "e.*")


def relations_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.posexplode("relations").alias("ordinal", "r")).select("file_path", "ordinal", "r.*")


def csharp_results(exported: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of exported C# analyses, a JSON result in each row.

    A relation belongs to the file of its source, the last file that defines it; without one it is
    dropped. Unknown entity types are dropped. Each file gets a module of its own.
    """
    results = exported.select(F.from_json(column, CSHARP_RESULT).alias("r"))
    e = results.select(F.explode("r.entities").alias("e")).select("e.*").filter(F.col("type").isin("class", "interface", "method"))
    members = e.select(
        "qualified_name", "name", F.col("type").alias("symbol_type"), "file_path", "line_start", "line_end", "content", "signature", "docstring",
        F.when(F.col("type") == "method", F.col("class_name")).alias("parent_class"), F.lit("csharp").alias("language"))
    last = members.groupBy("file_path").agg(F.max("line_end").alias("line_end"))
    modules = last.select(
        F.col("file_path").alias("qualified_name"), F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit("module").alias("symbol_type"), "file_path", F.lit(1).alias("line_start"), "line_end",
        F.lit("").alias("content"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("parent_class"), F.lit("csharp").alias("language"))
    owner = members.groupBy(F.col("qualified_name").alias("from_qn")).agg(F.max("file_path").alias("file_path"))
    r = results.select(F.explode("r.relations").alias("x")).select("x.*")
    relations = r.select(
        F.col("from").alias("from_qn"), F.substring_index("to", ".", -1).alias("to_name"), F.col("type").alias("rel_type"), F.coalesce("confidence", F.lit(CONFIDENCE["semantic"])).alias("confidence"),
        F.coalesce("resolution_type", F.lit("semantic")).alias("resolution_type"), F.col("to").alias("to_qn"))
    return modules.unionByName(members), relations.join(owner, "from_qn")


def routed(files: DataFrame) -> DataFrame:
    """Files with the reader that takes them."""
    s = suffix(F.col("file_path"))
    return files.withColumn("reader", F.when(s.isin("ts", "tsx", "js", "jsx", "mts", "cts"), "scanner").when(s == "cs", "exported").when(s.isin("md", "markdown", "txt", "html"), "documents").otherwise("unsupported"))
