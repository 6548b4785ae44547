"""Code units, imports and calls from source text.

One parse of a file gives rows of every kind. Python goes through the standard library's syntax tree;
TypeScript and JavaScript through a scanner of tokens and brackets (no grammar is at hand here), so its
unit ends and import forms follow the text, not a tree. Broken Python falls back to indentation.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = (
    "kind string, path string, language string, name string, start_line int, end_line int, text string, content_hash string, "
    "reason string, specifier string, line int, statement int, position int, local_name string, source_name string"
)
MIN_LINES = 3
BATCH_ROWS, BATCH_CHARS = 8192, 1 << 22  # of what a parse hands back at a time

SCRIPT_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|=>|[A-Za-z_$][\w$]*|\d[\w.]*|\S", re.S)
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
# After these a slash starts a regular expression, not a division.
BEFORE_PATTERN = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => return typeof case in of delete void throw new do else await yield".split()) | {""}
TEMPLATE_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\(")
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
NOT_NAMES = frozenset("if for while switch catch with return function await typeof new delete void in of do else case throw yield super import class extends".split())


class Source:
    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.text = path, language, text
        self.rows: list[dict] = []
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def add(self, kind: str, **fields) -> None:
        self.rows.append({"kind": kind, "path": self.path, "language": self.language, **fields})

    def unit(self, name: str, start: int, end: int, text: str, min_lines: int) -> None:
        if end - start + 1 >= min_lines:
            self.add("unit", name=name, start_line=start, end_line=end, text=text, content_hash="sha256:" + hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())


class Segments:
    """Cuts the text of a syntax tree's node out of its source; lines are found once a file, not once a node."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()
        self.starts = [m.start() for m in LINE.finditer(text)]

    def at(self, line: int, column: int) -> int:
        """The place of a column, which counts UTF-8 bytes."""
        start = self.starts[line - 1]
        return start + (column if self.ascii else len(self.text[start : start + column].encode("utf-8")[:column].decode("utf-8")))

    def of(self, node: ast.AST) -> str:
        return self.text[self.at(node.lineno, node.col_offset) : self.at(node.end_lineno, node.end_col_offset)]


#: Nodes without children, and the contexts and operators, which are no rows and hold none.
LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)


def inner(node: ast.AST) -> list[ast.AST]:
    """The children of a node, in their order, but for leaves."""
    out = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST) and not isinstance(v, LEAVES)]
        elif isinstance(value, ast.AST) and not isinstance(value, LEAVES):
            out.append(value)
    return out


def read_python(src: Source, min_lines: int) -> None:
    try:
        tree = ast.parse(src.text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return read_broken_python(src, min_lines)
    statements = 0
    segments = Segments(src.text)
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name = f"{owner}.{node.name}" if owner else node.name
            src.unit(name, node.lineno, node.end_lineno, segments.of(node), min_lines)
        elif isinstance(node, ast.ClassDef):
            owner = node.name
        elif isinstance(node, ast.ImportFrom):
            statements = node.lineno
            spec = "." * node.level + (node.module or "")
            for i, alias in enumerate(node.names):
                if alias.name == "*":
                    src.add("hole", reason="wildcard_import", specifier=spec, line=node.lineno)
                else:
                    src.add("import", local_name=alias.asname or alias.name, source_name=alias.name, specifier=spec, line=node.lineno, statement=statements, position=i)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                src.add("namespace", specifier=alias.name, line=node.lineno)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            src.add("call", name=node.func.id, line=node.func.lineno)
        stack += [(child, owner) for child in inner(node)]


def read_broken_python(src: Source, min_lines: int) -> None:
    """Functions by indentation; imports and calls line by line."""
    lines = src.text.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(r"(\s*)(?:async\s+)?def\s+(\w+)", line):
            end = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j
            src.unit(m[2], i + 1, end + 1, "\n".join(lines[i : end + 1]).strip(), min_lines)
        elif m := re.match(r"\s*from\s+([.\w]+)\s+import\s+(.+)", line):
            for k, part in enumerate(m[2].strip("() ").split(",")):
                names = part.split()
                if names == ["*"]:
                    src.add("hole", reason="wildcard_import", specifier=m[1], line=i + 1)
                elif names:
                    src.add("import", local_name=names[-1], source_name=names[0], specifier=m[1], line=i + 1, statement=i + 1, position=k)
        elif m := re.match(r"\s*import\s+([.\w]+)", line):
            src.add("namespace", specifier=m[1], line=i + 1)


def template_end(text: str, at: int) -> int:
    """Past the template string that starts at ``at``, with the templates inside its ``${...}`` parts."""
    stack, i, n = ["`"], at + 1, len(text)
    while i < n and stack:
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "`":
            if stack[-1] == "`":
                stack.pop()
            else:
                stack.append("`")
        elif stack[-1] == "`":
            if c == "$" and text[i + 1 : i + 2] == "{":
                stack.append("{")
                i += 1
        elif c == "{":
            stack.append("{")
        elif c == "}":
            stack.pop()
        i += 1
    return min(i, n)


def script_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(token, start, end) without comments; strings, templates and regular expressions are one token each."""
    at, last = 0, ""
    while at >= 0:
        begin, at = at, -1
        for m in SCRIPT_TOKEN.finditer(text, begin):
            token = m[0]
            if token[0] == "/" or token == "`":
                start = m.start()
                if token.startswith(("//", "/*")):
                    continue
                if token == "`":
                    at = template_end(text, start)
                elif last in BEFORE_PATTERN and (p := PATTERN.match(text, start)):
                    at = p.end()
                if at >= 0:  # the token is longer than the match: go on behind it
                    last = text[start:at]
                    yield last, start, at
                    break
            last = token
            yield token, m.start(), m.end()


class Script:
    """Tokens of a script without comments, with the partner of every bracket and the brace around every token."""

    def __init__(self, src: Source):
        found = list(script_tokens(src.text))
        self.src = src
        self.tok, self.at, self.end = map(list, zip(*found)) if found else ([], [], [])
        self.partner: dict[int, int] = {}
        self.brace = [-1] * len(found)
        stack: list[int] = []
        braces: list[int] = []
        for i, t in enumerate(self.tok):
            self.brace[i] = braces[-1] if braces else -1
            if len(t) > 1:
                continue
            if t in "([{":
                stack.append(i)
                if t == "{":
                    braces.append(i)
            elif t in ")]}" and stack:
                j = stack.pop()
                self.partner[j], self.partner[i] = i, j
                if braces and braces[-1] == j:
                    braces.pop()

    def get(self, i: int) -> str:
        return self.tok[i] if 0 <= i < len(self.tok) else ""

    def body_end(self, i: int) -> int:
        """The last token of an arrow's body that starts at i: a block, or up to the end of the expression."""
        if self.get(i) == "{":
            return self.partner.get(i, i)
        last = i
        while i < len(self.tok):
            if self.tok[i] in (";", ",", ")", "]", "}"):
                break
            if self.tok[i] in ("(", "[", "{"):
                i = self.partner.get(i, i)
            elif last < i and self.src.line(self.at[i]) > self.src.line(self.end[last]) and re.match(r"[A-Za-z_$]", self.tok[i]) and re.match(r"[\w$)\]}]", self.tok[last][-1]):
                break
            last = i
            i += 1
        return last

    def units(self, min_lines: int) -> None:
        src, classes = self.src, []
        for i, t in enumerate(self.tok):
            if t == "class" and re.match(r"[A-Za-z_$]", self.get(i + 1)):
                j = i + 1
                while j < len(self.tok) and self.tok[j] != "{":
                    j += 1
                classes.append((j, self.partner.get(j, len(self.tok)), self.tok[i + 1]))

        bodies = {c[0]: c[2] for c in classes}

        def emit(name: str, first: int, last: int) -> None:
            around = self.brace[first]
            while around >= 0 and around not in bodies:
                around = self.brace[around]
            owner = bodies.get(around)
            src.unit(f"{owner}.{name}" if owner else name, src.line(self.at[first]), src.line(self.end[last] - 1), src.text[self.at[first] : self.end[last]], min_lines)

        for i, (t, after) in enumerate(zip(self.tok, [*self.tok[1:], ""])):
            if t == "function":
                j = i + 1 + (self.get(i + 1) == "*")
                named = re.match(r"[A-Za-z_$]", self.get(j)) and self.get(j) or self.bound_name(i)
                body = self.after_parameters(j if self.get(j) == "(" else j + 1)
                first = i - 1 if self.get(i - 1) == "async" else i
                if named and body is not None:
                    emit(named, first, self.partner.get(body, body))
            elif t == "=>":
                first = self.partner.get(i - 1, i - 1) if self.get(i - 1) == ")" else i - 1
                first = self.typed_parameters(i, first)
                if self.get(first - 1) == "async":
                    first -= 1
                if name := self.bound_name(first):
                    emit(name, first, self.body_end(i + 1))
            elif after == "(" and re.match(r"[A-Za-z_$]", t) and t not in NOT_NAMES and self.brace[i] in bodies:
                body = self.after_parameters(i + 1)
                if body is not None and self.get(i - 1) not in (".", "new", "="):
                    first = i
                    while self.get(first - 1) in ("async", "static", "get", "set", "public", "private", "protected", "*", "override", "readonly"):
                        first -= 1
                    emit(t, first, self.partner.get(body, body))

    def typed_parameters(self, arrow: int, first: int) -> int:
        """With a return type between parameters and arrow, the parameters' bracket."""
        if self.get(arrow - 1) == ")" or self.get(arrow - 2) in ("=", "(", ","):
            return first
        for j in range(arrow - 1, max(-1, arrow - 40), -1):
            if self.get(j) in ("=", ";", "{", ","):
                break
            if self.get(j) == ":" and self.get(j - 1) == ")":
                return self.partner.get(j - 1, first)
        return first

    def bound_name(self, first: int) -> str | None:
        """The name that a function expression is bound to: x =, x: or x : type =."""
        if self.get(first - 1) == "async":
            first -= 1
        if self.get(first - 1) == ":" and re.match(r"[A-Za-z_$]", self.get(first - 2)):
            return self.get(first - 2)
        if self.get(first - 1) != "=":
            return None
        j = first - 2
        for k in range(j, max(-1, j - 40), -1):
            if self.get(k) in (";", "{", "}", ",") or self.get(k) in ("const", "let", "var"):
                j = k + 1 if self.get(k + 1) != "=" else j
                break
        else:
            j = max(0, j)
        name = self.get(j)
        return name if re.match(r"[A-Za-z_$]", name) else (self.get(first - 2) if re.match(r"[A-Za-z_$]", self.get(first - 2)) else None)

    def after_parameters(self, i: int) -> int | None:
        """The block after a parameter list at i, past a return type; None where there is none."""
        if self.get(i) == "<":
            while i < len(self.tok) and self.tok[i] != "(":
                i += 1
        if self.get(i) != "(" or i not in self.partner:
            return None
        i = self.partner[i] + 1
        if self.get(i) == ":":
            while i < len(self.tok) and self.tok[i] not in ("{", ";", "}"):
                i += 1
        return i if self.get(i) == "{" else None

    def imports_and_calls(self) -> None:
        src = self.src
        for i, (t, after) in enumerate(zip(self.tok, [*self.tok[1:], ""])):
            if after != "(" and t[0] != "`" and t not in ("import", "export"):
                continue
            line = src.line(self.at[i])
            if t[0] == "`":
                for m in TEMPLATE_CALL.finditer(t) if "${" in t else ():
                    inside = t.rfind("${", 0, m.start()) > t.rfind("}", 0, m.start())
                    if inside and m[1] not in NOT_NAMES:
                        src.add("call", name=m[1], line=src.line(self.at[i] + m.start()))
            elif t in ("import", "require") and self.get(i + 1) == "(" and self.get(i - 1) != ".":
                if self.get(i + 2)[:1] not in ("'", '"') or not self.get(i + 2):
                    src.add("hole", reason="dynamic_import", specifier=t, line=line)
                if t == "require":
                    src.add("call", name=t, line=line)
            elif t == "import" and self.get(i - 1) != ".":
                self.clause(i + 1, line)
            elif t == "export" and self.get(i + 1) == "*":
                j = i + 2
                while j < len(self.tok) and self.tok[j] != "from" and j < i + 6:
                    j += 1
                src.add("hole", reason="star_reexport", specifier=self.get(j + 1).strip("'\"`"), line=line)
            elif t == "export" and self.get(i + 1) == "{":
                close = self.partner.get(i + 1)
                if close and self.get(close + 1) == "from":
                    self.braces(i + 1, self.get(close + 2).strip("'\"`"), line)
            elif self.get(i + 1) == "(" and re.match(r"[A-Za-z_$]", t) and t not in NOT_NAMES and self.get(i - 1) not in (".", "function", "new", "*"):
                if not (self.after_parameters(i + 1) is not None and self.get(i - 1) in ("}", ";", "{", "async", "static", "get", "set", "public", "private", "protected", "")):
                    src.add("call", name=t, line=line)

    def clause(self, i: int, line: int) -> None:
        src, end = self.src, i
        while end < len(self.tok) and self.tok[end] not in ("from", ";") and self.tok[end][:1] not in ("'", '"'):
            end += 1
        if self.get(end) != "from":
            return
        spec = self.get(end + 1).strip("'\"`")
        if self.get(i) == "type":
            i += 1
        while i < end:
            if self.tok[i] == "*":
                src.add("namespace", specifier=spec, line=line)
                return
            if self.tok[i] == "{":
                self.braces(i, spec, line)
                i = self.partner.get(i, end)
            elif re.match(r"[A-Za-z_$]", self.tok[i]):
                src.add("import", local_name=self.tok[i], source_name="default", specifier=spec, line=line, statement=line, position=0)
            i += 1

    def braces(self, i: int, spec: str, line: int) -> None:
        close, parts, position = self.partner.get(i, i), [], 0
        for j in range(i + 1, close + 1):
            if self.tok[j] in (",", "}"):
                parts = parts[1:] if len(parts) > 1 and parts[0] == "type" else parts
                if parts:
                    self.src.add("import", local_name=parts[-1], source_name=parts[0], specifier=spec, line=line, statement=line, position=position)
                    position += 1
                parts = []
            else:
                parts.append(self.tok[j])


def rows_of(path: str, language: str, text: str, min_lines: int = MIN_LINES) -> list[dict]:
    """All rows of a file; a file that cannot be read at all gives none."""
    src = Source(path, language, text or "")
    if language == "python":
        read_python(src, min_lines)
    else:
        script = Script(src)
        script.units(min_lines)
        script.imports_and_calls()
    units = sorted((r for r in src.rows if r["kind"] == "unit"), key=lambda r: (r["start_line"], r["end_line"], r["name"]))
    return units + [r for r in src.rows if r["kind"] != "unit"]


def extracted(files: DataFrame, min_lines: int = MIN_LINES, texts: bool = True) -> DataFrame:
    """Rows of every kind of all files (path, source, language), one parse a file; units without ``texts`` have a null one.

    Rows of many small files leave in one batch, those of a large file in batches of their own.
    """

    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ROW.split(", ")])
    names = [n for n in schema.names if texts or n != "text"]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r.get(f.name) for r in rows] if f.name in names else [None] * len(rows), f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, source, language in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "language"))):
                held += rows_of(path, language, source, min_lines)
                size += len(source or "")
                if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                    for at in range(0, len(held), BATCH_ROWS):
                        yield packed(held[at : at + BATCH_ROWS])
                    held, size = [], 0
        if held:
            yield packed(held)

    return files.select("path", "source", "language").mapInArrow(run, ROW)


def kinds(rows: DataFrame) -> dict[str, DataFrame]:
    """The graph's inputs from extracted rows."""

    def of(kind: str, *columns: str) -> DataFrame:
        return rows.where(F.col("kind") == kind).select(*columns)

    return {
        "units": of("unit", "path", "language", "name", "start_line", "end_line", "text", "content_hash"),
        "imports": of("import", "path", "statement", "position", "local_name", "source_name", "specifier", "line", "language"),
        "namespaces": of("namespace", "path", "specifier", "line", "language"),
        "holes": of("hole", "path", "reason", "specifier", "line"),
        "calls": of("call", "path", "name", "line"),
    }
