"""Symbols and edges out of source texts, as rows.

Python is read with the interpreter's own parser; other languages by their declarations, calls and balanced
brackets in the text without comments and strings. A file that cannot be parsed reports an error; of a Python file the declarations
and imports are then found by lines and indentation. Each text is one row in and its symbols and edges are rows out, so Spark spreads the work by file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.functions.languages import EXTENSIONS
from arborine.sources.tables import for_all_cores

#: Python's built-in names, which are no symbols of a repository in any language (fixed values).
BUILTINS = frozenset(
    """print len range str int float bool list dict set tuple isinstance issubclass getattr setattr hasattr delattr super type enumerate zip sorted reversed map filter open repr format
    next iter abs min max sum any all id hash vars dir callable bytes bytearray frozenset object property staticmethod classmethod round pow divmod ord chr hex oct bin input""".split()
)
#: Languages whose calls count (fixed values).
CALLING = frozenset("python javascript typescript tsx go rust java".split())
#: Languages whose signatures name no parameters (fixed values).
PLAIN_SIGNATURES = frozenset(("c", "cpp"))
DOC_CHARS = 500
_BLANK = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_KEYWORDS = frozenset("if for while switch catch return else do try new throw typeof sizeof await yield match loop function func fn def class".split())
_CLASS = {
    "java": r"\b(?:class|interface|enum|record)\s+(?P<k>\w+)", "javascript": r"\bclass\s+(?P<k>[\w$]+)", "go": r"\btype\s+(?P<k>\w+)(?=[^\n]*)", "rust": r"\b(?:struct|enum|trait)\s+(?P<k>\w+)", "c": r"\b(?:struct|enum|union)\s+(?P<k>\w+)(?=\s*\{)",
    "cpp": r"\b(?:class|struct|enum(?:\s+class)?)\s+(?P<k>\w+)(?=[^;(){}]*\{)", "csharp": r"\b(?:class|interface|struct|record)\s+(?P<k>\w+)", "php": r"\b(?:class|interface|trait|enum)\s+(?P<k>\w+)",
    "kotlin": r"\b(?:class|object|interface)\s+(?P<k>\w+)", "swift": r"\b(?:class|struct|protocol|enum)\s+(?P<k>\w+)", "scala": r"\b(?:class|object|trait)\s+(?P<k>\w+)", "ruby": r"^\s*(?:class|module)\s+(?P<k>\w+)",
}
_CLASS["typescript"] = _CLASS["tsx"] = r"\b(?:class|interface|enum)\s+(?P<k>[\w$]+)"
_FUNCTION = {
    "go": r"\bfunc\s+(?:\([^()]*\)\s*)?(?P<f>\w+)", "rust": r"\bfn\s+(?P<f>\w+)", "php": r"\bfunction\s+(?P<f>\w+)", "kotlin": r"\bfun\s+(?P<f>\w+)", "swift": r"\bfunc\s+(?P<f>\w+)", "scala": r"\bdef\s+(?P<f>\w+)", "ruby": r"^\s*def\s+(?:self\.)?(?P<f>\w+[?!]?)",
    "javascript": r"\bfunction\b\s*\*?\s*(?P<f>[\w$]+)|\b(?:const|let|var)\s+(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?=\([^()]*\)\s*(?::[^={}\n]+)?=>)|(?=[\w$]+\s*=>))|^[ \t]*(?P<g>[\w$]+)\s*=\s*(?:async\s*)?(?=\([^()]*\)\s*(?::[^={}\n]+)?=>)",
}
_FUNCTION["typescript"] = _FUNCTION["tsx"] = _FUNCTION["javascript"]
_IMPORT = {
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "go": r"^\s*import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"|^\s+(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "c": r"^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]",
    "javascript": r"^\s*import\b[^;\n]*?[\"']([^\"'\n]+)[\"']", "csharp": r"^\s*using\s+([\w.]+)\s*;", "php": r"^\s*use\s+([\w\\]+)", "kotlin": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import\s+(\w+)", "scala": r"^\s*import\s+([\w.]+)",
}
_IMPORT["typescript"] = _IMPORT["tsx"] = _IMPORT["javascript"]
_IMPORT["cpp"] = _IMPORT["c"]
_SCAN = {
    language: re.compile("|".join(filter(None, (_CLASS[language], _FUNCTION.get(language), r"\bimpl\b[^{;]*?(?P<i>\w+)\s*(?=\{)|\bmod\s+(?P<m>\w+)(?=\s*\{)" if language == "rust" else None, r"(?P<c>[\w$]+)\s*!?\s*(?:<[\w$<>,. ]*>)?\s*\(", r"(?P<o>\{)", r"(?P<x>\})"))), re.M)
    for language in _CLASS
}


def module_name(path: str) -> str:
    dotted = re.sub(r"([^/])\.[^./]*$", r"\1", path).replace("/", ".")
    return re.sub(r"(^|\.)__init__$", "", dotted)


class _Rows:
    def __init__(self, path: str, language: str, text: str) -> None:
        self.path, self.language, self.symbols, self.edges = path, language, [], []
        self.module = module_name(path)
        self.symbols.append((path, "file", path.rsplit("/", 1)[-1], self.module, "", "", 1, text.count("\n") + 1))

    def add(self, kind: str, name: str, owner: tuple[str, str], signature: str, doc: str, start: int, end: int) -> tuple[str, str]:
        qualified = f"{owner[1]}.{name}" if owner[1] else name
        id_ = f"{self.path}::{qualified}"
        self.symbols.append((id_, kind, name, qualified, signature, doc if len(doc) <= DOC_CHARS else doc[: DOC_CHARS - 1] + "…", start, end))
        self.edges.append((owner[0], id_, "defines"))
        return id_, qualified


def _python(text: str, rows: _Rows) -> None:
    lines = text.split("\n")

    def parameters(node) -> str:
        body = "\n".join(lines[node.lineno - 1 : node.body[0].lineno])
        at = body.find("(", body.find(node.name))
        end = _closing(body, at)
        return body[at:end] if end > 0 else "()"

    def doc(node) -> str:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            raw = ast.get_source_segment(text, first.value) or ""
            return re.sub(r"^[rRuUbB]*(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", raw).strip()
        return ""

    def last(node) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def visit(node, owner: tuple[str, str], inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                me = rows.add("class", child.name, owner, "", doc(child), child.lineno, child.end_lineno)
                rows.edges.extend((me[0], name, "inherits") for b in child.bases if (name := last(b)))
                visit(child, me, "class")
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                me = rows.add("method" if inside == "class" else "function", child.name, owner, child.name + parameters(child), doc(child), child.lineno, child.end_lineno)
                visit(child, me, "function")
            elif isinstance(child, ast.Import):
                a = child.names[0]
                rows.edges.append((rows.path, a.name + (f" as {a.asname}" if a.asname else ""), "imports"))
            elif isinstance(child, ast.ImportFrom):
                if child.module != "__future__":
                    rows.edges.append((rows.path, "." * child.level + (child.module or ""), "imports"))
            else:
                if isinstance(child, ast.Call) and inside == "function" and (name := last(child.func)) and name not in BUILTINS:
                    rows.edges.append((owner[0], name, "calls"))
                visit(child, owner, inside)

    visit(ast.parse(text), (rows.path, rows.module), "module")


_PY_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)([^\n]*)", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?))", re.M)


def _python_lines(text: str, rows: _Rows) -> None:
    """Declarations and imports of a Python text that does not parse, by lines and their indentation; calls are left out."""
    bare = re.sub(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    rows.edges.extend((rows.path, m[1] or m[2], "imports") for m in _PY_IMPORT.finditer(bare) if m[1] != "__future__")
    owners = [(-1, (rows.path, rows.module), "module")]
    for m in _PY_HEAD.finditer(bare):
        pad = len(m[1].expandtabs(8))
        while owners[-1][0] >= pad:
            owners.pop()
        after = re.compile(rf"^[ \t]{{0,{pad}}}[^\s#)\]]", re.M).search(bare, m.end())
        start, end = bare.count("\n", 0, m.start()) + 1, bare.count("\n", 0, after.start() if after else len(bare.rstrip())) + (0 if after else 1)
        opened = text.find("(", m.start(3)) if m[4].lstrip().startswith("(") else -1
        closed = _closing(text, opened)
        owner, inside = owners[-1][1:]
        if m[2] == "class":
            me = rows.add("class", m[3], owner, "", "", start, end)
            bases = text[opened + 1 : closed - 1] if closed > 0 else ""
            rows.edges.extend((me[0], base, "inherits") for b in bases.split(",") if "=" not in b and (base := b.strip().rsplit(".", 1)[-1]).isidentifier())
        else:
            me = rows.add("method" if inside == "class" else "function", m[3], owner, m[3] + (text[opened:closed] if closed > 0 else "()"), "", start, end)
        owners.append((pad, me, "class" if m[2] == "class" else "function"))


def _closing(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``, -1 if there is none."""
    if at < 0:
        return -1
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.end()
    return -1


def _brackets(text: str, language: str, rows: _Rows) -> None:
    for m in re.finditer(_IMPORT.get(language, r"(?!)"), text, re.M):
        rows.edges.append((rows.path, next(g for g in m.groups() if g).strip("\"'`;<>"), "imports"))
    bare = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = lambda at: bare.count("\n", 0, at) + 1
    owners = [((rows.path, rows.module), "module", len(bare) + 1)]
    skip = 0
    for m in _SCAN[language].finditer(bare):
        while m.start() >= owners[-1][2]:
            owners.pop()
        owner, inside, _ = owners[-1]
        g = m.groupdict()
        if g["o"] or g["x"] or m.start() < skip:
            continue
        if name := g.get("k"):
            opened = bare.find("{", m.end())
            stop = bare.find(";", m.end())
            end = _closing(bare, opened) if opened >= 0 and not 0 <= stop < opened else (stop + 1 if stop > 0 else m.end())
            head = bare[m.end() : opened if 0 <= opened < end else end]
            me = rows.add("class", name, owner, "", "", line(m.start()), line(max(end - 1, m.start())))
            if language in ("java", "javascript", "typescript", "tsx"):
                for part in re.findall(r"\b(?:extends|implements)\s+([^{]*?)(?=\bimplements\b|$)", re.sub(r"<[^<>]*>", "", head), re.S):
                    rows.edges.extend((me[0], base, "inherits") for x in part.split(",") if (base := x.strip().rsplit(".", 1)[-1]) and base.isidentifier())
            if end > 0:
                owners.append((me, "class", end))
            continue
        if g.get("i") or g.get("m"):
            owners.append((owner, "class", _closing(bare, bare.find("{", m.end() - 1))))
            continue
        name = g.get("f") or g.get("b") or g.get("g")
        called = g["c"] if not name else None
        if called:
            opened = m.end() - 1
            end = _closing(bare, opened)
            behind = re.compile(r"\s*(?::[^={};()\n]+|throws\s[\w., ]+|const|noexcept|override)?\s*\{").match(bare, end) if end > 0 and language not in ("go", "rust", "php", "kotlin", "swift", "scala", "ruby") else None
            before = bare[max(0, m.start() - 12) : m.start()].rstrip()
            if behind and called not in _KEYWORDS and not before.endswith((".", "new", "=", "(", ",", "return", ">")) and (inside == "class" or language in ("c", "cpp")):
                name, skip = called, m.end()
            elif called not in _KEYWORDS and called not in BUILTINS and inside == "function" and language in CALLING:
                if not before.endswith(("fn", "func", "function")):
                    rows.edges.append((owner[0], called, "calls"))
                continue
            else:
                continue
        opened = bare.find("(", m.end() - (1 if called else 0))
        end = _closing(bare, opened)
        parameters = text[opened:end] if end > 0 and language not in PLAIN_SIGNATURES else "()"
        start = bare.find("{", max(end, m.end()))
        stop = bare.find(";", max(end, m.end()))
        close = _closing(bare, start) if start >= 0 and not 0 <= stop < start else (stop + 1 if stop > 0 else len(bare))
        skip = max(skip, end)
        me = rows.add("method" if inside == "class" else "function", name, owner, name + parameters, "", line(m.start() + len(m[0]) - len(m[0].lstrip())), line(max(close - 1, m.start())))
        owners.append((me, "function", close if close > 0 else len(bare)))


def parse_text(path: str, text: str | None) -> tuple[str | None, list[tuple], list[tuple], str | None]:
    """(language, symbols, edges, error) of one file; never raises. Unknown extensions report an error, null texts count as ''."""
    language = EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower())
    if language is None:
        return None, [], [], "unsupported file type"
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    rows, error = _Rows(path, language, text), None
    try:
        if language == "python":
            _python(text, rows)
        elif language in _SCAN:
            _brackets(text, language, rows)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        error = f"parse error: {type(e).__name__}"
        del rows.symbols[1:], rows.edges[:]
        if language == "python":
            _python_lines(text, rows)
    return language, rows.symbols, rows.edges, error


_SYMBOLS = "array<struct<id:string,kind:string,name:string,qualified_name:string,signature:string,docstring:string,start_line:bigint,end_line:bigint>>"
_EDGES = "array<struct<src_id:string,dst_id:string,kind:string>>"


def parse_files(files: DataFrame) -> DataFrame:
    """(path, language, symbols, edges, content_hash, error) of every row of ``files`` (path, text).

    A null path gives no row; repeated rows stay repeated; other columns are ignored.
    """
    symbol = pa.struct([(n, pa.int64() if n.endswith("line") else pa.string()) for n in ("id", "kind", "name", "qualified_name", "signature", "docstring", "start_line", "end_line")])
    edge = pa.struct([(n, pa.string()) for n in ("src_id", "dst_id", "kind")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse_text(p, t) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            named = lambda rows, kind: [dict(zip((f.name for f in kind), r)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([named(m[1], symbol) for m in made], pa.list_(symbol)),
                    pa.array([named(m[2], edge) for m in made], pa.list_(edge)), batch.column(2), pa.array([m[3] for m in made], pa.string()),
                ],
                ["path", "language", "symbols", "edges", "content_hash", "error"],
            )

    rows = files.where(F.col("path").isNotNull()).select("path", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return for_all_cores(rows, "path").mapInArrow(run, f"path string, language string, symbols {_SYMBOLS}, edges {_EDGES}, content_hash string, error string")


def extracted_symbols(parsed: DataFrame) -> DataFrame:
    """One row per symbol, in the form of the symbols table."""
    return parsed.select("path", "language", F.explode("symbols").alias("s")).select("s.id", "s.kind", "s.name", "s.qualified_name", "path", "language", "s.signature", "s.docstring", "s.start_line", "s.end_line")


def extracted_edges(parsed: DataFrame) -> DataFrame:
    """One row per edge as written: targets of imports, calls and bases are bare names; every edge weighs 1."""
    return parsed.select(F.explode("edges").alias("e")).select("e.src_id", "e.dst_id", "e.kind", F.lit(1.0).alias("weight"))
