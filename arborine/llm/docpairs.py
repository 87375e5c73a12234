"""Functions and methods paired with their documentation, found by island grammars.

Each language has a small grammar of islands: a documentation block, annotations, a
signature and a balanced body (by brackets, by words in Ruby and Lua, by indentation in Python). All other text is
water and skipped; comments and strings, which may look like islands, are drained first. The islands come from one pass over each text where it lies; only the
documented declarations are shuffled, to meet the rows of symbols with the same path, line and name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.functions.languages import EXTENSIONS
from arborine.sources.tables import for_all_cores

#: How documentation is written: a block comment, or runs of a line marker (fixed values).
BLOCK, SLASHES, TRIPLE, HASH, DASHES = r"/\*\*(?!/)(?:[^*]|\*(?!/))*\*/", r"//(?!/)", r"///(?!/)", r"#(?![!\[{'])", r"--"
DOC_STYLES: dict[str, str] = {
    "javascript": BLOCK, "typescript": BLOCK, "tsx": BLOCK, "java": BLOCK, "c": BLOCK, "php": BLOCK, "scala": BLOCK, "kotlin": BLOCK,
    "cpp": f"(?:{BLOCK}|LINES///(?!/))", "swift": f"(?:{BLOCK}|LINES///(?!/))", "go": SLASHES, "rust": TRIPLE, "csharp": TRIPLE,
    "ruby": HASH, "bash": HASH, "r": r"#'?", "lua": DASHES,
}
_LINE_RUN = r"{0}[^\n]*(?:\n[ \t]*{0}[^\n]*)*"
#: Lines for tools that may stand between documentation and declaration, and annotations before their brackets (fixed values).
_TOOL_LINE = re.compile(r"[ \t]*//[ \t]*(?:eslint-|@ts-|prettier-|nolint|go:)[^\n]*\n")
_ANNOTATION = re.compile(r"[ \t]*(?:@(?!interface\b)[\w.]+(?:[ \t]*(?=\())?|#!?(?=\[)|(?=\[[A-Z]))")
#: What a declaration must start with in languages that mark it by a keyword (fixed values).
_HEADS = {
    "go": r"func\b", "rust": r"(?:\w[\w()\" ]*\s)?fn\b", "ruby": r"def\b", "kotlin": r"(?:[\w ]*\s)?fun\b", "swift": r"(?:[\w ]*\s)?(?:func|init)\b", "scala": r"(?:[\w ]*\s)?def\b",
    "lua": r"(?:local\s+)?(?:function\b|[\w.]+\s*=\s*function\b)",
}
_HEAD = {language: re.compile(head) for language, head in _HEADS.items()}


def _island(style: str) -> re.Pattern:
    if style.startswith("(?:"):
        block, line = style[3:-1].split("|LINES")
        doc = f"(?:{block}|{_LINE_RUN.format(line)})"
    else:
        doc = style if style == BLOCK else _LINE_RUN.format(style)
    return re.compile(rf"^[ \t]*(?P<doc>{doc})[ \t]*\n", re.M)


ISLANDS = {language: _island(style) for language, style in DOC_STYLES.items()}
#: Water inside the islands: comments and strings by language.
_C_COMMENT, _C_STRING = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|//[^\n]*", r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_TRIPLE_QUOTED = r'"""(?:[^"\\]|\\.|"(?!""))*+"""'
_LONG_STRING = r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'"
_PY_STRING = r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|' + r"'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\Z)|" + _C_STRING
_RUST_STRING = r'\b[bc]?r(?P<raw>#*)"[\s\S]*?"(?P=raw)|"(?:[^"\\]|\\.)*+"|' + r"'(?:\\.[^'\n]*|[^'\\\n])'"
_WATER = {
    "python": (r"#[^\n]*", _PY_STRING), "python lines": (r"#[^\n]*", _C_STRING), "rust": (_C_COMMENT, _RUST_STRING), "go": (_C_COMMENT, r"`[^`]*`|" + _C_STRING), "c": (_C_COMMENT, _C_STRING), "cpp": (_C_COMMENT, _C_STRING),
    **dict.fromkeys(("javascript", "typescript", "tsx"), (_C_COMMENT, r"`(?:[^`\\]|\\.)*+`|" + _C_STRING)), **dict.fromkeys(("java", "kotlin", "swift", "scala", "csharp"), (_C_COMMENT, f"{_TRIPLE_QUOTED}|{_C_STRING}")),
    "php": (_C_COMMENT + r"|#(?!\[)[^\n]*", _LONG_STRING), **dict.fromkeys(("ruby", "bash", "r"), (r"(?<![\w$])#[^\n]*", _LONG_STRING)), "lua": (r"--\[\[[\s\S]*?(?:\]\]|\Z)|--[^\n]*", r"\[\[[\s\S]*?\]\]|" + _C_STRING),
}
_WATER_AT = {language: re.compile(f"(?P<comment>{c})|{t}", re.S) for language, (c, t) in _WATER.items()}
COMMENT, STRING = "\x01", "\x02"
_NOT_END = re.compile(r"[^\n]+")


def drained(text: str, language: str) -> str:
    """``text`` with its comments and strings overwritten by ``COMMENT`` and ``STRING`` signs, line ends kept."""

    def fill(m: re.Match) -> str:
        sign = COMMENT if m["comment"] is not None else STRING
        return _NOT_END.sub(lambda x: sign * len(x[0]), m[0]) if "\n" in m[0] else sign * len(m[0])

    return _WATER_AT[language].sub(fill, text)


_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\n]*?\])?\(", re.M)
_PY_GAP = re.compile(r"(?:\s*#[^\n]*\n|\s)*")
_PY_DOC = re.compile(r"[rRuU]?(?:\"\"\"(?P<a>(?:[^\\\"]|\\.|\"(?!\"\"))*)\"\"\"|'''(?P<b>(?:[^\\']|\\.|'(?!''))*)'''|\"(?P<c>(?:[^\\\"\n]|\\.)*)\"|'(?P<d>(?:[^\\'\n]|\\.)*)')", re.S)
_BRACKET = re.compile(r"[()\[\]{}]")
_NAMES = (
    re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\b\s*)?(?:function\b|\(|[\w$]+\s*=>)"),
    re.compile(r"\b(?:func|fn|fun|def|function|sub)\s+(?:\([^()]*\)\s*)?(?:self\.)?([\w$?!]+)"),
    re.compile(r"([\w$]+)\s*(?:<[^()\n]*>)?\s*[=:]\s*(?:async\b\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>)"),
    re.compile(r"([\w$~]+)\s*(?:<[^()\n]*>)?\s*\("),
)
_NOT_NAMES = frozenset("if for while switch catch return new else do throw await yield typeof sizeof assert super this function".split())


def _close(dry: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at`` in a drained text. -1 if it stays open."""
    depth = 0
    for m in _BRACKET.finditer(dry, at):
        depth += 1 if m[0] in "([{" else -1
        if depth <= 0:
            return m.end()
    return -1


#: Words of placeholders, tool markers and restatements that tell nothing (fixed values).
FILLER = frozenset(
    """a an the this that these those it its is are be was of for to from in on at by with and or as
    method function func procedure routine constructor member documentation document documents doc docs docstring docstrings description describe summary undocumented
    todo fixme xxx hack tbd wip placeholder stub auto autogenerated generated inheritdoc inherit none null nil na n a missing comment comments add here write me
    param params parameter parameters arg args argument arguments return returns returned throws raises see type rtype self cls name named called value values
    noqa nolint""".split()
)
_TOOLS = re.compile(
    r"\b(?:noqa|type:\s*ignore|pylint:|pragma:|mypy:|flake8|isort:|fmt:|yapf:|eslint|tslint|jshint|istanbul|c8 ignore|v8 ignore|prettier-|biome-|ts-(?:ignore|nocheck|expect-error)|nolint|NOLINT\w*|noinspection|clang-format|clippy|rustfmt|go:\w+|checkstyle|NOSONAR|SuppressWarnings|coverage:|cspell|@formatter)\S*[^\n]*",
    re.I,
)
_REMINDER = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD)\b[^\n]*", re.I)
_TAG = re.compile(r"[@\\](?:param|arg|argument|return|returns|throws|exception|type|see|since|author|deprecated|inheritDoc|override)\b|:(?:param|type|returns?|rtype|raises)\b[^:\n]*:|</?\w+[^>\n]*>", re.I)
_WORD = re.compile(r"[^\W_\d]+")
_HUMP = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")
_MARKS = re.compile(r"^[ \t]*(?:/\*\*+|\*+/|\*+(?!/)|///+|//+|#'|#+|--+)?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)


def stem(word: str) -> str:
    for end in ("ing", "ies", "ed", "es", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def _stems(name: str) -> set[str]:
    return {stem(w.lower()) for w in _HUMP.findall(name or "")}


def clean(doc: str) -> str:
    """Documentation without the signs of its comment."""
    return _MARKS.sub("", doc).strip()


def trivial(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether ``doc`` tells nothing beyond the names of the function and its parameters.

    True for null and blank texts, punctuation, placeholders, reminders, tool markers, tags without
    words and the names restated, in whatever form of their words.
    """
    if not doc or not doc.strip():
        return True
    said = _TAG.sub(" ", _REMINDER.sub(" ", _TOOLS.sub(" ", doc)))
    said = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", " ", said) if name else said
    known = _stems(name or "") | _stems(re.sub(r"^[^(]*", "", signature or ""))
    for word in _WORD.findall(said):
        for hump in _HUMP.findall(word) or [word]:
            w = hump.lower()
            if w not in FILLER and stem(w) not in known:
                return False
    return True


def _python(text: str) -> Iterator[tuple]:
    line, seen = 1, 0
    dry = drained(text, "python")
    if dry.rstrip().endswith(STRING) and not text.rstrip().endswith(('"', "'")):  # a long string has no end, so where others end is not known
        dry = drained(text, "python lines")
    for m in _PY_DEF.finditer(dry):
        opened = m.end() - 1
        closed = _close(dry, opened)
        colon = dry.find(":", closed) if closed > 0 else -1
        if colon < 0 or (arrow := dry[closed:colon].replace(STRING, "")).strip() and not arrow.lstrip().startswith("->"):
            continue
        d = _PY_DOC.match(text, _PY_GAP.match(text, colon + 1).end())
        if not d:
            continue
        doc = next(g for g in d.groups() if g is not None)
        line += dry.count("\n", seen, m.start())
        seen = m.start()
        name, signature = m.group(2), m.group(2) + text[opened:closed]
        if trivial(doc, name, signature):
            continue
        pad = len(m.group(1).expandtabs(8))
        end = re.compile(rf"^[ \t]{{0,{pad}}}[^\s{COMMENT}{STRING})\]}}]", re.M).search(dry, d.end())
        yield line, name, signature, doc.strip(), text[m.start() : end.start() if end else len(text)].rstrip()


def _declaration(dry: str, at: int) -> int:
    """The place behind the annotations that start at ``at``."""
    while True:
        m = _ANNOTATION.match(dry, at)
        if not m:
            return at
        end = m.end()
        if dry[end : end + 1] in ("(", "["):
            end = _close(dry, end)
            if end < 0:
                return at
        at = end
        while dry[at : at + 1] in (" ", "\t"):
            at += 1
        if dry[at : at + 1] == "\n":
            at += 1


def _brackets(text: str, language: str) -> Iterator[tuple]:
    line, seen = 1, 0
    dry = drained(text, language)
    for m in ISLANDS[language].finditer(text):
        if dry[m.start("doc")] != COMMENT:
            continue
        start = m.end()
        while tool := _TOOL_LINE.match(text, start):
            start = tool.end()
        start = _declaration(dry, start)
        while dry[start : start + 1] in (" ", "\t"):
            start += 1
        if start >= len(dry) or dry[start] in f"\n#/*@}}{COMMENT}{STRING}" or language in _HEAD and not _HEAD[language].match(dry, start):
            continue
        stop = dry.find("\n", start)
        stop = len(dry) if stop < 0 else stop
        name, place = _named(dry, start, stop)
        if not name:  # the first line has none: all up to the body
            ahead = re.compile(r"[{;}]").search(dry, start)
            if ahead and ahead.start() > stop:
                stop = ahead.start()
                name, place = _named(dry, start, stop)
        if not name:
            continue
        opened = dry.find("(", place)
        closed = _close(dry, opened) if 0 <= opened <= stop else -1
        signature = name + (text[opened:closed] if closed > 0 else "")
        doc = clean(m.group("doc"))
        line += dry.count("\n", seen, start)
        seen = start
        if trivial(doc, name, signature):
            continue
        yield line, name, signature, doc, text[start : _body(dry, language, start, max(closed, place))].rstrip()


def _named(dry: str, start: int, stop: int) -> tuple[str | None, int]:
    """The name that is declared between two places, and the place behind it."""
    for pattern in _NAMES:
        found = pattern.search(dry, start, stop)
        if found and found.group(1) not in _NOT_NAMES:
            return found.group(1), found.end(1)
    return None, start


_BLOCK_WORDS = {
    "ruby": re.compile(r"(?<![.:\w])(?:def|class|module|begin|case|do)\b|(?:(?<=\n)|(?<=;))[ \t]*(?:if|unless|while|until|for)\b|(?<![.:\w])(end)\b(?!:)"),
    "lua": re.compile(r"\b(?:function|do|if|repeat)\b|\b(end|until)\b"),
}


def _body(dry: str, language: str, start: int, behind: int) -> int:
    """Where the body ends of a declaration that starts at ``start`` and whose parameters end at ``behind``: at its closing bracket or word, or with its statement."""
    if words := _BLOCK_WORDS.get(language):
        depth = 0
        for m in words.finditer(dry, start):
            depth += -1 if m[1] else 1
            if not depth:
                return m.end()
        return len(dry)
    m = re.compile(r"[{;]|\n[ \t]*\n").search(dry, behind)
    if m and m[0] == "{":
        end = _close(dry, m.start())
        return end if end > 0 else len(dry)
    return m.start() + (m[0] == ";") if m else len(dry)


def documented(text: str | None, language: str) -> list[tuple]:
    """(line, name, signature, doc, body) of the declarations in ``text`` whose documentation is not trivial.

    A body goes to its closing bracket or word, in Python as far as it is indented; one that is never closed goes to the end.

    ``line`` is 1-based. Text outside the islands may be of any kind; null and blank texts have none.
    """
    if not text or (language not in ISLANDS and language != "python"):
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return list(_python(text) if language == "python" else _brackets(text, language))


def _found_in_texts(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                language = EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower())
                if language:
                    rows += [(path, *found) for found in documented(text, language)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "line", "name", "signature", "doc", "code"])

    rows = documents.where(F.col("path").isNotNull() & F.col("text").isNotNull()).select("path", "text")
    return for_all_cores(rows, "path").mapInArrow(run, "path string, line bigint, name string, signature string, doc string, code string")


def _recorded(symbols: DataFrame) -> DataFrame:
    """(id, doc) of the recorded docstrings that are not trivial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not trivial(*row) for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["id", "doc"])

    rows = symbols.where(F.length(F.trim("docstring")) > 0).select("id", "docstring", "name", "signature")
    return rows.mapInArrow(run, "id string, doc string")


def _callables(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "method") & F.col("id").isNotNull())


def documented_symbols(symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """(id): each distinct id of a function or method whose documentation is not trivial.

    The documentation is what ``docstring`` records or, in any document of the symbol's path, what belongs to
    the declaration of that name at ``start_line``. Repeated rows and texts count once; rows with a null id,
    kind, path or line find no text; empty tables give no rows; other columns are ignored.
    """
    wanted = _callables(symbols)
    places = wanted.select("id", "path", F.col("start_line").alias("line"), "name").distinct()
    texts = _found_in_texts(documents).select("path", "line", "name").distinct()
    return places.join(texts, ["path", "line", "name"]).select("id").unionByName(_recorded(wanted).select("id")).distinct()


def code_description_pairs(symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, language, signature, description, code): one pair per documented function or method.

    ``code`` runs from the declaration to the end of its balanced body. Where the text of the path is missing, the
    recorded docstring is the description and ``code`` is null; of several texts the smallest
    (description, code) is taken, so repeats give one row. Other cases as in ``documented_symbols``.
    """
    wanted = _callables(symbols)
    places = wanted.groupBy("id").agg(F.max(F.struct("path", F.col("start_line").alias("line"), "name", "language", F.col("signature").alias("recorded"))).alias("s")).select("id", "s.*")
    texts = _found_in_texts(documents).groupBy("path", "line", "name").agg(F.min(F.struct("doc", "code", "signature")).alias("t"))
    told = _recorded(wanted).groupBy("id").agg(F.min("doc").alias("told"))
    return (
        places.join(texts, ["path", "line", "name"], "left").join(told, "id", "left")
        .where(F.col("t").isNotNull() | F.col("told").isNotNull())
        .select("id", "language", F.coalesce(F.col("t.signature"), F.when(F.col("recorded") != "", F.col("recorded")), "name").alias("signature"), F.coalesce(F.col("t.doc"), "told").alias("description"), F.col("t.code").alias("code"))
    )
