"""Lexers and grammars of the languages whose expressions are told apart by operators and operands only.

C++, C#, PHP, Kotlin, Swift, Scala, R, Lua, Ruby and shell scripts. Every token is an operand (``i``), an infix operator (``b``), which needs
an operand on both sides, or an operator that may stand before, between or after operands (``q``). Operands may follow each other, as types, modifiers and
commands do. Blocks that words open and close (Lua, Ruby, shell) become curly brackets, and
the words between (then, else, do, ...) signs of their own, so the chart repairs them like all other groups. What stands in
the place of what among operands is not checked.
"""

from __future__ import annotations

import re

from arborine.llm.chart import MOST, Grammar

BAD = "\x00"
_NUMBER = r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*(?:'\d+)*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[A-Za-z]*"
_SLASHES = r"/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n]*"
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*[a-zA-Z]+\b(?:[^\n\\]|\\.|\\\n)*", re.M)

ITEM = r"[q]*(?:i|<p>|<s>|<b>)q*"
EXPR = rf"(?:({ITEM}(?=b?))|q+)"
LIST = rf"(?:({EXPR}(?=,)),?)"
RULES = {
    "(": [(1, rf"[;\n]*(?:{LIST}?[;\n]+)*{LIST}?|[bq]")],
    "[": [(1, rf"[\n]*{LIST}?[\n]*|[bqi,]*")],
    "{": [(1, rf"[;\n]*(?:{LIST}[;\n]+)*")],
    "top": rf"[;\n]*(?:{LIST}[;\n]+)*",
    "end": "\n",
}
_EMPTY_ITEMS = {**RULES, "(": [(1, rf"[\n]*(?:(?:{EXPR}b?)?,?\n*)*")], "[": [(1, rf"[\n]*(?:{EXPR}?,?\n*)*")]}


class Juxtaposed:
    """A language of operands and operators. ``infix`` and ``other`` are its operators, the longest that fits counts."""

    def __init__(self, infix: str, other: str, *, strings: str, unclosed: str, comments: str = _SLASHES, words: str = r"[^\W\d]\w*", lines: bool = False, directives: bool = False, infix_words: str = "", rules: dict = RULES, before=None) -> None:
        self.lines, self.directives, self.before = lines, directives, before
        self.sign = {**dict.fromkeys(other.split(), "q"), **dict.fromkeys(infix.split(), "b")}
        self.infix_words = frozenset(infix_words.split())
        operators = "|".join(map(re.escape, sorted(self.sign, key=len, reverse=True)))
        self.token = re.compile(rf"[^\S\n]++|(?P<c>{comments})|(?P<s>{strings})|(?P<z>{unclosed})|(?P<n>{_NUMBER})|(?P<w>{words})|(?P<o>{operators})|(?P<p>[()\[\]{{}},;])|(?P<l>\\?\n)|(?P<x>.)", re.S)
        self.grammar = Grammar(rules)

    def signs(self, text: str) -> tuple[str, bool]:
        out, cut = [], False
        for m in self.token.finditer(text):
            kind = m.lastgroup
            if kind == "w":
                out.append("b" if m[0] in self.infix_words else "i")
            elif kind == "o":
                out.append(self.sign[m[0]])
            elif kind == "p":
                out.append(m[0])
            elif kind in ("n", "s"):
                out.append("i")
            elif kind == "l" or kind == "c" and "\n" in m[0]:
                if self.lines and m[0][0] != "\\":
                    out.append("\n")
            elif kind in ("z", "x"):
                out.append(BAD)
                cut = kind == "z" and m.end() >= len(text.rstrip())
        return "".join(out), cut

    def cost(self, text: str) -> tuple[int, float, bool, bool]:
        """As ``syntax.Brackets.cost``."""
        if self.directives:
            text = _DIRECTIVE.sub("", text)
        if self.before:
            text = self.before(text)
        signs, cut = self.signs(text)
        if self.lines:
            signs = re.sub(r"\n+(?=[b,)\]])|(?<=[b,(\[])\n+", "", signs)
        return finish(self.grammar, signs, cut)


def finish(grammar: Grammar, signs: str, cut: bool) -> tuple[int, float, bool, bool]:
    flat, cost, exact, still_open = grammar.reduce(signs)
    flat += grammar.end
    where = 1.0
    if not grammar.top.accepts(flat):
        edits, at = grammar.top.repair(flat)
        cost, exact, where = cost + edits, exact and edits <= MOST, at / max(len(flat), 1)
    return cost, where, still_open or cut, exact


def _cpp() -> Juxtaposed:
    strings = r'(?:u8|[LuU])?R"(?P<raw>[^()\\\s]{0,16})\([\s\S]*?\)(?P=raw)"|(?:u8|[LuU])?"(?:[^"\\\n]|\\.|\\\n)*"|[LuU]?\'(?:[^\'\\\n]|\\.)+\''
    return Juxtaposed(
        "= == != <= >= <=> += -= *= /= %= ^= |= &= <<= >>= || / % ^ | . -> .* ->* ? <<", "* & && + - ++ -- < > >> : :: ... ~ !",
        strings=strings, unclosed=r'/\*[\s\S]*|["\'][^\n]*', directives=True, words=r"operator\s*(?:\(\s*\)|\[\s*\]|[-+*/%^&|~!=<>,]+|\"\"\s*\w+)|[^\W\d]\w*",
    )


def _csharp() -> Juxtaposed:
    strings = r'\$*"""[\s\S]*?"""+|(?:@\$?|\$@)"(?:[^"]|"")*"|\$"(?:[^"\\{\n]|\\.|\{\{|\{(?:[^{}"]|"[^"\n]*"|\{[^{}]*\})*\})*"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\''
    return Juxtaposed(
        "= == != <= >= => += -= *= /= %= ^= |= &= <<= >>= ?? ??= || && | % / . ?. ->", "* & + - ++ -- < > >> << : :: .. ^ ~ ! ?",
        strings=strings, unclosed=r'/\*[\s\S]*|["\'][^\n]*', directives=True, words=r"@?[^\W\d]\w*", infix_words="is as",
    )


def _php_code(text: str) -> str:
    """The code between the marks of PHP, as one text; what is outside them is output."""
    out = []
    for m in re.finditer(r"<\?(?:php\b|=|(?!xml))((?:[^?'\"/#<]++|'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|/\*(?:[^*]++|\*(?!/))*+\*/|(?://|#(?!\[))(?:[^\n?]|\?(?!>))*+|<<<[ \t]*['\"]?(\w+)['\"]?\n[\s\S]*?\n[ \t]*\2\b|\?(?!>)|.)*?)(?:\?>|\Z)", text, re.S):
        out.append(m[1] + "\n;")
    return "".join(out)


def _php() -> Juxtaposed:
    strings = r"<<<[ \t]*['\"]?(?P<doc>\w+)['\"]?\n(?:[\s\S]*?\n)?[ \t]*(?P=doc)\b|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`"
    return Juxtaposed(
        "= == === != !== <> <= >= <=> += -= *= /= .= %= **= ??= |= &= ^= <<= >>= ?? || && | ^ . -> ?-> % / * **", "& + - ! ~ @ ++ -- ? : :: ... < > << >> => # $",
        strings=strings, unclosed=r'/\*[\s\S]*|["\'`][\s\S]*', comments=_SLASHES + r"|#(?!\[)[^\n]*", words=r"\$*\\?[^\W\d][\w\\]*|\\", infix_words="instanceof and or xor", before=_php_code,
    )


def _kotlin() -> Juxtaposed:
    inner = r'(?:[^{}"]|"(?:[^"\\\n]|\\.)*"|\{(?:[^{}"]|"(?:[^"\\\n]|\\.)*")*\})*'
    strings = rf'"""(?:[^"]|"(?!""))*"""+|"(?:[^"\\\n$]|\\.|\$(?!\{{)|\$\{{{inner}\}})*"|\'(?:[^\'\\\n]|\\.)+\'|`[^`\n]+`'
    return Juxtaposed(
        "= == === != !== <= >= += -= *= /= %= && || ?: . ?. / %", "* -> : :: < > - + ! !! ++ -- & ? @ .. ..<",
        strings=strings, unclosed=r'/\*[\s\S]*|"""[\s\S]*|["\'][^\n]*', comments=_SLASHES + r"|\A#![^\n]*", words=r"@?[^\W\d]\w*(?:@\w+)?", lines=True,
    )


def _swift() -> Juxtaposed:
    inner = r'(?:[^()"]|"(?:[^"\\\n]|\\.)*"|\((?:[^()"]|"[^"\n]*"|\([^()]*\))*\))*'
    strings = rf'"""[\s\S]*?"""|#+"[^\n]*?"#+|"(?:[^"\\\n]|\\\({inner}\)|\\.)*"|`[^`\n]+`'
    return Juxtaposed(
        "= == === != !== <= >= += -= *= /= %= && || ?? ~= -> %", ". * : :: < > - + ! & ? @ .. ... ..< # \\ ~ / | ^ $ << >> &+ &- &*",
        strings=strings, unclosed=r'/\*[\s\S]*|"""[\s\S]*|"[^\n]*', words=r"[#@$]?\w+", lines=True, directives=False, comments=_SLASHES + r"|#(?:if|elseif|else|endif)\b[^\n]*|\A#![^\n]*",
    )


def _scala() -> Juxtaposed:
    return Juxtaposed(
        "= == != <= >= && || .", "=> <- -> + - * / % & | ^ < > ! ~ ? : # @ \\ ++ -- :: ::: <: >: <% =:= ++= += -= *= /= |= &= ~> <~ $ **",
        strings=r"\w*\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"+|\w*\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]+?)'|'\w+|`[^`\n]+`", unclosed=r'/\*[\s\S]*|"""[\s\S]*|["\'][^\n]*', words=r"[^\W\d][\w$]*", lines=True,
    )


def _r() -> Juxtaposed:
    return Juxtaposed(
        "= == != <= >= <- <<- -> ->> && || & | * / ^ |> $ @ : :: ::: := < >", "- + ! !! !!! ? ~ \\",
        strings=r"[rR](?P<q1>[\"'])(?P<d1>-*)\([\s\S]*?\)(?P=d1)(?P=q1)|[rR](?P<q2>[\"'])(?P<d2>-*)\[[\s\S]*?\](?P=d2)(?P=q2)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`", unclosed=r"[\"'`][\s\S]*", comments=r"#[^\n]*",
        words=r"[^\W\d][\w.]*|\.[\w.]*|\.\.\.", lines=True, rules=_EMPTY_ITEMS, infix_words="in", before=lambda t: re.sub(r"%[^%\n\s]*%", "*", t),
    )


class Worded:
    """A language whose blocks are opened and closed by words; ``lex`` gives its signs."""

    def __init__(self, lex, rules: dict) -> None:
        self.lex, self.grammar = lex, Grammar(rules)

    def cost(self, text: str) -> tuple[int, float, bool, bool]:
        signs, cut = self.lex(text)
        return finish(self.grammar, signs, cut)


_LUA = Juxtaposed(
    "= == ~= <= >= .. + * / // % ^ . : & | << >>", "- ~ # < > ::", strings=r"\[(?P<long>=*)\[[\s\S]*?\](?P=long)\]|\"(?:[^\"\\\n]|\\.|\\\n)*\"|'(?:[^'\\\n]|\\.|\\\n)*'", unclosed=r"\[=*\[[\s\S]*|[\"'][^\n]*",
    comments=r"--\[(?P<far>=*)\[[\s\S]*?\](?P=far)\]|--[^\n]*|\A#![^\n]*", words=r"[^\W\d]\w*|\.\.\.", infix_words="and or",
)
_LUA_WORDS = {"function": "{", "do": "{", "repeat": "{", "if": "{I", "then": "T", "elseif": "E", "else": "L", "end": "}", "until": "}", "not": "q"}


def _lua_signs(text: str) -> tuple[str, bool]:
    out, cut = [], False
    for m in _LUA.token.finditer(text):
        kind = m.lastgroup
        if kind == "w":
            out.append("b" if m[0] in _LUA.infix_words else _LUA_WORDS.get(m[0], "i"))
        elif kind == "o":
            out.append(_LUA.sign[m[0]])
        elif kind == "p":
            out.append(m[0])
        elif kind in ("n", "s"):
            out.append("i")
        elif kind in ("z", "x"):
            out.append(BAD)
            cut = kind == "z" and m.end() >= len(text.rstrip())
    return "".join(out), cut


def _lua() -> Worded:
    body = rf"(?:{LIST}?;)*{LIST}?"
    rules = {"(": RULES["("], "[": RULES["["], "{": [(1, body), (2, rf"I{EXPR}T{body}(?:E{EXPR}T{body})*(?:L{body})?")], "top": body}
    return Worded(_lua_signs, rules)


_RUBY = Juxtaposed(
    "= == === != =~ !~ <= >= <=> += -= *= /= ||= &&= |= &= <<= >>= **= %= && || => . &. ^ % /", "* ** & - + ! ~ < > << >> ? : :: | \\ -> .. ... @ $ `",
    strings=r"\"(?:[^\"\\#]|\\.|#(?!\{)|#\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\"|\{[^{}]*\})*\})*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<![\w)\]:]):[^\W\d]\w*[?!=]?(?![:\w])|(?<![\w)\]:]):\"(?:[^\"\\]|\\.)*\"|(?<![\w)\]:]):(?:\[\]=?|[-+*/%<>=!~]+)|(?<!\w)\?\w(?!\w)",
    unclosed=r"[\"'`][\s\S]*", comments=r"#[^\n]*|^=begin\b[\s\S]*?^=end\b[^\n]*", words=r"[@$]{0,2}[^\W\d]\w*[?!]?(?:(?=:[^:])|)|\$[\d!@&~`'+*?/\\,;.<>_0:\"-]", lines=True, infix_words="and or",
)
_RUBY_LITERAL = re.compile(r"%[wWiIqQrsx]?(?:\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]|\((?:[^()\\]|\\.|\([^()]*\))*\)|\{(?:[^{}\\]|\\.|\{[^{}]*\})*\}|<[^<>]*>|([|!/^])(?:(?!\1)[^\\]|\\.)*?\1)\w*|/(?:[^/\\\n]|\\.)+/\w*", re.S)
_HEREDOC = re.compile(r"<<[~-]?([\"'`]?)([A-Z_]\w*)\1")
_RUBY_OPEN, _RUBY_MODIFIER = frozenset("class module begin case".split()), frozenset("if unless while until for".split())


def _ruby_signs(text: str) -> tuple[str, bool]:
    text = re.split(r"^__END__$", text, maxsplit=1, flags=re.M)[0]
    kept, ends = [], []
    for line in text.split("\n"):
        if ends:
            if line.strip() == ends[0]:
                ends.pop(0)
            continue
        kept.append(_HEREDOC.sub('""', line))
        ends += [m[2] for m in _HEREDOC.finditer(line)]
    text = "\n".join(kept)
    out: list[str] = []
    at, loop, cut = 0, 0, bool(ends)
    while at < len(text):
        last = out[-1] if out else "\n"
        starts = last in "\n;b([{,q"
        if text[at] in "%/" and (starts or (text[at - 1 : at].isspace() and not text[at + 1 : at + 2].isspace() and last == "i")) and (m := _RUBY_LITERAL.match(text, at)):
            out.append("i")
            at = m.end()
            continue
        m = _RUBY.token.match(text, at)
        at, kind = m.end(), m.lastgroup
        if kind == "w":
            w = m[0]
            member = text[max(0, m.start() - 1) : m.start()] == "." and text[max(0, m.start() - 2) : m.start()] != ".." or text[at : at + 1] == ":" and text[at + 1 : at + 2] != ":"
            if member:
                out.append("i")
            elif w == "def":
                name = re.compile(r"\s*[^\s(;]+(?:\s*\((?:[^()]|\([^()]*\))*\)\s*=(?![=~>])|\s*=(?=\s))?").match(text, at)
                endless = bool(name and name[0].rstrip().endswith("=") and ("(" in name[0] or re.search(r"\s=$", name[0])))
                out.append("i" if endless else "{")
                out.append("b" if endless else "i")
                at = name.end() if name else at
            elif w in _RUBY_OPEN or w in _RUBY_MODIFIER and starts:
                out.append("{")
                loop += w in ("while", "until", "for")
            elif w == "do":
                if loop:
                    out.append(";")
                    loop -= 1
                else:
                    out.append("{")
            elif w == "end":
                out.append("}")
            elif w in ("then", "else", "ensure"):
                out.append(";")
            elif w in ("not", "when", "elsif", "in", "rescue"):
                out.append("q")
            else:
                out.append("b" if w in _RUBY.infix_words else "i")
        elif kind == "o":
            out.append(_RUBY.sign[m[0]])
        elif kind == "p":
            out.append(m[0])
        elif kind in ("n", "s"):
            out.append("i")
        elif kind == "l":
            if m[0][0] != "\\":
                out.append("\n")
                loop = 0
        elif kind in ("z", "x"):
            out.append(BAD)
            cut = kind == "z" and at >= len(text.rstrip())
    return re.sub(r"\n+(?=[b,)\]])|(?<=[b,(\[])\n+", "", "".join(out)), cut


_SHELL = re.compile(
    r"(?P<h>[ \t\r]+|\\\n)|(?P<c>(?<![^\s;&|()`])#[^\n]*)|(?P<l>\n)|(?P<a>\$\(\(|(?<![\w$])\(\()|(?P<t><<-?[ \t]*(?P<d>\\?[\w.]+|'[^'\n]+'|\"[^\"\n]+\"))|(?P<r>\d*(?:<<<|>>|<>|>&|<&|&>>|&>|>\||[<>](?!\())[ \t]*(?:\d+(?=[\s;&|)])|-)?)"
    r"|(?P<k>;;&|;&|;;)|(?P<o>&&|\|\||\|&|\||&|;|\$\(|[<>]\(|\(|\))|(?P<w>(?:[^\s;&|()<>\"'`\\$#]|\\.|\$(?![({'\"])|#|\$\{(?:[^{}\\'\"]|\\.|'[^']*'|\"(?:[^\"\\]|\\.)*\"|\$?\{(?:[^{}]|\{[^{}]*\})*\})*\}|\$?'(?:[^'\\]|\\.)*'|'[^']*'|\"(?:[^\"\\$`]|\\.|\$(?!\()|\$\(|`)*\")+)|(?P<b>`(?:[^`\\]|\\.)*`)|(?P<x>.)",
    re.S,
)
_DOUBLE = re.compile(r"(?:[^\"\\$`]++|\\.|\$(?!\())*+(\"|\$\(|`(?:[^`\\]|\\.)*`|\Z)", re.S)
_SHELL_WORDS = {"if": "{I", "then": "T", "elif": "E", "else": "L", "fi": "}", "while": "{W", "until": "{W", "for": "{O", "select": "{O", "do": "D", "done": "}", "case": "{C", "esac": "}", "{": "{B", "}": "}", "!": "", "time": ""}
_SHELL_WORD = re.compile(r"(?:[^\s;&|()<>\"'`\\$]++|\\.|\$(?![({'\"])|\$\{(?:[^{}\\'\"]|\\.|'[^']*'|\"(?:[^\"\\]|\\.)*\"|\{[^{}]*\})*\}|\$?'(?:[^'\\]|\\.)*')+", re.S)


def _shell_signs(text: str) -> tuple[str, bool]:
    """Signs of a shell script; words count as keywords only where a command may start."""
    out: list[str] = []
    at, n, start, cut = 0, len(text), True, False
    cases: list[list] = []  # open case blocks: [depth of round brackets, expecting a pattern]
    stack: list[str] = []  # what each open round bracket is: "(" or the double-quoted string around it
    waiting: list[tuple[str, bool]] = []

    def quoted(at: int) -> int:
        nonlocal cut
        m = _DOUBLE.match(text, at)
        end = m.end()
        if m[1].startswith("$("):
            stack.append('"')
            out.append("(")
            return -end
        if m[1].startswith("`"):
            return quoted(end)
        if not m[1]:
            out.append(BAD)
            cut = True
        return end

    def word() -> None:
        nonlocal start, target
        target = False
        if out and out[-1] == "i" and glued:
            pass
        else:
            out.append("i")
        start = False

    glued = target = False  # whether a word goes on, and whether a redirection waits for its word
    while at < n:
        if text[at] == '"':
            word()
            glued = True
            end = quoted(at + 1)
            if end < 0:
                start, at, glued = True, -end, False
            else:
                at = end
            continue
        m = _SHELL.match(text, at)
        kind = m.lastgroup if m.lastgroup != "d" else "t"
        if kind == "a" and (text[at] == "$" or start):
            depth, i = 0, at + (1 if text[at] == "$" else 0)
            while i < n:
                depth += text[i] == "("
                depth -= text[i] == ")"
                i += 1
                if not depth:
                    break
            word()
            glued = True
            if depth:
                out.append(BAD)
                cut = True
            at = i
            continue
        if kind in ("w", "x", "b", "a", "o") and (m2 := _SHELL_WORD.match(text, at)):
            t, at = m2[0], m2.end()
            whole = at >= n or text[at] in " \t\n;&|()<>"
            if not glued and whole and start and t in _SHELL_WORDS and not (cases and cases[-1][1] and t != "esac" and cases[-1][0] == len(stack)):
                sign = _SHELL_WORDS[t]
                out.append(sign)
                if sign == "{C":
                    cases.append([len(stack), None])
                    start = False
                elif t == "esac":
                    if cases:
                        cases.pop()
                    start = False
                elif sign == "{O":
                    start = False
                else:
                    start = sign != "}"
                continue
            if not glued and t == "in" and cases and cases[-1][1] is None and cases[-1][0] == len(stack):
                out.append("n")
                cases[-1][1] = True
                start = True
                continue
            if start and t == "[[" and whole:
                end = re.compile(r"\s\]\](?=[\s;&|)]|\Z)").search(text, at)
                word()
                if end:
                    at = end.end()
                else:
                    out.append(BAD)
                continue
            if not (cases and cases[-1][1] and cases[-1][0] == len(stack)) and t == "function" and start:
                continue
            assigns = start and re.match(r"\w+(?:\[[^\]]*\])?\+?=$", t) and at < n and text[at] == "("
            word()
            glued = True
            if assigns:
                stack.append("a")
                out.append("(")
                at += 1
                glued = False
            continue
        at = m.end()
        if kind in ("h", "c"):
            glued = False
            continue
        if kind == "b":
            word()
            glued = True
            continue
        glued = False
        if target and (kind in ("t", "r", "l", "k") or kind == "o" and m[0] not in ("$(", "<(", ">(")):
            out.append(BAD)
        target = kind == "r" and not re.search(r"(?:\d|-)$", m[0])
        if kind == "t":
            waiting.append((re.sub(r"[\\'\"]", "", m["d"]), m["t"].startswith("<<-")))
        elif kind == "r":
            pass
        elif kind == "l":
            out.append("\n")
            start = True
            for end, tabs in waiting:
                body = re.compile(rf"(?:^|(?<=\n)){'[\t]*' if tabs else ''}{re.escape(end)}(?=\n|\Z)").search(text, at)
                at = body.end() if body else n
                cut |= not body
                if not body:
                    out.append(BAD)
            waiting = []
        elif kind == "k":
            out.append("k")
            if cases:
                cases[-1][1] = True
            start = True
        elif kind in ("o", "a"):
            t = m[0] if kind == "o" else "("
            if kind == "a":
                at = m.start() + 1
            if t in ("(", "$(", "<(", ">("):
                if t == "(" and cases and cases[-1][1] and cases[-1][0] == len(stack):
                    continue
                if t != "(":
                    word()
                stack.append("(")
                out.append("(")
                start = True
            elif t == ")":
                if cases and cases[-1][1] and cases[-1][0] == len(stack):
                    out.append("P")
                    cases[-1][1] = False
                    start = True
                    continue
                out.append(")")
                back = stack.pop() if stack else "("
                start = len(out) > 1 and out[-2] == "("
                if back == '"':
                    end = quoted(at)
                    if end < 0:
                        start, at = True, -end
                    else:
                        start, at, glued = False, end, True
            else:
                out.append({"&&": "o", "||": "o", "|": "o" if not (cases and cases[-1][1] and cases[-1][0] == len(stack)) else "i", "|&": "o", "&": ";", ";": ";"}[t])
                start = True
        elif kind == "x":
            out.append(BAD)
    return "".join(out), cut


def _bash() -> Worded:
    command = r"(?:i|<p>|<b>)+"
    chain = rf"(?:{command}(?:o\n*{command})*)"
    body = rf"\n*(?:{chain}(?:[;\n]\n*))*{chain}?\n*"
    full = rf"\n*{chain}(?:[;\n]\n*{chain})*(?:;|\n)?\n*"
    branch = rf"\n*i+P(?:{full})?\n*(?:k\n*)?"
    rules = {
        "(": [(1, body), (2, r"[i\n]*")],
        "[": [(1, "")],
        "{": [(1, rf"I{full}T{full}(?:E{full}T{full})*(?:L{full})?"), (2, rf"W{full}D{full}"), (4, rf"O(?:i|<p>)*[;\n]*D{full}"), (8, rf"C(?:i|<p>)+\n*n\n*(?:{branch})*"), (16, rf"B{full}")],
        "top": body,
        "end": "\n",
    }
    return Worded(_shell_signs, rules)


LOOSER = {"cpp": _cpp, "csharp": _csharp, "php": _php, "kotlin": _kotlin, "swift": _swift, "scala": _scala, "r": _r, "lua": _lua, "ruby": lambda: Worded(_ruby_signs, RULES), "bash": _bash}
