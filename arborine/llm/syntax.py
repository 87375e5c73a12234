"""Source files that are no valid text of their language, by minimum-cost syntax repair.

A text becomes one sign per token, its brackets become chart cells (see ``chart``) and what is
left at the top is parsed as the file's statements; in Python, lines and their indentation take
the part of curly brackets and semicolons. Two operator signs that white space keeps from being one operator have a sign
between them. The repair cost of a file is the sum over its constituents; a file of cost 0 is valid. Where the edits fall tells the
kinds of damage apart.

Seven languages have grammars here, the other ten in ``looser``. The grammars take every valid construct they know of and are wider
than the languages in places (types, operators), so a file of cost 0 may still be wrong in a way that only a full parser
sees. Python files of nonzero cost are checked once more by the interpreter's own parser,
which only takes flags away.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.functions.languages import EXTENSIONS
from arborine.llm.chart import CACHED, MOST, Grammar
from arborine.llm.looser import LOOSER
from arborine.llm.unfold import unfolded
from arborine.sources.tables import for_all_cores

#: A token that no language has, and white space inside an operator; every grammar rejects them.
BAD, GAP = "\x00", "\x01"
#: Pairs of operator signs that make one operator and are never two in a row, whatever stands between them (fixed values).
NEVER = frozenset("== != <= -> => :: /= %= ^= |= += -= *= || ..".split())
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?)"
#: Marks of version control and of listings at the start of a line outside strings and comments (fixed values).
CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)
DIFF = re.compile(r"^(?:@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@|(?:---|\+\+\+) [ab]/)", re.M)


def _keywords(table: dict[str, str]) -> dict[str, str]:
    return {word: sign for sign, words in table.items() for word in words.split()}


class Brackets:
    """Lexer and grammar of a language whose blocks are in curly brackets.

    ``unclosed`` matches strings and comments that nothing ends, each as one bad token, so every lexer takes one pass.
    """

    def __init__(self, keywords: dict[str, str], rules: dict, *, comments: str, strings: str, unclosed: str, number: str, newlines: str = "drop", directives: bool = False, words: str = r"[^\W\d][\w$]*", legal: str = "+-*/%&|^<>=!~?:.,;()[]{}@#", never: frozenset[str] = NEVER, unfold=None) -> None:
        self.keywords, self.newlines, self.directives, self.never, self.unfold = _keywords(keywords), newlines, directives, never, unfold
        plain = "".join(c for c in legal if c not in "/.#'\"`$")
        self.token = re.compile(rf"[^\S\n]*+(?:(?P<w>{words})(?![\"'])|(?P<o>[{re.escape(plain)}])|(?P<l>\n)|(?P<c>{comments})|(?P<s>{strings})|(?P<z>{unclosed})|(?P<v>{words})|(?P<n>{number})|(?P<p>[{re.escape(legal)}])|(?P<x>\S)|\Z)", re.S)
        self.grammar = Grammar(rules)

    def signs(self, text: str) -> tuple[str, bool]:
        """One sign per token: brackets and operators as they are, words by keyword or ``i``, numbers ``0``, strings ``"``; and whether the last token has no end."""
        keyword, never, out, end = self.keywords.get, self.never, [], -1
        add, before, ended, cut = out.append, "", -1, False
        for m in self.token.finditer(text):
            kind = m.lastgroup
            if kind in ("o", "p"):
                c = m[kind]
                if before and m.end() - 1 != ended and before + c in never:
                    add(GAP)
                add(c)
                before, ended = c, m.end()
                continue
            if kind == "l":
                add("\n")
                continue
            if kind == "c":
                if "\n" in m[0]:
                    add("\n")
                continue
            if kind in ("w", "v"):
                t = m[kind]
                if t[0] == "'":
                    add("'")
                    t = ""
                add(BAD if m.start(kind) == end else keyword(t, "i"))
            elif kind == "s":
                add('"')
            elif kind == "n":
                add("0")
                end = m.end()
            elif kind == "z":
                add(BAD)
                cut = m.end() >= len(text.rstrip())
            elif kind == "x":
                add(BAD)
            before = ""
        return "".join(out), cut

    def cost(self, text: str) -> tuple[int, float, bool, bool]:
        """The cost, where at the top the first edit falls, whether the text stops short and whether the cost is exact."""
        if self.directives:
            text = re.sub(r"^[ \t]*#[ \t]*(?:include|include_next|define|undef|ifn?def|if|elif|else|endif|pragma|error|warning|line|region|endregion|nullable)\b(?:[^\n\\]|\\.|\\\n)*", "", text, flags=re.M)
        if self.unfold:
            text = self.unfold(text)
        signs, cut = self.signs(text)
        if self.newlines == "drop":
            signs = signs.replace("\n", "")
        elif self.newlines == "js":
            signs = re.sub(r"\n+(?=[.,:?=*/%&|^<>)\]}]|\+(?!\+)|-(?!-))|(?<=[=.,;:?*/%&|^<>!({\[VNK])\n+|(?<=[^+]\+)\n+|(?<=[^-]-)\n+|(?<=\))\n+(?=\{)", "", signs)
            signs = re.sub(r"\n+", "\n", signs)
        else:
            signs = re.sub(r"(?<![i0\"RB)\]}T+-])\n+|(?<=[^+]\+)\n+|(?<=[^-]-)\n+|^\n+", "", signs)
            signs = re.sub(r"\n+", "\n", signs)
        flat, cost, exact, still_open = self.grammar.reduce(signs)
        flat += self.grammar.end
        where = 1.0
        if not self.grammar.top.accepts(flat):
            edits, at = self.grammar.top.repair(flat)
            cost += edits
            exact &= edits <= MOST
            where = at / max(len(flat), 1)
        return cost, where, still_open or cut, exact


_SLASHES = r"/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n]*"


def _javascript(typed: bool, elements: bool) -> Brackets:
    word, name, group = "[ifoatmyEU]", "[A-Za-z]", "(?:<p>|<s>|<b>)"
    kind = rf"(?:[ifoatmyUMnNKF0\".&|?>!]|=>|X|<(?:[ifoatmyUnK0X\".&|?,:>\[\]<=]|{group})+|{group})+"
    kind = rf"{kind}(?::{kind})*" if typed else kind
    of = rf"(?::(?:{kind}))?" if typed else ""
    generic = r"(?:<[^();{}]*>)?" if typed else ""
    function = rf"a?F\*?{word}?{generic}<p2>{of}<b1>"
    klass = rf"K{word}?{generic}(?:X(?:{word}|[.,X<>]|<p>|<s>{f'|{generic}' if typed else ''})+)*<b4>"
    before = rf"(?:[-+!~NUa]|\+\+|--|\.\.\.|a?(?:{word}|{generic}<p2>{of})=>{'|<[^();{}]*>' if typed else ''})*"
    prime = rf"(?:{word}|0|\"|#{name}|<p1>|<s1>|<b3>|{function}|{klass}|M<p1>|M\.i|N\.i)"
    after = rf"(?:\??\.{name}|\?\.|\.#{name}|<p1>|<s1>|\+\+|--|\"{f'|!|t(?:{kind}|V)|<[^();{{}}]*><p1>' if typed else ''})*"
    one = before + prime + after
    op = r"(?:[-+*/%&|^<>=!]{1,4}|\?\??=?|:|[no]|,+|\?:)"
    es = rf"({one}(?={op}))"
    e = rf"({one}(?={op.replace('|,+', '')}))"
    head = r"(?:I<p1>|W<p1>|O[aU]?<p4>|L|D|Y|H<p>?|Z|JE?|[ifoatmy]:|@i(?:\.i)*<p1>?)\n?"
    module = rf"M(?:y?{word}?(?:,?(?:<b>|\*ti))?f)?\"(?:[i]<b>)?|M{word}={e}|J(?:y?<b>|\*(?:ti)?)(?:f\")?|J={e}"
    alias = rf"|m?y{word}{generic}=\|?{kind}[;\n]|m+V{word}{of}(?:,{word}{of})*[;\n]|m?a?F{word}?{generic}<p2>{of}[;\n]|m?y(?:{word}|\.|\")+{generic}(?:X{kind}(?:,{kind})*)?<b>|V?y{word}<b>|m?F{word}{generic}<p2>{of}[;\n]|mi<b>" if typed else ""
    block = rf"(?:<b1>|m*{function}|m*{klass}|S<p1><b8>{alias})"
    statement = rf"(?:(?:{head})*(?:(?:m*V|[RTB])?{es}?[;\n]+|(?:{module})[;\n]+|{block}[;\n]*))"
    param = rf"(?:(?:@i<p>?)*m*(?:\.\.\.)?(?:{word}|<s>|<b>)\??{of}(?:={e})?)"
    key = rf"(?:{name}|0|\"|<s1>|#{name})"
    prop = rf"(?:(?:{name}:)?{e}|{name}|[am]*\*?{key}{generic}<p2>{of}<b1>)"
    member = rf"(?:(?:@i(?:\.i)*{generic}<p1>?\n?)*[am]*\*?(?:{key}[?!]?)?(?:{generic}<p2>{of}<b1>[;\n]*|{generic}<p2>{of}[;\n]+|{of}(?:={e})?[;\n]+)|m<b1>\n*)"
    field = rf"(?:m*(?:{key}|<s>|-|\+)*\??(?:{generic}<p2>{of}|{of}(?:={e})?)[;,\n]*)"
    rules = {
        "(": [(1, rf"(?:{es},?)?"), (2, rf"({param}(?=,))?,?"), (4, rf"(?:V?{es})?;{es}?;{es}?|V?{es}"), *([(16, kind)] if typed else [])],
        "[": [(1, rf",*(?:{es},*)?{f'|(?:{kind},?)*' if typed else ''}")],
        "{": [(1, rf"[;\n]*{statement}*"), (2, rf"({prop}(?=,))?,?\n"), (4, rf"[;\n]*{member}*"), (8, rf"(?:\n*(?:C{es}|E):\n*{statement}*)*\n*"), *([(16, rf"\n*{field}*|({word}(?:={e})?(?=,))?,?\n|(?:{kind}:{kind}[;\n]*)*")] if typed else [])],
        "top": rf"[;\n]*{statement}*",
        "end": "\n",
    }
    keys = {
        "V": "const let var", "F": "function", "K": "class", "X": "extends implements", "R": "return", "T": "throw", "I": "if", "L": "else", "W": "while with", "O": "for", "D": "do",
        "S": "switch", "C": "case", "E": "default", "Y": "try", "H": "catch", "Z": "finally", "B": "break continue", "N": "new", "U": "typeof void delete await yield keyof", "M": "import", "J": "export",
        "f": "from", "o": "of", "n": "in instanceof", "a": "async", "t": "as satisfies" if typed else "as",
        "m": "static get set" + (" public private protected readonly abstract declare override" if typed else ""), "y": "interface enum namespace module type" if typed else "",
    }
    strings = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|(?:(?<=[=(,:;!&|?{}\[])|(?<=[=(,:;!&|?{}\[] )|(?<=\breturn )|(?<=\breturn)|(?<=^)|(?<=\n))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*'
    never = (NEVER | {"&&", "??", ">=", "?."}) - ({"!=", ">="} if typed else set())
    return Brackets(
        keys, rules, comments=_SLASHES + r"|\A#![^\n]*", strings=strings, unclosed=r"/\*[\s\S]*|`[\s\S]*|[\"'][^\n]*", number=rf"{_NUMBER}n?", newlines="js", words=r"(?:[^\W\d]|\$)[\w$]*", never=never, unfold=lambda t: unfolded(t, elements)
    )


def _java() -> Brackets:
    inside = r"(?:[ipm.&?<>XU,]|<s>)"
    kind = rf"(?:(?:[ip]\.?)+(?:<{inside}*>)?(?:\.i)*(?:<s>)*)"
    note = r"(?:(?:@i(?:\.i)*<p1>?)|m)*"
    prime = rf"(?:i|p|0|\"|<p1>|<b2>|N(?:[ip.]|<{inside}*>)+(?:<p1><b4>?|(?:<s1>)+<b2>?|<b2>)|p?(?:<s>)*\.K|S<p1><b8>)"
    after = r"(?:\.(?:<[^<>;]*>)?[iKN]|::[iN]|<p1>|<s1>|\+\+|--)*"
    before = r"(?:[-+!~]|\+\+|--|<p1>|(?:i|<p2>)->)*"
    one = rf"{before}(?:{prime}{after}|<b1>)"
    op = r"(?:[-+*/%&|^<>=!]{1,4}|\?|:|n[mF]?)"
    es = rf"({one}(?=(?:{op}|,)))"
    e = rf"({one}(?={op}))"
    head = r"(?:I<p1>|W<p1>|O<p4>|L|D|i:|s<p1>|Y<p4>?|H<p2>|Z)"
    klass = rf"(?:{note}@?Ki(?:<[^();{{}}]*>)?<p2>?(?:X(?:{inside})+)*<b4>)"
    statement = rf"(?:{head}*(?:(?:{note}{kind}|[RTBA])?{es}?;|<b1>|S<p1><b8>|{klass}))"
    param = rf"(?:{note}{kind}(?:\.\.\.)?(?:\|{kind})*i(?:<s>)*)"
    member = rf"(?:{note}(?:<[^();{{}}=]*>)?(?:{kind}?i<p2>(?:<s>)*(?:X(?:{inside})+)?(?:E{e})?(?:<b1>|;)|{kind}{es};|i<b1>|<b1>)|{klass}|;)"
    constant = r"((?:@i<p1>?)*i<p1>?<b4>?(?=,))"
    rules = {
        "(": [(1, rf"{es}?|({kind}(?=&))"), (2, rf"({param}(?=,))?|(i(?=,))"), (4, rf"(?:{note}{kind})?{es}?;{e}?;{es}?|{note}{kind}i:{e}|(?:(?:{note}{kind})?{e};?)*")],
        "[": [(1, rf"{e}?")],
        "{": [(1, rf"{statement}*"), (2, rf"(?:{es},?)?"), (4, rf"(?:{constant},?;?)?{member}*"), (8, rf"(?:(?:C(?:{es}|{kind}(?:i|<p2>))(?:i{es})?|m)(?::|->){statement}*)*")],
        "top": rf"(?:(?:@i(?:\.i)*<p1>?)*Pi(?:\.i)*;)?(?:;|Mm?i(?:\.i)*(?:\.\*)?;)*(?:{klass};*)*",
    }
    keys = {
        "P": "package", "M": "import", "K": "class interface enum record", "X": "extends implements throws super permits", "m": "public private protected static final abstract native transient volatile strictfp sealed default", "s": "synchronized",
        "R": "return", "T": "throw", "I": "if", "L": "else", "W": "while", "O": "for", "D": "do", "S": "switch", "C": "case", "Y": "try", "H": "catch", "Z": "finally", "B": "break continue", "A": "assert", "N": "new", "n": "instanceof",
        "p": "int long double float boolean byte short char void",
    }
    return Brackets(keys, rules, comments=_SLASHES, unclosed=r'/\*[\s\S]*|"""[\s\S]*|["\'][^\n]*', never=NEVER | {">=", "&&"}, strings=r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?!"")(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.[0-9a-fA-F]*)\'', number=rf"{_NUMBER}[lLfFdD]?", words=r"(?:[^\W\d]|\$)[\w$]*")


def _go() -> Brackets:
    kind = r"(?:i|\.|\*|\.\.\.|<s>|m<s>|c|<-|F<p>|T<b>|<p>|~)+"
    prime = rf"(?:i|m<p1>|0|\"|<p1>|F<p2>(?:{kind})?<b1>|(?:[*]|m?<s>)+(?:{kind})?(?:<b2>|<p1>)|T<b>(?:<b2>)?|c{kind}|<b2>)"
    after = r"(?:\.i|\.<p>|<p1>|<s1>|<b2>|\.\.\.)*"
    one = rf"(?:[-+!^*&r]|<-)*{prime}{after}(?:\+\+|--)?"
    op = r"(?:[-+*/%&|^<>=!]{1,3}|:=)"
    es = rf"({one}(?=(?:{op}|,)))"
    e = rf"({one}(?={op}))"
    spec = rf"i(?:,i)*(?:{kind})?(?:={es})?"
    cond = rf"{es}?(?:;{es}?)*"
    function = rf"F<p2>?i<s>?<p2>(?:{kind})?<b1>?"
    alias = rf"y(?:i<s>?=?{kind}|<p8>)"
    control = rf"((?:[IOS]{cond})?(?:<b1>|<b4>)(?=L))"
    statement = rf"(?:(?:i:\n*)?(?:[RBD]?{es}?|V{spec}|V<p8>|{alias}|{control})[;\n]+)"
    param = rf"(?:i(?:,i)*(?:{kind})?|{kind})"
    rules = {
        "(": [(1, rf"(?:{es}|{kind}(?:,{es})?)?,?|y"), (2, rf"({param}(?=,))?,?"), (4, r"\n*(?:[i.]?\"[;\n]*)*"), (8, rf"[;\n]*(?:(?:{spec}|i<s>?=?{kind})[;\n]*)*")],
        "[": [(1, rf"{e}?(?::{e}?)*|(i?(?:{kind})(?=,))|\.\.\.")],
        "{": [(1, rf"[;\n]*{statement}*"), (2, rf"((?:{e}:)?{e}(?=,))?,?\n"), (4, rf"\n*(?:(?:C(?:{es}|{kind})|E):\n*{statement}*)*"), (8, rf"[;\n]*(?:(?:(?:i(?:,i)*)?(?:{kind})|i<p2>(?:{kind})?|{kind}(?:\|{kind})*)\"?[;\n]+)*")],
        "top": rf"[;\n]*Ki[;\n]+(?:M(?:[i.]?\"|<p4>)[;\n]+)*(?:(?:{function}|V{spec}|V<p8>|{alias})[;\n]+)*",
        "end": "\n",
    }
    keys = {
        "K": "package", "M": "import", "F": "func", "y": "type", "V": "var const", "I": "if", "L": "else", "O": "for", "S": "switch select", "C": "case", "E": "default", "R": "return", "B": "break continue goto fallthrough",
        "D": "defer go", "r": "range", "T": "struct interface", "m": "map", "c": "chan",
    }
    return Brackets(keys, rules, comments=_SLASHES, unclosed=r'/\*[\s\S]*|`[\s\S]*|["\'][^\n]*', never=NEVER | {">=", ":="}, strings=r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.[0-9a-fA-Fx]*)\'', number=rf"{_NUMBER}i?", newlines="go", legal="+-*/%&|^<>=!~:.,;()[]{}")


def _rust() -> Brackets:
    kind = r"(?:[iqmFAOcux&*.<>+?!\"0XH']|::|->|=|<p>|<s>)+"
    generic = r"(?:<[^;{}\ue200-\ue2ff]*>)?"
    wide = r"(?:[iqmFAOcux&*.<>+?!\"0XH',:-]|=|<p>|<s>)+"
    pat = r"(?:[iqmc&|@.:_\"0-]|\.\.=|<p>|<s>|<b>)+"
    flat = r"(?:[iqm0\".:&*!<>=+\-/%^|?,anVx]|<p>|<s>|<b>)+"
    control = rf"(?:'i:)?(?:O{pat}n{flat}|W{flat}|l|u|q+|I{flat}|M{flat})?(?:<b1>|<b4>)(?:L(?:I{flat})?<b1>)*"
    prime = rf"(?:i(?:::(?:i|<[^;{{}}]*>))*(?:!(?:<p64>|<s64>|<b64>)|<b2>)?|\.\.|0|\"|<p1>|<s1>|{control}|[RB](?:'i)?)"
    after = rf"(?:\.(?:i|0|w)(?:::<[^;{{}}]*>)?|\?|<p1>|<s1>|a{kind})*"
    before = rf"(?:[-!*&qm]|::|R|V{pat}=|B(?:'i)?|\.\.=?|\|(?:(?:{pat})(?::{kind})?,?)*\|(?:->{kind})?)*"
    es = rf"(?:({before}{prime}{after}(?=(?:[-+*/%&|^<>=!]{{1,3}}|\.\.=?)))(?:\.\.)?)"
    trees = r"[^\x00\x01]*"
    attr, vis, where = r"(?:#!?<s64>)*", r"(?:p<p>?)?", rf"(?:H{wide})?"
    use = rf"{attr}{vis}G(?:[i:*a]|<b64>)+;"
    item = (
        rf"{attr}(?:{vis}[qcux\"]*Fi{generic}<p2>(?:->{wide})?{where}(?:<b1>|;)|{vis}Ti{generic}{where}(?:<b8>|<p>?{where};)|{vis}Ni{generic}{where}<b16>|{vis}u?Ji{generic}(?::{kind})?{where}<b32>"
        rf"|u?A{generic}!?{wide}(?:O{wide})?{where}<b32>|{vis}Ui(?:;|<b32>)|{vis}[cS]m?i:{kind}={es};|{vis}yi{generic}(?::{kind})?(?:={wide})?{where};|i!i?(?:<b64>|<p64>;|<s64>;)|u?x\"?<b32>|{vis}xii(?:ai)?;)"
    )
    statement = rf"(?:{attr}(?:V{pat}(?::{kind})?=)?{es}(?:L<b1>)?;|{attr}V{pat}(?::{kind})?;|{attr}{control};?|{use}|{item}|;)"
    param = rf"(?:{attr}(?:{pat})(?::{wide})?)"
    fields = rf"({attr}{vis}i:{wide}(?=,))"
    rules = {
        "(": [(1, rf"({es}(?=,))?,?"), (2, rf"({param}(?=,))?,?"), (4, rf"(?:(?:{attr}{vis}{kind}|,))*"), (64, trees)],
        "[": [(1, rf"({es}(?=[,;]))?,?|{kind}(?:;{es})?"), (2, r"[^;{}\x00\x01]*"), (64, trees)],
        "{": [(1, rf"(?:{statement})*(?:{attr}{es})?"), (2, rf"((?:{attr}[i0](?::{es})?|\.\.{es}?)(?=,))?,?"), (4, rf"(?:{attr}{pat}(?:I{flat})?=>(?:{es},?))*"), (8, rf"{fields}?,?"), (16, rf"({attr}i(?:<p>|<b>)?(?:={es})?(?=,))?,?"), (32, rf"(?:{item}|{use})*"), (64, trees)],
        "top": rf"(?:{attr}|{use}|{item}|;)*",
    }
    keys = {
        "F": "fn", "V": "let", "I": "if", "L": "else", "W": "while", "O": "for", "n": "in", "l": "loop", "M": "match", "R": "return", "B": "break continue", "T": "struct union", "N": "enum", "J": "trait", "A": "impl", "G": "use", "U": "mod",
        "p": "pub", "q": "async move ref dyn", "m": "mut", "c": "const", "S": "static", "u": "unsafe", "y": "type", "H": "where", "a": "as", "x": "extern", "w": "await",
    }
    strings = r'b?r"[^"]*"|[bc]?r(?P<raw>#+)"[\s\S]*?"(?P=raw)|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))\''
    nested = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|/\*(?:[^*]++|\*(?!/))*+\*/)*+\*/|//[^\n]*"
    return Brackets(keys, rules, comments=nested, unclosed=r'/\*[\s\S]*|"[\s\S]*', never=NEVER - {"||"}, strings=strings, number=r"(?:0[xob][0-9a-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?:[iuf](?:8|16|32|64|128|size))?", legal="+-*/%&|^<>=!?:.,;()[]{}@#$'", words=r"(?![bc]?r#+\")(?:r#)?[^\W\d]\w*|'[^\W\d]\w*+(?!')")


def _c() -> Brackets:
    spec = r"(?:[tm]|i<p>?|T(?:i<p>)?(?:i?<b4>|i?<b8>|i))+"
    name = r"(?:[*m]*(?:i|<p8>)(?:<s>|<p2>)*(?::0)?(?:i<p>?)*)"
    prime = r"(?:i|0|(?:\"|i)+|<p1>|<p2><b2>|z<p>?|<b2>)"
    one = rf"(?:[-+!~*&z]|\+\+|--|<p2>|<p16>)*{prime}(?:\.i|->i|<p1>|<s1>|\+\+|--)*"
    op = r"(?:[-+*/%&|^<>=!]{1,3}|\?|:)"
    es = rf"({one}(?=(?:{op}|,)))"
    e = rf"({one}(?={op}))"
    var = rf"({name}(?:={e})?(?=,))"
    head = r"(?:I<p1>|W<p1>|O<p4>|L|D|i:|C[^;{}:]+:|E:)"
    statement = rf"(?:{head}*(?:{spec}{var}?;|R?{es}?;|B;|Gi;|<b1>|S<p1><b1>))"
    param = r"(?:(?:[tm]|i<p>?|Ti)+[*m]*(?:i|<p8>)?(?:<s>|<p2>)*|\.\.\.)"
    item = rf"(?:{spec}[*m]*i<p2>(?:i<p1>?)*<b1>|{spec}{var}?;|;|i<p1>;?|m\"(?:<b16>|{spec}{var}?;))"
    rules = {
        "(": [(1, rf"{es}?"), (2, rf"({param}(?=,))?"), (4, rf"(?:{spec}{var}|{es})?;{es}?;{es}?"), (8, r"(?:[*mi]|<s>|<p2>)+"), (16, r"(?:[tmi]|Ti)+\**(?:<s>)*")],
        "[": [(1, rf"m*{e}?")],
        "{": [(1, rf"{statement}*{head}*"), (2, rf"((?:(?:\.i|<s>)+=)?{e}(?=,))?,?"), (4, rf"(?:{spec}{var}?;)*"), (8, rf"(i(?:={e})?(?=,)),?"), (16, rf"{item}*i?")],
        "top": rf"{item}*i?",
    }
    keys = {
        "t": "int long double float char short void unsigned signed _Bool bool size_t", "m": "static const extern inline volatile register restrict typedef auto _Noreturn", "T": "struct enum union", "R": "return", "B": "break continue", "G": "goto", "I": "if", "L": "else",
        "W": "while", "O": "for", "D": "do", "S": "switch", "C": "case", "E": "default", "z": "sizeof",
    }
    return Brackets(keys, rules, comments=_SLASHES, unclosed=r'/\*[\s\S]*|["\'][^\n]*', never=NEVER | {">="}, strings=r'[LuU]?"(?:[^"\\\n]|\\.)*"|[LuU]?\'(?:[^\'\\\n]|\\.)+\'', number=rf"(?:0[xX][0-9a-fA-F.]+(?:[pP][+-]?\d+)?|{_NUMBER})[uUlLfF]*", directives=True, legal="+-*/%&|^<>=!~?:.,;()[]{}")


class Python:
    """Lexer and grammar of Python 3, with indentation in the place of curly brackets."""

    KEYWORDS = _keywords({
        "d": "def", "k": "class", "a": "async", "w": "await", "I": "if", "e": "elif", "L": "else", "O": "for", "W": "while", "Y": "try", "H": "except", "Z": "finally", "C": "with", "R": "return", "T": "raise", "M": "import", "F": "from",
        "A": "as", "l": "lambda", "n": "not", "b": "and or in is", "P": "pass break continue", "G": "global nonlocal", "D": "del", "S": "assert", "Q": "yield",
    })
    TOKEN = re.compile(
        rf"(?P<s>[rRbBuUfFtT]{{0,2}}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*'))|(?P<c>#[^\n]*|\\\n)|(?P<z>[rRbBuUfFtT]{{0,2}}(?:\"\"\"[\s\S]*|'''[\s\S]*|[\"'][^\n]*))|(?P<w>[^\W\d]\w*)"
        rf"|(?P<n>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)[jJ]?)|(?P<h>[ \f\t]+)|(?P<l>\n)|(?P<o>[-+*/%@&|^<>=!~:.,;()\[\]{{}}])|(?P<x>.)",
        re.S,
    )
    ZERO = re.compile(r"0\d*[1-9]\d*$")

    def __init__(self) -> None:
        lam = r"l(?:\**i?(?:=[^:]+)?,?)*:"
        prime = r"(?:i|0|\"+|<p1>|<s>|<b>|\.\.\.|Q)"
        after = r"(?:\.i|<p1>|<s>)*"
        one = rf"(?:[-+~nw]|\*\*?|{lam}|QF?)*{prime}{after}"
        op = r"(?:[-+*/%@&|^<>]{1,2}|[=!<>]=|:=|b|bn|nb|I|L)"
        e = rf"(?:{one}(?:{op}{one})*)"
        es = rf"(?:{e}(?:,{e})*,?)"
        simple = rf"(?:{es}(?:(?:={es})*|:{e}(?:={es})?|(?:[-+*/%@&|^]|//|\*\*|<<|>>)={es})|R{es}?|T(?:{e}(?:F{e})?)?|P|Mi(?:\.i)*(?:Ai)?(?:,i(?:\.i)*(?:Ai)?)*|F\.*(?:i(?:\.i)*)?M(?:\*|i(?:Ai)?(?:,i(?:Ai)?)*|<p2>)|Gi(?:,i)*|D{es}|S{e}(?:,{e})?|ii<s>?={e})"
        line = rf"{simple}(?:;{simple})*;?"
        comp = rf"(?:a?O{es}(?:I{e})*)"
        arg = rf"(?:\**{e}|i={e}|{e}{comp}+)"
        param = rf"(?:\*\*?i?|i|/)(?::\*?{e})?(?:={e})?"
        with_ = rf"{e}(?:A{e})?"
        head = rf"(?:a?di<s>?<p4>(?:->{e})?:|ki<s>?<p1>?:|I{e}:|e{e}:|L:|a?O{es}:|W{e}:|Y:|H(?:\*?{es}(?:Ai)?)?:|Z:|a?C{with_}(?:,{with_})*,?:|ii?(?:{es}|{e}(?:Ai)?(?:I{e})?):|i{es}(?:Ai)?(?:I{e})?:)"
        piece = rf"{e}?(?::{e}?(?::{e}?)?)?"
        rules = {
            "(": [(1, rf"(?:{arg}(?:,{arg})*,?)?"), (2, r"i(?:Ai)?(?:,i(?:Ai)?)*,?"), (4, rf"(?:{param}(?:,{param})*,?)?")],
            "[": [(1, rf"(?:{piece}(?:,{piece})*,?)|{e}{comp}+|(?:i=?{e}?,?)*")],
            "{": [(1, rf"(?:(?:\*\*{e}|{e}:{e}|{e})(?:,(?:\*\*{e}|{e}:{e}|{e}))*,?)?|{e}(?::{e})?{comp}+")],
        }
        self.grammar = Grammar(rules)
        expanded = Grammar({"(": [], "[": [], "{": [], "top": rf"(?:@{e}|{head}(?:{line})?|{line})"})
        self.line = expanded.top
        self.head = Grammar({"(": [], "[": [], "{": [], "top": head}).top
        self._lines: dict[str, tuple[int, bool]] = {}

    NEVER = NEVER | frozenset(">= // << >> := &= @= **".split()) - {"||", "::", ".."}

    def signs(self, text: str) -> tuple[list[str], list[int], int, bool]:
        """The logical lines, one sign per token, their indentation, the open brackets at the end and whether the last token has no end."""
        keyword, lines, pads, row = self.KEYWORDS.get, [], [], []
        pad, depth, fresh, end = 0, 0, True, -1
        before, ended, cut = "", -1, False
        for m in self.TOKEN.finditer(text):
            kind, t = m.lastgroup, m[0]
            if kind == "h":
                if fresh:
                    pad = len(t.expandtabs(8))
                continue
            if kind == "l":
                if depth <= 0 and row:
                    lines.append("".join(row))
                    pads.append(first)
                    row = []
                if depth <= 0:
                    fresh, pad, depth = True, 0, 0
                continue
            if kind == "c":
                continue
            if fresh:
                first, fresh = pad, False
            if kind != "o":
                before = ""
            if kind == "w":
                row.append(BAD if m.start() == end else keyword(t, "i"))
            elif kind == "o":
                if before and ended != m.start() and before + t in self.NEVER:
                    row.append(GAP)
                row.append(t)
                before, ended = t, m.end()
                depth += 1 if t in "([{" else -1 if t in ")]}" else 0
            elif kind == "s":
                row.append('"')
            elif kind == "n":
                row.append(BAD if self.ZERO.match(t) or m.start() == end else "0")
                end = m.end()
            else:
                row.append(BAD)
                cut = kind == "z" and m.end() >= len(text.rstrip())
        if row:
            lines.append("".join(row))
            pads.append(first)
        return lines, pads, depth, cut

    def cost(self, text: str) -> tuple[int, float, bool, bool]:
        lines, pads, depth, cut = self.signs(text)
        cost, where, stack, deeper, exact = 0, 1.0, [0], False, True
        for k, (line, pad) in enumerate(zip(lines, pads)):
            got = self._lines.get(line)
            if got is None:
                flat, c, sure, _ = self.grammar.reduce(line)
                if not self.line.accepts(flat):
                    extra = self.line.repair(flat)[0]
                    c += extra
                    sure &= extra <= MOST
                opens = self.head.accepts(flat)
                if len(self._lines) > CACHED:
                    self._lines.clear()
                got = self._lines[line] = (c, opens, sure)
            c, opens, sure = got
            exact &= sure
            if deeper:
                if pad > stack[-1]:
                    stack.append(pad)
                else:
                    c += 1
            elif pad > stack[-1]:
                c += 1
            if pad < stack[-1]:
                while stack[-1] > pad:
                    stack.pop()
                if stack[-1] != pad:
                    c += 1
                    stack.append(pad)
            if c:
                where = min(where, k / len(lines))
                cost += c
            deeper = opens
        if deeper:
            cost, where = cost + 1, min(where, 1.0)
        return cost, where, deeper or depth > 0 or cut, exact


@cache
def _parser(language: str):
    made = {
        "python": Python, "javascript": lambda: _javascript(False, True), "typescript": lambda: _javascript(True, False), "tsx": lambda: _javascript(True, True), "java": _java, "go": _go, "rust": _rust, "c": _c,
    }
    return made[language]() if language in made else LOOSER[language]()


def repair(text: str | None, language: str) -> tuple[int, str, bool]:
    """The repair cost of ``text``, the kind of damage (``''`` at cost 0, else conflict, diff, truncation, mismatch or syntax) and whether the cost is exact.

    Null, empty and blank texts cost 0. A constituent that needs more than ``MOST`` edits counts as ``MOST`` + 1; the cost is then the
    least it can be.
    """
    if text is None or not text.strip():
        return 0, "", True
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text[0] == "\ufeff":
        text = text[1:]
    cost, where, short, exact = _parser(language).cost(text)
    if not cost:
        return 0, "", True
    if len(CONFLICT.findall(text)) >= 2:
        kind = "conflict"
    elif DIFF.search(text):
        kind = "diff"
    elif short:
        kind = "truncation"
    elif cost > 2 * MOST and where < 0.3:
        kind = "mismatch"
    else:
        kind = "syntax"
    return cost, kind, exact


def _python_takes(text: str) -> bool:
    """Whether the interpreter's own parser takes the text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def checked(text: str | None, language: str) -> tuple[int, str, bool]:
    """``repair``, with the exact check behind it for Python."""
    cost, kind, exact = repair(text, language)
    if cost and language == "python" and _python_takes(text):
        return 0, "", True
    return cost, kind, exact


def syntax_repairs(documents: DataFrame) -> DataFrame:
    """(doc_id, repo, language, cost, damage, exact) of every document whose ``path`` has a supported extension.

    ``cost`` is 0 for valid, null, empty and blank texts; where ``exact`` is false it is a lower bound. Repeated rows and texts each give a row, a null ``doc_id``
    or ``repo`` stays null, an empty table gives no rows, other columns (``lang`` too) are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, languages, costs, kinds, sure = [], [], [], [], []
            for i, (path, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                language = EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower())
                if language:
                    cost, kind, exact = checked(text, language)
                    keep.append(i)
                    languages.append(language)
                    costs.append(cost)
                    kinds.append(kind)
                    sure.append(exact)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(languages, pa.string()), pa.array(costs, pa.int64()), pa.array(kinds, pa.string()), pa.array(sure, pa.bool_())], ["doc_id", "repo", "language", "cost", "damage", "exact"]
            )

    rows = documents.where(F.col("path").contains(".")).select("doc_id", "repo", "path", "text")
    return for_all_cores(rows, "doc_id").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, repo string, language string, cost bigint, damage string, exact boolean")


def syntax_rates(repairs: DataFrame) -> DataFrame:
    """Per repo and language: (repo, language, files, broken, rate)."""
    return repairs.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("cost") > 0).alias("broken"), F.round(F.avg((F.col("cost") > 0).cast("double")), 6).alias("rate")
    )
