"""Script texts with their template strings and markup elements written as plain expressions.

A template string, or an element in the place of an expression, becomes an empty string that is called with each
expression inside it, so the grammar of the script parses those and nothing else. An element that is not closed in order becomes a sign that no
grammar takes.
"""

from __future__ import annotations

import re

_NEEDED = re.compile(r"\$\{|</|/>")
_CODE = re.compile(r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|[`{}<]|/(?![*/])", re.S)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+(`|\$\{|\Z)", re.S)
_OPENING = re.compile(r"<([A-Za-z][\w.:-]*)?(?!\s+extends\b)(?=[\s/>{])")
_INSIDE = re.compile(r"\s*(?:([\w$][\w$:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=[{<])))?)|(/>)|(>)|(\{))")
_CHILD = re.compile(r"[^<{]*+(?:(\{)|</\s*([\w.:-]*)\s*>|(?=<)|\Z)")
_BEFORE = frozenset("(,=?:&|[{};!>")
_BEFORE_WORD = re.compile(r"\b(?:return|default|yield|case|else|do|typeof|await)$")


def _starts_expression(text: str, at: int) -> bool:
    i = at - 1
    while i >= 0 and text[i].isspace():
        i -= 1
    return i < 0 or text[i] in _BEFORE or (text[i].isalpha() and bool(_BEFORE_WORD.search(text, max(0, i - 9), i + 1)))


def unfolded(text: str, elements: bool) -> str:
    """``text`` with nested template strings, and with ``elements`` markup too, as plain expressions; other texts as they are."""
    if not (m := _NEEDED.search(text)) or (not elements and "${" not in text):
        return text
    out: list[str] = []
    stack: list[list] = []  # what a closing curly bracket goes back to: None for a block, else the state of a template or an element
    at, n = 0, len(text)
    state: list | None = None  # ["template"], or ["tag" or "child", open names]
    while at < n:
        if state is None:
            m = _CODE.search(text, at)
            if not m:
                out.append(text[at:])
                break
            out.append(text[at : m.start()])
            c, at = m[0], m.end()
            if c == "`":
                out.append('""')
                state = ["template"]
            elif c == "{":
                out.append(c)
                stack.append([None])
            elif c == "}":
                back = stack.pop()[0] if stack else None
                out.append("}" if back is None else ")")
                state = back
            elif c == "<":
                tag = _OPENING.match(text, m.start()) if elements and _starts_expression(text, m.start()) else None
                if tag:
                    out.append('""')
                    state, at = ["tag", [tag[1] or ""]], tag.end()
                else:
                    out.append(c)
            elif c == "/":
                literal = _REGEX.match(text, m.start()) if _starts_expression(text, m.start()) else None
                out.append('""' if literal else c)
                at = literal.end() if literal else at
            else:
                out.append(c)
        elif state[0] == "template":
            m = _CHUNK.match(text, at)
            at = m.end()
            if m[1] == "${":
                out.append("(")
                stack.append([state])
            elif not m[1]:
                out.append("\x00")
            state = None
        elif state[0] == "tag":
            m = _INSIDE.match(text, at)
            if not m:
                out.append("\x00")
                state = None
                continue
            at = m.end()
            if m[4]:
                out.append("(")
                stack.append([state])
                state = None
            elif m[2]:
                state[1].pop()
                state = ["child", state[1]] if state[1] else None
            elif m[3]:
                state = ["child", state[1]]
            elif text.startswith("<", at) and (tag := _OPENING.match(text, at)):
                state[1].append(tag[1] or "")
                at = tag.end()
        else:
            m = _CHILD.match(text, at)
            at = m.end()
            if m[1]:
                out.append("(")
                stack.append([state])
                state = None
            elif m[2] is not None:
                if state[1].pop() != m[2]:
                    out.append("\x00")
                    state = None
                elif not state[1]:
                    state = None
            elif text.startswith("<", at) and (tag := _OPENING.match(text, at)):
                state[1].append(tag[1] or "")
                state, at = ["tag", state[1]], tag.end()
            else:
                out.append("\x00")
                state, at = None, at + 1
    if state is not None:
        out.append("\x00")
    return "".join(out)
