"""TypeScript and JavaScript taken apart in one pass: what is code, what is text.

A stack of modes says where the pass stands: code, a template, an expression in a
template, JSX text.  Text is blanked, code stays in its place, so positions and
lines of the result are those of the source.
"""

from __future__ import annotations

import re

#: Words after which a slash starts a regular expression, and a ``<`` an element.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default".split())
_STEP = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z0-9_$\u0080-\uffff]+)|(?P<mark>.)""", re.DOTALL)
# Bounded, so that a line of slashes costs no square of its length.
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n]){0,200}\]|[^/\\\[\n]){1,1000}/[a-z]*")
_TEXT = re.compile(r"[^<{]+")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))+", re.DOTALL)
_TAG = re.compile(r"</?(?:[A-Za-z_$][\w$.:-]*)?")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def code_of(text: str, jsx: bool = False) -> str:
    """The text with all that isn't code blank: comments, strings, the text of templates, regular expressions and, if asked, JSX text and tags.

    What ``${}`` and, in JSX, ``{}`` hold is code.  Whatever isn't closed reaches to the end of its line or of the text.
    """
    out: list[str] = []
    # modes: 'code' (with the number of braces open in it), 'template', 'tag' (inside <...>), 'children' (between tags)
    stack: list[list] = [["code", 0]]
    value = True  # whether a value may start here
    i, n = 0, len(text)
    while i < n:
        mode = stack[-1][0]
        if mode == "template":
            if m := _TEMPLATE.match(text, i):
                out.append(_blank(m[0]))
                i = m.end()
            elif text[i] == "`":
                out.append(" ")
                i += 1
                stack.pop()
                value = False
            elif text.startswith("${", i):
                out.append(",{")  # a comma, so that nothing before it is taken for the head of a body
                i += 2
                stack.append(["code", 0])
                value = True
            else:  # a backslash at the end
                out.append(" ")
                i += 1
            continue
        if mode == "children":
            if m := _TEXT.match(text, i):
                out.append(_blank(m[0]))
                i = m.end()
            elif text[i] == "{":
                out.append("{")
                i += 1
                stack.append(["code", 0])
                value = True
            else:
                closing = text.startswith("</", i)
                m = _TAG.match(text, i)
                out.append(_blank(m[0]))
                i = m.end()
                if closing:
                    stack.pop()
                    end = text.find(">", i)
                    end = n if end < 0 else end + 1
                    out.append(_blank(text[i:end]))
                    i, value = end, False
                else:
                    stack.append(["tag", 0])
            continue
        m = _STEP.match(text, i)
        kind, piece = m.lastgroup, m[0]
        if mode == "tag":
            if piece == "{":
                out.append("{")
                stack.append(["code", 0])
                value = True
            elif piece == ">":
                out.append(" ")
                stack.pop()
                if text[i - 1] != "/":
                    stack.append(["children", 0])
                else:
                    value = False
            else:
                out.append(_blank(piece))
            i = m.end()
            continue
        if kind in ("space", "comment"):
            out.append(piece if kind == "space" else _blank(piece))
        elif kind == "string":
            out.append(_blank(piece))
            value = False
        elif kind == "word":
            out.append(piece)
            value = piece in _BEFORE_VALUE
        elif piece == "`":
            out.append(" ")
            stack.append(["template", 0])
        elif piece == "/" and value and (r := _REGEX.match(text, i)):
            out.append(_blank(r[0]))
            i, value = r.end(), False
            continue
        elif piece == "<" and jsx and value and (tag := _TAG.match(text, i)) and (len(tag[0]) > 1 or text.startswith("<>", i)) and not tag[0].startswith("</"):
            out.append(_blank(tag[0]))
            i = tag.end()
            stack.append(["tag", 0])
            continue
        elif piece == "}" and len(stack) > 1 and not stack[-1][1]:
            stack.pop()
            out.append("}")
            value = False
        else:
            if piece == "{":
                stack[-1][1] += 1
            elif piece == "}":
                stack[-1][1] = max(0, stack[-1][1] - 1)
            out.append(piece)
            value = piece not in ")]"
        i = m.end()
    return "".join(out)
