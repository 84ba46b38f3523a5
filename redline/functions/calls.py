"""Member calls of a C# text and the sensitive names in their arguments.

One pass over the text's tokens with a stack of open brackets, so time grows
with the length of the text, whatever the nesting.  It is no parser: it knows
strings (verbatim, raw, interpolated with code in their holes), character
literals, comments, directives, brackets and chains of postfix parts
(``a.B(x)[i].C``), and nothing of statements or types.

Names count in the order of a syntax tree's nodes: in a chain the last member
comes first, then what is to its left, then its arguments.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from . import rules as R

#: Longest list of type arguments that is told from a comparison.
TYPE_ARGUMENTS = 256

_TOKEN = re.compile(
    r"(?P<skip>[^\S\n]++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))"
    r"|(?P<line>\n(?:[^\S\n]*+\#[^\n]*+)?+)"
    r"|(?P<raw>(?P<dollars>\$*+)(?P<quotes>\"{3,}+))"
    r"|(?P<open>\$@\"|@\$\"|\$\")"
    r"|(?P<text>@\"(?:[^\"]++|\"\")*+(?:\"|\Z)|\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]|\\[^\n][^'\n]*+)')"
    r"|(?P<name>@?[^\W\d]\w*+)"
    r"|(?P<number>\d[\w.]*+)"
    r"|(?P<mark>\?\.(?!\d)|=>|.)",
    re.S,
)
_TYPES = re.compile(r"<[\w\s.,<>?\[\]]{0,%d}?>(?=\s*+\()" % TYPE_ARGUMENTS)
_NAME = re.compile(r"[^\W\d]\w*+")
#: Words that are no names, and words after which a name is no declaration.
_WORDS = frozenset(
    "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit "
    "extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override "
    "params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint "
    "ulong unchecked unsafe ushort using virtual void volatile while yield when and or not with".split()
)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def sensitive(name: str) -> str | None:
    """Sensitive data type suggested by an identifier (first rule wins)."""
    n = name.lower()
    for needles, dtype in R.IDENTIFIER_RULES:
        if any(n == needle if kind == "equals" else needle in n for kind, needle in needles):
            return dtype
    return None


class _Group:
    """An open bracket: the first sensitive name in it, and its current chain."""

    __slots__ = ("bracket", "first", "filled", "call", "loop", "chain", "before", "found", "receiver", "member", "start", "parts")

    def __init__(self, bracket: str, call: int | None = None, loop: bool = False):
        self.bracket, self.call, self.loop = bracket, call, loop
        self.first, self.filled = None, False
        self.drop()

    def drop(self) -> None:
        """Forget the chain."""
        self.chain, self.before, self.found, self.receiver, self.member, self.start, self.parts = False, None, None, None, None, 0, 0

    def end(self) -> None:
        self.first = self.first or self.before or self.found
        self.drop()

    def begin(self, line: int, found: str | None = None, receiver: str | None = None) -> None:
        """A new chain with its first part."""
        self.end()
        self.chain, self.found, self.receiver, self.start, self.parts = True, found, receiver, line, 1


def _tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, token, line, end).  An interpolated string is ``open``, the tokens of
    its holes between ``hole`` and ``shut``, then ``close``."""
    at, line = 0, 1
    strings: list[tuple[str, str, int]] = []  # opened by, its closing quotes, braces of a hole
    depths: list[int] = []  # open brackets in each hole
    inside = False  # in the text of the innermost string
    if text.startswith("\ufeff"):
        at = 1
    if text[at:].lstrip(" \t").startswith("#"):  # a directive on the first line
        at = text.find("\n") if "\n" in text else len(text)
    while at < len(text):
        if inside:
            how, quotes, braces = strings[-1]
            plain = how == '$"'
            while True:
                c = text[at : at + 1]
                if not c or plain and c == "\n":
                    break
                if c == "\n":
                    line += 1
                elif plain and c == "\\":
                    at += 1
                elif c == '"' and text.startswith(quotes, at):
                    if len(quotes) == 1 and not plain and text.startswith('""', at):
                        at += 1
                    else:
                        break
                elif c == "{":
                    n = 1
                    while text.startswith("{", at + n):
                        n += 1
                    if n >= braces and (braces > 1 or n % 2):
                        at += n - 1
                        break
                    at += n - 1
                at += 1
            inside = False
            if text[at : at + 1] == "{":
                at += 1
                depths.append(0)
                yield "hole", "{", line, at
            else:
                at += 0 if text[at : at + 1] in ("", "\n") else len(quotes)
                strings.pop()
                yield "close", '"', line, at
            continue
        m = _TOKEN.match(text, at)
        kind, token, at = m.lastgroup, m[0], m.end()
        if kind == "skip":
            line += token.count("\n")
            continue
        if kind == "line":
            line += 1
            continue
        if m["raw"]:
            if m["dollars"]:
                strings.append((m["dollars"], m["quotes"], len(m["dollars"])))
                inside = True
                yield "open", token, line, at
            else:
                end = text.find(m["quotes"], at)
                end = len(text) if end < 0 else end + len(m["quotes"])
                yield "text", token, line, end
                line += text.count("\n", at, end)
                at = end
            continue
        if kind == "open":
            strings.append(('$"' if token == '$"' else "$@", '"', 1))
            inside = True
            yield kind, token, line, at
            continue
        if kind == "mark" and depths:
            if token in "([{":
                depths[-1] += 1
            elif token in ")]}" and depths[-1]:
                depths[-1] -= 1
            elif not depths[-1] and token in "}:":  # the hole ends, or its format begins
                if token == ":":
                    while at < len(text) and text[at] not in '}"\n':
                        at += 1
                    at += text[at : at + 1] == "}"
                else:
                    at += sum(text.startswith("}", at + i) for i in range(strings[-1][2] - 1))
                depths.pop()
                inside = True
                yield "shut", "}", line, at
                continue
        yield kind, token, line, at
        line += token.count("\n")


def member_calls(text: str, classify: Callable[[str], str | None] = sensitive) -> list[tuple[int, str | None, str, str | None]]:
    """(line, receiver, method, data type) of every call ``x.Method(arguments)``
    with an argument, in the order of their opening brackets.

    ``line`` is that on which the whole expression begins; ``receiver`` is given
    where it is a single name; the data type is that of the first sensitive
    name in the arguments.  ``x?.Method()`` is no member call, nor is a call that
    is never closed.
    """
    calls: list[list] = []
    stack = [_Group("")]
    kinds: dict[str, str | None] = {}
    after = ""  # the last token if it may make the next name a declaration
    dot = ""  # a dot that waits for its name
    last = ""
    skip_to = 0

    def close(group: _Group) -> None:
        group.end()
        outer = stack[-1]
        if group.call is not None:
            calls[group.call][3] = group.first
            calls[group.call][4] = group.filled
        outer.found = outer.found or group.first

    for kind, token, line, end in _tokens(text):
        if end <= skip_to:
            continue
        top = stack[-1]
        if kind not in ("shut", "close") and token not in _CLOSES:
            top.filled = True
        if kind == "name":
            name = token.lstrip("@")
            if token in _WORDS and not dot:
                top.end()
                if token in ("this", "base", "new", "typeof", "default", "nameof"):
                    top.begin(line)
                after, last = "", token
                continue
            if name not in kinds:
                kinds[name] = classify(name)
            found = kinds[name]
            if dot:
                if dot == "?.":
                    top.before, top.found, top.parts, top.receiver = top.before or top.found, None, 0, None
                    top.member = None
                else:
                    top.member = name
                if not top.chain:
                    top.begin(line)
                top.found = found or top.found
                top.parts += 1
            elif top.chain and last == "new":  # the created type
                top.found, top.parts = found, top.parts + 1
            elif after == "name":  # a type stands before it
                top.begin(line)
            else:
                top.begin(line, found, name)
            dot, after, last = "", "name", "name"
            types = _TYPES.match(text, end) if text[end : end + 1] == "<" else None
            if types:
                if top.parts == 1 and not top.member:
                    top.found = None  # of a generic name alone only the type arguments count
                for t in _NAME.findall(types[0]):
                    if t not in _WORDS:
                        top.found = top.found or classify(t)
                skip_to = types.end()
            continue
        after = ""
        if kind == "mark" and token in (".", "?."):
            if token == "?.":
                top.start = line
            dot, last = token, token
            continue
        if dot:
            dot = ""
            top.end()
        if kind in ("number", "text"):
            top.begin(line)
        elif kind == "open":
            top.begin(line)
            stack.append(_Group('"'))
        elif kind == "hole":
            stack[-1].end()
        elif kind == "shut":
            while len(stack) > 1 and stack[-1].bracket != '"':
                stack.pop()
            stack[-1].end()
        elif kind == "close":
            while len(stack) > 1 and stack[-1].bracket != '"':
                stack.pop()
            if len(stack) > 1:
                close(stack.pop())
        elif token in "([{":
            call = None
            if not top.chain:
                top.begin(line)
            elif token == "(":
                if top.member is not None:
                    call = len(calls)
                    calls.append([top.start, top.receiver if top.parts == 2 else None, top.member, None, None])
            top.member, top.receiver = None, None
            top.parts += 1
            stack.append(_Group(token, call, last in ("for",)))
        elif token in _CLOSES:
            depth = len(stack) - 1
            while depth and stack[depth].bracket != _CLOSES[token] and stack[depth].bracket != '"' and (token == "}" or stack[depth].bracket != "{"):
                depth -= 1
            if depth and stack[depth].bracket == _CLOSES[token]:
                del stack[depth + 1 :]  # never closed
                close(stack.pop())
                if token == "}":
                    stack[-1].end()
        elif token == "=>":
            top.drop()  # parameters are declarations
        elif token == ";":
            while len(stack) > 1 and stack[-1].bracket in "([" and not stack[-1].loop:
                stack.pop()  # never closed
            stack[-1].end()
        elif token != "!":
            top.end()
        last = token
    return [(line, receiver, method, found) for line, receiver, method, found, filled in calls if filled]
