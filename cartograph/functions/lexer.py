"""Tokens of C# and TypeScript source, with offsets.

Enough of both languages to find declarations and their spans: strings of all kinds,
comments, preprocessor lines, regular-expression literals, JSX elements and brackets.  Of
conditional C# only the branch in force is read, where no symbols are defined but those that
the text defines.  A JSX element is one token, as a string is.  Offsets are code points.  An
unclosed string or comment ends with the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

WORD, STRING, PUNCTUATION, COMMENT = "word", "string", "punctuation", "comment"
OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Tokens after which a slash starts a regular expression, besides punctuation.
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def _is_word(c: str) -> bool:
    return c.isalnum() or c in "_$@#" or ord(c) > 127 and not c.isspace()


def _plain_string(source: str, at: int, quote: str) -> int:
    """End of a string with backslash escapes that starts with ``quote`` at ``at``."""
    at += 1
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 2
            continue
        at += 1
        if c == quote or c == "\n" and quote != "`":
            return at
    return len(source)


def _csharp_string(source: str, at: int) -> int | None:
    """End of a C# string or character literal at ``at``; None if there is none."""
    lead = at
    while lead < len(source) and source[lead] in "$@" and lead - at < 8:
        lead += 1
    if lead >= len(source) or source[lead] not in "\"'" or (source[lead] == "'" and lead > at):
        return None
    marks = source[at:lead]
    if source[lead] == "'":
        return _plain_string(source, lead, "'")
    quotes = len(source[lead:]) - len(source[lead:].lstrip('"')) if source.startswith('"""', lead) else 1
    if quotes >= 3:  # raw: closed by as many quotes
        end = source.find('"' * quotes, lead + quotes)
        if end < 0:
            return len(source)
        end += quotes
        while end < len(source) and source[end] == '"':
            end += 1
        return end
    verbatim, holes = "@" in marks, "$" in marks
    i = lead + 1
    while i < len(source):
        c = source[i]
        if c == '"':
            if verbatim and source.startswith('""', i):
                i += 2
                continue
            return i + 1
        if c == "\\" and not verbatim:
            i += 2
            continue
        if holes and c == "{":
            if source.startswith("{{", i):
                i += 2
                continue
            i = _hole(source, i, _csharp_string)
            continue
        if c == "\n" and not verbatim and not holes:
            return i
        i += 1
    return len(source)


def _hole(source: str, at: int, string_at) -> int:
    """End of an interpolation hole whose brace is at ``at``."""
    depth, i = 0, at
    while i < len(source):
        c = source[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        elif c in "\"'`$@" and (end := string_at(source, i)) is not None:
            i = end
            continue
        i += 1
    return len(source)


def _script_string(source: str, at: int) -> int | None:
    quote = source[at]
    if quote in "'\"":
        return _plain_string(source, at, quote)
    if quote != "`":
        return None
    i = at + 1
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            return i + 1
        if c == "$" and source.startswith("${", i):
            i = _hole(source, i + 1, _script_string)
            continue
        i += 1
    return len(source)


def _regex_end(source: str, at: int) -> int | None:
    i, inside = at + 1, False
    while i < len(source) and source[i] != "\n":
        c = source[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "/" and not inside:
            i += 1
            while i < len(source) and source[i].isalpha():
                i += 1
            return i
        i += 1
    return None


_TAG = re.compile(r"[\w$][\w$.:-]*")


def _code(source: str, at: int) -> int | None:
    """End of the braces at ``at`` that hold code in a JSX element."""
    depth, i, before = 0, at, ""
    while i < len(source):
        c = source[i]
        end = None
        if source.startswith("/*", i) or source.startswith("//", i):
            close = source.find("*/" if source[i + 1] == "*" else "\n", i + 2)
            end = len(source) if close < 0 else close + 2 * (source[i + 1] == "*")
        elif c in "\"'`":
            end = _script_string(source, i)
        elif c == "<" and (not before or before in "(,=[{?:&|!;>"):
            end = _jsx(source, i)
        if end is not None:
            i, before = end, ")"
            continue
        depth += (c == "{") - (c == "}")
        if not depth:
            return i + 1
        if not c.isspace():
            before = "(" if c == "n" and source.endswith("return", 0, i + 1) else c
        i += 1
    return None


def _jsx(source: str, at: int) -> int | None:
    """End of the JSX element that starts at ``at``; None if it is something else."""
    tag = _TAG.match(source, at + 1)
    name, i = (tag[0], tag.end()) if tag else ("", at + 1)
    while name and i < len(source) and source[i] != ">":  # attributes
        c = source[i]
        if source.startswith("/>", i):
            return i + 2
        if c == "{":
            i = _code(source, i)
        elif c in "\"'":
            i = source.find(c, i + 1) + 1 or None
        elif c.isspace() or c in "=-:." or _is_word(c):
            i += 1
        else:
            return None
        if i is None:
            return None
    if i >= len(source) or source[i] != ">":
        return None
    i += 1
    while i < len(source):  # text, code and elements
        c = source[i]
        if source.startswith("</", i):
            close = re.compile(r"</\s*" + re.escape(name) + r"\s*>").match(source, i)
            return close.end() if close else None
        end = _jsx(source, i) if c == "<" else _code(source, i) if c == "{" else i + 1
        if end is None:
            return None
        i = end
    return None


_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w+)[ \t]*([^\r\n]*)")


class _Conditions:
    """Which branches of conditional C# are in force."""

    def __init__(self):
        self.symbols: set[str] = set()
        self.taken: list[bool] = []  # of each open #if, whether a branch has been in force

    def holds(self, text: str) -> bool:
        words = re.findall(r"\w+|&&|\|\||[!=]=|[()!]", text.split("//")[0])

        def either() -> bool:
            value = both()
            while words[:1] == ["||"]:
                words.pop(0)
                value = both() or value
            return value

        def both() -> bool:
            value = equal()
            while words[:1] == ["&&"]:
                words.pop(0)
                value = equal() and value
            return value

        def equal() -> bool:
            value = one()
            while words[:1] in (["=="], ["!="]):
                value = (words.pop(0) == "==") == (value == one())
            return value

        def one() -> bool:
            word = words.pop(0) if words else "false"
            if word == "!":
                return not one()
            if word == "(":
                value = either()
                if words[:1] == [")"]:
                    words.pop(0)
                return value
            return word == "true" or word in self.symbols

        return either()

    def after(self, source: str, at: int) -> int:
        """Where to read on after the directive at ``at``: past branches that are not in force."""
        line = _DIRECTIVE.match(source, at)
        if line is None:
            end = source.find("\n", at)
            return len(source) if end < 0 else end
        word, rest = line[1], line[2]
        if word == "define":
            self.symbols |= set(rest.split()[:1])
        elif word == "undef":
            self.symbols -= set(rest.split()[:1])
        elif word == "if":
            self.taken.append(self.holds(rest))
            if not self.taken[-1]:
                return self.skip(source, line.end())
        elif word in ("elif", "else") and self.taken:  # the branch above was in force
            return self.skip(source, line.end())
        elif word == "endif" and self.taken:
            self.taken.pop()
        return line.end()

    def skip(self, source: str, at: int) -> int:
        depth = 0
        while (end := source.find("\n", at)) >= 0:
            line = _DIRECTIVE.match(source, end + 1)
            at = end + 1
            if line is None:
                continue
            at, word = line.end(), line[1]
            if word == "if":
                depth += 1
            elif word == "endif" and depth:
                depth -= 1
            elif word == "endif":
                self.taken.pop()
                return at
            elif not depth and word in ("elif", "else") and not self.taken[-1] and (word == "else" or self.holds(line[2])):
                self.taken[-1] = True
                return at
        return len(source)


def tokenize(source: str, language: str, comments: bool = False) -> list[Token]:
    """Tokens in order; comments only if asked for."""
    sharp = language == "csharp"
    string_at = _csharp_string if sharp else _script_string
    out: list[Token] = []
    last: Token | None = None
    at, size, line_start = 0, len(source), True
    conditions = _Conditions()
    while at < size:
        c = source[at]
        if c == "\n":
            line_start = True
        if c.isspace() or c == "﻿":
            at += 1
            continue
        if sharp and c == "#" and line_start:  # preprocessor line
            at = conditions.after(source, at)
            continue
        line_start = False
        kind, end = PUNCTUATION, at + 1
        if source.startswith("//", at):
            end = source.find("\n", at)
            kind, end = COMMENT, size if end < 0 else end
        elif source.startswith("/*", at):
            end = source.find("*/", at + 2)
            kind, end = COMMENT, size if end < 0 else end + 2
        elif c in "\"'`" or sharp and c in "$@":
            found = string_at(source, at)
            if found is not None:
                kind, end = STRING, min(found, size)
            elif _is_word(c):
                kind = WORD
                while end < size and _is_word(source[end]):
                    end += 1
        elif _is_word(c):
            kind = WORD
            while end < size and _is_word(source[end]):
                end += 1
        elif source.startswith("=>", at):
            end = at + 2
        elif not sharp and c == "/" and (last is None or last.kind == PUNCTUATION and last.text not in (")", "]", "}") or last.text in BEFORE_REGEX):
            found = _regex_end(source, at)
            if found is not None:
                kind, end = STRING, found
        elif not sharp and c == "<" and (last is None or last.kind == PUNCTUATION and last.text not in (")", "]", "}", ">") or last.text in BEFORE_REGEX or last.text == "default"):
            found = _jsx(source, at)
            if found is not None:
                kind, end = STRING, found
        token = Token(kind, source[at:end], at, end)
        if kind != COMMENT:
            last = token
            out.append(token)
        elif comments:
            out.append(token)
        at = end
    return out


def partners(tokens: list[Token]) -> dict[int, int]:
    """Index of each opening bracket to that of its closing one (the last token if none)."""
    out: dict[int, int] = {}
    open_at: list[int] = []
    for k, t in enumerate(tokens):
        if t.kind != PUNCTUATION:
            continue
        if t.text in OPENING:
            open_at.append(k)
        elif t.text in CLOSING:
            while open_at:
                start = open_at.pop()
                out[start] = k
                if OPENING[tokens[start].text] == t.text:
                    break
    for start in open_at:
        out[start] = len(tokens) - 1
    return out


def without_comments(source: str, language: str) -> str:
    """``source`` less its comments; strings that look like comments stay."""
    out, at = [], 0
    for t in tokenize(source, language, comments=True):
        if t.kind == COMMENT:
            out.append(source[at : t.start])
            at = t.end
    return "".join(out) + source[at:]
