"""Members of C# and TypeScript source: names, signatures and spans.

Declarations are found by walking brackets; bodies are not entered.  C# gives methods,
constructors and properties of any visibility; TypeScript gives methods, constructors,
accessors, fields, interface members, functions, type aliases and enums.  Fields, events,
indexers, operators, destructors, enums and delegates of C# are left out, and functions of
top-level statements, as are constants that hold functions in TypeScript.  Signatures of
TypeScript members have no type parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import PUNCTUATION, STRING, WORD, Token, partners, tokenize

GLOBAL = "<global>"
#: Modifiers and declaration keywords of the languages.
SHARP_MODIFIERS = set(
    "public private protected internal static abstract virtual override sealed async extern unsafe partial readonly new required volatile const fixed file ref scoped".split()
)
SHARP_TYPES = {"class", "struct", "interface", "record"}
SCRIPT_MODIFIERS = set("public private protected static readonly async get set override abstract declare accessor".split())
SCRIPT_SIGNATURE_MODIFIERS = SCRIPT_MODIFIERS - {"abstract", "declare", "accessor"}


@dataclass
class Member:
    kind: str
    container: str
    name: str
    signature: str
    is_public: bool
    start: int
    end: int
    body_start: int | None = None
    body_end: int | None = None


class _Walker:
    def __init__(self, source: str, language: str):
        self.source = source
        self.tokens = tokenize(source, language)
        self.partner = partners(self.tokens)
        self.found: list[Member] = []

    def text(self, first: int, last: int) -> str:
        """Source of tokens ``first`` to ``last``, both included."""
        return self.source[self.tokens[first].start : self.tokens[last].end]

    def is_at(self, k: int, *texts: str) -> bool:
        return k < len(self.tokens) and self.tokens[k].kind != STRING and self.tokens[k].text in texts

    def skip_angles(self, k: int, stop: int) -> int:
        """Index after the type arguments that open at ``k``."""
        depth = 0
        while k < stop:
            t = self.tokens[k]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif k in self.partner:
                k = self.partner[k]
            elif t.text == ";":
                return k
            k += 1
        return stop

    def to_semicolon(self, k: int, stop: int) -> int:
        """Index of the next semicolon outside brackets, or ``stop - 1``."""
        while k < stop:
            if self.tokens[k].text == ";" and self.tokens[k].kind == PUNCTUATION:
                return k
            k = self.partner.get(k, k) + 1
        return stop - 1


class _Sharp(_Walker):
    def walk(self, k: int, stop: int, chain: tuple[str, ...], in_interface: bool = False) -> None:
        while k < stop:
            k = max(k + 1, self.declaration(k, stop, chain, in_interface))

    def declaration(self, k: int, stop: int, chain: tuple[str, ...], in_interface: bool) -> int:
        tokens, first = self.tokens, k
        while self.is_at(k, "["):
            k = self.partner[k] + 1
        modifiers = []
        while k < stop and tokens[k].kind == WORD and tokens[k].text in SHARP_MODIFIERS:
            modifiers.append(tokens[k].text)
            k += 1
        if k >= stop:
            return stop
        word = tokens[k].text
        if word in ("using", "extern", "global") and not chain:
            return self.to_semicolon(k, stop) + 1
        if word == "namespace":
            while k < stop and not self.is_at(k, "{", ";"):
                k += 1
            if self.is_at(k, "{"):
                self.walk(k + 1, self.partner[k], chain)
                return self.partner[k] + 1
            return k + 1
        if word in SHARP_TYPES and k + 1 < stop and tokens[k + 1].kind == WORD:
            return self.type_declaration(k, stop, chain)
        if word == "enum":
            while k < stop and not self.is_at(k, "{", ";"):
                k += 1
            return self.partner.get(k, k) + 1
        if word in ("delegate", "event"):
            return self.after_accessors_or_semicolon(k, stop)
        return self.member(first, k, stop, modifiers, chain, in_interface)

    def type_declaration(self, k: int, stop: int, chain: tuple[str, ...]) -> int:
        tokens = self.tokens
        is_interface = tokens[k].text == "interface"
        if tokens[k].text == "record" and self.is_at(k + 1, "class", "struct"):
            k += 1
        name = tokens[k + 1].text
        k += 2
        while k < stop and not self.is_at(k, "{", ";"):
            k = self.partner[k] + 1 if self.is_at(k, "(", "[") else k + 1
        if self.is_at(k, "{"):
            end = self.partner[k]
            self.walk(k + 1, end, (*chain, name.lstrip("@")), is_interface)
            return end + 2 if self.is_at(end + 1, ";") else end + 1
        return k + 1

    def after_accessors_or_semicolon(self, k: int, stop: int) -> int:
        while k < stop and not self.is_at(k, "{", ";"):
            k = self.partner[k] + 1 if self.is_at(k, "(", "[") else k + 1
        return self.partner.get(k, k) + 1

    def member(self, first: int, k: int, stop: int, modifiers: list[str], chain: tuple[str, ...], in_interface: bool) -> int:
        tokens, head = self.tokens, k
        container = ".".join(chain) or GLOBAL
        name_at = None
        while k < stop:
            t = tokens[k]
            if t.kind == WORD and t.text in ("operator", "this") or t.text == "~":
                return self.skip_member(k, stop)
            if t.text == "(":
                named = k > head and (tokens[k - 1].kind == WORD or tokens[k - 1].text == ">")
                if not named:  # a tuple type
                    k = self.partner[k] + 1
                    continue
                return self.method(first, head, k, stop, modifiers, container, chain)
            if t.text in ("{", "=>"):
                break
            if t.text in ("=", ";", "}") or t.kind == STRING:
                return self.to_semicolon(k, stop) + 1
            if t.text == "<":
                k = self.skip_angles(k, stop)
                continue
            if t.text == "[":
                k = self.partner[k] + 1
                continue
            if t.kind == WORD:
                name_at = k
            k += 1
        if k >= stop or name_at is None or name_at == head:
            return self.partner.get(k, k) + 1
        return self.property(first, head, name_at, k, stop, modifiers, container)

    def skip_member(self, k: int, stop: int) -> int:
        while k < stop and not self.is_at(k, "{", ";", "=>"):
            k = self.partner[k] + 1 if self.is_at(k, "(", "[") and not self.is_at(k - 1, "operator") else k + 1
        if self.is_at(k, "=>"):
            return self.to_semicolon(k, stop) + 1
        return self.partner.get(k, k) + 1

    def method(self, first, head, paren, stop, modifiers, container, chain) -> int:
        tokens = self.tokens
        name_end = paren - 1
        name_at = name_end
        if tokens[name_at].text == ">":
            depth = 0
            while name_at > head:
                depth += (tokens[name_at].text == ">") - (tokens[name_at].text == "<")
                name_at -= 1
                if not depth:
                    break
        name = tokens[name_at].text.lstrip("@")
        close = self.partner[paren]
        k = close + 1
        while k < stop and not self.is_at(k, "{", ";", "=>"):  # constraints, calls of another constructor
            k = self.partner[k] + 1 if self.is_at(k, "(", "[") else k + 1
        body = None
        if self.is_at(k, "{"):
            end = self.partner[k]
            body = (tokens[k].start, tokens[end].end)
        elif self.is_at(k, "=>"):
            end = self.to_semicolon(k, stop)
            body = (tokens[k].start, tokens[end - 1].end if tokens[end].text == ";" else tokens[end].end)
        else:
            end = min(k, stop - 1)
        is_constructor = name_at == head and bool(chain) and name == chain[-1]
        explicit_at = name_at
        while explicit_at - 2 >= head and tokens[explicit_at - 1].text == ".":  # IName.Member
            explicit_at -= 2
        returned = self.text(head, explicit_at - 1) if explicit_at > head else ""
        shown = self.text(name_at, close)
        signature = " ".join([*modifiers, *([returned] if returned else []), shown]).strip()
        kind = "constructor" if is_constructor else "method"
        if chain:
            self.found.append(Member(
                kind, container, name, signature, kind == "method" and "public" in modifiers, tokens[first].start, tokens[end].end, *(body or (None, None))
            ))
        return end + 1

    def property(self, first, head, name_at, k, stop, modifiers, container) -> int:
        tokens = self.tokens
        shown = " ".join([*modifiers, self.text(head, name_at - 1), tokens[name_at].text])
        if self.is_at(k, "=>"):
            end = self.to_semicolon(k, stop)
            body = (tokens[k].start, tokens[end - 1].end if tokens[end].text == ";" else tokens[end].end)
        else:
            close = self.partner[k]
            accessors, at, words = [], k + 1, []
            while at < close:
                t = tokens[at]
                if t.text == "[":
                    at = self.partner[at] + 1
                    continue
                if t.kind == WORD:
                    words.append(t.text)
                if t.text in (";", "{", "=>"):
                    accessors.append(" ".join(words) + ";")
                    words = []
                    at = self.to_semicolon(at, close) if t.text == "=>" else self.partner.get(at, at)
                at += 1
            shown += " { " + " ".join(accessors) + " }"
            body = (tokens[k].start, tokens[close].end)
            end = self.to_semicolon(close + 1, stop) if self.is_at(close + 1, "=") else close
        if container != GLOBAL:
            self.found.append(Member("property", container, tokens[name_at].text.lstrip("@"), shown, False, tokens[first].start, tokens[end].end, *body))
        return end + 1


class _Script(_Walker):
    #: A line break does not end a field before or after these.
    GOES_ON = set("= + - * / % & | ^ ? : , . < ( [ { => !".split())

    def walk(self, k: int, stop: int) -> None:
        tokens = self.tokens
        exported = False
        first = k
        while k < stop:
            t = tokens[k]
            word = t.text if t.kind == WORD else ""
            if word in ("export", "default", "declare", "abstract", "async") and k + 1 < stop:
                if word == "export":
                    exported, first = True, k + 1
                elif word in ("default", "declare"):
                    first = k + 1
                k += 1
                continue
            if word in ("class", "interface") and k + 1 < stop and (tokens[k + 1].kind == WORD or self.is_at(k + 1, "{")):
                k = self.container(k, stop)
            elif word == "function":
                k = self.function(first, k, stop, exported)
            elif word == "type" and k + 1 < stop and tokens[k + 1].kind == WORD and self.is_at(k + 2, "=", "<"):
                end = self.field_end(k + 2, stop)
                self.found.append(Member("type", GLOBAL, tokens[k + 1].text, f"type {tokens[k + 1].text}", False, t.start, tokens[end].end))
                k = end + 1
            elif word == "enum" and k + 1 < stop and tokens[k + 1].kind == WORD and self.is_at(k + 2, "{"):
                end = self.partner[k + 2]
                start = k - 1 if k and self.is_at(k - 1, "const") else k
                self.found.append(Member(
                    "enum", GLOBAL, tokens[k + 1].text, f"enum {tokens[k + 1].text}", False, tokens[start].start, tokens[end].end,
                    tokens[k + 2].start, tokens[end].end,
                ))
                k = end + 1
            elif word in ("namespace", "module") and k + 1 < stop and tokens[k + 1].kind in (WORD, STRING):
                while k < stop and not self.is_at(k, "{", ";"):
                    k += 1
                if self.is_at(k, "{"):
                    self.walk(k + 1, self.partner[k])
                k = self.partner.get(k, k) + 1
            elif word == "const" and self.is_at(k + 1, "enum"):
                k += 1
                continue
            else:
                k = self.partner.get(k, k) + 1
            exported, first = False, k

    def container(self, k: int, stop: int) -> int:
        tokens = self.tokens
        is_interface = tokens[k].text == "interface"
        name = tokens[k + 1].text if tokens[k + 1].kind == WORD and tokens[k + 1].text not in ("extends", "implements") else GLOBAL
        k += 1
        while k < stop and not self.is_at(k, "{"):
            k = self.skip_angles(k, stop) if self.is_at(k, "<") else self.partner[k] + 1 if self.is_at(k, "(", "[") else k + 1
        if k >= stop:
            return stop
        at, end = k + 1, self.partner[k]
        while at < end:
            at = max(at + 1, self.member(at, end, name, is_interface))
        return end + 1

    def field_end(self, k: int, stop: int) -> int:
        """Index of the last token of a declaration that a semicolon or a line break ends."""
        tokens = self.tokens
        while k < stop:
            if tokens[k].text in (";", ",") and tokens[k].kind == PUNCTUATION:
                return k
            end = self.partner.get(k, k)
            after = end + 1
            if after >= stop:
                return end
            broken = "\n" in self.source[tokens[end].end : tokens[after].start]
            if broken and tokens[end].text not in self.GOES_ON and tokens[after].text not in self.GOES_ON - {"(", "[", "{", "!", "*"}:
                return end
            k = after
        return stop - 1

    def type_end(self, k: int, stop: int) -> int:
        """Index after the type that starts at ``k``; a brace after a complete type ends it."""
        tokens, complete = self.tokens, False
        while k < stop:
            t = tokens[k]
            if t.kind == PUNCTUATION and t.text in (";", ",", "=", ")", "}"):
                return k
            if t.text == "{" and complete:
                return k
            if complete and "\n" in self.source[tokens[k - 1].end : t.start] and t.text not in ("|", "&", "=>", ".", "[", "<"):
                return k
            if t.text == "<":
                k, complete = self.skip_angles(k, stop), True
                continue
            complete = not (t.text in ("|", "&", "=>", ".", ":", "?") or t.kind == WORD and t.text in ("is", "keyof", "typeof", "extends", "infer", "asserts", "unique"))
            k = self.partner.get(k, k) + 1
        return stop

    def function(self, first: int, k: int, stop: int, exported: bool) -> int:
        tokens = self.tokens
        is_async = k > 0 and self.is_at(k - 1, "async")
        k += 1
        if self.is_at(k, "*"):
            k += 1
        if k >= stop or tokens[k].kind != WORD:
            return k
        name = tokens[k].text
        k += 1
        if self.is_at(k, "<"):
            k = self.skip_angles(k, stop)
        if not self.is_at(k, "("):
            return k
        close = self.partner[k]
        parameters = self.text(k, close)
        k, returned = close + 1, ""
        if self.is_at(k, ":"):
            end = self.type_end(k + 1, stop)
            returned = self.text(k, end - 1)
            k = end
        if not self.is_at(k, "{"):  # an overload signature
            return self.to_semicolon(k, stop) + 1 if self.is_at(k, ";") else k
        end = self.partner[k]
        signature = f"{'async ' if is_async else ''}function {name}{parameters}{returned}"
        self.found.append(Member("function", GLOBAL, name, signature, exported, tokens[first].start, tokens[end].end, tokens[k].start, tokens[end].end))
        return end + 1

    def member(self, k: int, stop: int, container: str, is_interface: bool) -> int:
        tokens = self.tokens
        if self.is_at(k, ";", ","):
            return k + 1
        while k < stop and tokens[k].text.startswith("@") and tokens[k].kind == WORD:  # decorators
            k += 1
            while self.is_at(k, "."):
                k += 2
            if self.is_at(k, "("):
                k = self.partner[k] + 1
        first, modifiers = k, []
        while k + 1 < stop and tokens[k].kind == WORD and tokens[k].text in SCRIPT_MODIFIERS and not self.is_at(k + 1, "(", ":", "=", ";", "?", "!", "<", ","):
            modifiers.append(tokens[k].text)
            k += 1
        if self.is_at(k, "*"):
            k += 1
        if k >= stop:
            return stop
        if self.is_at(k, "{"):  # static block
            return self.partner[k] + 1
        if self.is_at(k, "(", "<") and is_interface:  # call signature
            return self.field_end(k, stop) + 1
        name_at = k
        if self.is_at(k, "["):
            k = self.partner[k]
        name = self.text(name_at, k)
        k += 1
        mark = ""
        if self.is_at(k, "?", "!"):
            mark = "?" if self.is_at(k, "?") else ""
            k += 1
        if self.is_at(k, "<"):
            k = self.skip_angles(k, stop)
        shown = [m for m in modifiers if m in SCRIPT_SIGNATURE_MODIFIERS]
        public = not {"private", "protected"} & set(modifiers) and not name.startswith("#")
        if self.is_at(k, "("):
            close = self.partner[k]
            parameters, returned = self.text(k, close), ""
            k = close + 1
            if self.is_at(k, ":"):
                end = self.type_end(k + 1, stop)
                returned = self.text(k, end - 1)
                k = end
            body = (None, None)
            if self.is_at(k, "{"):
                end = self.partner[k]
                body = (tokens[k].start, tokens[end].end)
            else:
                end = k - 1
                if not is_interface:  # an overload or abstract signature is no definition
                    return k + 1 if self.is_at(k, ";") else k
            kind = "constructor" if name == "constructor" else "method"
            signature = " ".join([*shown, name + parameters + returned])
            self.found.append(Member(kind, container, name, signature, public and kind == "method", tokens[first].start, tokens[end].end, *body))
            return end + 2 if self.is_at(end + 1, ";", ",") else end + 1
        if tokens[name_at].text == "[" and is_interface:  # index signature
            return self.field_end(k, stop) + 1
        annotation = ""
        if self.is_at(k, ":"):
            end = self.type_end(k + 1, stop)
            annotation = self.text(k, end - 1)
            k = end
        end = self.field_end(k, stop) if k < stop and self.is_at(k, "=", ";", ",") else k - 1
        last = end - 1 if self.is_at(end, ";", ",") else end
        fields = [m for m in shown if m not in ("async", "get", "set")]
        signature = " ".join([*fields, name + (mark if annotation else "") + annotation])
        self.found.append(Member("field" if not is_interface else "property", container, name, signature, False, tokens[first].start, tokens[max(last, name_at)].end))
        return end + 1


def find_members(source: str, language: str) -> list[Member]:
    """All members in document order."""
    if language == "csharp":
        walker: _Walker = _Sharp(source, language)
        walker.walk(0, len(walker.tokens), ())
    else:
        walker = _Script(source, language)
        walker.walk(0, len(walker.tokens))
    return sorted(walker.found, key=lambda m: (m.start, m.end))


__all__ = ["GLOBAL", "Member", "Token", "find_members"]
