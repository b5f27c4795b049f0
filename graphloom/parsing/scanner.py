"""A tokenizer and declaration scanner for TypeScript and JavaScript.

It finds what the graph needs - imports, exports, declarations, calls, heritage - by matching
brackets and keywords over tokens; it builds no syntax tree.  Beyond its reach: decorators
with unbalanced text, exotic regular-expression positions, ``namespace`` bodies.

Complexity is 1 + the branches of the declaration's own body (if, for, while, case, catch,
?, &&, ||, ??), without those of inline callbacks.  Errors are unbalanced brackets, open
strings and characters no token begins with; a file fails above ERROR_SHARE errors a token.
"""

from __future__ import annotations

import re
from typing import Any, NamedTuple

MOST_BYTES = 2 * 1024 * 1024
ERROR_SHARE = 0.10
SIGNATURE_LENGTH = 500

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/|/\*.*\Z)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)|(?P<name>\#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
    |(?P<op>=>|\.\.\.|\?\?=|\?\.(?!\d)|&&=|\|\|=|===|!==|\*\*=|>>>=|<<=|==|!=|<=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|\*\*|[{}()\[\];,<>:=.?!+\-*/%&|^~@])""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
NOT_A_CALL = frozenset("if for while switch catch function return typeof await new super import require delete void in of do else case yield throw constructor".split())
VALUE_ENDS = frozenset((")", "]", "}"))
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await".split())
BRANCHES = frozenset(("if", "for", "while", "case", "catch", "&&", "||", "??"))
MODIFIERS = frozenset("public private protected static abstract override readonly async declare get set accessor".split())


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int


def tokenize(source: str) -> tuple[list[Token], list[Token], int]:
    """(tokens, comments, errors). A template string is one token; its expressions follow as tokens."""
    tokens: list[Token] = []
    comments: list[Token] = []
    errors, at, line, size = 0, 0, 1, len(source)
    templates: list[int] = []  # bracket depth at which a template's expression ends
    depth = 0

    def template(at: int) -> tuple[int, bool, bool]:
        """(end, whether an expression opens there, whether the template is complete)."""
        while at < size:
            c = source[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1, False, True
            elif c == "$" and source[at : at + 2] == "${":
                return at + 2, True, True
            else:
                at += 1
        return size, False, False

    def add_template(begin: int, end: int) -> None:
        nonlocal line
        tokens.append(Token("string", source[begin:end], line, begin, end))
        line += source.count("\n", begin, end)

    while at < size:
        c = source[at]
        if c == "`" or (c == "}" and templates and templates[-1] == depth):
            if c == "}":
                templates.pop()
                tokens.append(Token("op", ")", line, at, at + 1))
            end, opens, complete = template(at + 1)
            errors += not complete
            add_template(at, end)
            if opens:
                templates.append(depth)
                tokens.append(Token("op", "(", line, end - 1, end))
            at = end
            continue
        if c == "/" and source[at : at + 2] not in ("//", "/*"):
            last = tokens[-1] if tokens else None
            value = last is not None and (last.kind in ("number", "string") or last.text in VALUE_ENDS or (last.kind == "name" and last.text not in BEFORE_REGEX))
            found = None if value or (last is not None and last.text == "<") else REGEX.match(source, at)
            if found:
                tokens.append(Token("string", found[0], line, at, found.end()))
                at = found.end()
                continue
        found = TOKEN.match(source, at)
        if not found:
            errors += 1
            at += 1
            continue
        kind, text = found.lastgroup, found[0]
        if kind == "comment":
            comments.append(Token(kind, text, line, at, found.end()))
            errors += text.startswith("/*") and not text.endswith("*/")
        elif kind != "space":
            tokens.append(Token(kind, text, line, at, found.end()))
            depth += (text == "{") - (text == "}")
        line += text.count("\n")
        at = found.end()
    return tokens, comments, errors + len(templates)


def match_brackets(tokens: list[Token]) -> tuple[dict[int, int], int]:
    """Closing token of each opening one, and the number of brackets without a partner."""
    closes: dict[int, int] = {}
    stack: list[int] = []
    errors = 0
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in PAIRS:
            stack.append(i)
        elif t.text in (")", "]", "}"):
            if stack and PAIRS[tokens[stack[-1]].text] == t.text:
                closes[stack.pop()] = i
            else:
                errors += 1
                if stack:
                    stack.pop()
    return closes, errors + len(stack)


def unquote(text: str) -> str:
    return text[1:-1]


def doc_text(comment: str) -> str:
    if comment.startswith("//"):
        return comment[2:].strip()
    lines = [re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in comment[2:].removesuffix("*/").lstrip("*").split("\n")]
    return "\n".join(lines).strip()


class Scanner:
    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.tokens, self.comments, errors = tokenize(source)
        self.closes, unmatched = match_brackets(self.tokens)
        self.opens = {b: a for a, b in self.closes.items()}
        self.errors = errors + unmatched
        self.imports: list[dict[str, Any]] = []
        self.exports: list[dict[str, Any]] = []
        self.symbols: list[dict[str, Any]] = []
        self.spans: list[tuple[int, int, int]] = []  # first and last body token of a symbol
        self.exported: set[str] = set()
        self.default_name: str | None = None
        self.comment_ends = {c.end: c for c in self.comments}

    # helpers

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def skip_types(self, i: int, stops: frozenset[str] | set[str]) -> int:
        """The next token at this level that is one of ``stops``; brackets and <> are passed over."""
        angle = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.text == "<":
                angle += 1
            elif t.text == ">" and angle:
                angle -= 1
            elif t.text in stops and angle == 0:
                return i
            if t.kind == "op" and t.text in PAIRS:
                i = self.closes.get(i, len(self.tokens))
            i += 1
        return len(self.tokens)

    def statement_end(self, i: int) -> int:
        """Last token of the statement that begins at i: a semicolon, or the line break after a complete one."""
        start = i
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.text == ";":
                return i
            if t.text in (")", "]", "}"):
                return i - 1
            if i > start and t.line > self.tokens[i - 1].line and self._begins_statement(i):
                return i - 1
            i = self.closes.get(i, i) + 1 if t.kind == "op" and t.text in PAIRS else i + 1
        return len(self.tokens) - 1

    def _begins_statement(self, i: int) -> bool:
        before, t = self.tokens[i - 1], self.tokens[i]
        if before.kind == "op" and before.text not in (")", "]", "}", ">", "++", "--"):
            return False
        return t.kind == "name" and t.text not in ("instanceof", "in", "of", "as", "satisfies", "extends", "implements") or t.text in ("@", "{")

    def lead(self, i: int) -> tuple[int, str | None, int]:
        """(first line, doc comment, first token) of a declaration, with decorators and an adjacent comment."""
        first = i
        while True:  # decorators stand before it: @name, @name.name, @name(...)
            j = first - 1
            if self.text(j) == ")" and (opens := self.opens.get(j)) is not None:
                j = opens - 1
            while self.is_name(j) and self.text(j - 1) == ".":
                j -= 2
            if self.is_name(j) and self.text(j - 1) == "@":
                first = j - 1
                continue
            break
        line, doc = self.tokens[first].line, None
        begin = self.tokens[first].start
        gap_start = self.tokens[first - 1].end if first else 0
        above = [c for c in self.comments if gap_start <= c.start and c.end <= begin]
        while above:
            c = above.pop()
            last = c.line + c.text.count("\n")
            if line - last > 1 or (first and c.line == self.tokens[first - 1].line):
                break
            line = c.line
            if doc is None:
                doc = doc_text(c.text)
            if c.text.startswith("/*"):
                break
        return line, doc, first

    def signature(self, begin: int, end: int) -> str:
        """Source from one token to before another, white space joined, cut at a length."""
        last = self.tokens[end - 1].end if end - 1 >= begin else self.tokens[begin].end
        text = " ".join(self.source[self.tokens[begin].start : last].split())
        return text if len(text) <= SIGNATURE_LENGTH else text[: SIGNATURE_LENGTH - 1] + "…"

    def callable_kind(self, name: str, body: tuple[int, int], plain: str) -> str:
        if self.language != "typescript" and re.match(r"[A-Z]", name) and self.has_jsx(*body):
            return "REACT_COMPONENT"
        return "HOOK" if re.match(r"use[A-Z]", name) else plain

    def has_jsx(self, begin: int, end: int) -> bool:
        for i in range(begin, end):
            if self.text(i) == "<" and (self.is_name(i + 1) or self.text(i + 1) in (">", "/")):
                before = self.tokens[i - 1] if i else None
                if before is None or before.text in ("(", "return", "=>", "?", ":", "&&", "||", "=", ",", "[", "{", ">", "}"):
                    return True
        return False

    def add(self, name: str, kind: str, i: int, last: int, sign_to: int, body: tuple[int, int] | None, exported: bool, default: bool, parent: str | None = None, at: int | None = None, **more) -> None:
        line, doc, _ = self.lead(at if at is not None else i)
        if parent is None and body and any(s["name"] == name and s["kind"] == kind and s.get("_overload") for s in self.symbols):
            self.symbols[:] = [s for s in self.symbols if not (s["name"] == name and s.get("_overload"))]
        self.symbols.append({
            "name": name, "kind": kind, "startLine": line, "endLine": self.tokens[min(last, len(self.tokens) - 1)].line + self.text(last).count("\n"), "isExported": exported, "isDefault": default,
            "signature": self.signature(i, sign_to), "docComment": doc, "parentSymbol": parent, "complexity": 1, "calls": [], "extends": None, "implements": None, "_body": body, **more,
        })

    # statements

    def scan(self) -> None:
        i, end = 0, len(self.tokens)
        while i < end:
            i = max(self.statement(i, end), i + 1)
        for s in self.symbols:
            if s["parentSymbol"] is None:
                s["isExported"] |= s["name"] in self.exported
                s["isDefault"] |= s["name"] == self.default_name
        self.requires()
        self.attribute()

    def statement(self, i: int, end: int) -> int:
        t = self.text(i)
        if t == "import" and self.text(i + 1) not in ("(", "."):
            return self.import_statement(i)
        if t == "export":
            return self.export_statement(i)
        if t == "@":
            return self.after_decorator(i)
        found = self.declaration(i, i, False, False)
        if found is not None:
            return found
        if t in PAIRS:
            return self.closes.get(i, end) + 1
        return self.statement_end(i) + 1

    def after_decorator(self, i: int) -> int:
        i += 1
        while self.is_name(i):
            i += 1
            if self.text(i) != ".":
                break
            i += 1
        return self.closes.get(i, i) + 1 if self.text(i) == "(" else i

    def declaration(self, i: int, begin: int, exported: bool, default: bool) -> int | None:
        """Scan a declaration whose keyword may follow modifiers; the token after it, or None."""
        k = i
        while self.text(k) in ("async", "declare", "abstract") and self.tokens[k + 1 : k + 2] and self.tokens[k + 1].kind == "name":
            k += 1
        word, name = self.text(k), self.text(k + 1)
        if word == "function":
            k += 2 if name == "*" else 1
            return self.function(k, begin, exported, default)
        if word == "class":
            return self.class_(k, begin, exported, default)
        if word == "interface" and self.is_name(k + 1):
            body = self.skip_types(k + 2, {"{"})
            last = self.closes.get(body, body)
            self.add(name, "INTERFACE", begin, last, body, None, exported, default, extends=self.heritage(k + 2, body, "extends"))
            return last + 1
        if word == "enum" or (word == "const" and name == "enum"):
            k += word == "const"
            body = self.skip_types(k + 1, {"{"})
            self.add(self.text(k + 1), "ENUM", begin, self.closes.get(body, body), body, None, exported, default)
            return self.closes.get(body, body) + 1
        if word == "type" and self.is_name(k + 1) and self.text(k + 2) in ("=", "<"):
            last = self.type_end(self.skip_types(k + 2, {"="}) + 1)
            self.add(name, "TYPE_ALIAS", begin, last, last + (self.text(last) != ";"), None, exported, default)
            return last + 1
        if word in ("const", "let", "var"):
            return self.variables(k, begin, exported)
        return None

    def type_end(self, i: int) -> int:
        while True:
            last = self.statement_end(i)
            if self.text(last + 1) in ("|", "&") and self.text(last) != ";":
                i = last + 2
                continue
            return last

    def function(self, k: int, begin: int, exported: bool, default: bool) -> int:
        name = self.text(k) if self.is_name(k) else ""
        params = self.skip_types(k + (1 if name else 0), {"("})
        after = self.closes.get(params, len(self.tokens))
        body = self.body_after(after + 1)
        if body is None:  # an overload or an ambient declaration
            last = self.statement_end(after) if after < len(self.tokens) else after - 1
            if name and not any(s["name"] == name and s["parentSymbol"] is None for s in self.symbols):
                self.add(name, "FUNCTION", begin, last, last + (self.text(last) != ";"), None, exported, default, _overload=True)
            return last + 1
        last = self.closes.get(body, len(self.tokens) - 1)
        if name:
            self.add(name, self.callable_kind(name, (body, last), "FUNCTION"), begin, last, body, (params, last), exported, default)
        return last + 1

    def body_after(self, i: int) -> int | None:
        """The opening brace of a body after a parameter list, past a return type."""
        if self.text(i) == ":":
            i += 1
            if self.text(i) == "{":  # an object type
                i = self.closes.get(i, i) + 1
            while i < len(self.tokens):
                if self.text(i) == "{" and self.text(i - 1) not in ("|", "&", "=>", ":"):
                    return i
                if self.text(i) == ";" or (self.tokens[i].line > self.tokens[i - 1].line and self._begins_statement(i)):
                    return None
                i = self.closes.get(i, i) + 1
            return None
        return i if self.text(i) == "{" else None

    def heritage(self, i: int, end: int, word: str) -> list[str] | None:
        """Names after ``extends`` or ``implements`` before ``end``; what has no name is left out."""
        angle = 0
        while i < end and not (self.text(i) == word and angle == 0):
            angle += (self.text(i) == "<") - (self.text(i) == ">")
            i += 1
        names, i = [], i + 1
        while i < end and self.is_name(i) and self.text(i) not in ("extends", "implements"):
            name = self.text(i)
            i += 1
            while self.text(i) == "." and self.is_name(i + 1):
                name, i = f"{name}.{self.text(i + 1)}", i + 2
            if self.text(i) == "<":
                i = self.skip_types(i, {",", "{", "implements", "extends"}) if i < end else i
            if self.text(i) == "(":
                i = self.closes.get(i, i) + 1
            else:
                names.append(name)
            if self.text(i) != ",":
                break
            i += 1
        return names or None

    def class_(self, k: int, begin: int, exported: bool, default: bool) -> int:
        name = self.text(k + 1) if self.is_name(k + 1) and self.text(k + 1) not in ("extends", "implements") else ""
        body = k + 1
        while body < len(self.tokens) and self.text(body) != "{":
            body = self.closes.get(body, body) + 1
        last = self.closes.get(body, len(self.tokens) - 1)
        if name:
            self.add(name, "CLASS", begin, last, body, None, exported, default, extends=self.heritage(k + 2, body, "extends"), implements=self.heritage(k + 2, body, "implements"))
            self.members(name, body + 1, last)
        return last + 1

    def members(self, owner: str, i: int, end: int) -> None:
        while i < end:
            begin = i
            while self.text(i) == "@":
                i = begin = self.after_decorator(i)
            while self.text(i) in MODIFIERS and (self.is_name(i + 1) or self.text(i + 1) in ("*", "[")):
                i += 1
            i += self.text(i) == "*"
            name = self.text(i)
            if self.text(i) == "[":
                i, name = self.closes.get(i, i), ""
            angle = self.skip_types(i + 1, {"(", ";", "=", ":", "}"}) if self.text(i + 1) == "<" else i + 1
            if (self.is_name(i) or name == "") and self.text(angle) == "(" and i < end:
                after = self.closes.get(angle, end)
                body = self.body_after(after + 1)
                if body is not None and body < end:
                    last = self.closes.get(body, end - 1)
                    # overload signatures of a method collapse into the one with a body
                    self.symbols[:] = [s for s in self.symbols if not (s["name"] == name and s["parentSymbol"] == owner and s.get("_overload"))]
                    if name:
                        self.add(name, "METHOD", begin, last, body, (angle, last), False, False, owner)
                    i = last + 1
                else:
                    last = self.statement_end(after + 1)
                    if name and not any(s["name"] == name and s["parentSymbol"] == owner for s in self.symbols):
                        self.add(name, "METHOD", begin, last, last + (self.text(last) != ";"), None, False, False, owner, _overload=True)
                    i = last + 1
            else:  # a field; calls in it have no symbol
                i = max(self.statement_end(i) + 1, begin + 1)
            while self.text(i) == ";":
                i += 1

    def variables(self, k: int, begin: int, exported: bool) -> int:
        last = self.statement_end(k)
        i, first = k + 1, True
        while i <= last:
            name = self.text(i) if self.is_name(i) else ""
            equals = self.skip_types(i + 1, {"=", ",", ";"})
            stop = min(self.skip_types_value(equals + 1), last + 1)
            if self.text(equals) == "=" and equals <= last:
                if exported and name:
                    self.exports.append({"name": name, "isDefault": False, "line": self.tokens[i].line, "reExportFrom": None})
                if name:
                    self.value(name, begin if first else i, equals + 1, stop, exported, begin)
            elif exported and name and equals <= last + 1:
                self.exports.append({"name": name, "isDefault": False, "line": self.tokens[i].line, "reExportFrom": None})
                stop = equals
            i, first = stop + 1, False
        return last + 1

    def skip_types_value(self, i: int) -> int:
        """The comma or semicolon after an initializer."""
        while i < len(self.tokens) and self.text(i) not in (",", ";"):
            if self.text(i) == "<":
                i = self.generic_end(i)
            i = self.closes.get(i, i) + 1
        return i

    def generic_end(self, i: int) -> int:
        """The closing > of type arguments that a call or arrow function follows; i itself if they are none."""
        depth, k = 0, i
        while k < min(i + 200, len(self.tokens)):
            t = self.tokens[k]
            depth += (t.text == "<") - (t.text == ">")
            if depth == 0:
                return k if self.text(k + 1) == "(" else i
            if t.kind == "op" and t.text in (";", ")", "}", "&&", "||"):
                return i
            k = self.closes.get(k, k) + 1
        return i

    def value(self, name: str, begin: int, i: int, stop: int, exported: bool, at: int) -> None:
        """A symbol for an arrow function or function expression bound to a name."""
        k = i + (self.text(i) == "async")
        last = stop - 1 if stop - 1 >= i else i
        if self.text(k) == "function":
            params = self.skip_types(k + 1, {"("})
            body = self.body_after(self.closes.get(params, len(self.tokens)) + 1)
            if body is not None:
                self.add(name, self.callable_kind(name, (body, self.closes.get(body, last)), "ARROW_FUNCTION"), begin, last, body, (params, self.closes.get(body, last)), exported, False, at=at)
            return
        if self.text(k) == "<":
            k = self.skip_types(k, {"("})
        if self.text(k) == "(" or self.is_name(k):
            arrow = self.closes.get(k, k) + 1 if self.text(k) == "(" else k + 1
            if self.text(arrow) == ":":
                while arrow < stop and self.text(arrow) != "=>":
                    arrow = self.closes.get(arrow, arrow) + 1
                inner = arrow + 1  # a function type as return type has a second arrow
                while inner < stop and self.text(inner) != "{" and self.text(inner) != "=>":
                    inner = self.closes.get(inner, inner) + 1
            if self.text(arrow) == "=>" and arrow < stop:
                self.add(name, self.callable_kind(name, (arrow, last + 1), "ARROW_FUNCTION"), begin, last, arrow + 1, (k, last), exported, False, at=at)

    # modules

    def import_statement(self, i: int) -> int:
        last, line, k = self.statement_end(i), self.tokens[i].line, i + 1
        type_only = self.text(k) == "type" and self.text(k + 1) not in ("from", ",", "=")
        k += type_only
        if self.tokens[k : k + 1] and self.tokens[k].kind == "string":
            self._imported(unquote(self.text(k)), line, type_only)
            return last + 1
        if self.is_name(k) and self.text(k + 1) == "=":  # import x = require("m")
            if self.text(k + 2) == "require" and self.tokens[k + 4 : k + 5] and self.tokens[k + 4].kind == "string":
                self._imported(unquote(self.text(k + 4)), line, False, default=self.text(k), syntax="require")
            return last + 1
        default = namespace = None
        values: list[str] = []
        types: list[str] = []
        while k <= last and not (self.text(k) == "from" and self.tokens[k + 1 : k + 2] and self.tokens[k + 1].kind == "string"):
            if self.text(k) == "*":
                namespace, k = self.text(k + 2), k + 3
            elif self.text(k) == "{":
                for _, local, is_type in self.specifiers(k):
                    (types if is_type else values).append(local)
                k = self.closes.get(k, last) + 1
            else:
                default = self.text(k) if self.is_name(k) else default
                k += 1
        if self.tokens[k + 1 : k + 2] and self.tokens[k + 1].kind == "string":
            specifier = unquote(self.text(k + 1))
            if values or default or namespace or not types:
                self._imported(specifier, line, type_only, values, default, namespace)
            if types:
                self._imported(specifier, line, True, types)
        return last + 1

    def _imported(self, specifier, line, type_only, named=(), default=None, namespace=None, syntax="static") -> None:
        self.imports.append({"specifier": specifier, "named": list(named), "default": default, "namespace": namespace, "line": line, "isTypeOnly": type_only, "syntax": syntax})

    def specifiers(self, i: int) -> list[tuple[str, str, bool]]:
        """(name, local name, type only) in braces."""
        out, k, end = [], i + 1, self.closes.get(i, len(self.tokens))
        while k < end:
            is_type = self.text(k) == "type" and self.text(k + 1) not in (",", "}", "as")
            k += is_type
            name = local = self.text(k)
            if self.text(k + 1) == "as":
                local, k = self.text(k + 2), k + 2
            out.append((name, local, is_type))
            k += 2
        return out

    def export_statement(self, i: int) -> int:
        line, k = self.tokens[i].line, i + 1
        add = lambda name, default=False, source=None: self.exports.append({"name": name, "isDefault": default, "line": line, "reExportFrom": source})
        type_only = self.text(k) == "type" and self.text(k + 1) in ("{", "*")
        k += type_only
        if self.text(k) == "=":
            add(self.text(k + 1) if self.is_name(k + 1) else "")
            self.exported.add(self.text(k + 1))
            return self.statement_end(k) + 1
        if self.text(k) == "*":
            last = self.statement_end(k)
            name = self.text(k + 2) if self.text(k + 1) == "as" else ""
            source = next((unquote(self.text(j)) for j in range(k, last + 1) if self.tokens[j].kind == "string"), None)
            if source is not None:
                add(name, False, source)
                self._imported(source, line, type_only)
            return last + 1
        if self.text(k) == "{":
            after = self.closes.get(k, k) + 1
            source = unquote(self.text(after + 1)) if self.text(after) == "from" else None
            for name, local, _ in self.specifiers(k):
                add(local, local == "default", source)
                if source is None:
                    self.exported.add(name)
                    if local == "default":
                        self.default_name = name
            if source is not None:
                self._imported(source, line, type_only)
            return self.statement_end(k) + 1
        if self.text(k) == "default":
            k += 1
            before = len(self.symbols)
            found = self.declaration(k, i, True, True) if self.text(k) not in ("const", "let", "var", "type") else None
            if found is not None:
                add(self.symbols[before]["name"] if len(self.symbols) > before and self.symbols[before]["parentSymbol"] is None else "", True)
                return found
            last = self.statement_end(k)
            single = self.is_name(k) and (last == k or (last == k + 1 and self.text(last) == ";"))
            add(self.text(k) if single else "", True)
            if single:
                self.default_name = self.text(k)
                self.exported.add(self.text(k))
            return last + 1
        while self.text(k) == "@":
            k = self.after_decorator(k)
        before = len(self.symbols)
        is_variable = self.text(k) in ("const", "let", "var") and self.text(k + 1) != "enum"
        found = self.declaration(k, i, True, False)
        if found is None:
            return self.statement_end(k) + 1
        if not is_variable:
            made = next((s["name"] for s in self.symbols[before:] if s["parentSymbol"] is None), None)
            if made is None:  # an overload after the first
                made = next((self.text(j) for j in range(k, min(k + 6, len(self.tokens))) if self.is_name(j) and self.text(j) not in ("function", "async", "declare", "abstract")), "")
            if not any(e["name"] == made and not e["reExportFrom"] for e in self.exports):
                add(made)
        return found

    def requires(self) -> None:
        for i in range(len(self.tokens) - 3):
            word = self.text(i)
            if word in ("require", "import") and self.text(i + 1) == "(" and self.tokens[i + 2].kind == "string" and self.text(i - 1) != "." and self.text(i + 3) in (")", ","):
                text = self.text(i + 2)
                if text[0] == "`" and "${" in text:
                    continue
                if self.text(i - 1) == "=" and self.text(i - 3) == "import":
                    continue
                self._imported(unquote(text), self.tokens[i].line, False, syntax="require" if word == "require" else "dynamic")
        self.imports.sort(key=lambda x: x["line"])

    # bodies

    def attribute(self) -> None:
        for s in self.symbols:
            if s.get("_body"):
                begin, last = s["_body"]
                s["calls"] = self.calls(begin, last)
                s["complexity"] = 1 + self.branches(begin, last)

    def calls(self, begin: int, last: int) -> list[dict[str, Any]]:
        out, seen = [], set()
        for i in range(begin, min(last + 1, len(self.tokens))):
            if not self.is_name(i) or self.text(i) in NOT_A_CALL and self.text(i - 1) not in (".", "?."):
                continue
            after = i + 1
            if self.text(after) == "?." and self.text(after + 1) == "(":
                after += 1
            if self.text(after) == "<":
                k = after + 1
                while k < min(after + 40, len(self.tokens)) and (self.is_name(k) or self.text(k) in (",", ".", "[", "]", "<", "|", "&") or self.tokens[k].kind == "string"):
                    k += 1
                after = k + 1 if self.text(k) == ">" else after
            if self.text(after) != "(" or self.text(i - 1) in ("function", "new", "@"):
                continue
            close = self.closes.get(after, last)
            if self.text(close + 1) == "{" and self.text(i - 1) in ("{", ",", "}", ";", "get", "set", "async", "static", "*"):
                continue  # a method of an object literal or class
            receiver = self.receiver(i - 2) if self.text(i - 1) in (".", "?.") else None
            name = self.text(i)
            if (name, receiver) not in seen:
                seen.add((name, receiver))
                out.append({"name": name, "receiver": receiver, "line": self.tokens[i].line})
        return out

    def receiver(self, k: int) -> str | None:
        """Source of the expression that ends at k and that a member is called on; None if it is itself a call."""
        last = k
        while True:
            if self.text(k) in (")", "]"):
                opens = self.opens.get(k)
                if opens is None:
                    return None
                before = self.tokens[opens - 1] if opens else None
                applied = before is not None and (before.kind == "name" and before.text not in NOT_A_CALL or before.text in (")", "]"))
                if self.text(k) == ")" and applied:
                    j = opens - 1
                    while self.is_name(j) and self.text(j - 1) == ".":
                        j -= 2
                    if self.text(j - 1) != "new":
                        return None
                    return self.spelled(j - 1, last)
                k = opens - 1 if applied else opens
                if not applied:
                    return self.spelled(opens, last)
                continue
            if self.is_name(k) and self.text(k - 1) in (".", "?."):
                k -= 2
                continue
            if self.tokens[k].kind in ("name", "string"):
                return self.spelled(k, last)
            return None

    def spelled(self, begin: int, last: int) -> str:
        return " ".join(self.source[self.tokens[begin].start : self.tokens[last].end].replace("?.", ".").split())

    def branches(self, begin: int, last: int) -> int:
        count, i = 0, begin
        body = self.text(begin) == "("
        i = self.closes.get(begin, begin) + 1 if body else begin
        outer = True
        while i <= min(last, len(self.tokens) - 1):
            word = self.text(i)
            if word == "=>" and outer:
                outer = False
            elif word in ("function", "=>") or (word == "class"):
                if word == "=>" and self.text(i + 1) == "{":
                    i = self.closes.get(i + 1, i + 1)
                elif word == "=>":
                    while i < last and self.text(i + 1) not in (",", ";", ")", "]", "}"):
                        i = self.closes.get(i + 1, i + 1)
                else:
                    while i <= last and self.text(i) != "{":
                        i = self.closes.get(i, i) + 1
                    i = self.closes.get(i, i)
            elif word in BRANCHES and self.text(i - 1) != ".":
                count += 1
            elif word == "?" and self.text(i + 1) not in (":", ")", ",", ";", "="):
                count += 1
            if word == "{":
                outer = False
            i += 1
        return count


def parse(source: str | None, language: str | None) -> dict[str, Any]:
    """The facts of one file; parseState OK, FAILED or NOT_PARSED, never an exception."""
    empty: dict[str, Any] = {"imports": [], "exports": [], "symbols": [], "parseErrors": 0, "parseState": "OK"}
    if language is None or source is None:
        return empty | {"parseState": "NOT_PARSED"}
    if len(source.encode()) > MOST_BYTES:
        return empty | {"parseState": "FAILED", "parseErrors": 1}
    try:
        scanner = Scanner(source, language)
        if scanner.errors > ERROR_SHARE * len(scanner.tokens):
            return empty | {"parseState": "FAILED", "parseErrors": scanner.errors}
        scanner.scan()
    except Exception:  # noqa: BLE001 - one odd file must not end a run
        return empty | {"parseState": "FAILED", "parseErrors": 1}
    symbols = [{k: v for k, v in s.items() if not k.startswith("_")} for s in scanner.symbols]
    return {"imports": scanner.imports, "exports": scanner.exports, "symbols": symbols, "parseErrors": scanner.errors, "parseState": "OK"}
