"""Syntax extraction from TypeScript: a lexer and one tolerant pass over the tokens, run once a file on the executors.

The pass keeps a stack of braces, each with what opened it (function, class, interface, other), so that the
enclosing caller, nested definitions and exported ancestors are known at every token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<tpl>`)"""
    r"""|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|[{}()\[\];,.<>:=?!+\-*/%&|^~@\#\\])""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_HOOK = re.compile(r"^use[A-Z]")
#: Files whose rows are in a worker's memory at a time.
TOGETHER = 500
#: Words that look like calls or methods but are none (fixed values).
KEYWORDS = frozenset("if for while switch catch function return typeof await new in of instanceof void delete do else case throw yield import super class extends const let var with".split())


class Token:
    __slots__ = ("kind", "line", "start", "text")

    def __init__(self, kind: str, text: str, start: int, line: int):
        self.kind, self.text, self.start, self.line = kind, text, start, line


#: After these a value follows, so that ``<`` begins JSX and ``/`` a regular expression.
_BEFORE_VALUE = frozenset("( , = ? : && || ?? { [ => ; } ! & | + return default case typeof await yield".split())
#: Operators that :func:`_turn` acts on.
_TURNS = frozenset("{}<>")
#: ``<T,>`` and ``<T extends`` are type parameters also where JSX could stand.
_TYPE_PARAMETER = re.compile(r"<[A-Za-z_$][\w$]*\s*(?:,|extends\b)")


def _value(last: Token | None) -> bool:
    """Whether a value can begin after this token."""
    return last is None or last.text in _BEFORE_VALUE and last.kind in ("op", "name")


def lex(code: str, jsx: bool = False) -> list[Token]:
    """Tokens of a file. With ``jsx`` the text between tags gives none; what stands in braces there is code again."""
    out: list[Token] = []
    at, line, n = 0, 1, len(code)
    # what surrounds this place: "code" with the braces open in it, "open" or "close" in a tag, "text" between tags
    modes: list[list] = [["code", 0]]
    while at < n:
        mode = modes[-1]
        if mode[0] == "text":
            end = at
            while end < n and code[end] not in "<{":
                end += 1
            line += code.count("\n", at, end)
            at = end
            if at == n:
                break
            out.append(Token("op", code[at], at, line))
            at += 1
            modes.append(["code", 1] if code[at - 1] == "{" else ["close" if code.startswith("/", at) else "open"])
            continue
        last = out[-1] if out else None
        if mode[0] == "code" and code[at] == "/" and (_value(last) and last is not None and last.text != "}" or last is None or last.kind == "op" and last.text not in (")", "]", "}")):
            m = _REGEX.match(code, at)
            if m:
                out.append(Token("regex", m.group(), at, line))
                at = m.end()
                continue
        m = _LEX.match(code, at)
        if not m:
            at += 1
            continue
        kind, text = m.lastgroup, m.group()
        if kind == "name" or kind == "num" or kind == "op" and text not in _TURNS:  # most tokens; they change no mode and hold no line end
            out.append(Token(kind, text, at, line))
            at += len(text)
            continue
        if kind == "tpl":
            end, depth = at + 1, 0
            while end < n and (code[end] != "`" or depth):
                if code[end] == "\\":
                    end += 1
                elif code.startswith("${", end):
                    depth += 1
                elif code[end] == "}" and depth:
                    depth -= 1
                end += 1
            text = code[at : end + 1]
            out.append(Token("str", text, at, line))
        elif kind not in ("space", "comment"):
            out.append(Token(kind, text, at, line))
            if kind == "op":
                _turn(modes, text, code, at, jsx and _value(last), out)
        elif kind == "comment" and mode[0] != "code" and text.startswith("//"):
            text = "/"  # in a tag this is no comment
        line += text.count("\n")
        at += len(text)
    return out


def _turn(modes: list[list], text: str, code: str, at: int, value: bool, out: list[Token]) -> None:
    """What surrounds the place after an operator."""
    mode = modes[-1]
    if mode[0] == "code":
        if text == "{":
            mode[1] += 1
        elif text == "}" and mode[1]:
            mode[1] -= 1
            if not mode[1] and len(modes) > 1:
                modes.pop()
        elif text == "<" and value and re.match(r"<[A-Za-z_$>]", code[at : at + 2]) and not _TYPE_PARAMETER.match(code, at):
            modes.append(["open"])
    elif text == "{":
        modes.append(["code", 1])
    elif text == ">":
        modes.pop()
        if mode[0] == "close":
            if modes[-1][0] == "text":
                modes.pop()
        elif len(out) < 2 or out[-2].text != "/":  # not <x/>
            modes.append(["text"])


def import_kind(source: str) -> str:
    return "relative" if source.startswith(("./", "../")) else "alias" if source.startswith(("@", "~")) else "external"


#: Words that begin a statement, that go on with one on a new line, and that leave one unfinished at the end of a line.
_STARTS = frozenset("export import const let var function class interface type enum async abstract declare namespace if for while switch try return throw".split())
_GOES_ON = frozenset("instanceof in of as satisfies extends implements from else catch finally".split())
_UNFINISHED = frozenset("export default async abstract declare const let var function class interface type enum new typeof await extends implements import from as in of else case void delete".split())


class Extractor:
    """All seven relations of one file."""

    def __init__(self, path: str, code: str):
        self.path, self.code, self.t = path, code, lex(code, path.lower().endswith("x"))
        self.texts = [t.text for t in self.t]
        self.rows: dict[str, list[dict]] = {k: [] for k in schemas.AST}
        self.close = self._pairs()
        self.opened = {b: a for a, b in self.close.items()}
        self._statements()
        self.owner: dict[int, tuple[int, str]] = {}  # the brace of a body: where its function or class begins, and what it is
        self.later: list[tuple[dict, int]] = []  # rows whose export is told when all bodies are known

    def _pairs(self) -> dict[int, int]:
        stack, out, match = [], {}, {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in "([{":
                stack.append(i)
            elif t.kind == "op" and t.text in match:
                while stack and self.t[stack[-1]].text != match[t.text]:
                    stack.pop()
                if stack:
                    out[stack.pop()] = i
        return out

    def _statements(self) -> None:
        """For each token the bracket around it and the first token of its statement."""
        self.around, self.begin = [-1] * len(self.t), list(range(len(self.t)))
        stack: list[list] = [[-1, None]]  # bracket, begin of the statement now open
        for i, t in enumerate(self.t):
            if i in self.opened:
                while len(stack) > 1 and stack[-1][0] != self.opened[i]:
                    stack.pop()
                if len(stack) > 1:
                    stack.pop()
            top = stack[-1]
            if i and top[1] is not None and self._ends(i):
                top[1] = None
            if top[1] is None:
                top[1] = i
            self.around[i], self.begin[i] = top
            if t.kind == "op" and t.text == ";":
                top[1] = None
            if i in self.close:
                stack.append([i, None])

    def _ends(self, i: int) -> bool:
        """Whether a statement ends before token i without a semicolon."""
        now, last = self.t[i], self.t[i - 1]
        if now.text in _STARTS and now.kind == "name" and last.text == "}":
            return True
        if now.line == last.line or now.kind == "op" and now.text not in ("@", "{") or now.text in _GOES_ON:
            return False
        return last.kind in ("num", "str", "regex") or last.text in (")", "]", "}", ">") or last.kind == "name" and last.text not in _UNFINISHED

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def name(self, i: int) -> str | None:
        return self.text(i) if 0 <= i < len(self.t) and self.t[i].kind == "name" else None

    def raw(self, a: int, b: int) -> str:
        return self.code[self.t[a].start : self.t[b].start + len(self.t[b].text)]

    def run(self) -> dict[str, list[dict]]:
        self._definitions()
        self._top_level()
        self._calls()
        return self.rows

    # definitions -----------------------------------------------------------------

    def _skip_generics(self, i: int) -> int:
        if self.text(i) != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.t), i + 400)):
            depth += {"<": 1, ">": -1}.get(self.text(j), 0)
            if depth == 0:
                return j + 1
        return i

    def _params(self, i: int) -> list[str]:
        out, j, end, fresh = [], i + 1, self.close.get(i, i), True
        while j < end:
            x = self.text(j)
            if fresh and self.t[j].kind == "name" and x not in ("public", "private", "protected", "readonly"):
                out.append(x)
                fresh = False
            elif x in "([{" and self.t[j].kind == "op":
                fresh = False
                j = self.close.get(j, j)
            elif x == ",":
                fresh = True
            elif x == "<":
                j = max(j, self._skip_generics(j) - 1)
            elif x not in ("...", "@") and self.t[j].kind != "name":
                fresh = False
            j += 1
        return out

    def _props(self, i: int) -> list[str]:
        """Names of the first, destructured parameter."""
        if self.text(i + 1) != "{":
            return []
        out, j, end, fresh = [], i + 2, self.close.get(i + 1, i), True
        while j < end:
            x = self.text(j)
            if fresh and self.t[j].kind == "name":
                out.append(x)
                fresh = False
            elif x == ",":
                fresh = True
            elif x in ("{", "[", "("):
                j = self.close.get(j, j)
            j += 1
        return out

    def _body(self, i: int) -> tuple[int, int] | None:
        """The body after the parameters that close at i: braces, or for an arrow its expression."""
        j = i + 1
        if self.text(j) == ":":
            j += 1
            while j < len(self.t) and self.text(j) not in ("{", "=>", ";") or self.text(j) == "{" and self.text(self.close.get(j, j) + 1) in ("{", "=>", "[", "|", "&"):
                j = self.close.get(j, j) + 1
        if self.text(j) == "=>":
            j += 1
            if self.text(j) == "{":
                return j, self.close.get(j, len(self.t) - 1)
            end = j
            while end < len(self.t) and self.text(end) not in (",", ";", ")", "}", "]"):
                end = self.close.get(end, end) + 1
                if end < len(self.t) and self.t[end].line > self.t[end - 1].line and self.name(end) in ("const", "let", "function", "export", "class", "return"):
                    break
            return j, max(j, end - 1)
        return (j, self.close.get(j, len(self.t) - 1)) if self.text(j) == "{" else None

    def _definitions(self) -> None:
        self.spans: list[tuple[int, int, str | None]] = []  # body, enclosing name
        classes: list[tuple[int, int]] = []
        n = len(self.t)
        for i in range(n):
            x = self.text(i)
            if x == "class" and self.t[i].kind == "name" and self.text(i - 1) != ".":
                name = self.name(i + 1)
                j = i + 1
                while j < n and self.text(j) != "{":
                    j += 1
                classes.append((j, self.close.get(j, n - 1)))
                self.owner[j] = (i - (self.text(i - 1) == "abstract"), "class")
                head = self.raw(i, j) if j < n else ""
                if name and name[:1].isupper() and re.search(r"extends[^{]*Component", head):
                    self._component(name, "class", [], i)
            elif x in ("interface", "type") and self.name(i + 1) and self.text(i - 1) not in (".", "import", "export") or x in ("interface", "type") and self.text(i - 1) == "export" and self.name(i + 1):
                self._type(i, x)
        for i in range(n):
            x = self.text(i)
            if x == "function" and self.t[i].kind == "name" and self.text(i - 1) not in (".",):
                star = self.text(i + 1) == "*"
                j = i + 1 + star
                name = self.name(j)
                p = self._skip_generics(j + (name is not None))
                is_async = self.text(i - 1) == "async"
                if self.text(p) == "(" and p in self.close:
                    body = self._body(self.close[p])
                    lead = i - is_async
                    declared = name is not None and self.text(lead - 1) not in ("=", "(", ",", "return", ":", "=>")
                    if declared:
                        self._function(name, "generator" if star else "function", is_async, p, i, body)
                    if body:
                        self.spans.append((*body, name))
                        self.owner[body[0]] = (lead, "function")
            elif x == "=>":
                p = i - 1
                start = None
                if self.text(p) == ")" or self.t[p].kind == "name":
                    start = p if self.t[p].kind == "name" and self.text(p - 1) != ":" else self._open_before(i)
                if start is None:
                    continue
                body = self._body(i - 1)
                is_async = self.text(start - 1) == "async"
                name = self._bound_name(start - is_async)
                self._function(name, "arrow", is_async, start if self.text(start) == "(" else None, start - is_async, body, [self.text(start)] if self.t[start].kind == "name" else None)
                if body:
                    self.spans.append((*body, name))
                    self.owner[body[0]] = (start - is_async, "arrow")
        for a, b in classes:
            i = a + 1
            while i < b:
                x = self.text(i)
                if self.t[i].kind == "name" and x not in KEYWORDS:
                    p = self._skip_generics(i + 1)
                    if self.text(p) == "(" and p in self.close and self.text(i - 1) != ".":
                        body = self._body(self.close[p])
                        if body and self.text(body[0] - 1) != "=>":
                            self._function(x, "method", "async" in (self.text(i - 1), self.text(i - 2)), p, i, body, exported=False)
                            self.spans.append((*body, x))
                            self.owner[body[0]] = (i, "method")
                            i = body[1] + 1
                            continue
                if x in ("{", "(", "["):
                    i = self.close.get(i, i)
                i += 1
        self.spans.sort(key=lambda x: (x[0], -x[1]))
        for row, at in self.later:
            row["exported"] = self._exported(at)

    def _open_before(self, arrow: int) -> int | None:
        """The parenthesis of the parameters before an arrow, over a return type."""
        j = arrow - 1
        for j in range(arrow - 1, max(-1, arrow - 60), -1):
            if self.text(j) == ")":
                return self.opened.get(j)
            if self.text(j) in (";", "{", "}") and j != arrow - 1:
                return None
        return None

    def _bound_name(self, i: int) -> str | None:
        """The variable that an arrow is bound to, also through a call around it."""
        j = i - 1
        if self.text(j) == ">":  # type parameters
            depth = 0
            for k in range(j, max(-1, j - 60), -1):
                depth += {">": 1, "<": -1}.get(self.text(k), 0)
                if not depth:
                    j = k - 1
                    break
        for _ in range(2):
            if self.text(j) == "(":
                j -= 1
                while self.t[j].kind == "name" or self.text(j) == "." or self.text(j) == ">":
                    j -= 1
                    if self.text(j) == "=":
                        break
        if self.text(j) != "=":
            return None
        k = j - 1
        back = 0
        while k > 0 and back < 40 and self.text(k) not in ("const", "let", "var", ";", "{", "}"):
            k, back = k - 1, back + 1
        return self.name(k + 1) if self.text(k) in ("const", "let", "var") else None

    def _exported(self, i: int, most: int = 4) -> bool:
        """Whether an export statement is among the ``most`` nearest nodes around the definition that begins at token i."""
        up = 0
        while up < most:
            first = self.begin[i]
            declared = self.text(first + (self.text(first) == "export")) in ("const", "let", "var") and first < i
            up += 2 if declared else 0  # declarator and declaration
            if self.text(first) == "export":
                return up + 1 <= most
            brace = self.around[i]
            if brace < 0:
                return False
            if self.text(brace) == "(":
                callee = self.t[brace - 1] if brace else None
                called = callee is not None and (callee.kind == "name" and callee.text not in KEYWORDS or callee.text in (")", "]", ">"))
                up += 2 - 2 * declared if called else 1
                i = self._object_start(brace - 1) if called else brace
            elif self.text(brace) == "[":
                up, i = up + 1, brace
            else:
                at, kind = self.owner.get(brace, (brace, "block"))
                inside = 0 if declared or self.begin[i] == i else 1  # return or expression statement, field of a class or an object
                up += inside + (1 if kind == "block" and not self._is_statement(brace) else 2)
                i = at
        return False

    def _is_statement(self, brace: int) -> bool:
        """Whether a brace opens the block of a statement and not an object."""
        return self.text(brace - 1) in (")", "else", "try", "finally", "do", ";", "{", "}", "")

    def _function(self, name, kind, is_async, params, at, body, given=None, exported=None) -> None:
        names = given if given is not None else self._params(params) if params is not None else []
        row = {"file": self.path, "name": name, "kind": kind, "async": is_async, "params": names, "line": self.t[at].line, "exported": False}
        self.rows["functions"].append(row)
        if exported is None:
            self.later.append((row, at))
        if name and name[:1].isupper() and kind != "method" and body and self._jsx(*body):
            self._component(name, "arrow" if kind == "arrow" else "function", self._props(params) if params is not None else [], at)

    def _component(self, name, kind, props, at) -> None:
        row = {"file": self.path, "name": name, "kind": kind, "props": props, "exported": False, "line": self.t[at].line}
        self.rows["components"].append(row)
        self.later.append((row, at))

    def _jsx(self, a: int, b: int) -> bool:
        for i in range(a, min(b, len(self.t) - 2) + 1):
            if self.text(i) == "<" and self.text(i - 1) in ("(", "return", "=>", "?", ":", "&&", "||", "{", "[", ",", ">", "=") and (self.t[i + 1].kind == "name" or self.text(i + 1) == ">"):
                return True
        return False

    def _type(self, i: int, kind: str) -> None:
        j = self._skip_generics(i + 2)
        if kind == "type":
            if self.text(j) != "=":
                return
            j += 1
        while kind == "interface" and j < len(self.t) and self.text(j) != "{":
            j += 1
        members = []
        if self.text(j) == "{":
            end, k, fresh = self.close.get(j, len(self.t)), j + 1, True
            while k < end:
                x = self.text(k)
                if fresh and self.t[k].kind in ("name", "str") and x not in ("readonly",) and self.text(k + 1) in (":", "?", "(", "<"):
                    members.append(x.strip("'\""))
                    fresh = False
                elif x in ("{", "(", "["):
                    k = self.close.get(k, k)
                if self.text(k) in (";", ",") or k + 1 < end and self.t[k + 1].line > self.t[k].line:
                    fresh = True
                k += 1
        self.rows["types"].append({"file": self.path, "name": self.name(i + 1), "kind": kind, "exported": self.text(i - 1) == "export", "members": members, "line": self.t[i].line})

    # statements of the file ----------------------------------------------------------

    def _top_level(self) -> None:
        i, n = 0, len(self.t)
        while i < n:
            x = self.text(i)
            if x == "import" and self.text(i + 1) not in ("(", "."):
                i = self._import(i)
            elif x == "export":
                i = self._export(i)
            else:
                i = self.close.get(i, i) + 1 if x in ("{", "(", "[") else i + 1

    def _clause(self, i: int) -> list[tuple[str, str | None]]:
        out, j, end = [], i + 1, self.close.get(i, i)
        while j < end:
            name = self.text(j)
            if name == "type" and self.name(j + 1) and self.text(j + 1) != "as":
                j += 1
                name = self.text(j)
            alias = None
            if self.text(j + 1) == "as":
                alias = self.text(j + 2)
                j += 2
            out.append((name, alias))
            while j < end and self.text(j) != ",":
                j += 1
            j += 1
        return out

    def _import(self, i: int) -> int:
        row = {"file": self.path, "source": "", "import_kind": "", "default": None, "named": [], "namespace": None, "type_only": False, "side_effect": False, "line": self.t[i].line}
        j = i + 1
        if self.text(j) == "type" and self.text(j + 1) not in ("from", ","):
            row["type_only"] = True
            j += 1
        row["side_effect"] = j < len(self.t) and self.t[j].kind == "str"
        while j < len(self.t) and self.t[j].kind != "str" and self.text(j) != ";":
            if self.text(j) == "{":
                row["named"] = [{"name": a, "alias": b} for a, b in self._clause(j)]
                j = self.close.get(j, j)
            elif self.text(j) == "*":
                row["namespace"] = self.text(j + 2)
                j += 2
            elif self.t[j].kind == "name" and self.text(j) != "from":
                row["default"] = self.text(j)
            j += 1
        if j < len(self.t) and self.t[j].kind == "str":
            row["source"] = self.text(j).strip("'\"`")
            row["import_kind"] = import_kind(row["source"])
            self.rows["imports"].append(row)
        return j + 1

    def _export(self, i: int) -> int:
        line = self.t[i].line
        add = lambda **k: self.rows["exports"].append({"file": self.path, "name": None, "local_name": None, "kind": "named", "type_only": False, "source": None, "line": line} | k)
        j = i + 1
        only = self.text(j) == "type" and self.text(j + 1) in ("{", "*")
        j += only

        def source(k: int) -> str | None:
            return self.text(k + 1).strip("'\"`") if self.text(k) == "from" else None

        if self.text(j) == "*":
            if self.text(j + 1) == "as":
                add(name=self.text(j + 2), kind="namespace-reexport", type_only=only, source=source(j + 3))
                return j + 5
            add(name="*", kind="re-export", type_only=only, source=source(j + 1))
            return j + 3
        if self.text(j) == "{":
            end = self.close.get(j, j)
            src = source(end + 1)
            for name, alias in self._clause(j):
                add(name=alias or name, local_name=name, kind="re-export" if src else "named", type_only=only, source=src)
            return end + (3 if src else 1)
        if self.text(j) == "default":
            k = j + 1
            while self.text(k) in ("async", "function", "class", "*", "abstract"):
                k += 1
            add(name="default", local_name=self.name(k), kind="default")
            return j + 1
        while self.text(j) in ("async", "abstract", "declare"):
            j += 1
        word = self.text(j)
        if word in ("interface", "type"):
            add(name=self.name(j + 1), local_name=self.name(j + 1), type_only=True)
        elif word in ("const", "let", "var") and self.text(j + 1) != "enum":
            add(name=self.name(j + 1), local_name=self.name(j + 1))
        elif word in ("function", "class", "enum", "namespace", "const"):
            k = j + 1 + (self.text(j + 1) in ("*", "enum"))
            add(name=self.name(k), local_name=self.name(k))
        return j + 1

    # calls and hooks ------------------------------------------------------------------

    def _object_start(self, i: int) -> int:
        """First token of the member chain that ends at token i."""
        while i >= 0:
            if self.text(i) in (")", "]"):
                i = self.opened.get(i, i) - 1
                if i >= 0 and (self.t[i].kind == "name" and self.text(i) not in KEYWORDS or self.text(i) in (")", "]")):
                    continue
                return i + 1
            if self.text(i - 1) in (".", "?.") and self.t[i].kind == "name":
                i -= 2
                continue
            return i
        return 0

    def _calls(self) -> None:
        declared = {(r["line"], r["name"]) for r in self.rows["functions"] if r["kind"] in ("function", "generator", "method")}
        seen: dict[int, dict] = {}
        inside: list[tuple[int, int, str | None]] = []  # bodies around this token, the innermost last
        spans, nth = self.spans, 0
        for i, t in enumerate(self.t):
            while nth < len(spans) and spans[nth][0] <= i:
                inside.append(spans[nth])
                nth += 1
            while inside and inside[-1][1] < i:
                inside.pop()
            if t.kind != "name" or t.text in KEYWORDS or self.text(i + 1) not in ("(", "<", "?."):
                continue
            p = self._skip_generics(i + 1) if self.text(i + 1) == "<" else i + 1
            if self.text(p) == "?." and self.text(p + 1) == "(":
                p += 1
            if self.text(p) != "(" or p not in self.close or self.text(i - 1) == "function" or self.text(i - 2) == "function" and self.text(i - 1) == "*" or (t.line, t.text) in declared and self.text(i - 1) not in (".", "?.", "=", "return", "(", "new"):
                continue
            if t.text == "async" and self.text(self.close[p] + 1) == "=>":
                continue
            member = self.text(i - 1) in (".", "?.")
            start = self._object_start(i) if member else i
            new = self.text(start - 1) == "new"
            row = {"file": self.path, "caller": inside[-1][2] if inside else None, "callee": t.text, "callee_object": self.raw(start, i - 2) if member else None, "kind": "new" if new else "call", "line": self.t[start].line}
            seen[self.t[start].start - (4 if new else 0)] = row  # of calls that begin at one place the outermost stays
            if not member and not new and _HOOK.match(t.text):
                self.rows["hooks"].append({"file": self.path, "name": t.text, "caller": row["caller"], "args_count": self._count(p), "line": t.line})
        self.rows["calls"] = [seen[k] for k in sorted(seen)]

    def _count(self, p: int) -> int:
        end, j, n, fresh = self.close[p], p + 1, 0, True
        while j < end:
            if self.text(j) == ",":
                fresh = True
            elif fresh:
                n, fresh = n + 1, False
            j = self.close.get(j, j) + 1 if self.text(j) in ("(", "[", "{") else j + 1
        return n


def extract(path: str, code: str) -> dict[str, list[dict]]:
    return Extractor(path, code).run()


_OUT = T.StructType([*(T.StructField(k, T.ArrayType(v)) for k, v in schemas.AST.items()), T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])


def extract_files(files: DataFrame) -> DataFrame:
    """One row a TypeScript file with the seven relations as arrays. A file that is not text, or on which extraction
    fails, has none of them but an error (see :func:`rejects`); the others are not touched by it."""

    def one(path: str, code: str | None) -> dict:
        if code is None:
            return {"path": path, "error": "not valid UTF-8"}
        try:
            return {**extract(path, code), "path": path, "error": None}
        except Exception as e:  # one odd file must not end the job; it is reported
            return {"path": path, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_OUT)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows = [one(p, c) for p, c in zip(part["path"].to_pylist(), part["content"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = files.where(F.lower("path").rlike(r"\.tsx?$")).select("path", "content")
    return kept.repartition(spread, "path").mapInArrow(run, _OUT)  # small tables come in few partitions, and a file takes about a millisecond


def relation(extracted: DataFrame, name: str) -> DataFrame:
    return extracted.select(F.explode(name).alias("r")).select("r.*")


def rejects(extracted: DataFrame) -> DataFrame:
    """(path, error) of the files that could not be read."""
    return extracted.where("error is not null").select("path", "error")
