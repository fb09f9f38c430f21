"""Lexer and parser of the path language (XPath 3.1 expressions) into a small syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any


class PathSyntaxError(ValueError):
    """XPST0003"""


@dataclass(frozen=True)
class Node:
    """One expression: its kind, a name or operator, and its parts."""

    kind: str
    name: Any = None
    parts: tuple = ()
    extra: Any = field(default=None)


_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\(:(?:[^:(]|:(?!\))|\((?!:))*:\))+)
    |(?P<double>(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)|(?P<decimal>\d+\.\d*|\.\d+)|(?P<integer>\d+)
    |(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')
    |(?P<uri>Q\{[^{}]*\}[\w.\-]+)
    |(?P<name>[A-Za-z_À-￿][\w.\-]*(?::(?!:)[A-Za-z_À-￿][\w.\-]*)?)
    |(?P<op>::|:=|\|\||=>|!=|<=|>=|<<|>>|//|\.\.|[-+*/=<>|()\[\]{},.$@!?#:])""",
    re.X,
)
AXES = ("child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "self", "attribute", "namespace", "following", "following-sibling", "preceding", "preceding-sibling")
KIND_TESTS = ("node", "text", "comment", "processing-instruction", "element", "attribute", "document-node", "namespace-node", "schema-element", "schema-attribute")
VALUE_COMPARE = ("eq", "ne", "lt", "le", "gt", "ge")
GENERAL_COMPARE = ("=", "!=", "<", "<=", ">", ">=")


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise PathSyntaxError(f"XPST0003: unexpected {text[at]!r} at {at}")
        if found.lastgroup != "space":
            out.append((found.lastgroup, found.group()))
        at = found.end()
    return [*out, ("end", "")]


def parse(text: str) -> Node:
    p = _Parser(lex(text))
    out = p.expr()
    p.need("end", "")
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def see(self, *texts: str, ahead: int = 0) -> bool:
        kind, text = self.peek(ahead)
        return kind in ("op", "name") and text in texts

    def got(self, *texts: str) -> str | None:
        return self.take()[1] if self.see(*texts) else None

    def need(self, kind: str, text: str | None = None) -> str:
        found, value = self.take()
        if found != kind or (text is not None and value != text):
            raise PathSyntaxError(f"XPST0003: expected {text or kind}, found {value or 'the end'!r}")
        return value

    def op(self, text: str) -> None:
        self.need("op", text)

    # expressions, loosest first

    def expr(self) -> Node:
        parts = [self.single()]
        while self.got(","):
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else Node("sequence", parts=tuple(parts))

    def single(self) -> Node:
        if self.see("for", "let", "some", "every") and self.see("$", ahead=1):
            return self.binding()
        if self.see("if") and self.see("(", ahead=1):
            self.take()
            self.op("(")
            test = self.expr()
            self.op(")")
            self.need("name", "then")
            then = self.single()
            self.need("name", "else")
            return Node("if", parts=(test, then, self.single()))
        return self.binary(0)

    def binding(self) -> Node:
        kind = self.take()[1]
        bound = []
        while True:
            self.op("$")
            name = self.need("name")
            self.op(":=") if kind == "let" else self.need("name", "in")
            bound.append((name, self.single()))
            if not self.got(","):
                break
        self.need("name", "return" if kind in ("for", "let") else "satisfies")
        return Node(kind, parts=(self.single(),), extra=tuple(bound))

    LEVELS = (("or",), ("and",), ("compare",), ("||",), ("to",), ("+", "-"), ("*", "div", "idiv", "mod"), ("union", "|"), ("intersect", "except"))

    def binary(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.typed()
        ops = self.LEVELS[level]
        left = self.binary(level + 1)
        if ops == ("compare",):
            kind = "general" if self.see(*GENERAL_COMPARE) else "value" if self.see(*VALUE_COMPARE) else "node-compare" if self.see("is", "<<", ">>") else None
            return Node(kind, self.take()[1], (left, self.binary(level + 1))) if kind else left
        while self.see(*ops):
            name = self.take()[1]
            left = Node({"|": "set", "union": "set", "intersect": "set", "except": "set", "or": "logic", "and": "logic", "||": "concat", "to": "range"}.get(name, "arithmetic"), "union" if name == "|" else name, (left, self.binary(level + 1)))
        return left

    def typed(self) -> Node:
        out = self.arrow()
        for kind, words in (("instance", ("instance", "of")), ("treat", ("treat", "as")), ("castable", ("castable", "as")), ("cast", ("cast", "as"))):
            if self.see(words[0]) and self.see(words[1], ahead=1):
                self.at += 2
                out = Node(kind, self.sequence_type(), (out,))
        return out

    def sequence_type(self) -> str:
        name = self.need("name") if self.peek()[0] == "name" else self.need("uri")
        if self.got("("):
            depth, inner = 1, ""
            while depth:
                kind, text = self.take()
                if kind == "end":
                    raise PathSyntaxError("XPST0003: a type is not closed")
                depth += (text == "(") - (text == ")")
                inner += text if depth else ""
            name += f"({inner})"
        return name + (self.got("?", "*", "+") or "")

    def arrow(self) -> Node:
        out = self.unary()
        while self.got("=>"):
            if self.got("$"):
                target = Node("variable", self.need("name"))
            elif self.see("("):
                self.take()
                target = self.expr()
                self.op(")")
            else:
                out = Node("call", self.need("name"), (out, *self.arguments()))
                continue
            out = Node("dynamic", parts=(target, out, *self.arguments()))
        return out

    def unary(self) -> Node:
        minus = 0
        while self.see("-", "+"):
            minus += self.take()[1] == "-"
        out = self.simple_map()
        return Node("negate", parts=(out,)) if minus % 2 else out

    def simple_map(self) -> Node:
        out = self.path()
        while self.got("!"):
            out = Node("map", parts=(out, self.path()))
        return out

    # paths

    def path(self) -> Node:
        steps: list[Node] = []
        if self.got("//"):
            steps = [Node("root"), Node("step", "descendant-or-self", extra=("kind", "node", ()))]
        elif self.got("/"):
            steps = [Node("root")]
            if not self._starts_step():
                return steps[0]
        steps.append(self.step())
        while self.see("/", "//"):
            if self.take()[1] == "//":
                steps.append(Node("step", "descendant-or-self", extra=("kind", "node", ())))
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else Node("path", parts=tuple(_fused(steps)))

    def _starts_step(self) -> bool:
        kind, text = self.peek()
        return kind in ("name", "uri", "string", "integer", "decimal", "double") or text in ("@", "*", ".", "..", "$", "(", "[")

    def step(self) -> Node:
        kind, text = self.peek()
        if text == ".." and kind == "op":
            self.take()
            return self.predicates(Node("step", "parent", extra=("kind", "node", ())))
        if text == "@" and kind == "op":
            self.take()
            return self.predicates(Node("step", "attribute", extra=self.node_test()))
        if kind == "name" and text in AXES and self.see("::", ahead=1):
            self.at += 2
            return self.predicates(Node("step", text, extra=self.node_test()))
        if text == "*" and kind == "op":
            return self.predicates(Node("step", "child", extra=self.node_test()))
        if kind in ("name", "uri") and not (self.see("(", ahead=1) and text not in KIND_TESTS) and not self.see("#", ahead=1) and not (text in ("map", "array") and self.see("{", ahead=1)) and not (text == "function" and self.see("(", ahead=1)):
            test = self.node_test()
            return self.predicates(Node("step", "attribute" if test[:2] == ("kind", "attribute") else "child", extra=test))
        return self.postfix()

    def node_test(self) -> tuple:
        kind, text = self.take()
        if text == "*":
            if self.see(":") and self.peek(1)[0] == "name":
                self.take()
                return ("name", "*", self.need("name"))
            return ("name", "*", "*")
        if kind == "uri":
            uri, _, local = text[2:].partition("}")
            return ("name", "{" + uri, local)
        if kind != "name":
            raise PathSyntaxError(f"XPST0003: no node test: {text!r}")
        if text in KIND_TESTS and self.see("("):
            self.take()
            inner = []
            while not self.got(")"):
                inner.append(self.take()[1])
            return ("kind", text, tuple(inner))
        if self.see(":") and self.see("*", ahead=1):
            self.at += 2
            return ("name", text, "*")
        prefix, _, local = text.rpartition(":")
        return ("name", prefix, local)

    def predicates(self, out: Node) -> Node:
        while self.got("["):
            out = Node("filter", parts=(out, self.expr()))
            self.op("]")
        return out

    def postfix(self) -> Node:
        out = self.primary()
        while True:
            if self.got("["):
                out = Node("filter", parts=(out, self.expr()))
                self.op("]")
            elif self.see("("):
                out = Node("dynamic", parts=(out, *self.arguments()))
            elif self.got("?"):
                out = Node("lookup", parts=(out, *self.key()))
            else:
                return out

    def key(self) -> tuple[Node, ...]:
        if self.got("*"):
            return ()
        kind, text = self.peek()
        if kind == "integer":
            self.take()
            return (Node("literal", int(text), extra="integer"),)
        if kind == "name":
            self.take()
            return (Node("literal", text, extra="string"),)
        self.op("(")
        out = self.expr()
        self.op(")")
        return (out,)

    def arguments(self) -> tuple[Node, ...]:
        self.op("(")
        out = []
        while not self.got(")"):
            if self.see("?") and self.see(",", ")", ahead=1):
                self.take()
                out.append(Node("placeholder"))
            else:
                out.append(self.single())
            if not self.see(")"):
                self.op(",")
        return tuple(out)

    def primary(self) -> Node:
        kind, text = self.take()
        if kind == "string":
            return Node("literal", text[1:-1].replace(text[0] * 2, text[0]), extra="string")
        if kind == "integer":
            return Node("literal", int(text), extra="integer")
        if kind == "decimal":
            return Node("literal", Decimal(text), extra="decimal")
        if kind == "double":
            return Node("literal", float(text), extra="double")
        if text == "$":
            return Node("variable", self.need("name"))
        if text == ".":
            return Node("context")
        if text == "(":
            if self.got(")"):
                return Node("sequence")
            out = self.expr()
            self.op(")")
            return Node("paren", parts=(out,))
        if text == "?":
            return Node("lookup", parts=(Node("context"), *self.key()))
        if text == "[":
            members = []
            while not self.got("]"):
                members.append(self.single())
                if not self.see("]"):
                    self.op(",")
            return Node("array", parts=tuple(members))
        if kind in ("name", "uri"):
            if text == "map" and self.got("{"):
                entries = []
                while not self.got("}"):
                    key = self.single()
                    self.op(":")
                    entries.append((key, self.single()))
                    if not self.see("}"):
                        self.op(",")
                return Node("map-constructor", extra=tuple(entries))
            if text == "array" and self.got("{"):
                body = Node("sequence") if self.see("}") else self.expr()
                self.op("}")
                return Node("array-of", parts=(body,))
            if text == "function" and self.see("("):
                return self.inline()
            if self.got("#"):
                return Node("reference", text, extra=int(self.need("integer")))
            if self.see("("):
                return Node("call", text, self.arguments())
        raise PathSyntaxError(f"XPST0003: unexpected {text or 'end'!r}")

    def inline(self) -> Node:
        self.op("(")
        names = []
        while not self.got(")"):
            self.op("$")
            names.append(self.need("name"))
            if self.got("as"):
                self.sequence_type()
            if not self.see(")"):
                self.op(",")
        if self.got("as"):
            self.sequence_type()
        self.op("{")
        body = Node("sequence") if self.see("}") else self.expr()
        self.op("}")
        return Node("function", extra=tuple(names), parts=(body,))


def _fused(steps: list[Node]) -> list[Node]:
    """descendant-or-self::node()/child::x is descendant::x, unless a predicate counts positions."""
    out: list[Node] = []
    for s in steps:
        before = out[-1] if out else None
        if before == Node("step", "descendant-or-self", extra=("kind", "node", ())) and s.kind == "step" and s.name == "child":
            out[-1] = Node("step", "descendant", extra=s.extra)
        else:
            out.append(s)
    return out
