"""Translation of XPath regular expressions to Java's, done once on the driver."""

from __future__ import annotations

#: Classes of XML name characters.
NAME_START = r"_:A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�"
NAME_CHAR = NAME_START + r"\-.0-9·̀-ͯ‿-⁀"


class RegexError(ValueError):
    """FORX0001 (flags), FORX0002 (pattern) or FORX0003 (matches the empty string)."""


def translate(pattern: str, flags: str = "") -> str:
    """The Java form of an XPath pattern, its flags as an inline group."""
    if bad := set(flags) - set("smixq"):
        raise RegexError(f"FORX0001: unknown flag {sorted(bad)[0]}")
    inline = "".join(f for f in "i" if f in flags)
    head = f"(?{inline}u)" if inline else ""
    if "q" in flags:
        return head + "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in pattern)
    if "x" in flags:
        pattern = _without_space(pattern)
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            piece, at = _escape(pattern, at, inside=False)
            out.append(piece)
        elif c == "[":
            piece, at = _class(pattern, at)
            out.append(piece)
        elif c == ".":
            out.append("(?s:.)" if "s" in flags else r"[^\n\r]")
            at += 1
        elif c == "^":
            out.append(r"(?<=\A|\n)" if "m" in flags else r"\A")
            at += 1
        elif c == "$":
            out.append(r"(?=\n|\z)" if "m" in flags else r"\z")
            at += 1
        elif c == "(" and pattern[at : at + 2] == "(?" and pattern[at : at + 3] != "(?:":
            raise RegexError("FORX0002: only (?: is allowed after a parenthesis")
        else:
            out.append(c)
            at += 1
    return head + "".join(out)


def _without_space(pattern: str) -> str:
    out, depth, at = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        depth += (c == "[") - (c == "]" and depth > 0)
        if depth or c not in " \t\r\n":
            out.append(c)
        at += 1
    return "".join(out)


def _escape(pattern: str, at: int, inside: bool) -> tuple[str, int]:
    if at + 1 >= len(pattern):
        raise RegexError("FORX0002: a pattern may not end in a backslash")
    c = pattern[at + 1]
    if c in "iIcC":
        body = NAME_START if c in "iI" else NAME_CHAR
        if inside:
            return (body if c.islower() else f"&&[^{body}]"), at + 2
        return f"[{'' if c.islower() else '^'}{body}]", at + 2
    if c in "pP":
        end = pattern.find("}", at)
        name = pattern[at + 3 : end] if pattern[at + 2 : at + 3] == "{" and end > 0 else ""
        if not name:
            raise RegexError("FORX0002: a category needs braces")
        if name.startswith("Is"):
            name = "In" + name[2:]
        return f"\\{c}{{{name}}}", end + 1
    if c in "dDwW":
        table = {"d": r"\p{Nd}", "D": r"\P{Nd}", "w": r"[^\p{P}\p{Z}\p{C}]", "W": r"[\p{P}\p{Z}\p{C}]"}
        return table[c], at + 2
    if c in "sS":
        return ("" if inside and c == "s" else "[") + {"s": r" \t\n\r", "S": r"^ \t\n\r"}[c] + ("" if inside and c == "s" else "]"), at + 2
    if c in r"nrt\|.?*+(){}[]-^$":
        return "\\" + c, at + 2
    if c.isdigit() and not inside:
        return "\\" + c, at + 2
    raise RegexError(f"FORX0002: unknown escape \\{c}")


def _class(pattern: str, at: int) -> tuple[str, int]:
    """One bracketed class; [a-[b]] takes b's characters away."""
    out, at = ["["], at + 1
    if pattern[at : at + 1] == "^":
        out.append("^")
        at += 1
    while at < len(pattern):
        c = pattern[at]
        if c == "]":
            return "".join(out) + "]", at + 1
        if c == "-" and pattern[at + 1 : at + 2] == "[":
            taken, at = _class(pattern, at + 1)
            inner = taken[1:-1]
            out.append("&&[" + (inner[1:] if inner.startswith("^") else "^" + inner) + "]")
        elif c == "\\":
            piece, at = _escape(pattern, at, inside=True)
            out.append(piece)
        else:
            out.append("\\" + c if c in "[&~#" else c)
            at += 1
    raise RegexError("FORX0002: a class is not closed")


def replacement(text: str, flags: str = "") -> str:
    """The Java form of a replacement: $N and \\$ and \\\\ are the only special parts."""
    if "q" in flags:
        return text.replace("\\", "\\\\").replace("$", "\\$")
    at = 0
    while at < len(text):
        if text[at] == "\\":
            if text[at + 1 : at + 2] not in ("\\", "$"):
                raise RegexError("FORX0004: a backslash may only stand before \\ or $")
            at += 1
        elif text[at] == "$" and not text[at + 1 : at + 2].isdigit():
            raise RegexError("FORX0004: a $ needs a digit")
        at += 1
    return text
