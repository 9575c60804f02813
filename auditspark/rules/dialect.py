"""Plan-time rewrite of rule patterns from the JavaScript dialect.

Java (Spark) differences handled here:
  * ``\\b`` in Java counts accented letters as word characters; JavaScript
    does not.  Rewritten as an explicit ASCII boundary.
  * ``$`` in Java also matches before a final ``\\r``; without the ``m`` flag
    JavaScript's ``$`` is end of input, so it becomes ``\\z``.
  * A ``{`` that does not start a quantifier is a literal in JavaScript but an
    error in Java: escaped.
  * Flags: ``i`` -> ``(?i)``, ``m`` -> ``(?m)``; ``g`` is implied by
    ``regexp_extract_all``.

RE2 (the DuckDB oracle) takes the JavaScript text almost as is; only flags are
prefixed. Look-ahead rules are handled by the caller.
"""
from __future__ import annotations

import re

_ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_QUANT = re.compile(r"\{\d+(,\d*)?\}")


def _flag_prefix(flags: str) -> str:
    out = ""
    if "i" in flags:
        out += "i"
    if "m" in flags:
        out += "m"
    return f"(?{out})" if out else ""


def to_java(pattern: str, flags: str) -> str:
    multiline = "m" in flags
    out = []
    i, n = 0, len(pattern)
    in_class = False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                out.append(_ASCII_BOUNDARY)
            else:
                out.append(c + nxt)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            # a leading ']' or '^]' is literal inside the class
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("^")
                i += 1
        elif c == "$" and not multiline:
            out.append(r"\z")
        elif c == "{" and not _QUANT.match(pattern, i):
            out.append(r"\{")
        else:
            out.append(c)
        i += 1
    return _flag_prefix(flags) + "".join(out)


def to_re2(pattern: str, flags: str) -> str:
    out = []
    i, n = 0, len(pattern)
    in_class = False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            out.append(c + pattern[i + 1])
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
        elif c == "[":
            in_class = True
        elif c == "{" and not _QUANT.match(pattern, i):
            out.append(r"\{")
            i += 1
            continue
        out.append(c)
        i += 1
    return _flag_prefix(flags) + "".join(out)


_GLOB_TOKEN = re.compile(r"\*\*/|\*\*|.", re.DOTALL)
_GLOB_PART = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_to_regex(glob: str) -> str:
    """A glob (``*`` and ``?`` within a path segment, ``**`` across) as the body of
    a Java or RE2 regex; neighbouring ``**`` runs count as one."""
    tokens = _GLOB_TOKEN.findall(re.sub(r"\*\*(?:/?\*+)*", "**", glob))
    return "".join(_GLOB_PART.get(t) or (t if t.isalnum() or t in "/_- " or ord(t) > 127 else "\\" + t) for t in tokens)


def any_of(words) -> str:
    """A Java or RE2 regex for any of the words, common beginnings written once: at a
    place of a text, one branch by its character and not one for each word."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}  # a word ends: what is longer need not be looked at

    def branch(node: dict) -> str:
        if "" in node:
            return ""
        parts = [re.escape(c) + branch(rest) for c, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return branch(tree)
