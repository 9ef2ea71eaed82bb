"""Wildcard and automaton patterns as Java regular expressions of whole strings."""

from __future__ import annotations

import re


def wildcard(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _split_top(pattern: str, sign: str) -> list[str]:
    out, depth, cls, at, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            cls = True
        elif c == "]":
            cls = False
        elif not cls and c in "()":
            depth += 1 if c == "(" else -1
        elif not cls and depth == 0 and c == sign:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def lucene(pattern: str) -> str:
    """Anchored at both ends; @ is any string, <n-m> a number between, & both sides, ~ the complement of what follows."""
    both = _split_top(pattern, "&")
    if len(both) > 1:
        return "(?s)^" + "".join(f"(?=(?:{_plain(p)})$)" for p in both[:-1]) + f"(?:{_plain(both[-1])})$"
    return f"(?s)^(?:{_plain(pattern)})$"


def _plain(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out += pattern[i : i + 2]
            i += 1
        elif c == "[":
            end = pattern.index("]", i + 2)
            out += pattern[i : end + 1]
            i = end
        elif c == "@":
            out += ".*"
        elif c == '"':
            end = pattern.index('"', i + 1)
            out += re.escape(pattern[i + 1 : end])
            i = end
        elif c == "<" and (m := re.match(r"<(\d+)-(\d+)>", pattern[i:])):
            lo, hi = int(m[1]), int(m[2])
            width = len(m[1]) if len(m[1]) == len(m[2]) else 0
            out += "(?:" + "|".join(str(n).zfill(width) for n in range(min(lo, hi), max(lo, hi) + 1)) + ")"
            i += len(m[0]) - 1
        elif c == "~":
            end = i + 2
            if pattern[i + 1] == "(":
                depth, end = 1, i + 2
                while depth:
                    depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                    end += 1
            rest = pattern[end:]
            out += f"(?!(?:{_plain(pattern[i + 1:end])})(?:{_plain(rest)})$).*"
            i = end - 1
        elif c in "^$":
            out += "\\" + c
        else:
            out += c
        i += 1
    return out


def minimum_should_match(spec: object, n: int) -> int:
    """``2``, ``-1``, ``75%``, ``-25%`` and ``3<90% 5<-1`` of n clauses."""
    text = str(spec).strip()
    if "<" in text:
        out = n
        for part in text.split():
            bound, _, then = part.partition("<")
            if n <= int(bound):
                return out
            out = minimum_should_match(then, n)
        return out
    if text.endswith("%"):
        p = float(text[:-1])
        k = int(n * abs(p) / 100)
        k = n - k if p < 0 else k
    else:
        k = int(text)
        k = n + k if k < 0 else k
    return max(0, min(n, k)) if text.startswith("-") or "%" in text else k
