"""Operators over the positions of tokens that no built-in expresses: sloppy phrases, intervals, edit distance with transpositions."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance, or limit + 1 where it is greater."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            nxt[j] = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                nxt[j] = min(nxt[j], before[j - 2] + 1)
        before, row = row, nxt
        if min(row) > limit and min(before) > limit:
            return limit + 1
    return row[-1]


def fuzziness(value: object, term: str) -> int:
    """AUTO:low,high by length, or the number itself."""
    text = str(value).upper()
    if text.startswith("AUTO"):
        low, high = map(int, text[5:].split(",")) if ":" in text else (3, 6)
        return 0 if len(term) < low else 1 if len(term) < high else 2
    return min(2, int(float(text)))


def fuzzy_any(tokens: Column, term: str, edits: int, prefix: int = 0) -> Column:
    """Whether a token is within ``edits`` of the term, swaps of neighbours counting once. Tokens are cut by length and prefix first."""
    near = F.filter(tokens, lambda x: (F.abs(F.length(x) - len(term)) <= edits) & (F.substring(x, 1, prefix) == term[:prefix]) & (F.levenshtein(x, F.lit(term)) <= 2 * edits))

    @F.pandas_udf("boolean")
    def close(found: pd.Series) -> pd.Series:
        return found.map(lambda ts: any(osa(t, term, edits) <= edits for t in ts) if ts is not None else False)

    return (F.size(near) > 0) & close(near)


def edits(c: Column, term: str, limit: int) -> Column:
    """The edits between a string and the term, swaps of neighbours counting once, or limit + 1 where there are more."""

    @F.pandas_udf("int")
    def apart(found: pd.Series) -> pd.Series:
        return found.map(lambda t: osa(t, term, limit))

    return apart(c)


def phrase(tokens: Column, terms: list[str], slop: int = 0, prefix: bool = False, ends: list[str] | None = None) -> Column:
    """Whether the terms stand in a row; with ``slop``, whether the spread of place minus offset is at most that. ``prefix``: the last need only begin a token, or is one of ``ends`` where these are given."""
    k = len(terms)
    if k == 0 or (prefix and ends == []):
        return F.lit(False)
    begun = (lambda c: F.startswith(c, F.lit(terms[-1]))) if ends is None else (lambda c: c.isin(ends))
    if slop == 0:

        def here(x: Column, i: Column) -> Column:
            ok = begun(x) if prefix and k == 1 else x == terms[0]
            for j in range(1, k):
                other = F.get(tokens, i + j)
                ok = ok & F.coalesce(begun(other) if prefix and j == k - 1 else other == terms[j], F.lit(False))
            return ok

        return F.coalesce(F.exists(F.transform(tokens, here), lambda b: b), F.lit(False))

    @F.pandas_udf("boolean")
    def sloppy(rows: pd.Series) -> pd.Series:
        def fits(ts: list[str] | None) -> bool:
            if ts is None:
                return False
            at = [[i - n for i, t in enumerate(ts) if ((t.startswith(w) if ends is None else t in ends) if prefix and n == k - 1 else t == w)] for n, w in enumerate(terms)]
            if not all(at):
                return False
            ends = sorted((p, n) for n, ps in enumerate(at) for p in ps)
            for lo, _ in ends:
                near = [sorted(p for p in ps if lo <= p <= lo + slop) for ps in at]
                if all(near) and _distinct([[p + n for p in ps] for n, ps in enumerate(near)]):
                    return True
            return False

        return rows.map(fits)

    needed = F.lit(True)
    for t in terms[: k - 1 if prefix else k]:
        needed = needed & F.array_contains(tokens, t)
    return F.coalesce(needed, F.lit(False)) & sloppy(F.when(needed, tokens))


def _distinct(options: list[list[int]]) -> bool:
    """Whether each slot can take a place of its own."""
    taken: dict[int, int] = {}

    def place(n: int, seen: set[int]) -> bool:
        for p in options[n]:
            if p not in seen:
                seen.add(p)
                if p not in taken or place(taken[p], seen):
                    taken[p] = n
                    return True
        return False

    return all(place(n, set()) for n in range(len(options)))


def _minimal(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that hold no other, ascending in both ends."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: (-s[0], s[1])):
        if not out or s[1] < out[-1][1]:
            out.append(s)
    return out[::-1]


def _combine(parts: list[list[tuple[int, int]]], mode: str, max_gaps: int) -> list[tuple[int, int]]:
    """Spans that hold one of each part: in order without overlap, in any order, or in any order without overlap."""
    found: set[tuple[int, int]] = set()
    starts = [[a for a, _ in p] for p in parts]

    def grow(left: list[int], got: list[tuple[int, int]]) -> None:
        if not left:
            lo, hi = min(a for a, _ in got), max(b for _, b in got)
            covered = len({p for a, b in got for p in range(a, b + 1)})
            if max_gaps < 0 or hi - lo + 1 - covered <= max_gaps:
                found.add((lo, hi))
            return
        first = bisect_right(starts[left[0]], got[-1][1]) if mode == "ordered" and got else 0
        for k in range(first, len(parts[left[0]])):
            s = parts[left[0]][k]
            if mode == "ordered" and got and 0 <= max_gaps < s[0] - got[0][0] - sum(b - a + 1 for a, b in got):
                break  # what comes later leaves more out
            if mode == "unordered_no_overlap" and any(s[0] <= b and a <= s[1] for a, b in got):
                continue
            if mode == "unordered" and s in got:
                continue
            grow(left[1:], [*got, s])
            if mode == "ordered" and max_gaps < 0 and got:
                break  # the first place after what stands before gives the shortest span

    grow(list(range(len(parts))), [])
    return _minimal(found)


def evaluate_intervals(rule: dict, tokens: list[str]) -> list[tuple[int, int]]:
    """Minimal intervals of a rule with analyzed terms: match {terms, max_gaps, mode}, token {regex}, fuzzy {term, edits}, all_of, any_of, each with an optional filter."""
    kind, how = rule["kind"], rule
    if kind == "match":
        out = _combine([[(i, i) for i, t in enumerate(tokens) if t == w] for w in how["terms"]], how["mode"], how["max_gaps"]) if how["terms"] else []
    elif kind == "regex":
        p = re.compile(how["pattern"])
        out = [(i, i) for i, t in enumerate(tokens) if p.fullmatch(t)]
    elif kind == "fuzzy":
        out = [(i, i) for i, t in enumerate(tokens) if osa(t, how["term"], how["edits"]) <= how["edits"]]
    elif kind == "any_of":
        out = _minimal({s for r in how["rules"] for s in evaluate_intervals(r, tokens)})
    else:
        out = _combine([evaluate_intervals(r, tokens) for r in how["rules"]], how["mode"], how["max_gaps"])
    if "filter" in how:
        name, inner = how["filter"]
        other = evaluate_intervals(inner, tokens)
        tests = {
            "containing": lambda s: any(s[0] <= o[0] and o[1] <= s[1] for o in other),
            "contained_by": lambda s: any(o[0] <= s[0] and s[1] <= o[1] for o in other),
            "overlapping": lambda s: any(o[0] <= s[1] and s[0] <= o[1] for o in other),
            "before": lambda s: any(s[1] < o[0] for o in other),
            "after": lambda s: any(s[0] > o[1] for o in other),
        }
        test = tests[name.removeprefix("not_")]
        out = [s for s in out if test(s) != name.startswith("not_")]
    return out


def _needed(rule: dict) -> set[str]:
    """Terms without which a rule has no interval."""
    if rule["kind"] == "match":
        return set(rule["terms"])
    return {t for r in rule["rules"] for t in _needed(r)} if rule["kind"] == "all_of" else set()


def _of_token(rule: dict) -> Callable[[Column], Column] | None:
    """For a rule whose intervals are single tokens that a built-in tells, whether a token is one."""
    if "filter" in rule:
        return None
    if rule["kind"] == "match" and len(rule["terms"]) == 1:
        return lambda x: x == rule["terms"][0]
    if rule["kind"] == "regex":
        return lambda x: F.regexp_like(x, F.lit(f"\\A(?:{rule['pattern']})\\z"))
    if rule["kind"] == "any_of" and rule["rules"] and all(tests := [_of_token(r) for r in rule["rules"]]):
        return lambda x: reduce(lambda a, b: a | b, [test(x) for test in tests])
    return None


def _in_a_row(tokens: Column, tests: list[Callable[[Column], Column]]) -> Column:
    """Whether tokens that pass the tests stand in a row, in one pass: bit j of the state tells whether the last j + 1 tokens pass the first tests, one bit more that a row has ended."""
    k, none = len(tests), F.lit(0).cast("long")

    def step(state: Column, x: Column) -> Column:
        passed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(test(x), F.lit(1 << j).cast("long")).otherwise(none) for j, test in enumerate(tests)])
        ended = state.bitwiseOR(F.shiftleft(state, 1)).bitwiseAND(F.lit(1 << k))
        return F.shiftleft(state, 1).bitwiseOR(F.lit(1)).bitwiseAND(passed).bitwiseOR(ended)

    return F.aggregate(tokens, none, step) >= 1 << (k - 1)


def _built_in(tokens: Column, rule: dict) -> Column | None:
    """Whether the rule has an interval, where built-ins tell it: single tokens, any of such rules, tokens in a row."""
    if test := _of_token(rule):
        return F.exists(tokens, test)
    if "filter" in rule:
        return None
    if rule["kind"] == "any_of":
        found = [_built_in(tokens, r) for r in rule["rules"]]
        return reduce(lambda a, b: a | b, found) if found and all(x is not None for x in found) else None
    if rule["kind"] in ("match", "all_of") and rule["mode"] == "ordered" and rule["max_gaps"] == 0:
        parts = [{"kind": "match", "terms": [t]} for t in rule["terms"]] if rule["kind"] == "match" else rule["rules"]
        tests = [_of_token(r) for r in parts]
        return _in_a_row(tokens, tests) if 0 < len(tests) < 60 and all(tests) else None
    return None


def intervals(tokens: Column, rule: dict) -> Column:
    """Whether the rule has an interval, by built-ins where they tell it. Else rows without a term that it needs are cut off before they go to Python."""
    needed = F.lit(True)
    for t in sorted(_needed(rule)):
        needed = needed & F.array_contains(tokens, t)
    if (found := _built_in(tokens, rule)) is not None:
        return F.coalesce(needed & found, F.lit(False))
    told = json.dumps(rule)

    @F.pandas_udf("boolean")
    def match(rows: pd.Series) -> pd.Series:
        parsed = json.loads(told)
        return rows.map(lambda ts: ts is not None and bool(evaluate_intervals(parsed, list(ts))))

    return needed & match(tokens)
