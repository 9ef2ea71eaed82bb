"""Plain Python versions of the corpus operators, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def contamination(docs: list[tuple], items: list[tuple], span: int = 10) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            k = min(span, len(w))
            for i in range(len(w) - k + 1):
                windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    lengths = sorted({len(k) for k in windows})
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def base_licenses(text: str | None) -> tuple:
    w, starts, labels = words(text), [], set()
    for label, phrase in (("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])):
        for i in range(len(w) - len(phrase) + 1):
            if w[i : i + len(phrase)] == phrase:
                starts.append(i)
                labels.add(label)
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def base_secrets(text: str | None) -> tuple:
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))
    return (*[sum(k == j for _, j, _ in out) for k in range(3)], hashlib.sha256(told.encode()).hexdigest())


def markov_ratios(strings: list[tuple[str, bool]], alphabet: str) -> dict[str, float]:
    """Log-likelihood ratio of each pair of characters from strings labelled random or not, by add-one counts."""
    logs = {}
    for label in (True, False):
        seen = Counter(s[i : i + 2] for s, random in strings if random == label for i in range(len(s) - 1))
        for a in alphabet:
            total = sum(seen[a + b] + 1 for b in alphabet)
            for b in alphabet:
                logs[label, a + b] = math.log((seen[a + b] + 1) / total)
    return {g: logs[True, g] - logs[False, g] for _, g in logs}


def markov_spans(text: str | None, ratios: dict[str, float], least: float = 0.7) -> list[tuple[int, int]]:
    """Parts of long runs outside fixed forms whose mean ratio is high enough."""
    t, base, out = text or "", [], []
    base += [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    base += [m.span() for m in re.finditer("AKIA[A-Z0-9]{14,}", t)] + [m.span() for m in re.finditer("[0-9a-f]{16,}", t)]
    named = ASSIGN.pattern[: ASSIGN.pattern.rindex("([")]
    for run in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        at = 0
        forms = [m.span() for m in re.finditer(named + "[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", run[0])]
        for s, e in [*forms, (len(run[0]), len(run[0]))]:
            part, start = run[0][at:s], run.start() + at
            if len(part) >= 20 and re.search("[A-Za-z]", part) and not any(x < start + len(part) and start < y for x, y in base):
                if sum(ratios[part[i : i + 2]] for i in range(len(part) - 1)) / (len(part) - 1) >= least:
                    out.append((start, start + len(part)))
            at = e
    return out
