"""query_string and simple_query_string: text syntax parsed into query nodes."""

from __future__ import annotations

import re

from corvane.plans.mapping import TEXT, Mapping

_WORD = re.compile(r'"((?:[^"\\]|\\.)*)"(?:~(\d+))?|/((?:[^/\\]|\\.)+)/|((?:[^\s()\[\]{}":^~\\]|\\.)+)')


def _fields(body: dict, mapping: Mapping) -> list[str]:
    names = body.get("fields") or ([body["default_field"]] if body.get("default_field") not in (None, "*") else ["*"])
    out = []
    for n in names:
        name, caret, boost = n.partition("^")
        for m in mapping.match(name) if "*" in name else [name]:
            f = mapping.get(m)
            if f and (f.type in TEXT or f.type == "keyword" or "*" not in name):
                out.append(m + caret + boost)
    return out


def _over(names: list[str], make: object) -> dict:
    """The same clause over each field: the best of them scores."""
    clauses = []
    for n in names:
        name, _, boost = n.partition("^")
        q = make(name)
        clauses.append({"bool": {"must": [q], "boost": float(boost)}} if boost else q)
    return clauses[0] if len(clauses) == 1 else {"dis_max": {"queries": clauses}} if clauses else {"match_none": {}}


def _as_token(text: str, name: str, mapping: Mapping) -> str:
    """A pattern as it meets a field's tokens: those of text are lower case, a keyword's value is as it is."""
    f = mapping.get(name)
    return text.lower() if f and f.type in TEXT else text


def _leaf(names: list[str], text: str, quoted: bool, slop: int | None, regex: str | None, fuzzy: str | None, body: dict, mapping: Mapping) -> dict:
    bare = re.sub(r"\\(.)", r"\1", text)
    if regex is not None:
        return _over(names, lambda n: {"regexp": {n: {"value": regex}}})
    if quoted:
        return _over(names, lambda n: {"match_phrase": {n: {"query": bare, "slop": slop if slop is not None else int(body.get("phrase_slop", 0))}}})
    if re.search(r"(?<!\\)[*?]", text):
        if text == "*":
            return _over(names, lambda n: {"exists": {"field": n}}) if names else {"match_all": {}}
        return _over(names, lambda n: {"wildcard": {n: {"value": _as_token(text, n, mapping)}}})
    if fuzzy is not None:
        return _over(names, lambda n: {"fuzzy": {n: {"value": _as_token(bare, n, mapping), "fuzziness": fuzzy or body.get("fuzziness", "AUTO")}}})
    return _over(names, lambda n: {"match": {n: {"query": bare, "operator": body.get("default_operator", "or"), "lenient": True}}})


class _Parser:
    def __init__(self, text: str, body: dict, mapping: Mapping) -> None:
        self.s, self.i, self.body, self.mapping = text, 0, body, mapping
        self.all = str(body.get("default_operator", "or")).lower() == "and"

    def _space(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def _word(self, *words: str) -> str | None:
        self._space()
        for w in words:
            if self.s.startswith(w, self.i) and (not w.isalpha() or self.i + len(w) == len(self.s) or self.s[self.i + len(w)] in " ("):
                self.i += len(w)
                return w
        return None

    def parse(self, names: list[str]) -> dict:
        clauses: list[tuple[str, dict]] = []
        op = ""
        while True:
            self._space()
            if self.i >= len(self.s) or self.s[self.i] == ")":
                break
            if w := self._word("AND", "&&", "OR", "||"):
                op = "AND" if w in ("AND", "&&") else "OR"
                continue
            occur = "must" if self.all else "should"
            if w := self._word("NOT", "!", "+", "-"):
                occur = "must" if w == "+" else "must_not"
            q = self._clause(names)
            if op == "AND":
                if occur == "should":
                    occur = "must"
                if clauses and clauses[-1][0] == "should":
                    clauses[-1] = ("must", clauses[-1][1])
            elif op == "OR" and self.all:
                if occur == "must":
                    occur = "should"
                if clauses and clauses[-1][0] == "must":
                    clauses[-1] = ("should", clauses[-1][1])
            clauses.append((occur, q))
            op = ""
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        out: dict = {}
        for occur, q in clauses:
            out.setdefault(occur, []).append(q)
        if "minimum_should_match" in self.body and "should" in out:
            out["minimum_should_match"] = self.body["minimum_should_match"]
        return {"bool": out} if out else {"match_none": {}}

    def _clause(self, names: list[str]) -> dict:
        self._space()
        if m := re.compile(r"((?:[\w.*]|\\.)+):").match(self.s, self.i):
            if m[1] == "_exists_":
                self.i = m.end()
                return {"exists": {"field": self._take_word()}}
            names, self.i = self._expand(m[1]), m.end()
        self._space()
        if self.i < len(self.s) and self.s[self.i] == "(":
            self.i += 1
            q = self.parse(names)
            self._space()
            if self.i >= len(self.s):
                raise ValueError("Failed to parse query: missing )")
            self.i += 1
            return self._boosted(q)
        if self.i < len(self.s) and self.s[self.i] in "[{":
            m = re.compile(r"([\[{])\s*(\S+?)\s+TO\s+(\S+?)\s*([\]}])").match(self.s, self.i)
            if not m:
                raise ValueError(f"Failed to parse query [{self.s}]")
            self.i = m.end()
            how = {}
            if m[2] != "*":
                how["gte" if m[1] == "[" else "gt"] = m[2].strip('"')
            if m[3] != "*":
                how["lte" if m[4] == "]" else "lt"] = m[3].strip('"')
            return self._boosted(_over(names, lambda n: {"range": {n: how}}))
        if m := re.compile(r"([<>]=?)([\w.+-]+)").match(self.s, self.i):
            self.i = m.end()
            return _over(names, lambda n: {"range": {n: {{"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[m[1]]: m[2]}}})
        m = _WORD.match(self.s, self.i)
        if not m:
            raise ValueError(f"Failed to parse query [{self.s}]")
        self.i = m.end()
        fuzzy = None
        if m[4] is not None and (z := re.compile(r"~(\d(?:\.\d+)?)?").match(self.s, self.i)):
            fuzzy, self.i = z[1] or "", z.end()
        return self._boosted(_leaf(names, m[1] if m[1] is not None else m[4] or "", m[1] is not None, int(m[2]) if m[2] else None, m[3], fuzzy, self.body, self.mapping))

    def _expand(self, name: str) -> list[str]:
        name = name.replace("\\", "")
        return self.mapping.match(name) if "*" in name else [name]

    def _take_word(self) -> str:
        m = re.compile(r"[\w.]+").match(self.s, self.i)
        self.i = m.end()
        return m[0]

    def _boosted(self, q: dict) -> dict:
        if m := re.compile(r"\^(\d+(?:\.\d+)?)").match(self.s, self.i):
            self.i = m.end()
            return {"bool": {"must": [q], "boost": float(m[1])}}
        return q


def parse_query_string(text: str, body: dict, mapping: Mapping) -> dict:
    """Lucene's classic syntax: fields, AND OR NOT + -, groups, phrases, wildcards, regular expressions, fuzzy words, ranges, boosts, _exists_."""
    p = _Parser(text, body, mapping)
    q = p.parse(_fields(body, mapping))
    if p.i < len(p.s):
        raise ValueError(f"Failed to parse query [{text}]")
    return q


def parse_simple(text: str, body: dict, mapping: Mapping) -> dict:
    """The forgiving syntax: + | - " * ( ) ~; what cannot be read is left out. ``flags`` choose the signs that count."""
    flags = set(str(body.get("flags", "ALL")).upper().split("|"))
    on = lambda *names: "ALL" in flags or bool(flags & set(names))
    names, i = _fields(body, mapping), 0
    every = str(body.get("default_operator", "or")).lower() == "and"

    def group(top: bool) -> dict:
        nonlocal i
        ways: list[list[dict]] = [[]]  # alternatives of |, each a list of clauses
        loose: list[bool] = [True]
        while i < len(text):
            c = text[i]
            if c.isspace():
                i += 1
            elif c == ")" and on("PRECEDENCE"):
                i += 1
                if not top:
                    break
            elif c == "+" and on("AND"):
                i += 1
                loose[-1] = False
            elif c == "|" and on("OR"):
                i += 1
                ways.append([])
                loose.append(True)
            else:
                negative = c == "-" and on("NOT")
                i += negative
                q = leaf()
                if q is None:
                    continue
                ways[-1].append({"bool": {"must_not": [q]}} if negative else q)
        made = []
        for clauses, free in zip(ways, loose, strict=True):
            if clauses:
                made.append(clauses[0] if len(clauses) == 1 else {"bool": {"must" if every or not free else "should": clauses}})
        if not made:
            return {"match_none": {}}
        spec = {"minimum_should_match": body["minimum_should_match"]} if "minimum_should_match" in body else {}
        if len(made) == 1:
            if spec and "bool" in made[0] and "should" in made[0]["bool"]:
                made[0]["bool"] |= spec
            return made[0]
        return {"bool": {"should": made}}

    def leaf() -> dict | None:
        nonlocal i
        if i >= len(text):
            return None
        if text[i] == "(" and on("PRECEDENCE"):
            i += 1
            return group(False)
        if text[i] == '"' and on("PHRASE"):
            end = text.find('"', i + 1)
            if end < 0:
                i += 1
                return None
            words, i = text[i + 1 : end], end + 1
            slop = 0
            if on("NEAR", "SLOP") and (m := re.compile(r"~(\d+)").match(text, i)):
                slop, i = int(m[1]), m.end()
            return _over(names, lambda n: {"match_phrase": {n: {"query": words, "slop": slop}}})
        m = re.compile(r'(?:[^\s()|"\\+]|\\.)+').match(text, i)
        if not m:
            i += 1
            return None
        i = m.end()
        word = re.sub(r"\\(.)", r"\1", m[0]) if on("ESCAPE") else m[0]
        if word.endswith("*") and on("PREFIX") and len(word) > 1:
            return _over(names, lambda n: {"prefix": {n: _as_token(word[:-1], n, mapping)}})
        if on("FUZZY") and (z := re.fullmatch(r"(.+)~(\d*)", word)):
            return _over(names, lambda n: {"fuzzy": {n: {"value": _as_token(z[1], n, mapping), "fuzziness": z[2] or "AUTO"}}})
        return _over(names, lambda n: {"match": {n: {"query": word}}})

    return group(True)
