"""Text analysis as columns: character filters, tokenizers, token filters and analyzers over array<string> of tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.stem import LANGUAGES, light_stem, porter

ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
STOP = {
    "_english_": ENGLISH_STOP,
    "_french_": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "_german_": "aber als am an auch auf aus bei bin bis bist da dann das dass dem den der des die doch du ein eine einem einen einer es für hat ich ihr im in ist ja mit nicht noch nur ob oder sich sie sind so um und uns von vor war was wenn wer wie wir zu zum zur".split(),
    "_spanish_": "a al como con de del el ella en entre es esta este la las lo los más me mi no nos o para pero por que se si sin sobre su sus te tu un una y ya yo".split(),
    "_none_": [],
}
TOKEN = r"[\p{L}\p{N}\p{M}_]+(?:['’.:][\p{L}\p{N}\p{M}_]+)*"
_FOLD = {c: d for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) and d != c and len(d) == 1}
_FOLD2 = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ø": "o", "Ø": "O", "đ": "d", "ł": "l", "Ł": "L"}


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def html_strip(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?[A-Za-z][^>]*>|<![^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return bare


def _mapping(text: Column, mappings: list[str] = ()) -> Column:
    for m in mappings:
        a, b = (x.strip() for x in m.split("=>"))
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


CHAR_FILTERS: dict[str, Callable[..., Column]] = {
    "html_strip": html_strip,
    "mapping": _mapping,
    "pattern_replace": lambda text, pattern="", replacement="": F.regexp_replace(text, pattern, replacement),
}


def _grams(x: Column, lo: int, hi: int, edge: bool) -> Column:
    n = F.length(x)
    starts = F.array(F.lit(1)) if edge else F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.filter(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.when(i + k - 1 <= n, x.substr(i, k))), lambda g: g.isNotNull()))
    return F.flatten(each)


def _path(text: Column, delimiter: str = "/", reverse: bool = False) -> Column:
    parts = F.split(text, re.escape(delimiter))
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)) if reverse else F.slice(parts, F.lit(1), i + 1), delimiter))


TOKENIZERS: dict[str, Callable[..., Column]] = {
    "standard": lambda t: _all(t, TOKEN),
    "classic": lambda t: _all(t, r"[\p{L}\p{N}][\p{L}\p{N}.&@'-]*[\p{L}\p{N}]|[\p{L}\p{N}]"),
    "uax_url_email": lambda t: _all(t, r"https?://[^\s<>\"]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|" + TOKEN),
    "whitespace": lambda t: _all(t, r"\S+"),
    "letter": lambda t: _all(t, r"\p{L}+"),
    "lowercase": lambda t: F.transform(_all(t, r"\p{L}+"), F.lower),
    "keyword": lambda t: F.when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>")),
    "ngram": lambda t, min_gram=1, max_gram=2: _grams(t, min_gram, max_gram, False),
    "edge_ngram": lambda t, min_gram=1, max_gram=2: _grams(t, min_gram, max_gram, True),
    "pattern": lambda t, pattern=r"\W+", group=-1: F.filter(F.split(t, pattern), lambda x: x != "") if group < 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group)),
    "simple_pattern": lambda t, pattern="": _all(t, pattern or "(?!)"),
    "simple_pattern_split": lambda t, pattern="": F.filter(F.split(t, pattern or "(?!)"), lambda x: x != ""),
    "char_group": lambda t, tokenize_on_chars=("whitespace",): F.filter(F.split(t, "[" + "".join({"whitespace": r"\s", "letter": r"\p{L}", "digit": r"\d", "punctuation": r"\p{Punct}", "symbol": r"\p{S}"}.get(c, re.escape(c)) for c in tokenize_on_chars) + "]+"), lambda x: x != ""),
    "path_hierarchy": _path,
    "PathHierarchy": _path,
}


def _each(f: Callable[[Column], Column]) -> Callable[..., Column]:
    return lambda tokens: F.transform(tokens, f)


def _fold(x: Column) -> Column:
    x = F.translate(x, "".join(_FOLD), "".join(_FOLD.values()))
    for a, b in _FOLD2.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _is_in(words: list[str], ignore_case: bool = False) -> Callable[[Column], Column]:
    known = [w.lower() for w in words] if ignore_case else list(words)
    return lambda x: (F.lower(x) if ignore_case else x).isin(known) if known else F.lit(False)


def _stop(tokens: Column, stopwords: str | list[str] = "_english_", ignore_case: bool = False) -> Column:
    words = STOP.get(stopwords, ENGLISH_STOP) if isinstance(stopwords, str) else [w for s in stopwords for w in STOP.get(s, [s])]
    inside = _is_in(words, ignore_case)
    return F.filter(tokens, lambda x: ~inside(x))


def _shingle(tokens: Column, min_shingle_size: int = 2, max_shingle_size: int = 2, output_unigrams: bool = True, token_separator: str = " ") -> Column:
    sizes = ([1] if output_unigrams else []) + list(range(min_shingle_size, max_shingle_size + 1))
    grams = F.transform(tokens, lambda _, i: F.array_compact(F.array(*[F.when(i + k <= F.size(tokens), F.array_join(F.slice(tokens, i + 1, k), token_separator)) for k in sizes])))
    return F.flatten(grams)


def _stemmer(language: str) -> Callable[[Column], Column]:
    """Stems through a vectorised UDF, each distinct word of a batch once."""
    stem = porter if language in ("english", "porter", "porter2") else partial(light_stem, language=language)

    @F.pandas_udf("array<string>")
    def stemmed(tokens: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        return tokens.map(lambda ts: None if ts is None else [memo[t] if t in memo else memo.setdefault(t, stem(t)) for t in ts])

    return stemmed


def _word_delimiter(tokens: Column, preserve_original: bool = False, **_: object) -> Column:
    def parts(x: Column) -> Column:
        split = F.regexp_extract_all(x, F.lit(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|\p{Lo}+"), F.lit(0))
        return F.when(F.size(split) > 1, F.concat(F.array(x), split)).otherwise(split) if preserve_original else split

    return F.flatten(F.transform(tokens, parts))


def _synonym(tokens: Column, synonyms: list[str] = (), **_: object) -> Column:
    table: dict[str, list[str]] = {}
    for rule in synonyms:
        left, arrow, right = rule.partition("=>")
        words = [w.strip() for w in left.split(",")]
        for w in words:
            table.setdefault(w, []).extend([r.strip() for r in right.split(",")] if arrow else words)
    if not table:
        return tokens
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, ",".join(dict.fromkeys(v)))])
    return F.flatten(F.transform(tokens, lambda x: F.split(F.coalesce(F.try_element_at(known, x), x), ",")))


def _common_grams(tokens: Column, common_words: list[str] = ()) -> Column:
    common = _is_in(common_words)
    pairs = F.transform(tokens, lambda x, i: F.array_compact(F.array(x, F.when((i + 1 < F.size(tokens)) & (common(x) | common(F.get(tokens, i + 1))), F.concat_ws("_", x, F.get(tokens, i + 1))))))
    return F.flatten(pairs)


def _cjk_bigram(tokens: Column) -> Column:
    han = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+$"
    return F.flatten(F.transform(tokens, lambda x: F.when(F.regexp_like(x, F.lit(han)) & (F.length(x) > 1), F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: x.substr(i, F.lit(2)))).otherwise(F.array(x))))


def _decompound(tokens: Column, word_list: list[str] = (), **_: object) -> Column:
    return F.flatten(F.transform(tokens, lambda x: F.concat(F.array(x), F.filter(F.array(*[F.lit(w) for w in word_list]).cast("array<string>"), lambda w: (F.lower(x) != w) & F.contains(F.lower(x), w)))))


def _override(tokens: Column, rules: list[str] = ()) -> Column:
    return _synonym(tokens, [r for r in rules])


def _replace_chars(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def f(x: Column) -> Column:
        for a, b in pairs:
            x = F.regexp_replace(x, a, b)
        return x

    return f


TOKEN_FILTERS: dict[str, Callable[..., Column]] = {
    "lowercase": _each(F.lower),
    "uppercase": _each(F.upper),
    "asciifolding": lambda t, preserve_original=False: F.flatten(F.transform(t, lambda x: F.array_distinct(F.array(_fold(x), x)))) if preserve_original else F.transform(t, _fold),
    "stop": _stop,
    "stemmer": lambda t, language="english", name=None: _stemmer((name or language).removeprefix("light_"))(t),
    "porter_stem": lambda t: _stemmer("english")(t),
    "snowball": lambda t, language="English": _stemmer(language.lower())(t),
    "shingle": _shingle,
    "synonym": _synonym,
    "synonym_graph": _synonym,
    "word_delimiter": _word_delimiter,
    "word_delimiter_graph": _word_delimiter,
    "ngram": lambda t, min_gram=1, max_gram=2: F.flatten(F.transform(t, lambda x: _grams(x, min_gram, max_gram, False))),
    "edge_ngram": lambda t, min_gram=1, max_gram=2: F.flatten(F.transform(t, lambda x: _grams(x, min_gram, max_gram, True))),
    "trim": _each(lambda x: F.trim(x)),
    "truncate": lambda t, length=10: F.transform(t, lambda x: F.substring(x, 1, length)),
    "length": lambda t, min=0, max=2**31 - 1: F.filter(t, lambda x: (F.length(x) >= min) & (F.length(x) <= max)),
    "unique": lambda t, only_on_same_position=False: F.array_distinct(t),
    "reverse": _each(F.reverse),
    "elision": lambda t, articles=("l", "m", "t", "qu", "n", "s", "j", "d", "c"): F.transform(t, lambda x: F.regexp_replace(x, f"(?i)^(?:{'|'.join(articles)})['’]", "")),
    "cjk_bigram": _cjk_bigram,
    "cjk_width": _each(lambda x: F.translate(x, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))),
    "decimal_digit": _each(lambda x: F.translate(x, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 3)),
    "keyword_repeat": lambda t: F.flatten(F.transform(t, lambda x: F.array(x, x))),
    "remove_duplicates": lambda t: F.flatten(F.transform(t, lambda x, i: F.when((i > 0) & (F.get(t, i - 1) == x), F.array().cast("array<string>")).otherwise(F.array(x)))),
    "keyword_marker": lambda t, keywords=(), **_: t,
    "stemmer_override": _override,
    "pattern_replace": lambda t, pattern="", replacement="", all=True: F.transform(t, lambda x: F.regexp_replace(x, pattern, replacement)),
    "pattern_capture": lambda t, patterns=(), preserve_original=True: F.flatten(F.transform(t, lambda x: F.array_distinct(F.concat(*([F.array(x)] if preserve_original else []), *[F.regexp_extract_all(x, F.lit(p if "(" in p else f"({p})"), F.lit(1)) for p in patterns])))),
    "apostrophe": _each(lambda x: F.regexp_replace(x, "['’].*$", "")),
    "classic": _each(lambda x: F.regexp_replace(F.regexp_replace(x, "['’][sS]$", ""), r"(?<=\p{L})\.(?=\p{L}|$)", "")),
    "fingerprint": lambda t, separator=" ", **_: F.when(F.size(t) > 0, F.array(F.array_join(F.sort_array(F.array_distinct(t)), separator))).otherwise(t),
    "limit": lambda t, max_token_count=1: F.slice(t, 1, max_token_count),
    "keep": lambda t, keep_words=(), keep_words_case=False: F.filter(t, _is_in(list(keep_words), keep_words_case)),
    "keep_types": lambda t, types=("<ALPHANUM>",), mode="include": F.filter(t, lambda x: F.regexp_like(x, F.lit(r"^[\p{N}.,]+$")) == F.lit(("<NUM>" in types) == (mode == "include"))),
    "delimited_payload": lambda t, delimiter="|", encoding="float": F.transform(t, lambda x: F.substring_index(x, delimiter, 1)),
    "type_as_payload": lambda t: t,
    "common_grams": _common_grams,
    "flatten_graph": lambda t: t,
    "dictionary_decompounder": _decompound,
    "german_normalization": _each(_replace_chars([("ß", "ss"), ("ae", "a"), ("oe", "o"), ("(?<![aeq])ue", "u"), ("ä", "a"), ("ö", "o"), ("ü", "u")])),
    "arabic_normalization": _each(_replace_chars([("[آأإ]", "ا"), ("ى", "ي"), ("ة", "ه"), ("[ً-ْـ]", "")])),
    "persian_normalization": _each(_replace_chars([("[ىی]", "ي"), ("ک", "ك"), ("[ۀہ]", "ه"), ("ٔ", "")])),
    "hindi_normalization": _each(_replace_chars([("[ँं]", "ं"), ("़", ""), ("्", ""), ("आ", "अ"), ("ई", "इ"), ("ऊ", "उ")])),
    "indic_normalization": _each(lambda x: F.regexp_replace(x, "[‌‍]", "")),
    "sorani_normalization": _each(_replace_chars([("[ىي]", "ی"), ("ك", "ک"), ("‌", "")])),
}


def _multiplexer(tokens: Column, filters: list[str] = (), preserve_original: bool = True, registry: dict | None = None) -> Column:
    ways = [_chain(tokens, [n.strip() for n in f.split(",")], registry or {}) for f in filters]
    return F.array_distinct(F.concat(*([tokens] if preserve_original else []), *ways))


def _chain(tokens: Column, names: list, custom: dict[str, dict]) -> Column:
    for name in names:
        how = dict(name if isinstance(name, dict) else custom.get(name, {"type": name}))
        kind = how.pop("type")
        if kind == "multiplexer":
            tokens = _multiplexer(tokens, registry=custom, **how)
        elif kind in TOKEN_FILTERS:
            tokens = TOKEN_FILTERS[kind](tokens, **how)
        else:
            raise ValueError(f"unsupported token filter [{kind}]")
    return tokens


def _language(name: str) -> dict:
    filters: list = ["lowercase"]
    if name in ("french", "italian", "catalan", "irish"):
        filters.insert(0, "elision")
    filters.append({"type": "stop", "stopwords": f"_{name}_" if f"_{name}_" in STOP else "_none_"})
    filters.append({"type": "stemmer", "language": name})
    return {"tokenizer": "standard", "filter": filters}


ANALYZERS: dict[str, dict] = {
    "standard": {"tokenizer": "standard", "filter": ["lowercase"]},
    "simple": {"tokenizer": "lowercase"},
    "whitespace": {"tokenizer": "whitespace"},
    "keyword": {"tokenizer": "keyword"},
    "stop": {"tokenizer": "lowercase", "filter": ["stop"]},
    "pattern": {"tokenizer": "pattern", "filter": ["lowercase"]},
    "fingerprint": {"tokenizer": "standard", "filter": ["lowercase", "asciifolding", "fingerprint"]},
    "classic": {"tokenizer": "classic", "filter": ["classic", "lowercase", "stop"]},
    "cjk": {"tokenizer": "standard", "filter": ["cjk_width", "lowercase", "cjk_bigram", "stop"]},
    "snowball": {"tokenizer": "standard", "filter": ["lowercase", "stop", "porter_stem"]},
    **{name: _language(name) for name in LANGUAGES},
    "kuromoji": {"tokenizer": "standard", "filter": ["cjk_width", "lowercase", "cjk_bigram"]},  # pairs of characters stand for words, as there is no dictionary
}


def analyze(text: Column, analyzer: str | dict = "standard", settings: dict | None = None) -> Column:
    """The tokens of ``text``: a name of ANALYZERS, one of ``settings`` ({analyzer, tokenizer, filter, char_filter}: custom parts by name), or a definition. Null gives null."""
    settings = settings or {}
    how = analyzer if isinstance(analyzer, dict) else settings.get("analyzer", {}).get(analyzer) or ANALYZERS.get(analyzer)
    if how is None:
        raise ValueError(f"unsupported analyzer [{analyzer}]")
    if how.get("type", "custom") != "custom":
        base = dict(ANALYZERS[how["type"]])
        if "stopwords" in how:
            base["filter"] = [f for f in base.get("filter", []) if (f if isinstance(f, str) else f["type"]) != "stop"] + [{"type": "stop", "stopwords": how["stopwords"]}]
        if how["type"] == "pattern" and "pattern" in how:
            base["tokenizer"] = {"type": "pattern", "pattern": how["pattern"]}
        how = base
    for name in how.get("char_filter", []):
        part = dict(name if isinstance(name, dict) else settings.get("char_filter", {}).get(name, {"type": name}))
        text = CHAR_FILTERS[part.pop("type")](text, **part)
    part = how.get("tokenizer", "standard")
    part = dict(part if isinstance(part, dict) else settings.get("tokenizer", {}).get(part, {"type": part}))
    kind = part.pop("type")
    if kind not in TOKENIZERS:
        raise ValueError(f"unsupported tokenizer [{kind}]")
    return _chain(TOKENIZERS[kind](text, **part), how.get("filter", []), settings.get("filter", {}))


def normalize(text: Column, filters: list[str]) -> Column:
    """A keyword's normalizer: filters of single characters over the whole value."""
    return F.get(_chain(F.array(text), filters, {}), F.lit(0))
