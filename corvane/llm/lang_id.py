"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the longest context: a leaf of a tree is a string of ORDER + 1 bytes.
ORDER = 4
_PIECE = 1 << 20


def _codes(raw: np.ndarray, longest: int = ORDER) -> np.ndarray:
    """The last ``longest`` + 1 bytes at each place but the first ``longest``, as one number."""
    n = max(0, len(raw) - longest)
    code = raw[:n].astype(np.int64)
    for k in range(1, longest + 1):
        code <<= 8
        code |= raw[k : n + k]
    return code


def _find(where: np.ndarray, what: np.ndarray) -> np.ndarray:
    """The place of each number in a sorted array, -1 where it is not in it."""
    if not len(where):
        return np.full(len(what), -1)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return np.where(where[at] == what, at, -1)


@dataclass
class _Level:
    """A language's contexts of one length, ascending, and the strings of a context and its successor, ascending.

    Of a context: how often it was seen, its kinds of successors, and both again for the context one shorter without
    these successors, which is what that one is asked after an escape.
    """

    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    below_total: np.ndarray
    below_kinds: np.ndarray
    strings: np.ndarray
    counts: np.ndarray


def _tree(strings: np.ndarray, counts: np.ndarray, longest: int) -> list[_Level]:
    """The levels of a language, shortest contexts first, from its strings of ``longest`` + 1 bytes and how often each was seen."""
    levels: list[_Level] = []
    for k in range(longest + 1):
        own, at = np.unique(strings % 256 ** (k + 1), return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(own))
        contexts, where = np.unique(own >> 8, return_inverse=True)
        total, kinds = np.bincount(where, weights=n, minlength=len(contexts)), np.bincount(where, minlength=len(contexts)).astype(float)
        if k:
            up = levels[-1]
            parent = _find(up.contexts, contexts % 256 ** (k - 1))
            gone = np.bincount(where, weights=up.counts[_find(up.strings, own % 256**k)], minlength=len(contexts))
            below_total, below_kinds = up.total[parent] - gone, up.kinds[parent] - kinds
        else:
            below_total, below_kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
        levels.append(_Level(contexts, total, kinds, below_total, below_kinds, own, n))
    return levels


def _tree_bits(levels: list[_Level], code: np.ndarray) -> np.ndarray:
    """The code length of the last byte of each string after the others, by the recursion of method C with exclusion."""
    bits, left = np.zeros(len(code)), np.arange(len(code))
    total, kinds, escaped = np.zeros(len(code)), np.zeros(len(code)), np.zeros(len(code), bool)
    for k in reversed(range(len(levels))):
        level, c = levels[k], code[left]
        at = _find(level.contexts, (c >> 8) % 256**k)
        met = at >= 0
        fresh = met & ~escaped[left]
        total[left[fresh]], kinds[left[fresh]] = level.total[at[fresh]], level.kinds[at[fresh]]
        whole = total[left] + kinds[left]
        told = _find(level.strings, c % 256 ** (k + 1))
        hit = told >= 0
        bits[left[hit]] += np.log2(whole[hit] / level.counts[told[hit]])
        out = met & ~hit & (kinds[left] > 0)
        bits[left[out]] += np.log2(whole[out] / kinds[left[out]])
        total[left[met]], kinds[left[met]], escaped[left[met]] = level.below_total[at[met]], level.below_kinds[at[met]], True
        left = left[~hit]
    root = levels[0].kinds[0] if len(levels[0].kinds) else 0
    bits[left] += math.log2(max(1.0, 256 - root))
    return bits


@dataclass
class PpmModel:
    """Frozen statistics: the trees of each language over bytes.

    Code lengths are exact, with the longest context seen and escapes by method C with exclusion: in a context seen T times
    with D kinds of successors, a byte seen c times costs -log2(c / (T + D)), another -log2(D / (T + D)) and its cost in the
    context one shorter, where the kinds already refused count no more; a context not seen costs nothing; below the empty
    context the bytes never seen are alike. ``bits`` holds what strings seen in any language cost in each, so that others
    alone are walked through the trees.
    """

    languages: list[str]
    trees: list[list[_Level]]
    seen: np.ndarray
    bits: np.ndarray
    longest: int = ORDER

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], longest: int = ORDER) -> PpmModel:
        """From each language's strings of ``longest`` + 1 bytes and their counts."""
        languages = sorted(counts)
        trees = [_tree(*counts[x], longest) for x in languages]
        seen = np.unique(np.concatenate([counts[x][0] for x in languages])) if languages else np.zeros(0, np.int64)
        bits = np.stack([_tree_bits(t, seen) for t in trees], axis=1).astype(np.float32) if trees else np.zeros((0, 0), np.float32)
        return cls(languages, trees, seen.astype(np.int64), bits, longest)

    def index(self) -> np.ndarray:
        """A hash table of places in ``seen``, of which the last to fall on a slot stays; what it does not tell is searched."""
        width = max(10, (4 * len(self.seen)).bit_length())
        slots = np.full(1 << width, 0, dtype=np.int32)
        slots[_slot(self.seen, width)] = np.arange(len(self.seen), dtype=np.int32)
        return slots

    def lengths(self, texts: list[bytes], slots: np.ndarray) -> np.ndarray:
        """The code length of each text under each language, in bits. Long texts are taken in pieces that overlap by a context."""
        out = np.zeros((len(texts), len(self.languages)))
        width, blank = len(slots).bit_length() - 1, b" " * self.longest
        missed: list[np.ndarray] = []
        of: list[int] = []
        for i, text in enumerate(texts):
            whole = blank + text
            for at in range(0, len(text), _PIECE):
                code = _codes(np.frombuffer(whole[at : at + _PIECE + self.longest], dtype=np.uint8), self.longest)
                row = slots[_slot(code, width)]
                off = np.flatnonzero(self.seen[row] != code)
                if len(off):
                    row[off] = _find(self.seen, code[off])
                    unseen = off[row[off] < 0]
                    if len(unseen):
                        missed.append(code[unseen])
                        of.append(i)
                        row = row[row >= 0]
                out[i] += self.bits[row].sum(0, dtype=np.float64)
        if missed:
            at, code = np.repeat(of, [len(m) for m in missed]), np.concatenate(missed)
            for x, tree in enumerate(self.trees):
                out[:, x] += np.bincount(at, weights=_tree_bits(tree, code), minlength=len(texts))
        return out


def _slot(code: np.ndarray, width: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)).astype(np.int64)


_LOADED: dict[str, tuple[PpmModel, np.ndarray]] = {}


def _held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = 800) -> PpmModel:
    """Fit the trees on about ``documents`` documents of each language, chosen by the id's hash among those that are not held out.

    The bound is on the sample alone; its counts are made by the executors, and what reaches the driver is one number for
    each string of ORDER + 1 bytes and language that the sample holds. Rows without a text or language are left out; with no row left the model has
    no language.
    """
    known = df.where(~_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return PpmModel.fit({})
    many = 1_000_003
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, math.ceil(many * min(1.0, documents / n))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(6)), F.lit(many)) < share)
    sample = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    found = _counted(sample).groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    by = {x: found.filter(pc.equal(found["lang"], x)) for x in sizes}
    return PpmModel.fit({x: (t["code"].to_numpy(), t["n"].to_numpy().astype(float)) for x, t in by.items() if t.num_rows})


def _counted(sample: DataFrame) -> DataFrame:
    """Counts, by language and batch, of strings of ORDER + 1 bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                texts = batch.filter(pc.equal(batch.column(0), lang)).column(1).to_pylist()
                codes, n = np.unique(np.concatenate([_codes(np.frombuffer(b" " * ORDER + t, dtype=np.uint8)) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    return sample.mapInArrow(of, "lang string, code long, n long")


def identify(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = 800, model: PpmModel | None = None, carry: bool = False) -> DataFrame:
    """The language whose trees give each whole text the shortest code.

    Returns one row per document: ``id_col`` (all columns with ``carry``), held_out (the CRC of the id leaves 2 by 4),
    lang_pred and score, the language's share of 2**-length over all languages. Texts that are null, empty or without a
    letter are ``und`` with score 0, as are all texts where no language was learned. Ids and ``lang`` play no part in a
    prediction; null ids are not held out; an empty table gives no rows.
    """
    model = model or train(df, id_col=id_col, text_col=text_col, lang_col=lang_col, documents=documents)
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the strings of the sample
    kept = [c for c in (df.columns if carry else [id_col]) if c not in ("held_out", "lang_pred", "score")]
    letters = F.coalesce(F.regexp_like(text_col, F.lit(r"\p{L}")), F.lit(False))
    slim = df.select(*[F.col(f"`{c}`") for c in kept], _held_out(id_col).alias("held_out"), F.when(letters, F.col(text_col).cast("binary")).alias("_cv_bytes"))
    languages, key = [*model.languages, "und"], uuid.uuid4().hex

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = (sent.value, sent.value.index())
        model, rows = _LOADED[key]
        for batch in batches:
            texts, n = batch.column(len(kept) + 1), len(batch)
            best, score = np.full(n, len(languages) - 1), np.zeros(n)
            some = [i for i in range(n) if texts[i].is_valid] if model.languages else []
            for at in range(0, len(some), 256):  # of so many texts at once the strings seen nowhere are kept
                part = some[at : at + 256]
                bits = model.lengths([texts[i].as_py() for i in part], rows)
                best[part] = bits.argmin(1)
                score[part] = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], pa.array([languages[i] for i in best], pa.string()), pa.array(score)], [*kept, "held_out", "lang_pred", "score"])

    return slim.mapInArrow(of, slim.drop("_cv_bytes").schema.add("lang_pred", "string").add("score", "double"))
