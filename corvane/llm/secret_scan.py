"""Secret scans: fixed forms, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NAMED = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ASSIGN = _NAMED + r"([A-Za-z0-9+/_.=-]+)"
#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "markov")
#: What the models read: whole runs of these characters, but for the fixed forms within them, in parts of so many characters.
LEAST_PART = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WITHIN = _NAMED + r"[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET)

#: Words of which ordinary identifiers are made. Fixed values, of the languages that identifiers and file names are written in.
WORDS = (
    "access account action address after agent archive array background balance before between billing block board branch bridge browser buffer build button cache call camera category center chain change channel "
    "check child client cloud column command comment config connection content context control copy count country create current customer data date default delete description detail device directory display document "
    "domain download element email enable encoding engine entry environment error event example expected export factory feature field file filter folder format found friend function garden general group handler header "
    "health height helper history house image index information inner input insert instance interface item journal keyboard knowledge label language layer length level library light line link list load local location "
    "logger machine manager market measure memory message method mode model module mountain name network number object offset option order output package page parameter parent partition path pattern people player "
    "position previous price process product profile program project property provider public quality query queue quick random record region registry remote report request resource response result return right river "
    "abteilung anfrage beispiel datei fehler gemeinde geschichte geschwindigkeit gesellschaft nachricht rechnung schule strasse verwaltung verzeichnis wissenschaft zeitung "
    "ancien biblioteca bonjour ciudad commentaire compte demande desarrollo donnees ejemplo enfant espacio fichier gouvernement historia informacion jardin maison mensaje montagne nombre pregunta quelque reponse siempre trabajo usuario utilisateur ville"
).split()


def _events(text: Column, pattern: str, kind: str, may: str, good: object) -> Column:
    """Leftmost non-overlapping matches: array of (kind, characters before it since the last one, its own, whether it counts). Texts without ``may`` are not cut up."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(pieces, found, lambda p, m: _event(kind, F.length(p), F.coalesce(F.length(m), F.lit(0)), F.coalesce(good(m), F.lit(False))))
    return F.when(F.regexp_like(text, F.lit(may)), pairs).otherwise(F.array().cast(_EVENTS))


_EVENTS = "array<struct<k:int,gap:int,n:int,ok:boolean>>"


def _event(kind: str, gap: Column, n: Column, ok: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("k"), gap.alias("gap"), n.alias("n"), ok.alias("ok"))


def _parts(text: Column, llr: Column, least: float) -> Column:
    """The parts of candidates that hold no fixed form, as events; those of enough characters, a letter among them, count by their score."""
    pieces, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    runs = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def part(x: Column, forms: Column, p: Column, i: Column) -> Column:
        gap = F.when(i == 0, x["gap"]).otherwise(F.length(F.get(forms, i - 1)))
        ok = (F.length(p) >= LEAST_PART) & F.regexp_like(p, F.lit("[A-Za-z]"))
        return _event("markov", gap, F.length(p), F.when(ok, markov_score(p, llr) >= least).otherwise(F.lit(False)))

    def cut(x: Column) -> Column:
        forms = F.regexp_extract_all(x["m"], F.lit(WITHIN), F.lit(0))
        return F.transform(F.split(x["m"], WITHIN, -1), lambda p, i: part(x, forms, p, i))

    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), F.flatten(F.transform(F.filter(runs, lambda x: x["m"].isNotNull()), cut))).otherwise(F.array().cast(_EVENTS))


def _shown(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def labelled_samples(spark: SparkSession, strings: int = 4000) -> DataFrame:
    """The labelled sample of the models: column s, and random, whether s is a random string. ``strings`` bounds it: four of each sort for each.

    Random strings are hexadecimal, base-64 and alphanumeric forms of digests. Ordinary ones are identifiers and paths of
    two to four words in the usual spellings, some numbered, and ruled lines.
    """
    ids = spark.range(strings)
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = ids.select(F.explode(F.array(digest, F.upper(F.substring(digest, 1, 40)), F.base64(F.unhex(digest)), F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 512))), "[+/=]", ""))).alias("s"))
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    vocabulary = F.array(*[F.lit(w) for w in WORDS])
    words = F.slice(F.array(*[F.get(vocabulary, draw(k, len(WORDS))) for k in range(4)]), F.lit(1), draw(4, 3) + 2)
    number = F.when(draw(5, 3) == 0, F.concat(F.get(F.array(*[F.lit(x) for x in "_-"]), draw(6, 2)), draw(7, 10_000).cast("string"))).otherwise(F.lit(""))
    joined = F.element_at(F.array(*[F.array_join(words, x) for x in ("_", "-", "/", "")]), draw(8, 4) + 1)
    camel = F.array_join(F.transform(words, F.initcap), "")
    rule = F.repeat(F.get(F.array(*[F.lit(x) for x in "-=_+/"]), draw(9, 5)), draw(10, 40) + 20)
    ordinary = ids.select(F.explode(F.array(F.concat(joined, number), F.upper(F.concat(F.array_join(words, "_"), number)), F.concat(camel, number), F.when(draw(11, 4) == 0, rule).otherwise(joined))).alias("s"))
    return random.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))


def train_markov(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of the alphabet's characters, random over ordinary, from strings s labelled random or not.

    Each model is a chain of order one with add-one counts: a label without strings leaves its chain even. Pairs with
    another character are left out, null strings and labels too. Only the counts of pairs, a fixed number, reach the driver.
    """
    at = {a + b: i * _N + j for i, a in enumerate(ALPHABET) for j, b in enumerate(ALPHABET)}
    strings = labelled.where((F.length("s") > 1) & F.col("random").isNotNull())
    pairs = strings.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("g"))
    counts = {label: [1.0] * (_N * _N) for label in (True, False)}
    for r in pairs.where(F.regexp_like("g", F.lit("^[A-Za-z0-9+/_=-]{2}$"))).groupBy("random", "g").count().collect():
        counts[r["random"]][at[r["g"]]] += r["count"]

    def conditional(c: list[float]) -> list[float]:
        rows = [sum(c[i * _N : (i + 1) * _N]) for i in range(_N)]
        return [math.log(x / rows[i // _N]) for i, x in enumerate(c)]

    return [a - b for a, b in zip(conditional(counts[True]), conditional(counts[False]), strict=True)]


def markov_score(s: Column, llr: Column) -> Column:
    """The mean log-likelihood ratio over the pairs of a string of the alphabet's characters."""
    code = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    of = lambda i: F.get(code, F.ascii(F.substring(s, i, F.lit(1))))
    total = F.aggregate(F.sequence(F.lit(1), F.length(s) - 1), F.lit(0.0), lambda a, i: a + F.get(llr, of(i) * _N + of(i + 1)))
    return total / (F.length(s) - 1)


def scan_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", llr: list[float] | None = None, least: float = 0.7) -> DataFrame:
    """Secrets in documents.

    Fixed forms: assignments to names such as ``token``, access keys and runs of hexadecimal digits. Beyond them, runs of
    20 or more characters of the alphabet, less the fixed forms within them, are secrets where they hold a letter and the
    mean log-likelihood ratio of the two Markov models is at least ``least``; those that overlap a fixed form are not told
    twice. ``llr`` is ``train_markov``'s result, trained on ``labelled_samples`` where it is None.

    Matches are told as lengths, in order; running sums over a document's own rows make the places, so that time stays
    linear in them.

    Returns one row per document: ``id_col``, n_assign, n_access, n_hex, n_markov, base_sha256, spans. Null counts as an
    empty text, without spans; null or repeated ids are rows of their own; an empty table gives no rows; other columns are
    not read.
    """
    ratios = llr if llr is not None else train_markov(labelled_samples(df.sparkSession))
    table = F.expr(f"array({','.join(f'{x!r}D' for x in ratios)})")
    text = F.col("_cv_t")
    docs = df.select(F.col(id_col).alias("_cv_id"), F.monotonically_increasing_id().alias("_cv_rid"), F.coalesce(F.col(text_col), F.lit("")).alias("_cv_t"))
    own = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("gap"), F.lit(0).alias("n"), F.lit(True).alias("ok")))
    docs = docs.select(
        "_cv_id", "_cv_rid",
        F.concat(
            own,
            _events(text, ASSIGN, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
            _events(text, "AKIA[A-Z0-9]{14,}", "access", "AKIA[A-Z0-9]{14}", lambda m: F.length(m) >= 18),
            _events(text, "[0-9a-f]{16,}", "hex", "[0-9a-f]{16}", lambda m: F.length(m) >= 16),
            _parts(text, table, least),
        ).alias("_cv_events"),
    )
    # Dealt out by the outer form, as the other puts a filter on the array's size into the plan, which would make it again.
    rows = docs.select("_cv_id", "_cv_rid", F.posexplode_outer("_cv_events").alias("_cv_i", "x")).select(F.when(F.col("_cv_i") == 0, F.col("_cv_id")).alias("_cv_id"), "_cv_rid", "_cv_i", "x.*")
    rows = rows.repartition("_cv_rid")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_cv_rid", "k").orderBy("_cv_i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("_cv_id", "_cv_rid", "k", "ok", (end - F.col("n")).cast("int").alias("s"), end.cast("int").alias("e")).where("ok")
    base = F.col("k").between(0, 2)
    before = Window.partitionBy("_cv_rid").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_cv_rid").orderBy(F.desc("s"), "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_cv_to", F.max(F.when(base, F.col("e"))).over(before)).withColumn("_cv_from", F.min(F.when(base, F.col("s"))).over(after))
    clear = F.coalesce(F.col("_cv_to") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("_cv_from") >= F.col("e"), F.lit(True))
    rows = rows.where((F.col("k") < 3) | clear)
    span = F.struct("s", "k", "e")
    count = lambda kind: F.count(F.when(F.col("k") == KINDS.index(kind), True)).alias(f"n_{kind}")
    told = rows.groupBy("_cv_rid").agg(
        F.first("_cv_id", ignorenulls=True).alias(id_col), *[count(k) for k in KINDS],
        F.collect_list(F.when(base, span)).alias("_cv_base"), F.collect_list(F.when(F.col("k") >= 0, span)).alias("_cv_all"),
    )
    return told.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(_shown(F.col("_cv_base")), 256).alias("base_sha256"), _shown(F.col("_cv_all")).alias("spans"))
