"""Sources and sinks: bulk NDJSON, seeds, and writes that turn one index into the next."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans.mapping import TEXT, coerce, dynamic_properties, id_in
from corvane.plans.query import Compiler
from corvane.plans.search import META, Engine, Index

_ACTION = r'^\s*\{\s*"(index|create|update|delete)"\s*:'


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Actions of NDJSON bulk files: op, _index, _id, source, and their place. Files are read whole by line number, as a source line belongs to the line before it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).where(F.trim("value") != "")
    w = Window.partitionBy("file").orderBy("block", "n")
    with_next = lines.withColumn("next", F.lead("value").over(w)).withColumn("prev", F.lag("value").over(w))
    op = F.regexp_extract("value", _ACTION, 1)
    # A line is an action unless the line before it is one that takes a source; runs of look-alikes are resolved by parity.
    takes = F.regexp_extract("value", _ACTION, 1).isin("index", "create", "update")
    run = with_next.withColumn("takes", takes).withColumn("brk", F.sum(F.when(~F.col("takes"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("file", F.coalesce("brk", F.lit(0))).orderBy("block", "n"))
    marked = run.withColumn("place", place)
    is_source = F.col("place") % 2 == 0
    actions = marked.where(~is_source & (op != ""))
    body = F.from_json("value", "map<string,struct<_index:string,_id:string,routing:string>>")
    meta = F.map_values(body)[0]
    return actions.select(op.alias("op"), meta["_index"].alias("_index"), meta["_id"].alias("_id"), F.when(F.col("takes"), F.col("next")).alias("source"), "file", "block", "n")


def apply_bulk(engine: Engine, actions: DataFrame, name: str, schema: str, id_col: str = "_id") -> tuple[Index, DataFrame]:
    """The index after its actions, taken in order for each id, and a result for each action. Rows carry ``_version``, which each write of an id raises, and ``_seq_no``, which goes up in the order of actions."""
    own = actions.where(F.coalesce(F.col("_index"), F.lit(name)) == name).withColumn(id_col, F.coalesce("_id", F.md5(F.concat_ws(":", "file", "block", "n"))))
    w = Window.partitionBy(id_col).orderBy("file", "block", "n")
    there_before = _plain(engine.indices[name]).df if name in engine.indices else own.limit(0)
    version = F.col("_version") if "_version" in there_before.columns else F.lit(1).cast("long")
    existed = there_before.select(id_col, version.alias("_cv_base"), F.lit(True).alias("_cv_old"))
    first = ((there_before.agg(F.max("_seq_no")).first()[0] if "_seq_no" in there_before.columns else None) or -1) + 1
    told = own.join(existed, id_col, "left").withColumn("_cv_before", F.lag("op").over(w))
    there = F.when(F.col("_cv_before").isNull(), F.col("_cv_old").isNotNull()).otherwise(F.col("_cv_before") != "delete")
    status = F.when((F.col("op") == "create") & there, 409).when(F.col("op").isin("update", "delete") & ~there, 404).when((F.col("op") == "index") & ~there | (F.col("op") == "create"), 201).otherwise(200)
    result = F.when(status == 409, "version_conflict").when(status == 404, "not_found").when(F.col("op") == "delete", "deleted").when(status == 201, "created").otherwise("updated")
    raised = F.coalesce("_cv_base", F.lit(0)) + F.sum((status < 400).cast("long")).over(w)
    told = told.withColumn("_version", raised.cast("long"))
    results = told.select("op", F.col(id_col).alias("_id"), status.alias("status"), result.alias("result"), "_version", (F.col("n") + first).alias("_seq_no"), "n")
    good = told.withColumn("status", status).where("status < 400")
    # The actions of an id from its last one that is no update: updates merge into it in order, or into the row that was there.
    starts = F.sum((F.col("op") != "update").cast("int")).over(w)
    good = good.withColumn("part", starts).withColumn("parts", F.max("part").over(Window.partitionBy(id_col))).where("part = parts")
    source = F.when(F.col("op") == "update", F.coalesce(F.get_json_object("source", "$.doc"), F.col("source"))).otherwise(F.col("source"))
    place = F.struct("file", "block", "n")
    parsed = good.withColumn("s", F.from_json(source, schema))
    named = [f.name for f in parsed.schema["s"].dataType.fields]
    kind = F.when(F.max(F.col("op") == "delete"), "delete").when(F.max("parts") == 0, "update").otherwise("index")
    merged = [F.max_by(F.col("s")[c], F.when(F.col("s")[c].isNotNull(), place)).alias(c) for c in named]
    last = parsed.groupBy(id_col).agg(kind.alias("op"), F.max("_version").alias("_version"), (F.max_by("n", place) + first).alias("_seq_no"), *merged)
    new = last.where("op <> 'delete'")
    fields = [c for c in new.columns if c not in (id_col, "op")]
    if name in engine.indices:
        old = _plain(engine.indices[name])
        untouched = old.df.join(last.select(id_col), id_col, "left_anti")
        merged = new.alias("n").join(old.df.alias("o"), id_col, "left")
        both = merged.select(id_col, *[(F.when(F.col("op") == "update", F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"n.{c}")) if c in old.df.columns else F.col(f"n.{c}")).alias(c) for c in fields])
        added = [c for c in fields if c not in old.df.columns and c not in META]
        df, props = untouched.unionByName(both, allowMissingColumns=True), old.mapping.declared | (dynamic_properties(both.select(added)) if added else {})
    else:
        df, props = new.drop("op"), dynamic_properties(new.drop("op", id_col, "_version", "_seq_no"))
    return engine.create(name, df, props, engine.indices[name].mapping.settings if name in engine.indices else None, id_col), results


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is unset and the driver is the only machine, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def compact(engine: Engine, name: str) -> Index:
    """Write an index once to the shared folder and read it from there, so that a chain of writes does not grow its plan."""
    ix, spark = _plain(engine.index(name)), engine.spark
    path = f"{shared_folder(spark)}/corvane-index-{uuid.uuid4().hex}"
    ix.df.write.parquet(path)
    return engine.create(name, spark.read.schema(ix.df.schema).parquet(path), ix.mapping.declared, ix.mapping.settings, ix.id_col)


def store_tokens(engine: Engine, name: str) -> Index:
    """Analyse an index's text fields once: written to the shared folder beside its columns, tokens are read by text queries, which else make them again for each request.

    Fields within nested objects are left as they are. A write to the index gives one without stored tokens.
    """
    ix, spark = _plain(engine.index(name)), engine.spark
    fields = [f for f in ix.mapping.fields.values() if f.type in TEXT and not f.multi and f.column in ix.df.columns]
    columns = {f.name: f"_cv_tokens_{i}" for i, f in enumerate(fields)}
    path = f"{shared_folder(spark)}/corvane-tokens-{uuid.uuid4().hex}"
    df = ix.df.withColumns({columns[f.name]: ix.mapping.tokens(f) for f in fields})
    df.write.parquet(path)
    engine.indices[name] = Index(name, spark.read.schema(df.schema).parquet(path), ix.mapping.storing(columns), engine, ix.id_col)
    return engine.indices[name]


def _plain(ix: Index) -> Index:
    """The index without stored tokens, as a write needs it."""
    return replace(ix, df=ix.df.drop(*ix.mapping.stored.values()), mapping=ix.mapping.storing({})) if ix.mapping.stored else ix


def index_documents(engine: Engine, name: str, docs: DataFrame, properties: dict | None = None, id_col: str = "_id") -> Index:
    """Coerce rows to a mapping and make an index of them; a later row of an id takes the place of an earlier one."""
    if id_col not in docs.columns:
        docs = docs.withColumn(id_col, F.expr("uuid()"))
    return engine.create(name, coerce(docs, properties or {}), properties, id_col=id_col)


def upsert(engine: Engine, name: str, rows: DataFrame) -> Index:
    """Rows replace those of the same id and join the rest."""
    old = _plain(engine.index(name))
    df = old.df.join(rows.select(old.id_col), old.id_col, "left_anti").unionByName(rows, allowMissingColumns=True)
    engine.indices[name] = Index(name, df, old.mapping, engine, old.id_col)
    return engine.indices[name]


def delete_by_query(engine: Engine, name: str, query: dict, max_docs: int | None = None) -> int:
    """Remove matching rows; the number removed."""
    ix = _plain(engine.index(name))
    gone = ix.filtered(query).select(ix.id_col)
    gone = gone.orderBy(ix.id_col).limit(max_docs) if max_docs is not None else gone
    n = gone.count()
    engine.indices[name] = Index(name, ix.df.join(gone, ix.id_col, "left_anti"), ix.mapping, engine, ix.id_col)
    return n


def update_by_query(engine: Engine, name: str, query: dict, changes: dict[str, Column]) -> Index:
    """Set columns where a query matches."""
    ix = _plain(engine.index(name))
    c = Compiler(ix.df, ix.mapping, engine, False, ix.id_col)
    m = c.compile(query)
    df = c.df.withColumns({n: F.when(m.hit, v).otherwise(F.col(n)) for n, v in changes.items()}).select(*ix.df.columns)
    engine.indices[name] = Index(name, df, ix.mapping, engine, ix.id_col)
    return engine.indices[name]


def update(engine: Engine, name: str, doc_id: object, partial: dict, upsert_doc: dict | None = None, doc_as_upsert: bool = False) -> Index:
    """Merge a partial document into one row, or add it."""
    ix = _plain(engine.index(name))
    here = id_in(ix.df, ix.id_col, [doc_id])
    if ix.df.where(here).isEmpty():
        doc = partial if doc_as_upsert else upsert_doc
        if doc is None:
            raise KeyError(f"document [{doc_id}] missing")
        kinds = dict(ix.df.dtypes)
        row = engine.spark.range(1).select(F.lit(doc_id).cast(kinds[ix.id_col]).alias(ix.id_col), *[F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in doc.items() if k != ix.id_col])
        return upsert(engine, name, row)
    kinds = dict(ix.df.dtypes)
    df = ix.df.withColumns({k: F.when(here, F.lit(v).cast(kinds.get(k, "string"))).otherwise(F.col(k) if k in kinds else F.lit(None)) for k, v in partial.items()})
    engine.indices[name] = Index(name, df, ix.mapping, engine, ix.id_col)
    return engine.indices[name]


def get(engine: Engine, name: str, doc_id: object) -> DataFrame:
    ix = _plain(engine.index(name))
    return ix.df.where(id_in(ix.df, ix.id_col, [doc_id]))


def mget(engine: Engine, wanted: list[tuple[str, object]]) -> DataFrame:
    """A row for each pair of index and id, in their order, with whether it was found. The list is the request's own."""
    asked = F.broadcast(engine.spark.createDataFrame([(n, i, str(d)) for n, (i, d) in enumerate(wanted)], "position int, _index string, _id string"))
    parts = None
    for i in dict.fromkeys(i for i, _ in wanted):
        ix = engine.index(i)
        rows = ix.df.withColumn("_index", F.lit(i)).withColumn("_id", F.col(ix.id_col).cast("string"))
        parts = rows if parts is None else parts.unionByName(rows, allowMissingColumns=True)
    return asked.join(parts.withColumn("found", F.lit(True)), ["_index", "_id"], "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("position")


def reindex(engine: Engine, source: str, dest: str, query: dict | None = None, columns: list[str] | None = None, max_docs: int | None = None, op_type: str = "index") -> Index:
    """Copy matching rows into an index, replacing those of the same id unless ``op_type`` is create."""
    ix = _plain(engine.index(source))
    rows = ix.filtered(query).select(*([ix.id_col, *[c for c in columns if c != ix.id_col]] if columns else ix.df.columns))
    rows = rows.orderBy(ix.id_col).limit(max_docs) if max_docs is not None else rows
    if dest not in engine.indices:
        return engine.create(dest, rows, {n: how for n, how in ix.mapping.declared.items() if n in rows.columns or how.get("type") == "alias"}, ix.mapping.settings, ix.id_col)
    if op_type == "create":
        rows = rows.join(engine.index(dest).df.select(ix.id_col), ix.id_col, "left_anti")
    return upsert(engine, dest, rows)


def load_seed(engine: Engine, folder: str) -> list[str]:
    """``<name>.template.json``, ``<name>.index.json`` (mappings), ``<name>.ndjson`` (documents) and ``aliases.json`` of a folder, in this order."""
    made = []
    for f in sorted(os.listdir(folder)):
        if f.endswith(".template.json"):
            with open(os.path.join(folder, f)) as fh:
                engine.templates[f.removesuffix(".template.json")] = json.load(fh)
    for f in sorted(os.listdir(folder)):
        if f.endswith(".ndjson"):
            name = f.removesuffix(".ndjson")
            props: dict = engine.template_for(name).get("mappings", {}).get("properties", {})
            spec = os.path.join(folder, f"{name}.index.json")
            if os.path.exists(spec):
                with open(spec) as fh:
                    body = json.load(fh)
                props = props | body.get("mappings", {}).get("properties", {})
            docs = engine.spark.read.json(os.path.join(folder, f))
            index_documents(engine, name, docs, props)
            made.append(name)
    path = os.path.join(folder, "aliases.json")
    if os.path.exists(path):
        with open(path) as fh:
            for alias, targets in json.load(fh).items():
                for t in targets if isinstance(targets, list) else [targets]:
                    put_alias(engine, alias, t if isinstance(t, str) else t["index"], None if isinstance(t, str) else t.get("filter"))
    return made


def put_alias(engine: Engine, alias: str, index: str, query: dict | None = None) -> None:
    engine.aliases.setdefault(alias, {})[index] = query


def remove_alias(engine: Engine, alias: str, index: str) -> None:
    engine.aliases[alias].pop(index)
    if not engine.aliases[alias]:
        engine.aliases.pop(alias)


def export(engine: Engine, name: str, path: str) -> None:
    _plain(engine.index(name)).df.write.parquet(path)


def open_parquet(engine: Engine, name: str, path: str, properties: dict | None = None, id_col: str = "_id") -> Index:
    return engine.create(name, engine.spark.read.parquet(path), properties, id_col=id_col)
