"""Schema sources: DDL text, data files, Spark's catalog, and how they combine.

All give the same table: ``provider_id, table_id, catalog, schema, name,
ordinal, column_name, column_type, nullable``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parser import SqlError, parse
from ..functions.scan import Token, bare, fold, split_statements, tokens

COLUMNS = "provider_id string, table_id string, catalog string, schema string, name string, ordinal int, column_name string, column_type string, nullable boolean"
_NOT_COLUMNS = {"PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX", "FULLTEXT", "EXCLUDE", "LIKE", "PERIOD"}
_AFTER_TYPE = {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "CONSTRAINT", "COMMENT", "AUTO_INCREMENT", "GENERATED", "COLLATE", "IDENTITY", "ON", "KEY", "ENCODE", "INVISIBLE"}


class DdlError(ValueError):
    """DDL that cannot be read, in strict mode."""


def _items(ts: list[Token]) -> list[list[Token]]:
    """Split the tokens of a parenthesised list at its top-level commas."""
    out, depth = [[]], 0
    for t in ts:
        depth += {"(": 1, "<": 1, "[": 1, ")": -1, ">": -1, "]": -1}.get(t.text if t.kind == "op" else "", 0)
        if depth == 0 and t.text == "," and t.kind == "op":
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _column(ts: list[Token], sql: str) -> tuple[str, str | None, bool | None] | None:
    if ts[0].word in _NOT_COLUMNS and len(ts) > 1 and (ts[1].text == "(" or ts[1].word or ts[1].kind == "quoted") and not (ts[0].word in ("KEY", "INDEX", "PERIOD") and ts[1].word in ("INT", "BIGINT", "STRING", "TEXT", "VARCHAR")):
        return None
    end, depth = 1, 0
    while end < len(ts) and (depth or ts[end].word not in _AFTER_TYPE):
        depth += {"(": 1, "<": 1, ")": -1, ">": -1}.get(ts[end].text, 0)
        end += 1
    kind = sql[ts[1].start : ts[end - 1].end] if end > 1 else None
    words = [t.word for t in ts[end:]]
    null = None
    for i, w in enumerate(words):
        if w == "NULL":
            null = not (i and words[i - 1] == "NOT")
            break
    return bare(ts[0].text), kind, null


def read_ddl(sql: str, provider: str = "ddl:inline", strict: bool = False) -> list[dict]:
    """Columns of each CREATE TABLE, and of each view whose columns are all known by name; the first definition wins."""
    out: dict[str, list[dict]] = {}

    def add(name: str, cols: list[tuple]) -> None:
        parts = name.split(".")
        key = fold(name)
        if key not in out:
            out[key] = [{"provider_id": provider, "table_id": key, "catalog": parts[-3] if len(parts) > 2 else None, "schema": parts[-2] if len(parts) > 1 else None, "name": parts[-1], "ordinal": i, "column_name": c, "column_type": t, "nullable": n} for i, (c, t, n) in enumerate(cols)]

    for start, _, text in split_statements(sql):
        ts = tokens(text)
        words = [t.word for t in ts[:8]]
        try:
            if words[:1] != ["CREATE"]:
                if strict:
                    parse(text, start)
                continue
            st = parse(text, start)
            if "VIEW" in words:
                names = st.columns or _view_names(st.query)
                if names and len({fold(n) for n in names}) == len(names):
                    add(st.target, [(n, None, None) for n in names])
            elif "TABLE" in words and st.kind == "DDL":
                i = next(k for k, t in enumerate(ts) if t.word == "TABLE") + 1
                while i < len(ts) and ts[i].text != "(":
                    i += 1
                depth, j = 0, i
                while j < len(ts):
                    depth += {"(": 1, ")": -1}.get(ts[j].text, 0)
                    if depth == 0:
                        break
                    j += 1
                cols = [c for x in _items(ts[i + 1 : j]) if (c := _column(x, text))]
                if cols:
                    add(st.target, cols)
        except (SqlError, StopIteration, IndexError) as e:
            if strict:
                raise DdlError(str(e)) from e
    return [r for rows in out.values() for r in rows]


def _view_names(q) -> list[str]:
    while q is not None and q.branches:
        q = q.branches[0]
    outs = q.scope.outputs if q is not None and q.scope else []
    names = [o.name for o in outs]
    return names if names and all(names) and not any(o.expr.kind == "star" for o in outs) else []


def from_ddl(texts: DataFrame, provider: str = "ddl:auto", strict: bool = False) -> DataFrame:
    """``texts(source_file, sql)`` to catalog rows; across files the first, by name, wins."""

    def run(frames):
        for f in frames:
            rows = [{**r, "source_file": src} for src, sql in zip(f["source_file"], f["sql"]) for r in read_ddl(sql or "", provider, strict)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in (COLUMNS + ", source_file string").split(", ")])

    got = texts.select("source_file", "sql").mapInPandas(run, COLUMNS + ", source_file string")
    first = F.min("source_file").over(Window.partitionBy("table_id"))
    return got.withColumn("first", first).where("source_file = first").drop("first", "source_file")


def from_frames(frames: dict[str, DataFrame], provider: str = "files") -> DataFrame:
    """Catalog rows from DataFrame schemas."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(provider, fold(name), None, None, name.split(".")[-1], i, f.name, f.dataType.simpleString(), f.nullable) for name, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, COLUMNS)


def from_spark(spark: SparkSession, database: str | None = None, provider: str = "spark") -> DataFrame:
    """Catalog rows of the tables and views that Spark's own catalog lists."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = ".".join([*(t.namespace or []), t.name])
        rows += [(provider, fold(t.name), t.catalog, (t.namespace or [None])[-1], t.name, i, c.name, c.dataType, c.nullable) for i, c in enumerate(spark.catalog.listColumns(name))]
    return spark.createDataFrame(rows, COLUMNS)


def from_jdbc(spark: SparkSession, url: str, tables: list[str], provider: str = "jdbc", **options: str) -> DataFrame:
    """Catalog rows of database tables; only metadata is read."""
    frames = {t: spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT * FROM {t} WHERE 1 = 0) q", **options).load() for t in tables}
    return from_frames(frames, provider)


def checked(catalog: DataFrame) -> DataFrame:
    """The catalog itself; an error if a table id or one of its columns is declared twice."""
    twice = catalog.groupBy("table_id").agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("places"), F.count_distinct(F.lower("column_name")).alias("names")).where("n > places OR n > names")
    if found := twice.orderBy("table_id").take(1):
        raise ValueError(f"duplicate_table: {found[0]['table_id']} is declared twice")
    return catalog


def compose(*catalogs: DataFrame | None) -> DataFrame | None:
    """Catalogs by falling priority: for each table the first that has it; None without any."""
    given = [c for c in catalogs if c is not None]
    if not given:
        return None
    out = given[0].withColumn("_rank", F.lit(0))
    for i, c in enumerate(given[1:], 1):
        out = out.unionByName(c.withColumn("_rank", F.lit(i)))
    return out.withColumn("_best", F.min("_rank").over(Window.partitionBy("table_id"))).where("_rank = _best").drop("_rank", "_best")


def find(catalog: DataFrame, names: DataFrame, search_path: tuple[str, ...] = ()) -> DataFrame:
    """``names(query)`` with the ``table_id`` each means: an exact id, else the only table of that name on the search path."""
    tables = catalog.select("table_id", F.lower("schema").alias("schema"), F.lower("name").alias("name")).distinct()
    wanted = names.select("query", F.lower("query").alias("key"))
    exact = wanted.join(tables.select(F.col("table_id").alias("key"), "table_id"), "key", "left")
    near = tables.where(F.col("schema").isin([s.lower() for s in search_path])).groupBy("name").agg(F.count("*").alias("n"), F.min("table_id").alias("only")).where("n = 1")
    return exact.join(near, exact["key"] == near["name"], "left").select("query", F.coalesce("table_id", "only").alias("table_id"))


def search(catalog: DataFrame, text: str) -> DataFrame:
    """Tables whose name or id contains ``text``, case folded, by id."""
    return catalog.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains("table_id", F.lit(text.lower()))).select("table_id", "name").distinct().orderBy("table_id")
