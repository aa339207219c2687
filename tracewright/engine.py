"""LineageEngine: SQL scripts as DataFrames in, lineage tables out.

A script is split, parsed and resolved inside ``mapInPandas``; the schema of the
tables it names travels with it as one column, joined in beforehand, so no
catalog is broadcast whatever its size.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rewrite
from .functions.checkpoints import cut
from .functions.parser import SqlError, parse
from .functions.scan import fold, split_statements
from .plans.lineage import Model, count_references

SKIPPED = ("DDL", "OTHER", "MERGE")
FACTS = "source_file string, statement_index int, what string, ordinal int, body string"
#: what -> schema of its body
SHAPES = {
    "statement": "statement_kind string, target_id string, span_start int, span_end int, n_references int, text string",
    "edge": "edge_id string, from_id string, to_id string, kind string, transform string, expression string, span_start int, span_end int",
    "column": "column_id string, table_id string, name string, scope_id string, is_output boolean, type string, nullable boolean",
    "scope": "scope_id string, scope_kind string, parent_id string, span_start int, span_end int",
    "unknown": "reason string, span_start int, span_end int",
    "diagnostic": "severity string, code string, message string, span_start int, span_end int",
    "table": "table_id string, name string, alias string, span_start int, span_end int",
}


def analyse(sql: str, schema: dict | None = None, tolerant: bool = True, source_edges: bool = True) -> list[tuple[int, str, int, dict]]:
    """``(statement, what, ordinal, body)`` facts of a script; never raises on bad SQL.

    Strict: one bad statement leaves only its diagnostic.  Tolerant: the others stay.
    """
    out: list[tuple[int, str, int, dict]] = []
    said: Counter = Counter()

    def bad(i: int, code: str, text: str, s: int, e: int, severity: str = "ERROR") -> None:
        out.append((i, "diagnostic", said[i], {"severity": severity, "code": code, "message": text, "span_start": s, "span_end": e}))
        said[i] += 1

    chunks = split_statements(sql)
    if not chunks:
        bad(0, "tokens.empty_input", "no statement", 0, len(sql))
    i = -1
    for start, end, text in chunks:
        try:
            parsed = parse(text, start)
        except SqlError as e:
            i += 1
            bad(i, "tokens.parse_error", str(e), e.start, e.end)
            if not tolerant:
                return [x for x in out if x[1] == "diagnostic"]
            continue
        for st in (parsed, *parsed.more):
            i += 1
            out.append((i, "statement", 0, {"statement_kind": st.kind, "target_id": fold(st.target) or None, "span_start": start, "span_end": end, "n_references": count_references(st), "text": text}))
            seen: set[str] = set()
            for t in st.tables:
                if fold(t.name) not in seen:
                    seen.add(fold(t.name))
                    out.append((i, "table", len(seen) - 1, {"table_id": fold(t.name), "name": t.name, "alias": t.alias or None, "span_start": t.start, "span_end": t.end}))
            for text_, s, e in st.warnings:
                bad(i, "tokens.semantic_partial", text_, s, e, "WARNING")
            if st.kind in SKIPPED:
                continue
            m = Model(st, text, schema, start, source_edges)
            for what, rows in (("edge", m.edges), ("column", m.columns()), ("scope", m.scopes()), ("unknown", [dict(zip(("reason", "span_start", "span_end"), u)) for u in m.unknowns])):
                out += [(i, what, k, r) for k, r in enumerate(rows)]
    return out


def table_names(sql: str) -> list[str]:
    """Folded names of all tables that a script mentions, subqueries included."""
    names: set[str] = set()
    for start, _, text in split_statements(sql):
        try:
            st = parse(text, start)
        except SqlError:
            continue
        every = [st, *st.more]
        names |= {fold(t.name) for x in every for t in x.tables} | {fold(x.target) for x in every if x.target}
        scopes = [x.scope for x in every if x.scope]
        stack = [x.query for x in every if x.query] + [q for x in every for _, e in x.assignments for q in e.subqueries()]
        while stack or scopes:
            if stack:
                q = stack.pop()
                stack += [*q.branches, *(b for _, _, b in q.ctes)]
                scopes += [q.scope] if q.scope else []
                continue
            sc = scopes.pop()
            for s in sc.sources:
                stack += [s.query] if s.query else []
                names |= {fold(s.name)} if s.name else set()
            stack += [q for e in sc.exprs() for q in e.subqueries()]
    return sorted(names - {""})


def _run(tolerant: bool, source_edges: bool):
    def run(frames):
        for f in frames:
            rows = [(src, i, what, k, json.dumps(body)) for src, sql, raw in zip(f["source_file"], f["sql"], f["schema_json"]) for i, what, k, body in analyse(sql or "", json.loads(raw) if raw else None, tolerant, source_edges)]
            yield pd.DataFrame(rows, columns=["source_file", "statement_index", "what", "ordinal", "body"])

    return run


class LineageEngine:
    """``scripts(source_file, sql)`` to tables; ``catalog(table_id, ordinal, column_name, column_type, nullable)`` is optional."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def with_schema(self, scripts: DataFrame, catalog: DataFrame | None) -> DataFrame:
        """``(source_file, sql, schema_json)``: each script with the tables that it names; a null text names none.

        The tables are found once for each distinct text and joined by its hash,
        so scripts may share a source_file or lack one.  Parsing costs far more
        than the bytes of a script tell, so scripts are spread over all shuffle
        partitions first; adaptive execution would read them in one task.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = scripts.select("source_file", "sql")
        if catalog is None:
            return rows.withColumn("schema_json", F.lit(None).cast("string"))

        @F.pandas_udf("array<string>")
        def named(sqls: pd.Series) -> pd.Series:
            return sqls.map(lambda s: table_names(s or ""))

        key = F.sha2(F.col("sql").cast("binary"), 256)
        texts = rows.where("sql is not null").groupBy(key.alias("key")).agg(F.first("sql").alias("sql")).repartition(n)
        wanted = texts.select("key", F.explode(named("sql")).alias("table_id"))
        tables = catalog.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "column_type", "nullable"))).alias("columns"))
        known = wanted.join(tables, "table_id").groupBy("key").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("table_id", F.transform("columns", lambda c: F.to_json(F.array(c["column_name"], c["column_type"], c["nullable"].cast("string")))))))).alias("schema_json"))
        return rows.withColumn("key", key).join(known, "key", "left").select("source_file", "sql", F.coalesce("schema_json", F.lit("{}")).alias("schema_json")).repartition(n)

    def facts(self, scripts: DataFrame, catalog: DataFrame | None = None, tolerant: bool = True, source_edges: bool = True, store: bool = True) -> DataFrame:
        """All facts of ``scripts``; they are stored by ``what``, so that each :meth:`table` reads its own part and no script is parsed again, unless ``store`` is false."""
        rows = self.with_schema(scripts, catalog)
        found = rows.mapInPandas(_run(tolerant, source_edges) if catalog is None else _nested(tolerant, source_edges), FACTS)
        return cut(found, "what") if store else found

    def formatted(self, scripts: DataFrame, multiline: bool = True) -> DataFrame:
        """``(source_file, sql, text, diagnostics)``; text is null for SQL that cannot be read."""

        def run(frames):
            for f in frames:
                rows = [(src, sql, *rewrite.format_sql(sql or "", multiline)) for src, sql in zip(f["source_file"], f["sql"])]
                yield pd.DataFrame([(a, b, t, [{"code": c, "message": m} for c, m in ds]) for a, b, t, ds in rows], columns=["source_file", "sql", "text", "diagnostics"])

        return scripts.select("source_file", "sql").mapInPandas(run, "source_file string, sql string, text string, diagnostics array<struct<code:string,message:string>>")

    def validated(self, scripts: DataFrame, catalog: DataFrame) -> DataFrame:
        """``(source_file, ordinal, code, message, span_start, span_end)``: what does not fit the catalog, a row each."""

        def run(frames):
            for f in frames:
                rows = [(src, k, *x) for src, sql, raw in zip(f["source_file"], f["sql"], f["schema_json"]) for k, x in enumerate(rewrite.validate(sql or "", _schema_of(raw)))]
                yield pd.DataFrame(rows, columns=["source_file", "ordinal", "code", "message", "span_start", "span_end"])

        return self.with_schema(scripts, catalog).mapInPandas(run, "source_file string, ordinal int, code string, message string, span_start int, span_end int")

    @staticmethod
    def table(facts: DataFrame, what: str) -> DataFrame:
        """One of the tables in ``SHAPES`` out of :meth:`facts`."""
        body = F.from_json("body", SHAPES[what])
        return facts.where(F.col("what") == what).select("source_file", "statement_index", "ordinal", body.alias("b")).select("source_file", "statement_index", "ordinal", "b.*")

    def lineage(self, sql: str, catalog: DataFrame | None = None, **options) -> DataFrame:
        """Edges of one script."""
        scripts = self.spark.createDataFrame([("-", sql)], "source_file string, sql string")
        return self.table(self.facts(scripts, catalog, **options), "edge")


def _schema_of(raw: str) -> dict:
    flag = {"true": True, "false": False, None: None}
    return {t: [(c[0], c[1], flag[c[2]]) for c in map(json.loads, cols)] for t, cols in json.loads(raw).items()}


def _nested(tolerant: bool, source_edges: bool):
    run = _run(tolerant, source_edges)

    def outer(frames):
        yield from run(f.assign(schema_json=f["schema_json"].map(lambda raw: json.dumps(_schema_of(raw)))) for f in frames)

    return outer
