"""Queries as an editor asks them, put together from the operators. texts: files (path, lang, text)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lattica.functions import exprs as X
from lattica.functions.lines import comment_above, enclosing_call, split_params
from lattica.operators import graph as G
from lattica.operators.resolve import classified, references_at
from lattica.operators.store import BASE_KINDS, CALLABLE, CLASS_KINDS, Store, symbol_order
from lattica.sources.shared import keep

MODES = ("callees", "callers", "both", "bases", "derived", "classes", "includes", "included", "include_both")
INCLUDE = r"""^\s*#\s*include\s*([<"][^">]+[">])"""


def at_place(resolved: DataFrame, path: str, line: int, col: int) -> DataFrame:
    """The occurrence that a place is in."""
    return resolved.where((F.col("path") == path) & (F.col("line") == line) & F.lit(col).between(F.col("col"), F.col("col") + F.length("name")))


def line_at(texts: DataFrame, path: str, line: int) -> DataFrame:
    """(line): the text of a line; no row beyond the end."""
    rows = texts.where(F.col("path") == path).select(F.get(F.split("text", "\r?\n"), F.lit(line)).alias("line"))
    return rows.where("line is not null")


def preview(texts: DataFrame, path: str, line: int, around: int = 6) -> DataFrame:
    """(path, line, txt): the lines of a file from `around` above a line to as many below it."""
    rows = texts.where(F.col("path") == path).select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "txt"))
    return rows.where(F.col("line").between(line - around, line + around))


def word_at(line: Column, col: int) -> Column:
    """The identifier that a column is in or right behind."""
    head = F.regexp_extract(F.substring(line, 1, col), r"([A-Za-z0-9_]*)$", 1)
    word = F.concat(head, F.regexp_extract(F.substring(line, col + 1, 1 << 20), r"^([A-Za-z0-9_]*)", 1))
    return F.when(word.rlike("^[A-Za-z_]"), word)


def include_target(store: Store, texts: DataFrame, path: str, line: int) -> DataFrame:
    """(path, line) of the file that an include on a line names, if it is in the project."""
    raw = line_at(texts, path, line).select(F.regexp_extract("line", INCLUDE, 1).alias("raw")).where("raw <> ''")
    inc = raw.select(X.normalize_include(F.col("raw")).alias("path"))
    return store.resolved_includes(inc).where("resolved is not null").select(F.col("resolved").alias("path"), F.lit(0).alias("line"))


def symbols_at(store: Store, resolved: DataFrame, path: str, line: int, col: int, texts: DataFrame | None = None) -> DataFrame:
    """The symbols that a place may mean, `place` 0 for those in the file and 1 for others: a member's own, all definitions of a
    name; none for locals. With texts, what no occurrence covers is looked up by the word that stands there."""
    at = at_place(resolved, path, line, col).select("name", "res_kind", F.when(F.col("res_kind") == "member", F.col("qualname")).alias("q"))
    if texts is not None:
        word = line_at(texts, path, line).select(word_at(F.col("line"), col).alias("name")).where("name is not null")
        at = at.unionByName(word.join(at.select("name"), "name", "left_anti").select("name", F.lit("symbol").alias("res_kind"), F.lit(None).cast("string").alias("q")))
    at = F.broadcast(at.where("res_kind <> 'local'").select("name", "q").distinct())
    s = store.symbols.join(at, "name").where("q is null or qualname = q").drop("q")
    place = (F.lower("path") != path.lower()).cast("int")
    return store._definitions(s.select(*store.symbols.columns)).withColumn("place", place)


def definition(store: Store, resolved: DataFrame, texts: DataFrame, path: str, line: int, col: int) -> DataFrame:
    """(path, line) to go to: the file of an include on the line, else where what stands at the place is declared or defined, but for
    the line itself; definitions in the same file come first."""
    to = include_target(store, texts, path, line)
    local = at_place(resolved, path, line, col).where("res_kind = 'local'").select(F.col("decl_path").alias("path"), F.col("decl_line").alias("line"), F.lit(0).alias("place"), F.lit(0).alias("no"))
    found = symbols_at(store, resolved, path, line, col, texts)
    found = found.select("path", "line", "place", X.kind_rank(F.col("kind")).alias("no")).unionByName(local)
    found = found.where(~((F.col("path") == path) & (F.col("line") == line))).groupBy("path", "line").agg(F.min(F.struct("place", "no")).alias("o"))
    inside = found.crossJoin(F.broadcast(to.agg(F.count("*").alias("includes")))).where("includes = 0")  # one row
    return to.withColumn("o", F.struct(F.lit(0).alias("place"), F.lit(0).alias("no"))).unionByName(inside.drop("includes")).orderBy("o", "path", "line").select("path", "line")


def declaration(store: Store, resolved: DataFrame, path: str, line: int, col: int) -> DataFrame:
    """Prototypes of the name at a place that is neither local nor a member."""
    at = at_place(resolved, path, line, col).where("res_kind = 'symbol'").select("name").distinct()
    return store.symbols.where("kind = 'prototype'").join(F.broadcast(at), "name").orderBy(*symbol_order())


def with_comment(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """symbols, few of them, with the comment above each, null for prototypes and where there is none."""
    names = symbols.columns
    j = symbols.join(texts.join(F.broadcast(symbols.select("path").distinct()), "path", "left_semi").select("path", F.split("text", "\r?\n").alias("_lines")), "path", "left")

    def run(batches):
        for batch in batches:
            out = []
            for kind, line, lines in zip(batch.column("kind").to_pylist(), batch.column("line").to_pylist(), batch.column("_lines").to_pylist(), strict=True):
                marks = [re.sub(r"^\s*(/\*+|\*+/|\*|//+)\s?|\s*\*+/\s*$", "", x).strip() for x in comment_above(lines, line)] if lines and kind != "prototype" else []
                out.append("\n".join(marks).strip() or None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "comment"])

    return j.select(*names, "_lines").mapInArrow(run, StructType([*symbols.schema.fields, StructField("comment", StringType())]))


def hover(store: Store, resolved: DataFrame, texts: DataFrame, path: str, line: int, col: int, most: int = 3) -> DataFrame:
    """Up to three symbols at a place (same file first) with kind, signature, number of callers and the comment above; for a local its
    type."""
    s = symbols_at(store, resolved, path, line, col, texts)
    s = s.orderBy("place", *symbol_order()).limit(most).select("name", "kind", "signature", "path", "line")
    calls = store.refs.where("kind = 'call'").join(F.broadcast(s.where(F.col("kind").isin(*CALLABLE)).select("name").distinct()), "name").groupBy("name").agg(F.count("*").alias("callers"))
    local = at_place(resolved, path, line, col).where("res_kind = 'local'").select("name", F.lit("local").alias("kind"), F.concat_ws(" ", "l_type", "name").alias("signature"), F.col("decl_path").alias("path"), F.col("decl_line").alias("line"), F.lit(None).cast("string").alias("comment")).distinct()
    counted = with_comment(s, texts).unionByName(local).join(calls, "name", "left")
    callers = F.when(F.col("kind").isin(*CALLABLE), F.coalesce("callers", F.lit(0))).otherwise(0)
    return counted.select("name", "kind", "signature", "path", "line", "comment", callers.alias("callers"))


def signature_help(store: Store, before: str) -> DataFrame:
    """(signature, kind, path, line, parameters, active) for the call that is open at the end of `before`, the text up to a place:
    each signature once; active is the parameter that is being written, by the first signature."""
    call = enclosing_call(before)
    name, place = call or ("", 0)
    s = store.find_symbols(name).where(F.col("kind").isin(*CALLABLE, "prototype"))
    bare = s.select(F.regexp_replace("signature", r"\s*[{;]\s*$", "").alias("signature"), "kind", "path", "line", F.struct(X.kind_rank(F.col("kind")), F.col("line") - F.col("end_line"), "path", "line", "col").alias("o"))
    once = bare.groupBy("signature").agg(F.min_by(F.struct("kind", "path", "line"), "o").alias("x"), F.min("o").alias("o")).select("signature", "x.*", "o")
    names = ["signature", "kind", "path", "line", "o"]

    def run(batches):
        for batch in batches:
            lists = [split_params(t[t.index("(") + 1 : t.rindex(")")]) if "(" in t and t.rfind(")") > t.index("(") else [] for t in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], [*names, "parameters"])

    split = once.mapInArrow(run, StructType([*once.schema.fields, StructField("parameters", ArrayType(StringType()))]))
    first = F.broadcast(split.agg(F.min_by(F.size("parameters"), "o").alias("n")))  # one row
    active = F.least(F.lit(place), F.greatest(F.lit(0), F.col("n") - 1))
    return split.crossJoin(first).orderBy("o").select("signature", "kind", "path", "line", "parameters", active.alias("active"))


def search_project(store: Store, words: str, limit: int = 300) -> DataFrame:
    """Functions that use all words, which white space or commas part."""
    return store.functions_using_all([w for w in re.split(r"[\s,]+", words) if w], limit)


def symbol_tree(store: Store, page: int = 2000) -> DataFrame:
    """(kind, count, name, path, line): symbols of each kind by name, one more than a page, with the kind's count; kinds in their order."""
    s = store.symbols.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy("name", "path", "line"))).where(F.col("_r") <= page + 1)
    place = F.array_position(F.lit(list(X.KINDS)), F.col("kind"))
    return s.join(F.broadcast(store.kind_counts()), "kind").orderBy(place, "name", "path", "line").select("kind", "count", "name", "path", "line")


def type_item(store: Store, resolved: DataFrame, path: str, line: int, col: int) -> DataFrame:
    """The class or struct that a type hierarchy of a place begins with, one row at most."""
    return symbols_at(store, resolved, path, line, col).where(F.col("kind").isin(*BASE_KINDS)).orderBy("place", *symbol_order()).limit(1)


def supertypes(store: Store, symbol_id: int) -> DataFrame:
    return store.bases_of(symbol_id).where("base_id is not null")


def subtypes(store: Store, name: str) -> DataFrame:
    return store.derived_of(name.rsplit("::", 1)[-1])


def call_item(store: Store, resolved: DataFrame, path: str, line: int, col: int) -> DataFrame:
    """The symbol that a call hierarchy of a place begins with: what can be called, else a prototype."""
    return symbols_at(store, resolved, path, line, col).where(F.col("kind").isin(*CALLABLE, "prototype")).orderBy((~F.col("kind").isin(*CALLABLE)).cast("int"), "place", *symbol_order()).limit(1)


def centre(store: Store, name: str, classes: bool = False, path: str | None = None, line: int | None = None) -> DataFrame:
    """The symbol that a relation graph of name begins with: callables come first, or classes in graphs of classes; if there is none,
    with path and line, the function around the place."""
    first = F.col("kind").isin(*(CLASS_KINDS if classes else CALLABLE))
    found = store.find_definitions(name).withColumn("o", (~first).cast("int"))
    if path is not None and line is not None and not classes:
        found = found.unionByName(store.enclosing_function(path, line).withColumn("o", F.lit(2)))
    return found.orderBy("o", "path", "line").limit(1).drop("o")


def call_edges(store: Store) -> tuple[DataFrame, DataFrame]:
    """Edges between functions and what they call, by name: the best definition, or an external node."""
    best = store.best_definitions(first=CALLABLE).select("name", F.col("id").alias("to"))
    c = store.refs.where("kind = 'call' and from_symbol is not null").groupBy("from_symbol", "name").agg(F.count("*").alias("count"), F.min("line").alias("line"))
    e = c.join(best, "name", "left").select(F.col("from_symbol").cast("string").alias("src"), F.coalesce(F.col("to").cast("string"), F.concat(F.lit("ext:"), "name")).alias("dst"), "count", "line")
    n = store.symbols.select(F.col("id").cast("string").alias("id"), F.col("name").alias("label"), "kind", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    return e, n


def uses_edges(store: Store, node: str) -> DataFrame | None:
    """Edges from functions to a symbol that cannot be called, by all references to its name; None if it can be."""
    own = store.symbols.where(F.col("id").cast("string") == node).select("name", "kind").limit(1).collect()
    if not own or own[0].kind in CALLABLE:
        return None
    r = store.refs.where((F.col("name") == own[0].name) & F.col("from_symbol").isNotNull())
    return r.groupBy("from_symbol").agg(F.count("*").alias("count"), F.min("line").alias("line")).select(F.col("from_symbol").cast("string").alias("src"), F.lit(node).alias("dst"), "count", "line")


def relations(store: Store, node: str, mode: str = "callees", depth: int = 1, max_nodes: int = G.MAX_NODES, folders: G.Folders | None = None) -> G.Graph:
    """The graph of a mode around a node id: symbols for calls and classes, 'file:' and a path for includes. What cannot be called has
    the functions that refer to it as callers."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode in ("callees", "callers", "both"):
        return G.build(*call_edges(store), node, mode, depth, max_nodes, first_callers=uses_edges(store, node), folders=folders)
    e, n = G.class_edges(store) if mode in ("bases", "derived", "classes") else G.include_edges(store)
    way = {"bases": "callees", "includes": "callees", "derived": "callers", "included": "callers"}.get(mode, "both")
    return G.build(e, n, node, way, depth, max_nodes, ("class", "file"), total="max")


@dataclass
class Context:
    """What a place means: definition (symbols), members (of it), type (of a variable), type_members, uses (path, line, col, kind,
    from_qualname, hidden): nearest files first, in the own file the own function first, what means something else last."""

    definition: DataFrame
    members: DataFrame
    type: DataFrame
    type_members: DataFrame
    uses: DataFrame


def members_through_typedef(store: Store, symbols: DataFrame) -> DataFrame:
    """Members of a few classes or typedefs; a typedef without any gives those of the type it names."""
    tag = F.regexp_extract("signature", rf"^typedef\s+(?:const\s+)?(?:(?:struct|class|union)\s+)?({X.IDENTIFIER})", 1)
    own = symbols.select(F.col("qualname").alias("owner")).unionByName(symbols.where("kind = 'typedef'").select(tag.alias("owner")))
    m = store.symbols.where(F.col("kind").isin("field", "method", "prototype") & F.col("qualname").contains("::"))
    m = m.withColumn("owner", F.regexp_extract("qualname", "^(.*)::[^:]*$", 1))
    return m.join(F.broadcast(own.distinct()), "owner").orderBy("path", "line", "col").select(*store.symbols.columns)


def context(store: Store, resolved: DataFrame, texts: DataFrame, path: str, line: int, col: int) -> Context:
    """The context of a place; one look-up tells what stands there."""
    at = at_place(resolved, path, line, col).limit(1).collect()
    own = keep(symbols_at(store, resolved, path, line, col, texts).orderBy("place", *symbol_order()), "context")
    first = own.orderBy("place", *symbol_order()).limit(1).drop("place")
    kind = X.base_type_name(F.regexp_extract("signature", r"^(.*?)\b[A-Za-z_]\w*\s*(?:\[[^\]]*\]\s*)*(?:=.*)?;?\s*$", 1))
    types = first.where("kind in ('variable', 'field')").select(kind.alias("type"))
    name = at[0].name if at else None
    if at and at[0].res_kind == "local":
        types = store.symbols.sparkSession.createDataFrame([(at[0].l_type or "",)], "type string").select(X.base_type_name(F.col("type")).alias("type"))
        uses = references_at(store, resolved, path, line, col, True).withColumns({"kind": F.lit("ref"), "from_symbol": F.lit(None).cast("long"), "hidden": F.lit(False)})
    else:
        word = name or next((r[0] for r in line_at(texts, path, line).select(word_at(F.col("line"), col)).collect()), None) or ""
        uses = classified(store, resolved, word, at[0].qualname if at and at[0].res_kind == "member" else None)
    of = F.regexp_extract("type", rf"({X.IDENTIFIER})$", 1)
    kinds = store.symbols.where(F.col("kind").isin(*CLASS_KINDS, "typedef", "enum"))
    typed = keep(kinds.join(F.broadcast(types.select(of.alias("name")).where(F.col("name") != (name or ""))), "name").orderBy(*symbol_order()).limit(1).select(*store.symbols.columns), "context")
    here = store.enclosing_function(path, line).select(F.col("id").alias("here"))
    near = store._with_from(uses).join(F.broadcast(here), F.col("from_symbol") == F.col("here"), "left")
    total = F.count("*").over(Window.partitionBy("path", "hidden"))
    near = near.withColumns({"d": X.distance(F.col("path"), path) + (F.lower("path") != path.lower()).cast("int"), "n": total, "away": F.when(F.lower("path") == path.lower(), F.col("here").isNull().cast("int")).otherwise(0)})
    near = near.orderBy("hidden", "d", F.desc("n"), "path", "away", "line", "col").select("path", "line", "col", "kind", "from_qualname", "hidden")
    return Context(own, members_through_typedef(store, first.where(F.col("kind").isin(*CLASS_KINDS, "typedef"))), typed, members_through_typedef(store, typed), near)
