"""Registered queries over the parsed sample project, with SQL that makes the expected rows from the driver's tables and the places
that the names have in the sample's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import resolve as R
from lattica.operators.store import Store
from lattica.plans import tasks as T
from lattica.sources import projects as P
from lattica.sources import samples as S

QUERIES, ORACLES = {}, {}

# kind of file ('s' supplier, 'h' and 'n' nation, 'r' region), name, scope, kind, line, column, last line, signature
SYMBOLS = [
    ("s", "LIMIT_{K}", "", "macro", 2, 8, 2, "#define LIMIT_{K} 10"),
    ("s", "box_{K}", "", "struct", 3, 15, 3, "typedef struct box_{K} { int wide; long high;"),
    ("s", "wide", "box_{K}::", "field", 3, 32, 3, "int wide"),
    ("s", "high", "box_{K}::", "field", 3, 43, 3, "long high"),
    ("s", "box_{K}_t", "", "typedef", 3, 51, 3, "typedef struct box_{K} { int wide; long high; } box_{K}_t"),
    ("s", "tone_{K}", "", "enum", 4, 5, 4, "enum tone_{K} { DARK_{K}, PALE_{K} = 4"),
    ("s", "DARK_{K}", "", "enumerator", 4, 19, 4, "DARK_{K}"),
    ("s", "PALE_{K}", "", "enumerator", 4, 32, 4, "PALE_{K} = 4"),
    ("s", "area_{K}", "", "prototype", 5, 4, 5, "int area_{K}(struct box_{K} *b, int times)"),
    ("s", "seen_{K}", "", "variable", 6, 11, 6, "static int seen_{K} = 0"),
    ("s", "area_{K}", "", "function", 8, 4, 14, "int area_{K}(struct box_{K} *b, int times)"),
    ("s", "twice_{K}", "", "function", 15, 4, 15, "int twice_{K}(struct box_{K} *b)"),
    ("h", "scale_{N}", "", "prototype", 1, 4, 1, "int scale_{N}(int x, int y)"),
    ("n", "scale_{N}", "", "function", 1, 4, 1, "int scale_{N}(int x, int y)"),
    ("r", "geo_{R}", "", "namespace", 0, 10, 10, "namespace geo_{R}"),
    ("r", "Base_{R}", "geo_{R}::", "class", 1, 6, 5, "class Base_{R} {"),
    ("r", "run_{R}", "geo_{R}::Base_{R}::", "prototype", 3, 7, 3, "void run_{R}()"),
    ("r", "size_{R}", "geo_{R}::Base_{R}::", "field", 4, 6, 4, "int size_{R}"),
    ("r", "Land_{R}", "geo_{R}::", "class", 6, 6, 8, "class Land_{R} : public Base_{R}, private Other<int> {"),
    ("r", "size_{R}", "geo_{R}::Land_{R}::", "field", 7, 6, 7, "int size_{R}"),
    ("r", "Either_{R}", "geo_{R}::", "union", 9, 6, 9, "union Either_{R} { int whole; float part;"),
    ("r", "whole", "geo_{R}::Either_{R}::", "field", 9, 21, 9, "int whole"),
    ("r", "part", "geo_{R}::Either_{R}::", "field", 9, 34, 9, "float part"),
    ("r", "run_{R}", "geo_{R}::Base_{R}::", "function", 11, 5, 11, "void geo_{R}::Base_{R}::run_{R}()"),
]
# kind of file, name, line, column, calls, function around, what it means: 'local' with the line of its declaration, 'member' with
# its qualified name, 'symbol', or nothing; calls come first, then the rest, in the order of the text
USES = [
    ("s", "scale_{N}", 12, 11, "call", "area_{K}", "symbol", "parts/n{N}.c", 1),
    ("s", "area_{K}", 15, 48, "call", "twice_{K}", "symbol", "", 8),
    ("s", "area_{K}", 15, 68, "call", "twice_{K}", "symbol", "", 8),
    ("s", "box_{K}", 5, 23, "ref", None, "symbol", "", 3),
    ("s", "b", 5, 35, "ref", None, None, None, None),
    ("s", "times", 5, 42, "ref", None, None, None, None),
    ("s", "box_{K}", 8, 23, "ref", "area_{K}", "symbol", "", 3),
    ("s", "b", 8, 35, "ref", "area_{K}", "local", "", 8),
    ("s", "times", 8, 42, "ref", "area_{K}", "local", "", 8),
    ("s", "sum", 10, 8, "ref", "area_{K}", "local", "", 10),
    ("s", "times", 10, 14, "ref", "area_{K}", "local", "", 8),
    ("s", "seen_{K}", 11, 4, "ref", "area_{K}", "symbol", "", 6),
    ("s", "b", 11, 19, "ref", "area_{K}", "local", "", 8),
    ("s", "wide", 11, 22, "ref", "area_{K}", "member", "", 3),
    ("s", "sum", 12, 4, "ref", "area_{K}", "local", "", 10),
    ("s", "b", 12, 20, "ref", "area_{K}", "local", "", 8),
    ("s", "high", 12, 23, "ref", "area_{K}", "member", "", 3),
    ("s", "LIMIT_{K}", 12, 29, "ref", "area_{K}", "symbol", "", 2),
    ("s", "sum", 13, 11, "ref", "area_{K}", "local", "", 10),
    ("s", "box_{K}", 15, 24, "ref", "twice_{K}", "symbol", "", 3),
    ("s", "b", 15, 36, "ref", "twice_{K}", "local", "", 15),
    ("s", "b", 15, 60, "ref", "twice_{K}", "local", "", 15),
    ("s", "b", 15, 80, "ref", "twice_{K}", "local", "", 15),
    ("h", "x", 1, 17, "ref", None, None, None, None),
    ("h", "y", 1, 24, "ref", None, None, None, None),
    ("n", "x", 1, 17, "ref", "scale_{N}", "local", "", 1),
    ("n", "y", 1, 24, "ref", "scale_{N}", "local", "", 1),
    ("n", "x", 1, 36, "ref", "scale_{N}", "local", "", 1),
    ("n", "y", 1, 40, "ref", "scale_{N}", "local", "", 1),
    ("r", "scale_00", 11, 30, "call", "geo_{R}::Base_{R}::run_{R}", "symbol", "parts/n00.c", 1),
    ("r", "Base_{R}", 6, 22, "ref", None, "symbol", "", 1),
    ("r", "Other", 6, 38, "ref", None, None, None, None),
    ("r", "Base_{R}", 11, 12, "ref", "geo_{R}::Base_{R}::run_{R}", "symbol", "", 1),
    ("r", "run_{R}", 11, 20, "ref", "geo_{R}::Base_{R}::run_{R}", "symbol", "", 11),
    ("r", "size_{R}", 11, 39, "ref", "geo_{R}::Base_{R}::run_{R}", "symbol", "", 4),
]


def _values(rows: list[tuple]) -> str:
    word = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(word, r))})" for r in rows)


def _made(*columns: str) -> str:
    return ", ".join(f"replace(replace(replace({c}, '{{K}}', k), '{{N}}', n), '{{R}}', r) AS {c}" for c in columns)


def _numbered(uses: list[tuple]) -> list[tuple]:
    """Uses with their number in the file after the kind of file."""
    count: dict[str, int] = {}
    out = []
    for f, *rest in uses:
        out.append((f, count.setdefault(f, 0), *rest))
        count[f] += 1
    return out


CODE = f"""WITH made AS (SELECT 'app/s' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.c' AS path, 's' AS f, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS k, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS n, '' AS r FROM supplier
UNION ALL SELECT 'parts/n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || x.tail, x.f, '', lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), '' FROM nation, (VALUES ('.h', 'h'), ('.c', 'n')) x(tail, f)
UNION ALL SELECT 'geo/r' || CAST(r_regionkey AS VARCHAR) || '.cpp', 'r', '', '', CAST(r_regionkey AS VARCHAR) FROM region),
symbols AS (SELECT path, f, {_made("name")}, scope || name AS qualname, kind, line, col, end_line, {_made("signature")} FROM made JOIN (VALUES {_values(SYMBOLS)}) t(f, name, scope, kind, line, col, end_line, signature) USING (f)),
refs AS (SELECT path, f, seq, {_made("name")}, line, col, kind, {_made("inside")}, means, coalesce(nullif({_made("spot").removesuffix(" AS spot")}, ''), path) AS decl_path, decl_line, spot IS NULL AS lost FROM made JOIN (VALUES {_values(_numbered(USES))}) t(f, seq, name, line, col, kind, inside, means, spot, decl_line) USING (f))
"""
CODE = CODE.replace("scope || name AS qualname", "replace(replace(replace(scope || name, '{K}', k), '{N}', n), '{R}', r) AS qualname")
PLACES = ", first AS (SELECT path, name, min(line) AS line FROM symbols GROUP BY ALL), places AS (SELECT r.path, r.line, r.col, r.name, r.means AS res_kind, CASE WHEN r.means = 'local' THEN NULL ELSE coalesce(s.qualname, d.qualname) END AS qualname, CASE WHEN NOT lost THEN decl_path END AS decl_path, decl_line FROM refs r LEFT JOIN symbols s ON s.path = r.path AND s.name = r.name AND s.line = r.decl_line LEFT JOIN symbols d ON d.path = r.decl_path AND d.name = r.name AND d.line = r.decl_line AND d.path <> r.path) "
ONE = "app/s000001.c"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(CODE + "SELECT path, name, qualname, kind, line, col, end_line, signature FROM symbols")
def code_symbols(spark, d):
    return S.code(spark, d).store.symbols.select("path", "name", "qualname", "kind", "line", "col", "end_line", "signature")


@query(CODE + "SELECT path, seq, name, kind, line, col, inside AS from_qualname FROM refs")
def code_refs(spark, d):
    s = S.code(spark, d).store
    return s._with_from(s.refs).select("path", "seq", "name", "kind", "line", "col", "from_qualname")


@query(CODE + "SELECT 'geo_' || r || '::Land_' || r AS qualname, b.base, 'geo_' || r || '::' || b.base AS base_qualname FROM made, (SELECT 'Base_' AS x) x, LATERAL (SELECT x.x || made.r AS base) b WHERE f = 'r' UNION ALL SELECT 'geo_' || r || '::Land_' || r, 'Other', NULL FROM made WHERE f = 'r'")
def code_bases(spark, d):
    s = S.code(spark, d).store
    return s._base_edges(s.bases).join(s.symbols.select(F.col("id").alias("symbol_id"), "qualname"), "symbol_id").select("qualname", "base", "base_qualname")


@query(CODE + "SELECT path, 'parts/n' || n || '.h' AS include, 0 AS line, false AS is_system, 'parts/n' || n || '.h' AS resolved FROM made WHERE f = 's' AND false UNION ALL SELECT path, 'parts/n' || n || '.h', 0, false, NULL FROM made WHERE f = 's' UNION ALL SELECT path, 'stdio.h', 1, true, NULL FROM made WHERE f = 's' UNION ALL SELECT path, 'n' || n || '.h', 0, false, 'parts/n' || n || '.h' FROM made WHERE f = 'n'")
def code_includes(spark, d):
    """'parts/n00.h' is a whole path here, with nothing before it, so it is not found; 'n00.h' is."""
    s = S.code(spark, d).store
    f = s.files.select(F.col("path").alias("own"))
    i = s.resolved_includes(s.includes.join(_ids(s), "file_id"))
    return i.join(f, "own").select(F.col("own").alias("path"), F.col("path").alias("include"), "line", "is_system", "resolved")


def _ids(s: Store):
    """(file_id, own): files of symbols by the id that the parser gives them."""
    return s.symbols.select("file_id", F.col("path").alias("own")).distinct()


@query(CODE + "SELECT x.path, r.name, x.type, x.kind, r.line, r.col FROM refs r JOIN (SELECT path, 'b' AS name, 'box_' || k AS type, 'param' AS kind FROM made WHERE f = 's' UNION ALL SELECT path, 'times', 'int', 'param' FROM made WHERE f = 's' UNION ALL SELECT path, 'sum', 'int', 'local' FROM made WHERE f = 's' UNION ALL SELECT path, t.name, 'int', 'param' FROM made, (VALUES ('x'), ('y')) t(name) WHERE f = 'n') x ON x.path = r.path AND x.name = r.name WHERE r.means = 'local' AND r.line = r.decl_line AND r.seq IN (SELECT min(seq) FROM refs q WHERE q.path = r.path AND q.name = r.name AND q.decl_line = r.decl_line)")
def code_locals(spark, d):
    return S.code(spark, d).local.select("path", "name", "type", "kind", "line", "col")


@query(CODE + PLACES + "SELECT * FROM places")
def code_resolved(spark, d):
    """What each reference means; declared names are left out."""
    c = S.code(spark, d)
    return c.resolved.join(c.store.refs.select("path", "line", "col"), ["path", "line", "col"], "left_semi").select("path", "line", "col", "name", "res_kind", "qualname", "decl_path", "decl_line")


@query(CODE + "SELECT r.name, r.line, r.col, CAST(1 AS BIGINT) AS count, 'function' AS target_kind, r.decl_path AS target_path, 1 AS target_line FROM refs r WHERE path = 'app/s000001.c' AND kind = 'call' AND inside = 'area_000001'")
def code_callees(spark, d):
    s = S.code(spark, d).store
    return s.callees_of(s.find_definitions("area_000001").first().id)


@query(CODE + "SELECT path, line, col, inside AS from_qualname FROM refs WHERE name = 'scale_00' AND kind = 'call'")
def code_callers(spark, d):
    return S.code(spark, d).store.callers_of("scale_00").select("path", "line", "col", "from_qualname")


@query(CODE + "SELECT path, line, col FROM refs WHERE name = 'scale_00' UNION ALL SELECT path, line, col FROM symbols WHERE name = 'scale_00' AND kind = 'function'")
def find_references(spark, d):
    c = S.code(spark, d)
    return R.references(c.store, c.resolved, "scale_00", declarations=True)


@query(CODE + "SELECT path, line, col, path <> 'app/s000001.c' AS hidden FROM refs WHERE name = 'wide'")
def member_references(spark, d):
    """A field of one struct among fields of that name in all others."""
    c = S.code(spark, d)
    return R.classified(c.store, c.resolved, "wide", "box_000001::wide").select("path", "line", "col", "hidden")


@query(CODE + f"SELECT path, line, col FROM refs WHERE path = '{ONE}' AND name = 'b' AND inside = 'area_000001' AND line > 8")
def references_of_local(spark, d):
    c = S.code(spark, d)
    return R.references_at(c.store, c.resolved, ONE, 11, 19)


@query(CODE + f"SELECT path, line, col, 3 AS length, 'total' AS text FROM refs WHERE path = '{ONE}' AND name = 'sum'")
def rename_edits(spark, d):
    return R.rename_edits(S.code(spark, d).resolved, ONE, 12, 4, "total")


@query(CODE + "SELECT path, line, col FROM refs WHERE path = 'parts/n03.c' AND name = 'x'")
def highlights(spark, d):
    return R.highlights(S.code(spark, d).resolved, "parts/n03.c", 1, 36).select("path", "line", "col")


@query(CODE + "SELECT path, line, col, name, CASE WHEN kind = 'call' OR (f = 'r' AND name LIKE 'run%') THEN 'function' WHEN means = 'member' THEN 'property' WHEN means = 'local' AND name = 'sum' THEN 'variable' WHEN means = 'local' THEN 'parameter' WHEN name LIKE 'LIMIT%' THEN 'macro' WHEN name LIKE 'seen%' THEN 'variable' ELSE 'type' END AS token FROM refs WHERE means IS NOT NULL AND name NOT LIKE 'size%'")
def semantic_tokens(spark, d):
    c = S.code(spark, d)
    refs = c.store.refs.select("path", "line", "col")
    return R.semantic_tokens(c.resolved.join(refs, ["path", "line", "col"], "left_semi"), c.store).select("path", "line", "col", "name", "token")


@query(CODE + "SELECT DISTINCT name, 'function' AS source, CAST(NULL AS VARCHAR) AS type FROM symbols WHERE starts_with(name, 'scale') ")
def completion(spark, d):
    c = S.code(spark, d)
    return R.completion(c.store, c.local, ONE, 400, "scale")


@query(CODE + f"SELECT name, kind, qualname, signature FROM symbols WHERE path = '{ONE}' AND kind = 'field'")
def member_completion(spark, d):
    c = S.code(spark, d)
    return R.member_completion(c.store, c.local, ONE, 400, "    seen += b->")


@query(CODE + "SELECT signature, 'function' AS kind, path, line, 'struct box_000001 *b|int times' AS parameters, 1 AS active FROM symbols WHERE name = 'area_000001' AND kind = 'function'")
def signature_help(spark, d):
    return T.signature_help(S.code(spark, d).store, "    x = area_000001(twice_000001(b), ").withColumn("parameters", F.concat_ws("|", "parameters"))


@query(CODE + f"SELECT decl_path AS path, decl_line AS line FROM refs WHERE path = '{ONE}' AND line = 12 AND col = 11")
def go_to_definition(spark, d):
    c = S.code(spark, d)
    return T.definition(c.store, c.resolved, c.texts, ONE, 12, 13)


@query("SELECT 'parts/n07.h' AS path, 0 AS line")
def go_to_include(spark, d):
    c = S.code(spark, d)
    return T.definition(c.store, c.resolved, c.texts, "parts/n07.c", 0, 12)


@query(CODE + "SELECT path, line, col FROM symbols WHERE kind = 'prototype' AND name = 'scale_00'")
def go_to_declaration(spark, d):
    c = S.code(spark, d)
    return T.declaration(c.store, c.resolved, "geo/r2.cpp", 11, 31).select("path", "line", "col")


@query(CODE + f"SELECT name, kind, signature, path, line, 'what it counts' AS comment, CAST(2 AS BIGINT) AS callers FROM symbols WHERE path = '{ONE}' AND name = 'area_000001' AND kind = 'function'")
def hover(spark, d):
    c = S.code(spark, d)
    return T.hover(c.store, c.resolved, c.texts, ONE, 15, 50)


@query(CODE + "SELECT name, qualname, kind, path, line, CAST(5 AS BIGINT) AS hits FROM symbols WHERE kind = 'function' AND starts_with(name, 'area_') ORDER BY path LIMIT 300")
def search_project(spark, d):
    return T.search_project(S.code(spark, d).store, "times, sum")


@query(CODE + "SELECT 'sub' AS side, qualname FROM symbols WHERE name = 'Land_3' UNION ALL SELECT 'super', qualname FROM symbols WHERE name = 'Base_3' UNION ALL SELECT 'item', qualname FROM symbols WHERE name = 'Base_3'")
def type_hierarchy(spark, d):
    c = S.code(spark, d)
    item = T.type_item(c.store, c.resolved, "geo/r3.cpp", 6, 23)
    land = c.store.find_definitions("Land_3").first().id
    up = T.supertypes(c.store, land).select(F.lit("super").alias("side"), F.col("base_qualname").alias("qualname"))
    return T.subtypes(c.store, "geo_3::Base_3").select(F.lit("sub").alias("side"), "qualname").unionByName(up).unionByName(item.select(F.lit("item").alias("side"), "qualname"))


@query(CODE + "SELECT inside AS from_qualname, path AS from_path, string_agg(line || ':' || col, ',' ORDER BY line, col) AS ranges, count(*) AS count FROM refs WHERE kind = 'call' AND name = 'area_000001' GROUP BY ALL")
def call_hierarchy(spark, d):
    c = S.code(spark, d)
    name = T.call_item(c.store, c.resolved, ONE, 8, 6).first().name
    places = F.concat_ws(",", F.transform("ranges", lambda x: F.concat_ws(":", x["line"].cast("string"), x["col"].cast("string"))))
    return c.store.incoming_calls(name).select("from_qualname", "from_path", places.alias("ranges"), "count")


@query(CODE + f"SELECT 'area_000001' AS label, 0 AS depth, 'function' AS kind UNION ALL SELECT 'twice_000001', -1, 'function' UNION ALL SELECT name, 1, 'function' FROM refs WHERE path = '{ONE}' AND line = 12 AND kind = 'call'")
def relations_both(spark, d):
    s = S.code(spark, d).store
    return T.relations(s, str(T.centre(s, "area_000001").first().id), "both", 2).nodes.select("label", "depth", "kind")


@query("SELECT 'area_000001' AS label, -1 AS depth UNION ALL SELECT 'seen_000001', 0")
def callers_of_variable(spark, d):
    """What cannot be called has the functions that refer to it as callers."""
    s = S.code(spark, d).store
    return T.relations(s, str(T.centre(s, "seen_000001").first().id), "callers").nodes.select("label", "depth")


@query("SELECT 'area_000001' AS name")
def centre_of_place(spark, d):
    """Nothing has the name, so the function around the place is the centre."""
    return T.centre(S.code(spark, d).store, "nothing", path=ONE, line=12).select("name")


@query(CODE + "SELECT 'file:' || path AS id, CASE WHEN path = 'parts/n05.c' THEN 0 ELSE 1 END AS depth, 'file' AS kind FROM made WHERE path IN ('parts/n05.c', 'parts/n05.h')")
def code_include_graph(spark, d):
    s = S.code(spark, d).store
    own = Store(s.files.join(_ids(s).withColumnRenamed("own", "path"), "path").drop("id").withColumnRenamed("file_id", "id"), s.symbols, s.refs, s.bases, s.includes)
    return T.relations(own, "file:parts/n05.c", "include_both", 2).nodes.select("id", "depth", "kind")


@query(CODE + "SELECT qualname, line FROM symbols WHERE path = 'geo/r1.cpp' AND name = 'Base_1' UNION ALL SELECT qualname, line FROM symbols WHERE path = 'geo/r1.cpp' AND name = 'Land_1' UNION ALL SELECT NULL, NULL")
def code_class_graph(spark, d):
    s = S.code(spark, d).store
    g = T.relations(s, str(s.find_definitions("Land_1").first().id), "classes", 2)
    return g.nodes.join(s.symbols.select(F.col("id").cast("string").alias("id"), "qualname", "line"), "id", "left").select("qualname", "line")


@query(CODE + f"SELECT path, line, col, kind, inside AS from_qualname, coalesce(means IN ('local', 'member'), false) AS hidden FROM refs WHERE name = 'size_2'")
def context_uses(spark, d):
    c = S.code(spark, d)
    return T.context(c.store, c.resolved, c.texts, "geo/r2.cpp", 11, 39).uses


@query(CODE + f"SELECT name, qualname, kind FROM symbols WHERE path = '{ONE}' AND kind = 'field'")
def context_members(spark, d):
    c = S.code(spark, d)
    return T.context(c.store, c.resolved, c.texts, ONE, 5, 24).members.select("name", "qualname", "kind")


@query(CODE + f"SELECT name, kind FROM symbols WHERE path = '{ONE}' AND kind IN ('struct')")
def context_type(spark, d):
    """The type of a parameter."""
    c = S.code(spark, d)
    return T.context(c.store, c.resolved, c.texts, ONE, 11, 19).type.select("name", "kind")


TOKENS = [("#include", "preprocessor", 0, 0), ('"n{N}.h"', "string", 0, 9), ("int", "type", 1, 0), ("scale_{N}", "function", 1, 4), ("(", "operator", 1, 12), ("int", "type", 1, 13), ("x", "identifier", 1, 17), (",", "operator", 1, 18), ("int", "type", 1, 20), ("y", "identifier", 1, 24), (")", "operator", 1, 25), ("{", "operator", 1, 27), ("return", "keyword", 1, 29), ("x", "identifier", 1, 36), ("*", "operator", 1, 38), ("y", "identifier", 1, 40), (";", "operator", 1, 41), ("}", "operator", 1, 43)]


@query(CODE + f"SELECT path, line, start, start + length(t) AS stop, cls FROM (SELECT path, line, start, replace(t, '{{N}}', n) AS t, cls FROM made, (VALUES {_values(TOKENS)}) x(t, cls, line, start) WHERE f = 'n')")
def tokens_of_lines(spark, d):
    """The line lexer as a table function over files."""
    from lattica.functions.lines import Tokens

    spark.udtf.register("lattica_tokens", Tokens)
    S.code(spark, d).texts.where("path like 'parts/%.c'").createOrReplaceTempView("lattica_texts")
    return spark.sql("SELECT f.path, t.line, t.start, t.stop, t.cls FROM lattica_texts f, LATERAL lattica_tokens(f.text) t")


@query(CODE + "SELECT path, CASE f WHEN 'r' THEN 'cpp' WHEN 'h' THEN 'cpp' ELSE 'c' END AS lang, CASE WHEN f IN ('h', 'n') THEN regexp_replace(path, '^parts/', '') ELSE path END AS below FROM made")
def path_languages(spark, d):
    """Languages of files, and their paths without a folder in front."""
    from lattica.functions import exprs as X

    p = F.col("path")
    inside = F.when(X.dir_of(p, "Parts") == "/", X.base_name(p)).otherwise(X.short_file(p))
    return S.code(spark, d).store.files.select("path", X.lang_for_path(p).alias("lang"), inside.alias("below"))
