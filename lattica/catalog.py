"""Registered queries of the engine's own operators and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.operators import graph as G
from lattica.operators import store as S
from lattica.plans import tasks as T
from lattica.sources import projects as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANK = "CASE WHEN kind IN ('function','method') THEN 0 WHEN kind IN ('macro','struct','class','typedef','enum','union') THEN 1 WHEN kind IN ('variable','enumerator') THEN 2 WHEN kind = 'field' THEN 3 WHEN kind = 'prototype' THEN 4 ELSE 5 END"
TEXT = """WITH raw AS (SELECT doc_id, lang, source, lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, string_split_regex(text, '\\r?\\n') AS ls, n_chars FROM documents),
lines AS (SELECT doc_id, path, source, unnest(ls) AS txt, CAST(unnest(range(len(ls))) AS INTEGER) AS line FROM raw),
named AS (SELECT *, regexp_extract_all(txt, '[A-Za-z_][A-Za-z0-9_]*') AS names FROM lines),
files AS (SELECT doc_id AS id, path, CAST(0 AS BIGINT) AS mtime, n_chars AS size, lang FROM raw),
symbols AS (SELECT doc_id * 1000000 + line AS id, doc_id AS file_id, path, names[1] AS name, source || '::' || names[1] AS qualname,
  (['function','prototype','macro','struct','variable','field'])[line % 6 + 1] AS kind, line, 0 AS col, CAST(line + length(txt) % 4 AS INTEGER) AS end_line FROM named WHERE len(names) > 0),
refs AS (SELECT file_id, path, line, from_symbol, name, col, CASE WHEN col = 0 THEN 'call' ELSE 'ref' END AS kind FROM
  (SELECT doc_id AS file_id, path, line, doc_id * 1000000 + line AS from_symbol, unnest(names) AS name, CAST(unnest(range(len(names))) AS INTEGER) AS col FROM named WHERE len(names) > 0)),
ranked AS (SELECT *, RANK AS rk FROM symbols),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN kind = 'prototype' THEN 1 ELSE 0 END, rk, end_line - line DESC, path, line, col, id) AS r FROM ranked) WHERE r = 1),
called AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN kind = 'prototype' THEN 1 ELSE 0 END, CASE WHEN kind IN ('function', 'method', 'macro') THEN 0 ELSE 1 END, rk, end_line - line DESC, path, line, col, id) AS r FROM ranked) WHERE r = 1)
""".replace("RANK", RANK)
STAR = """WITH edges AS (SELECT 'c:' || CAST(o_custkey AS VARCHAR) AS src, 'p:' || CAST(l_partkey AS VARCHAR) AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT 'p:' || CAST(l_partkey AS VARCHAR), 's:' || CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem GROUP BY ALL),
dirs AS (SELECT n_nationkey, r_name || '/' || n_name AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS id, c_name AS label, 'function' AS kind, dir FROM customer JOIN dirs ON c_nationkey = n_nationkey
UNION ALL SELECT 'p:' || CAST(p_partkey AS VARCHAR), p_name, 'function', p_brand FROM part
UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR), s_name, 'macro', dir FROM supplier JOIN dirs ON s_nationkey = n_nationkey)
"""
CLASSES = """WITH sy AS (SELECT 'r:' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, r_name AS qualname, 'world' AS path FROM region
UNION ALL SELECT 'n:' || CAST(n_nationkey AS VARCHAR), n_name, r_name || '::' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), c_name, r_name || '::' || n_name || '::' || c_name, r_name || '/' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ba AS (SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS symbol_id, r_name AS base FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'r:' || CAST(r_regionkey AS VARCHAR), 'World' FROM region)
"""
FILE, NAME, FREQUENT = "en/src1/1.txt", "The", "the"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*columns.split())


SYMBOL = "path name qualname kind line col end_line"
SYMBOL_SQL = "path, name, qualname, kind, line, col, end_line"


@query(TEXT + f"SELECT path, count(*) AS total, CAST(sum(CASE WHEN kind = 'call' THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM refs WHERE name = '{FREQUENT}' GROUP BY path")
def reference_files(spark, d):
    return P.text_store(spark, d).reference_files(FREQUENT)


@query(TEXT + "SELECT kind, count(*) AS count FROM symbols GROUP BY kind")
def kind_counts(spark, d):
    return P.text_store(spark, d).kind_counts()


@query(TEXT + "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS refs")
def stats(spark, d):
    return P.text_store(spark, d).stats()


@query(TEXT + "SELECT id, path, mtime, size, lang FROM files")
def all_files(spark, d):
    return P.text_store(spark, d).all_files()


@query(TEXT + f"SELECT id, path, mtime, size, lang FROM files WHERE path = '{FILE}'")
def get_file(spark, d):
    return P.text_store(spark, d).get_file(FILE)


@query(TEXT + "SELECT path, line, txt FROM lines")
def source_lines(spark, d):
    return pick(P.text_lines(spark, d), "path line txt")


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM symbols WHERE name = '{NAME}'")
def find_symbols(spark, d):
    return pick(P.text_store(spark, d).find_symbols(NAME), SYMBOL)


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM symbols WHERE name = '{NAME}' AND (kind <> 'prototype' OR NOT EXISTS (SELECT 1 FROM symbols WHERE name = '{NAME}' AND kind <> 'prototype'))")
def find_definitions(spark, d):
    return pick(P.text_store(spark, d).find_definitions(NAME), SYMBOL)


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM best")
def best_definitions(spark, d):
    return pick(P.text_store(spark, d).best_definitions(), SYMBOL)


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM ranked WHERE instr(lower(name), 'tion') > 0 ORDER BY instr(lower(name), 'tion'), length(name), rk, name, path, line, col LIMIT 200")
def search_symbols(spark, d):
    return pick(P.text_store(spark, d).search_symbols(" TION "), SYMBOL)


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rk, end_line - line DESC, path, line, col, id) AS r FROM ranked WHERE starts_with(name, 'Th')) WHERE r = 1 ORDER BY rk, name LIMIT 50")
def symbols_with_prefix(spark, d):
    return pick(P.text_store(spark, d).symbols_with_prefix("Th", 50), SYMBOL)


@query(TEXT + "SELECT DISTINCT name FROM symbols WHERE kind IN ('macro', 'struct')")
def names_of_kind(spark, d):
    return P.text_store(spark, d).names_of_kind("macro", "struct")


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM symbols WHERE kind = 'macro' ORDER BY name, path, line, col LIMIT 5000")
def symbols_by_kind(spark, d):
    return pick(P.text_store(spark, d).symbols_by_kind("macro"), SYMBOL)


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM symbols WHERE path = '{FILE}'")
def file_symbols(spark, d):
    return pick(P.text_store(spark, d).file_symbols(FILE), SYMBOL)


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM symbols WHERE path = '{FILE}' AND kind = 'function' AND 0 BETWEEN line AND end_line ORDER BY line DESC, col DESC LIMIT 1")
def enclosing_function(spark, d):
    return pick(P.text_store(spark, d).enclosing_function(FILE, 0), SYMBOL)


@query(TEXT + "SELECT path, spot, name, line FROM (SELECT p.path, p.spot, s.name, s.line, row_number() OVER (PARTITION BY p.path, p.spot ORDER BY s.line DESC, s.col DESC) AS r FROM (SELECT path, line AS spot FROM lines) p JOIN symbols s ON p.path = s.path AND s.kind = 'function' AND p.spot BETWEEN s.line AND s.end_line) WHERE r = 1")
def enclosing_functions(spark, d):
    places = P.text_lines(spark, d).select("path", F.col("line").alias("spot"))
    return pick(P.text_store(spark, d).enclosing_functions(places), "path spot name line")


@query(TEXT + "SELECT path, name, qualname, kind, line FROM symbols WHERE starts_with(qualname, 'src1::') AND instr(substr(qualname, 7), '::') = 0 AND kind IN ('field', 'method', 'prototype')")
def members_of(spark, d):
    return pick(P.text_store(spark, d).members_of("src1"), "path name qualname kind line")


REF_SQL = "r.path, r.line, r.col, r.kind, s.name AS from_name, s.qualname AS from_qualname, s.kind AS from_kind"
REF = "path line col kind from_name from_qualname from_kind"


@query(TEXT + f"SELECT {REF_SQL} FROM refs r LEFT JOIN symbols s ON r.from_symbol = s.id WHERE r.name = '{NAME}' AND r.kind = 'call'")
def callers_of(spark, d):
    return pick(P.text_store(spark, d).callers_of(NAME), REF)


@query(TEXT + f"SELECT count(*) AS count FROM refs WHERE name = '{NAME}' AND kind = 'call'")
def caller_count(spark, d):
    return P.text_store(spark, d).caller_count(NAME)


@query(TEXT + f"SELECT {REF_SQL} FROM refs r LEFT JOIN symbols s ON r.from_symbol = s.id WHERE r.name = '{FREQUENT}' ORDER BY r.path, r.line, r.col LIMIT 200000")
def references_of(spark, d):
    return pick(P.text_store(spark, d).references_of(FREQUENT), REF)


@query(TEXT + "SELECT c.name, c.line, c.col, c.count, b.kind AS target_kind, b.path AS target_path, b.line AS target_line FROM (SELECT name, min(line) AS line, min(col) AS col, count(*) AS count FROM refs WHERE from_symbol = 1000000 AND kind = 'call' GROUP BY name) c LEFT JOIN called b ON c.name = b.name")
def callees_of(spark, d):
    return P.text_store(spark, d).callees_of(1_000_000)


@query(TEXT + f"SELECT r.line, r.col, r.kind, s.qualname AS from_qualname FROM refs r LEFT JOIN symbols s ON r.from_symbol = s.id WHERE r.name = '{FREQUENT}' AND r.path = '{FILE}' ORDER BY r.line, r.col LIMIT 500")
def references_in_file(spark, d):
    return P.text_store(spark, d).references_in_file(FREQUENT, FILE)


@query(TEXT + "SELECT s.name, s.qualname, s.kind, s.path, s.line, h.hits FROM (SELECT from_symbol, count(DISTINCT name) AS n, count(*) AS hits FROM refs WHERE name IN ('the', 'of', 'and') GROUP BY from_symbol) h JOIN symbols s ON s.id = h.from_symbol WHERE h.n = 3 ORDER BY h.hits DESC, s.path, s.line LIMIT 200")
def functions_using_all(spark, d):
    return P.text_store(spark, d).functions_using_all(["the", "of", "and"])


@query(TEXT + f"SELECT s.qualname AS from_qualname, s.path AS from_path, s.line AS from_line, count(*) AS count FROM refs r JOIN symbols s ON r.from_symbol = s.id WHERE r.name = '{NAME}' AND r.kind = 'call' GROUP BY ALL")
def incoming_calls(spark, d):
    return pick(P.text_store(spark, d).incoming_calls(NAME), "from_qualname from_path from_line count")


@query(TEXT + "SELECT c.name, c.line, c.count, b.path AS target_path FROM (SELECT name, min(line) AS line, count(*) AS count FROM refs WHERE from_symbol = 1000000 AND kind = 'call' GROUP BY name) c JOIN called b ON c.name = b.name")
def outgoing_calls(spark, d):
    return pick(P.text_store(spark, d).outgoing_calls(1_000_000), "name line count target_path")


@query(TEXT + f"SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(DISTINCT from_symbol) AS size, count(*) AS count, sum(count(DISTINCT from_symbol)) OVER () > 24 AS folded FROM refs WHERE name = '{NAME}' AND kind = 'call' GROUP BY 1")
def callers_grouped_by_dir(spark, d):
    return P.text_store(spark, d).callers_grouped(NAME)


@query(TEXT + f"SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS refs, CAST(sum(calls) AS BIGINT) AS calls, CAST(coalesce(sum(CASE WHEN r > 60 THEN total END), 0) AS BIGINT) AS hidden FROM (SELECT path, count(*) AS total, sum(CASE WHEN kind = 'call' THEN 1 ELSE 0 END) AS calls, row_number() OVER (ORDER BY count(*) DESC, path) AS r FROM refs WHERE name = '{FREQUENT}' GROUP BY path)")
def uses_summary(spark, d):
    return P.text_store(spark, d).uses_summary(FREQUENT)


@query(TEXT + f"SELECT * FROM (SELECT path, count(*) AS total, CAST(sum(CASE WHEN kind = 'call' THEN 1 ELSE 0 END) AS BIGINT) AS calls, CAST(CASE WHEN split_part(path, '/', 1) <> 'en' THEN 4 WHEN split_part(path, '/', 2) <> 'src1' THEN 2 ELSE 0 END AS INTEGER) AS distance FROM refs WHERE name = '{FREQUENT}' GROUP BY path) ORDER BY distance, total DESC, path LIMIT 60")
def closeness_order(spark, d):
    return P.text_store(spark, d).closest_files(FREQUENT, FILE)


@query(TEXT + "SELECT m.name, coalesce(u.refs, 0) AS refs, coalesce(u.files, 0) AS files, coalesce(u.top_files, '') AS top_files FROM (SELECT DISTINCT name FROM symbols WHERE starts_with(qualname, 'src1::') AND instr(substr(qualname, 7), '::') = 0 AND kind IN ('field', 'method', 'prototype')) m LEFT JOIN (SELECT name, CAST(sum(total) AS BIGINT) AS refs, count(*) AS files, string_agg(CASE WHEN r <= 3 THEN split_part(path, '/', 3) END, ',' ORDER BY r) AS top_files FROM (SELECT name, path, count(*) AS total, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, path) AS r FROM refs GROUP BY name, path) GROUP BY name) u ON m.name = u.name")
def member_usage(spark, d):
    return P.text_store(spark, d).member_usage("src1")


@query(TEXT + f", s AS (SELECT * FROM symbols WHERE path = '{FILE}') SELECT name, kind, line, end_line, parent, parent_line FROM (SELECT a.name, a.kind, a.line, a.end_line, p.name AS parent, p.line AS parent_line, row_number() OVER (PARTITION BY a.id ORDER BY p.line DESC, p.end_line, p.col DESC) AS r FROM s a LEFT JOIN s p ON p.kind IN ('struct', 'function') AND p.line <= a.line AND p.end_line >= a.end_line AND (p.line < a.line OR p.end_line > a.end_line)) WHERE r = 1")
def outline_nesting(spark, d):
    return P.text_store(spark, d).outline(FILE)


@query(TEXT + "SELECT path, line, txt FROM lines WHERE path = 'en/src1/1.txt' AND line BETWEEN 0 AND 6")
def preview_lines(spark, d):
    return T.preview(P.text_files(spark, d), FILE, 0)


@query(TEXT + "SELECT kind, count, name, line, path FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, path, line) AS r, count(*) OVER (PARTITION BY kind) AS count FROM symbols) WHERE r <= 2001")
def symbol_tree(spark, d):
    return T.symbol_tree(P.text_store(spark, d))


# files and events
@query(TEXT + "SELECT id, path FROM files WHERE id % 7 = 0")
def removed_files(spark, d):
    f = P.text_store(spark, d).files
    return pick(S.removed_files(f, f.where("id % 7 <> 0")), "id path")


@query(TEXT + "SELECT path, size + id % 2 AS size FROM files WHERE id % 2 = 1 OR id % 5 = 0")
def changed_files(spark, d):
    f = P.text_store(spark, d).files
    return pick(S.changed_files(f.where("id % 5 <> 0"), f.withColumn("size", F.col("size") + F.col("id") % 2)), "path size")


@query(TEXT + "SELECT path FROM files WHERE NOT (lower(path) = 'en/src1' OR starts_with(lower(path), 'en/src1/') OR starts_with(lower(path), 'de/'))")
def excluded_paths(spark, d):
    return pick(S.not_excluded(P.text_store(spark, d).files, ["EN\\src1", "de/"]), "path")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_events(spark, d):
    return pick(S.latest_events(P.read(spark, d, "events"), "user_id", ["ts", "event_id"]), "user_id event_id event_type")


# includes
@query("SELECT file_id, regexp_replace(raw, '^(\\.\\.?/)+', '') AS include, false AS is_system FROM (SELECT page_id AS file_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS raw FROM pages)")
def normalize_include(spark, d):
    return P.web_includes(spark, d).select("file_id", X.normalize_include(F.col("raw")).alias("include"), X.is_system_include(F.col("raw")).alias("is_system"))




@query(TEXT + ", includes AS (SELECT doc_id AS file_id, source || '/' || CAST(doc_id + 20 AS VARCHAR) || '.txt' AS inc FROM documents), resolved AS (SELECT i.file_id, i.inc, f.path AS resolved FROM includes i LEFT JOIN files f ON split_part(f.path, '/', 2) || '/' || split_part(f.path, '/', 3) = i.inc) SELECT file_id, inc AS path, resolved FROM resolved")
def resolve_include(spark, d):
    s = P.text_store(spark, d)
    return pick(s.resolved_includes(), "file_id path resolved")


@query(TEXT + "SELECT f.path, 0 AS line FROM files f WHERE split_part(f.path, '/', 2) || '/' || CAST(f.id + 20 AS VARCHAR) || '.txt' = 'src1/41.txt'")
def included_by(spark, d):
    return P.text_store(spark, d).included_by("en/src1/41.txt")


# class hierarchy
@query(CLASSES + "SELECT b.base, s.qualname AS base_qualname FROM ba b LEFT JOIN sy s ON s.name = b.base WHERE b.symbol_id = 'n:3'")
def bases_of(spark, d):
    return pick(P.star_bases(spark, d).bases_of("n:3"), "base base_qualname")


@query(CLASSES + "SELECT s.id, s.name, s.qualname FROM sy s JOIN ba b ON s.id = b.symbol_id WHERE b.base = 'NATION_3'")
def derived_of(spark, d):
    return pick(P.star_bases(spark, d).derived_of("NATION_3"), "id name qualname")


@query(CLASSES + ", e AS (SELECT symbol_id AS src, coalesce(s.id, 'ext:' || base) AS dst FROM ba LEFT JOIN sy s ON s.name = base) SELECT src AS source, dst AS target, CAST(1 AS BIGINT) AS count FROM e WHERE src = 'n:3' OR src IN (SELECT dst FROM e WHERE src = 'n:3')")
def class_graph(spark, d):
    e, n = G.class_edges(P.star_bases(spark, d))
    return G.build(e, n, "n:3", "callees", 2, 100_000, ("class",)).edges


# call graph
TWO = STAR + ", l1 AS (SELECT src, dst, n FROM edges WHERE src = 'c:1'), l2 AS (SELECT e.src, e.dst, e.n FROM edges e WHERE e.src IN (SELECT dst FROM l1)), seen AS (SELECT 'c:1' AS id, 0 AS depth UNION ALL SELECT DISTINCT dst, 1 FROM l1 UNION ALL SELECT DISTINCT dst, 2 FROM l2) "


@query(TWO + "SELECT s.id, s.depth, n.label, n.kind, n.dir, false AS external FROM seen s JOIN nodes n ON s.id = n.id")
def call_graph_nodes(spark, d):
    return G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "c:1", "callees", 2, 1_000_000).nodes


@query(TWO + "SELECT src AS source, dst AS target, n AS count FROM l1 UNION ALL SELECT src, dst, n FROM l2")
def call_graph_edges(spark, d):
    return G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "c:1", "callees", 2, 1_000_000).edges


@query(STAR + "SELECT id, depth FROM (SELECT 's:1' AS id, 0 AS depth UNION ALL SELECT DISTINCT src, -1 FROM edges WHERE dst = 's:1')")
def call_graph_callers(spark, d):
    return pick(G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "s:1", "callers", 1, 1_000_000).nodes, "id depth")


@query(STAR + ", l AS (SELECT dst, min(line) AS line FROM (SELECT 'p:' || CAST(l_partkey AS VARCHAR) AS dst, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 1) GROUP BY dst ORDER BY line, dst LIMIT 9) SELECT dst AS id, 1 AS depth FROM l UNION ALL SELECT 'c:1', 0")
def call_graph_capped(spark, d):
    return pick(G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "c:1", "callees", 1, 10).nodes, "id depth")


@query(STAR + "SELECT 'callees' AS side, n.dir AS dir, count(*) AS size, CAST(sum(e.n) AS BIGINT) AS count, sum(count(*)) OVER () > 3 AS grouped FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.src = 'c:1' GROUP BY n.dir")
def call_graph_folders(spark, d):
    return G.folded(G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "c:1", "callees", 1, 1_000_000), "c:1", "", 3)


@query(STAR + "SELECT 'c:1' AS id, false AS callees, false AS callers, false AS folder UNION ALL SELECT DISTINCT dst, EXISTS (SELECT 1 FROM edges e WHERE e.src = x.dst), false, false FROM edges x WHERE src = 'c:1'")
def call_graph_expandable(spark, d):
    e = P.star_edges(spark, d)
    return G.expandable(G.build(e, P.star_nodes(spark, d), "c:1", "callees", 1, 1_000_000), e)


@query(STAR + "SELECT 's:1' AS id, false AS callees, false AS callers, false AS folder UNION ALL SELECT DISTINCT src, false, EXISTS (SELECT 1 FROM edges e WHERE e.dst = x.src), false FROM edges x WHERE dst = 's:1'")
def call_graph_expandable_callers(spark, d):
    e = P.star_edges(spark, d)
    return G.expandable(G.build(e, P.star_nodes(spark, d), "s:1", "callers", 1, 1_000_000), e)


GROUPED = STAR + ", m AS (SELECT dst, n, CASE WHEN dir = 'Brand#13' THEN dst ELSE 'grp:callees:c:1:' || dir END AS id, dir FROM edges JOIN nodes ON nodes.id = dst WHERE src = 'c:1') "
FOLDERS = G.Folders(3, ("grp:callees:c:1:Brand#13",))


@query(GROUPED + "SELECT id, count(*) AS parts, 1 AS depth, CASE WHEN id = any_value(dst) THEN 'function' ELSE 'group' END AS kind, CASE WHEN id = any_value(dst) THEN NULL ELSE any_value(dir) || '/ (' || count(*) || ')' END AS folder FROM m GROUP BY id UNION ALL SELECT 'c:1', 1, 0, 'function', NULL")
def call_graph_grouped(spark, d):
    """Folders in place of the centre's callees, one of them opened."""
    n = G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "c:1", "callees", 1, 1_000_000, folders=FOLDERS).nodes
    parts = F.when(F.col("kind") == "group", F.regexp_extract("label", r"\((\d+)\)$", 1).cast("long")).otherwise(1)
    return n.select("id", parts.alias("parts"), "depth", "kind", F.when(F.col("kind") == "group", F.col("label")).alias("folder"))


@query(GROUPED + "SELECT 'c:1' AS source, id AS target, CAST(sum(n) AS BIGINT) AS count FROM m GROUP BY id")
def call_graph_grouped_edges(spark, d):
    return G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "c:1", "callees", 1, 1_000_000, folders=FOLDERS).edges


TRADE = """WITH sold AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM sold),
e AS (SELECT 'n:' || a AS src, 'n:' || b AS dst, n FROM top WHERE r <= 3 OR a = b),
l1 AS (SELECT * FROM e WHERE src = 'n:3'), d1 AS (SELECT DISTINCT dst AS id FROM l1 WHERE dst <> 'n:3'),
l2 AS (SELECT * FROM e WHERE src IN (SELECT id FROM d1)), d2 AS (SELECT DISTINCT dst AS id FROM l2 WHERE dst <> 'n:3' AND dst NOT IN (SELECT id FROM d1)),
k1 AS (SELECT src, dst, CASE WHEN src = dst THEN 1 ELSE n END AS n FROM e WHERE dst = 'n:3'), u1 AS (SELECT DISTINCT src AS id FROM k1 WHERE src <> 'n:3'),
k2 AS (SELECT src, dst, CASE WHEN src = dst THEN 1 ELSE n END AS n FROM e WHERE dst IN (SELECT id FROM u1)), u2 AS (SELECT DISTINCT src AS id FROM k2 WHERE src <> 'n:3' AND src NOT IN (SELECT id FROM u1)),
seen AS (SELECT id, min_by(depth, o) AS depth FROM (SELECT 'n:3' AS id, 0 AS depth, 0 AS o UNION ALL SELECT id, 1, 1 FROM d1 UNION ALL SELECT id, 2, 2 FROM d2 UNION ALL SELECT id, -1, 3 FROM u1 UNION ALL SELECT id, -2, 4 FROM u2) GROUP BY id)
"""


@query(TRADE + "SELECT src AS source, dst AS target, CAST(sum(n) AS BIGINT) AS count FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY src, dst")
def call_graph_both(spark, d):
    """Both sides in a graph with cycles and calls of oneself: what is found from both sides adds up."""
    return G.build(P.trade_edges(spark, d), P.trade_nodes(spark, d), "n:3", "both", 2).edges


@query(TRADE + "SELECT id, depth FROM seen")
def call_graph_both_nodes(spark, d):
    return pick(G.build(P.trade_edges(spark, d), P.trade_nodes(spark, d), "n:3", "both", 2).nodes, "id depth")


@query(CLASSES + "SELECT 'r:0' AS id, 0 AS depth UNION ALL SELECT 'n:' || CAST(n_nationkey AS VARCHAR), -1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), -2 FROM customer WHERE c_nationkey = 0")
def call_graph_expanded(spark, d):
    """One node of the last level opened: its callers stand a level below it."""
    e, n = G.class_edges(P.star_bases(spark, d))
    return pick(G.expand(G.build(e, n, "r:0", "callers", 1, 1_000_000, ("class",)), e, n, {"n:0": "callers", "c:none": "callers"}, 1_000_000).nodes, "id depth")


@query(TWO + "SELECT 'c:1' AS node, 0 AS level, 'c:1' AS path UNION ALL SELECT dst, 1, 'c:1>' || dst FROM l1 UNION ALL SELECT l2.dst, 2, 'c:1>' || l2.src || '>' || l2.dst FROM l2")
def graph_outline(spark, d):
    g = G.build(P.star_edges(spark, d), P.star_nodes(spark, d), "c:1", "callees", 2, 1_000_000)
    return G.outline(g, "c:1", 2).select("node", "level", F.concat_ws(">", "path").alias("path"))


@query(TEXT + ", inc AS (SELECT doc_id AS file_id, source || '/' || CAST(doc_id + 20 AS VARCHAR) || '.txt' AS inc FROM documents), e AS (SELECT 'file:' || o.path AS source, coalesce('file:' || f.path, 'ext:' || i.inc) AS target FROM inc i JOIN files o ON o.id = i.file_id LEFT JOIN files f ON split_part(f.path, '/', 2) || '/' || split_part(f.path, '/', 3) = i.inc) SELECT source, target, CAST(1 AS BIGINT) AS count FROM e WHERE source = 'file:en/src1/1.txt' OR source IN (SELECT target FROM e WHERE source = 'file:en/src1/1.txt')")
def include_graph(spark, d):
    e, n = G.include_edges(P.text_store(spark, d))
    return G.build(e, n, "file:en/src1/1.txt", "callees", 2, 1_000_000, ("file",)).edges


# limits that end in the middle
@query(TEXT + f"SELECT {REF_SQL} FROM refs r LEFT JOIN symbols s ON r.from_symbol = s.id WHERE r.name = '{FREQUENT}' ORDER BY r.path, r.line, r.col LIMIT 1000")
def references_limited(spark, d):
    return pick(P.text_store(spark, d).references_of(FREQUENT, 1000), REF)


@query(TEXT + f"SELECT r.line, r.col, r.kind, s.qualname AS from_qualname FROM refs r LEFT JOIN symbols s ON r.from_symbol = s.id WHERE r.name = '{FREQUENT}' AND r.path = '{FILE}' ORDER BY r.line, r.col LIMIT 3")
def references_in_file_limited(spark, d):
    return P.text_store(spark, d).references_in_file(FREQUENT, FILE, 3)


@query(TEXT + f"SELECT {SYMBOL_SQL} FROM symbols WHERE kind = 'macro' ORDER BY name, path, line, col LIMIT 50")
def symbols_by_kind_limited(spark, d):
    return pick(P.text_store(spark, d).symbols_by_kind("macro", 50), SYMBOL)


# expressions
@query("SELECT p_partkey, 'ns::' || replace(p_brand, '#', '_') AS type_name, replace(p_brand, '#', '_') AS declared FROM part")
def type_names(spark, d):
    """Types with template arguments, qualifiers, pointers and arrays, and the type in front of a declared name."""
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    text = F.concat(F.lit("static const ns::"), brand, F.lit("<a, b<c>> *const &[4]"))
    return P.read(spark, d, "part").select("p_partkey", X.base_type_name(text).alias("type_name"), X.type_from_declaration(F.concat(F.lit("extern struct "), brand, F.lit(" *kept[8], *other = 0")), "kept").alias("declared"))


@query(TEXT + ", c AS (SELECT id, trim(regexp_replace(regexp_extract(text, '^[^\\r\\n]*'), '\\s+', ' ', 'g')) AS s FROM files JOIN documents ON doc_id = id) SELECT id, CASE WHEN length(s) > 200 THEN substr(s, 1, 199) || '…' ELSE s END AS first FROM c")
def first_lines(spark, d):
    return P.read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.first_line(F.col("text")).alias("first"))


@query("SELECT p_partkey, p_type AS declaration, regexp_extract(p_type, '([A-Za-z_][A-Za-z0-9_]*)\\s*$', 1) AS type_name FROM part")
def base_type_name(spark, d):
    return P.read(spark, d, "part").select("p_partkey", F.col("p_type").alias("declaration"), X.base_type_name(F.concat(F.lit("const "), "p_type", F.lit(" *&"))).alias("type_name"))


@query(TEXT + "SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', 3) AS base, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS short, CAST(NULL AS VARCHAR) AS lang FROM files")
def path_parts(spark, d):
    p = F.col("path")
    return P.text_store(spark, d).files.select("path", X.dir_of(p).alias("dir"), X.base_name(p).alias("base"), X.short_file(p).alias("short"), X.lang_for_path(p).alias("lang"))


@query(TEXT + ", c AS (SELECT path, line, trim(regexp_replace(txt, '\\s+', ' ', 'g')) AS s FROM lines) SELECT path, line, CASE WHEN length(s) > 240 THEN substr(s, 1, 239) || '…' ELSE s END AS signature FROM c")
def collapsed_signature(spark, d):
    return P.text_lines(spark, d).select("path", "line", X.collapse(F.col("txt")).alias("signature"))


from lattica import catalog_code  # noqa: E402

QUERIES |= catalog_code.QUERIES
ORACLES |= catalog_code.ORACLES
