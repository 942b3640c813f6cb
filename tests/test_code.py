"""The C and C++ reader, projects in a folder, and queries over parsed trees."""

import pytest

from lattica.functions.lines import comment_above, enclosing_call, snippet, split_params, styled_ranges, tokenize_line
from lattica.operators import graph as G
from lattica.plans import tasks as T
from lattica.sources.code import Project, Settings, glob_pattern
from lattica.sources.cparse import blank_macros, index_text

PUMP = """// water for the beds
#include <math.h>
#include "parts/valve.h"

enum mode { OFF = 1, DRIP, FLOOD };
typedef double litres;
typedef struct tank { litres level, most; struct valve *out; } tank_s;
typedef union { long whole; char bytes[8]; } word_u;

#define HALF(v) ((v) / 2)
extern int open_valve(struct valve *v, enum mode m);
litres (*on_low)(litres);
const char *(*names_of(int kind))[4];
static litres poured;

static litres refill(tank_s *t) {
    litres was = t->level;
    t->level = HALF(t->most);
    poured += t->level - was;
    return poured;
}

int water(tank_s *t, enum mode m)
{
    if (t->level < 1.0)
        refill(t);
    if (open_valve(t->out, m) && open_valve(t->out, OFF))
        poured -= floor(t->level);
    return water_more(t);
}
"""
VALVE = "#ifndef VALVE_H\nstruct valve { int turns; };\nint open_valve(struct valve *v, enum mode m);\n#endif\n"
BEDS = """#include "./../parts/valve.h"
namespace garden {
struct Plot { virtual ~Plot(); int width; };
class Bed : protected Plot, public Shade<Plot>, virtual public base::Marked {
  int rows;
public:
  explicit Bed(int n) : rows(n) {}
  int plant(const char *what);
  bool empty() const { return !rows && dry(width); }
};
template <class K> K widest(K a, K b) { return a < b ? b : a; }
}
int garden::Bed::plant(const char *what) { open_valve(0, DRIP); return widest<int>(rows, 2); }
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, text in (("pump.c", PUMP), ("parts/valve.h", VALVE), ("plan/beds.cpp", BEDS), ("build/made.c", "int made;"), ("notes.txt", "int no;")):
        (top / path).parent.mkdir(exist_ok=True)
        (top / path).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    return Project(spark, str(tmp_path_factory.mktemp("db"))).sync([tree])


def column(df, name="name"):
    return [r[name] for r in df.collect()]


def line_of(text, part):
    return text[: text.index(part)].count("\n")


def test_declarations_by_kind():
    found = {}
    for s in index_text(PUMP, "c").symbols:
        found.setdefault(s.kind, set()).add(s.qualname)
    assert found["function"] == {"refill", "water"} and found["prototype"] == {"open_valve", "names_of"}
    assert found["enumerator"] >= {"OFF", "DRIP", "FLOOD"} or found["enumerator"] == {"mode::OFF", "mode::DRIP", "mode::FLOOD"}
    assert found["typedef"] == {"litres", "tank_s", "word_u"} and found["macro"] == {"HALF"} and found["struct"] == {"tank"} and found["enum"] == {"mode"}
    assert found["variable"] == {"on_low", "poured"}
    assert found["field"] == {"tank::level", "tank::most", "tank::out", "word_u::whole", "word_u::bytes"}


def test_classes_and_scopes():
    x = index_text(BEDS, "cpp")
    kinds = {(s.qualname, s.kind) for s in x.symbols}
    assert {("garden", "namespace"), ("garden::Bed", "class"), ("garden::Plot", "struct"), ("garden::Bed::empty", "method"), ("garden::widest", "function")} <= kinds
    assert {k for q, k in kinds if q == "garden::Bed::plant"} == {"prototype", "method"} or {k for q, k in kinds if q == "garden::Bed::plant"} == {"prototype", "function"}
    assert sorted(b for k, b in x.bases if x.symbols[k].name == "Bed") == ["Marked", "Plot", "Shade"] or sorted(b for k, b in x.bases) == ["Plot", "Shade", "base::Marked"]
    assert [(p, system) for p, _, system in x.includes] == [("parts/valve.h", False)]


def test_references_know_their_function():
    x = index_text(PUMP, "c")
    by = {(r.name, r.kind, x.symbols[r.owner].name if r.owner >= 0 else None) for r in x.refs}
    assert {("open_valve", "call", "water"), ("HALF", "call", "refill"), ("poured", "ref", "water"), ("poured", "ref", "refill"), ("OFF", "ref", "water"), ("litres", "ref", None)} <= by
    assert sum(r.name == "open_valve" and r.kind == "call" for r in x.refs) == 2
    calls = index_text(PUMP, "c", references=False).refs
    assert calls and {r.kind for r in calls} == {"call"}


def test_places_count_in_utf16_and_survive_blanked_macros():
    assert [(s.name, s.col) for s in index_text("/* 𝛼β */ long tail;", "c").symbols] == [("tail", 15)]
    marked = "static HOT_PATH long tail(void) { return 0; }"
    s = index_text(marked, "c", ["HOT_PATH", "not-a-name"]).symbols
    assert [(x.name, x.kind, x.col) for x in s] == [("tail", "function", marked.index("tail"))]
    assert blank_macros(marked, ["HOT_PATH"]) == marked.replace("HOT_PATH", " " * 8)


@pytest.mark.parametrize("text", ["", "}", "enum", "class X :", "int f(int", "#include", "#define\n", '"open', "'", "a<b<c", "template <", "((((((", "{[(}])", "void " * 900, "operator", "~"])
def test_text_that_is_no_code(text):
    index_text(text, "c")
    index_text(text, "cpp")


def test_files_and_includes(store, tree):
    assert [p[len(tree) + 1 :] for p in column(store.all_files(), "path")] == ["parts/valve.h", "plan/beds.cpp", "pump.c"]
    row = store.get_file(f"{tree}/pump.c").first()
    assert row.lang == "c" and row.size == len(PUMP) and store.get_file_by_id(row.id).first() == row
    found = {r.path: (r.is_system, r.resolved) for r in store.includes_of(f"{tree}/pump.c").collect()}
    assert found == {"math.h": (True, None), "parts/valve.h": (False, f"{tree}/parts/valve.h")}
    assert column(store.included_by(f"{tree}/parts/valve.h"), "path") == [f"{tree}/plan/beds.cpp", f"{tree}/pump.c"]
    assert not store.included_by("parts/valve.h").count()  # a path that is all of the include has nothing before it


def test_names(store, tree):
    assert column(store.find_symbols("open_valve"), "kind") == ["prototype", "prototype"] and store.declarations("open_valve").count() == 2
    assert column(store.definitions_near("open_valve", f"{tree}/pump.c"), "path")[0] == f"{tree}/pump.c"
    assert column(store.find_definitions("water"), "line") == [line_of(PUMP, "int water")]
    assert column(store.search_symbols(" VAL ")) and not store.search_symbols(" ").count()
    assert set(column(store.symbols_with_prefix("wa"))) == {"water"} and not store.symbols_with_prefix("").count()
    one = store.find_symbols("water").first()
    assert store.get_symbol(one.id).first() == one
    assert column(store.members_of("tank")) == ["level", "most", "out"]
    assert "Bed" not in column(store.members_of("garden")) and column(store.members_of("garden", "class")) == ["Bed"]


def test_calls(store, tree):
    water = store.find_definitions("water").first().id
    assert [(r.name, r.target_kind, r["count"]) for r in store.callees_of(water).collect()] == [("refill", "function", 1), ("open_valve", "prototype", 2), ("floor", None, 1), ("water_more", None, 1)]
    assert set(column(store.callers_of("open_valve"), "from_name")) == {"water", "plant"} and store.caller_count("open_valve").first()[0] == 3
    assert column(store.functions_using_all(["poured", "level"])) and not store.functions_using_all(["poured", "poured"]).count()
    assert not store.functions_using_all(["poured", "absent"]).count()
    assert store.enclosing_function(f"{tree}/pump.c", line_of(PUMP, "poured -=")).first().name == "water"


def test_kinds_of_callees_bases_and_prefixes(spark):
    """A function is called before a larger struct of its name; bases are classes, not unions; kinds order names before a limit."""
    row = lambda i, name, kind, line, end: (i, 1, "p.cpp", name, name, kind, line, 0, end, name)
    s = spark.createDataFrame([row(1, "knot", "struct", 0, 90), row(2, "knot", "macro", 95, 95), row(3, "Sort", "union", 0, 9), row(4, "knap", "prototype", 1, 1), row(5, "knit", "function", 2, 3)], "id long, file_id long, path string, name string, qualname string, kind string, line int, col int, end_line int, signature string")
    refs = spark.createDataFrame([(1, "p.cpp", 0, "knot", "call", 3, 1, 5)], "file_id long, path string, seq int, name string, kind string, line int, col int, from_symbol long")
    from lattica.operators.store import Store

    store = Store(s, s, refs, spark.createDataFrame([(3, "Sort", 1)], "symbol_id long, base string, file_id long"))
    assert column(store.callees_of(5), "target_kind") == ["macro"]
    assert column(store.bases_of(3), "base_qualname") == [None]
    assert column(store.symbols_with_prefix("kn", 1)) == ["knit"]


def test_graphs_of_a_tree(store, tree):
    e, n = G.class_edges(store)
    bed = str(store.find_symbols("Bed").where("kind = 'class'").first().id)
    g = G.build(e, n, bed, "both", 2, 150, ("class",))
    assert {(r.label, r.external) for r in g.nodes.collect()} >= {("Bed", False), ("Plot", False), ("Shade", True)} and not g.truncated
    inc = T.relations(store, f"file:{tree}/pump.c", "includes")
    assert {(r.label, r.kind, r.external) for r in inc.nodes.collect()} == {("pump.c", "file", False), ("valve.h", "file", False), ("math.h", "system", True)}
    poured = str(store.find_definitions("poured").first().id)
    assert {(r.label, r.depth) for r in T.relations(store, poured, "callers").nodes.collect()} == {("poured", 0), ("refill", -1), ("water", -1)}


def test_graph_sides_and_openings(spark):
    edges = spark.createDataFrame([("a", "b", 1, 1), ("b", "c", 1, 1), ("c", "d", 1, 1), ("c", "b", 1, 2), ("b", "a", 1, 2), ("a", "a", 3, 3), ("d", "e", 1, 1), ("a", "ext:z", 1, 9)], "src string, dst string, count long, line int")
    nodes = spark.createDataFrame([(x, x, "function", f"dir{x}") for x in "abcde"], "id string, label string, kind string, dir string")
    both = G.build(edges, nodes, "a", "both", 2)
    got = {(r.source, r.target): r["count"] for r in both.edges.collect()}
    assert got[("c", "b")] == 1 and got[("a", "b")] == 2 and got[("a", "a")] == 4
    small = G.build(edges, nodes, "a", "callees", 1)
    more = G.expand(small, edges, nodes, {"c": "callees", "b": "callees"})
    assert {(r.id, r.depth) for r in more.nodes.collect()} == {("a", 0), ("b", 1), ("ext:z", 1), ("c", 2), ("d", 3)}
    capped = G.expand(small, edges, nodes, {"b": "callees", "c": "callees"}, 4)
    assert capped.nodes.count() == 4 and capped.truncated
    assert {r.id for r in G.expandable(small, edges).where("callees").collect()} == {"b"}
    shut = G.build(edges, nodes, "a", "callees", 1, folders=G.Folders(1))
    assert {(r.id, r.label, r.kind) for r in shut.nodes.where("depth = 1").collect()} == {("grp:callees:a:dira", "dira/ (1)", "group"), ("grp:callees:a:dirb", "dirb/ (1)", "group"), ("grp:callees:a:(external)", "(external)/ (1)", "group")}


def test_globs():
    import re

    fits = lambda g, p: bool(re.fullmatch(glob_pattern(g), p))
    assert fits("**/*.{c,h}", "a/b/x.c") and fits("**/*.{c,h}", "x.h") and not fits("*.c", "a/x.c") and fits("lib/**", "lib/a/b.c") and not fits("?.c", "ab.c")


def test_syncs_write_only_what_changed(spark, tmp_path):
    top = tmp_path / "src"
    top.mkdir()
    for k in range(12):
        (top / f"m{k}.c").write_text(f"int part{k}(void) {{ return part{k + 1}(); }}\n")
    p = Project(spark, str(tmp_path / "db"), buckets=8)
    before = p.sync([str(top)])
    first = p.manifest()
    assert p.sync([str(top)]) is not None and p.manifest() == first
    (top / "m3.c").write_text("int other(void) { return part9() * part9(); }\n")
    after = p.sync([str(top)])
    assert sum(g == 2 for g in p.manifest()["tables"]["symbols"].values()) == 1
    assert set(column(before.symbols)) == {f"part{k}" for k in range(12)}  # a reader's tables are still there
    assert set(column(after.symbols)) == {f"part{k}" for k in range(12) if k != 3} | {"other"} and after.caller_count("part9").first()[0] == 3
    (top / "m3.c").unlink()
    (top / "new.h").write_text("int fresh;\n")
    third = p.sync([str(top)])
    again = Project(spark, str(tmp_path / "db2")).sync([str(top)])
    for t in ("files", "symbols", "refs"):
        rows = [sorted(str([r[c] for c in sorted(x.columns)]) for x in [getattr(s, t)] for r in x.collect()) for s in (third, again)]
        assert rows[0] == rows[1]
    assert column(p.sync([str(top)], excluded=[f"{top}/new.h".upper()]).files.where("path like '%new.h'"), "path") == []
    assert p.sync([str(top)], include=("m1*.c",)).stats().first().files == 3
    p.remove_file(f"{top}/m1.c")
    p.index_text("inside.c", "int held(void);")
    assert {"held", "part10"} <= set(column(p.store().symbols)) and "part1" not in column(p.store().symbols)
    assert p.clear().stats().first().files == 0


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_text("int a;")
    p = Project(spark, str(tmp_path / "db"), Settings(encoding="no-such-charset"))
    assert p.sync([str(tmp_path / "src")]).symbols.count() == 0
    assert "LookupError" in p.errors().first().error
    assert Project(spark, str(tmp_path / "db")).sync([str(tmp_path / "src")]).symbols.count() == 1  # other settings: all is parsed anew


def test_tokens_of_lines(spark):
    found, carry = tokenize_line("uint8_t next = 0x1f; // tail")
    assert [c for _, _, c in found] == ["type", "identifier", "operator", "number", "operator", "comment"] and not carry
    assert tokenize_line("call(x) /* on")[1] and tokenize_line("still on", True) == ([(0, 8, "comment")], True)
    from lattica.functions.lines import Tokens

    spark.udtf.register("tokens", Tokens)
    rows = spark.sql("SELECT t.* FROM VALUES ('/* up\ndown */ return 7;') AS v(text), LATERAL tokens(text) t").collect()
    assert [(r.line, r.cls, r.in_comment) for r in rows] == [(0, "comment", False), (1, "comment", True), (1, "keyword", True), (1, "number", True), (1, "operator", True)]


def test_parameters_and_open_calls():
    assert split_params("struct valve *v, pair<int, long> p, int (*cb)(char, char) , ,void") == ["struct valve *v", "pair<int, long> p", "int (*cb)(char, char)"]
    assert split_params("void") == [] and split_params("") == [] and split_params("a[f(1, 2)], ...") == ["a[f(1, 2)]", "..."]
    cases = {"pour(a, mix(b, c), ": ("pour", 2), "pour(a, mix(b": ("mix", 0), "while (x": None, "pour(a); ": None, "pour(list[1, ": None, 'pour("(,", ': ("pour", 1), "pour(a)": None, "": None, "(": None, "pour(x, { 1": None}
    assert {t: enclosing_call(t) for t in cases} == cases
    assert enclosing_call("pour(a,\n" + "b,\n" * 20) is None and enclosing_call("pour(a,\n" + "b,\n" * 19) == ("pour", 20)


def test_lines_around_a_place():
    lines = PUMP.split("\n")
    at = line_of(PUMP, "enum mode")
    assert comment_above(["/* one", " * two */", "int x;"], 2) == ["/* one", " * two */"] and comment_above(lines, at) == []
    assert snippet(lines, at, at + 9, before=0, after=1) == [(at, lines[at]), (at + 1, lines[at + 1])]
    text = "level = level + 1; // level"
    assert styled_ranges(text, False, text.index("level", 3), 5)[0] == [(0, 5, "identifier", False), (6, 7, "operator", False), (8, 13, "identifier", True), (14, 15, "operator", False), (16, 17, "number", False), (17, 18, "operator", False), (19, 27, "comment", False)]


def test_stream_of_file_events(spark, tmp_path):
    from lattica.streaming.watch import EVENTS, changes, follow

    src = tmp_path / "src"
    src.mkdir()
    (src / "w.c").write_text("int w(void) { return 1; }")
    p = Project(spark, str(tmp_path / "db"))
    p.index_text(f"{src}/gone.c", "int gone;")
    first = changes(p, [str(src)], 1)
    assert {(r.op, r.path.rsplit("/", 1)[1]) for r in first.collect()} == {("upsert", "w.c"), ("delete", "gone.c")}
    events = first.unionByName(first.where("op = 'upsert'").selectExpr("event_id + 100 as event_id", "op", "id", "path", "mtime + 1 as mtime", "size", "lang"))
    events.write.parquet(str(tmp_path / "events"))
    follow(p, spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events")), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(120)
    assert column(p.store().all_files(), "path") == [f"{src}/w.c"] and p.store().find_symbols("w").count() == 1
