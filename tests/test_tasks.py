from lattica.operators import resolve as R
from lattica.plans import tasks as T
from lattica.sources.code import FILES, Settings, parse, split, stable_id

MAIN = '#include "u.h"\nint add(int a, int b);\nint run(int n) {\n    return add(n, helper(n)) + add(1, 2);\n}\n'
UTIL = "int add(int a, int b) { return a + b; }\n"


def test_tasks(spark):
    rows = [(stable_id(p), p, 0, len(t), "c", t) for p, t in (("p/main.c", MAIN), ("p/util.c", UTIL), ("p/u.h", "int add(int a, int b);\n"))]
    texts = spark.createDataFrame(rows, FILES + ", text string")
    store = split(texts.drop("text"), parse(texts, Settings()))
    resolved = R.resolve(store, *R.scope_tables(texts)).persist()
    col = MAIN.split("\n")[3].index("add")
    assert [(r.path, r.line) for r in T.definition(store, resolved, texts, "p/main.c", 3, col).collect()] == [("p/util.c", 0)]
    assert {(r.kind, r.callers) for r in T.hover(store, resolved, texts, "p/main.c", 3, col).collect()} == {("function", 2)}
    assert [r.signature for r in T.hover(store, resolved, texts, "p/main.c", 3, MAIN.split("\n")[3].index("n,")).collect()] == ["int n"]
    assert [r.name for r in T.search_project(store, "add, helper").collect()] == ["run"]
    run = str(T.centre(store, "run").first().id)
    g = T.relations(store, run, "both", 2)
    assert sorted(r.label for r in g.nodes.collect()) == ["add", "helper", "run"] and {r["count"] for r in g.edges.collect()} == {1, 2}
    inc = T.relations(store, "file:p/main.c", "includes")
    assert {r.label for r in inc.nodes.collect()} == {"main.c", "u.h"}
    assert {r.kind for r in T.symbol_tree(store).collect()} == {"function", "prototype"}
