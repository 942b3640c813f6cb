"""Resolution of occurrences in a small program whose names shadow each other, and what an editor asks about its places."""

import pytest

from lattica.operators import resolve as R
from lattica.plans import tasks as T
from lattica.sources.code import FILES, Settings, parse, split, stable_id

HEADER = "struct leaf { int size; struct stem *on; };\nint trim(int size);\n"
MAIN = """#include "tree.h"
struct stem { struct leaf *first; long size; };
typedef struct stem branch;
struct stem trunk;
/* grows by one */
struct leaf *sprout(branch *b);
long size;
enum { SPRING = 3 };

long measure(branch *b, int deep)
{
    struct leaf *l = b->first;
    long size = l->size;
    while (deep--)
        size += trim(l->on->size) + sprout(b)->size;
    trunk.size = size + ((branch *)l)->size;
    return size;
}

int trim(int size) { return size > SPRING ? measure(0, size) : 0; }

void grow(void) { size++; trunk.first = 0; unknown.size = 1; }
"""
FILES_OF = {"t/tree.h": HEADER, "t/main.c": MAIN}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(stable_id(p), p, 0, len(t), "c", t) for p, t in FILES_OF.items()]
    texts = spark.createDataFrame(rows, FILES + ", text string")
    store = split(texts.drop("text"), parse(texts, Settings()))
    store.symbols, store.refs = store.symbols.persist(), store.refs.persist()
    local, occ = R.scope_tables(texts)
    local = local.persist()
    return store, local, R.resolve(store, local, occ).persist(), texts


def place(part, skip=0, text=MAIN):
    at = text.index(part) + skip
    return text[:at].count("\n"), at - text.rfind("\n", 0, at) - 1


def test_what_occurrences_mean(found):
    got = {(r.line, r.col): (r.res_kind, r.qualname, r.decl_path, r.decl_line) for r in found[2].where("path = 't/main.c'").collect()}
    row = lambda part: place(part)[0]
    assert got[place("b->first", 3)] == ("member", "stem::first", "t/main.c", row("struct stem {"))
    assert got[place("l->size", 3)] == ("member", "leaf::size", "t/tree.h", 0)
    assert got[place("l->on->size", 7)] == ("member", "stem::size", "t/main.c", row("struct stem {"))
    assert got[place("sprout(b)->size", 11)] == ("member", "leaf::size", "t/tree.h", 0)
    assert got[place("trunk.size", 6)] == ("member", "stem::size", "t/main.c", row("struct stem {"))
    assert got[place("(branch *)l)->size", 14)] == ("member", "stem::size", "t/main.c", row("struct stem {"))
    assert got[place("size += trim")] == ("local", None, "t/main.c", row("long size = l"))
    assert got[place("return size;", 7)] == ("local", None, "t/main.c", row("long size = l"))
    assert got[place("size > SPRING")][0] == "local" and got[place("size++")] == ("symbol", "size", "t/main.c", row("\nlong size;") + 1)


def test_references_with_options(found):
    store, _, r, _ = found
    at = lambda df: sorted((x.path, x.line, x.col) for x in df.collect())
    leaf = at(R.references(store, r, "size", "leaf::size"))  # with what is only known by its name, as that may mean it
    assert leaf == sorted([("t/main.c", *place("l->size", 3)), ("t/main.c", *place("sprout(b)->size", 11)), ("t/main.c", *place("unknown.size", 8)), ("t/main.c", *place("size++")), ("t/tree.h", 1, HEADER.split("\n")[1].index("size"))])
    with_own = at(R.references(store, r, "size", "leaf::size", declarations=True))
    assert ("t/tree.h", 0, HEADER.index("size")) in with_own and len(with_own) == len(leaf) + 1
    top = at(R.references(store, r, "size"))
    assert ("t/main.c", *place("size++")) in top and ("t/main.c", *place("l->size", 3)) not in top and ("t/main.c", *place("return size;", 7)) not in top
    assert at(R.references(store, r, "trim", path="T/MAIN.C", declarations=True)) == sorted([("t/main.c", *place("int trim(int size) {", 4)), ("t/main.c", *place("trim(l->on"))])
    assert not R.references(store, r, "trim", path="t/tree.h", declarations=True).count()  # a prototype is no definition
    assert at(R.references_at(store, r, "t/main.c", *place("return size;", 7))) == sorted(("t/main.c", *place(p, k)) for p, k in (("size += trim", 0), ("trunk.size = size", 13), ("return size;", 7)))


def test_edits_and_highlights(found):
    _, _, r, _ = found
    edits = R.rename_edits(r, "t/main.c", *place("size += trim"), "length").collect()
    assert {(e.line, e.col) for e in edits} >= {place("size += trim"), place("return size;", 7)} and place("size++") not in {(e.line, e.col) for e in edits}
    assert {e.text for e in edits} == {"length"} and {e.length for e in edits} == {4}
    assert {(x.line, x.col) for x in R.highlights(r, "t/main.c", *place("deep--")).collect()} >= {place("deep--")}


def test_tokens(found):
    store, _, r, _ = found
    token = {(x.line, x.col): x.token for x in R.semantic_tokens(r.where("path = 't/main.c'"), store).collect()}
    assert token[place("deep--")] == "parameter" and token[place("return size;", 7)] == "variable" and token[place("measure(0")] == "function"
    assert token[place("SPRING ?")] == "enumMember" and token[place("l->size", 3)] == "property" and token[place("trunk.size")] == "variable"


def test_completion(found):
    store, local, _, _ = found
    body = MAIN.index("while (deep")
    assert [(x.name, x.source) for x in R.completion(store, local, "t/main.c", body, "de").collect()] == [("deep", "local")]
    assert {x.name: x.source for x in R.completion(store, local, "t/main.c", body, "tr").collect()} == {"trim": "function", "trunk": "variable"}
    assert not R.completion(store, local, "t/main.c", body, "d").count()
    assert [x.name for x in R.member_completion(store, local, "t/main.c", body, "b->").collect()] == ["first", "size"]
    assert [x.name for x in R.member_completion(store, local, "t/main.c", body, "x = l->on->first.").collect()] == ["size", "on"]
    assert [x.name for x in R.member_completion(store, local, "t/main.c", body, "sprout(b)->").collect()] == ["size", "on"]
    assert not R.member_completion(store, local, "t/main.c", body, "nothing.").count()


def test_signature_help(found):
    store = found[0]
    rows = T.signature_help(store, "    x = trim(measure(b, 1), ").collect()
    assert [(r.signature, r.parameters, r.active) for r in rows] == [("int trim(int size)", ["int size"], 0)]
    assert T.signature_help(store, "measure(b, d").first().active == 1 and not T.signature_help(store, "if (").count() and not T.signature_help(store, "absent(").count()


def test_definition_and_hover(found):
    store, _, r, texts = found
    go = lambda *p: [(x.path, x.line) for x in T.definition(store, r, texts, "t/main.c", *p).collect()]
    assert go(*place("tree.h")) == [("t/tree.h", 0)]
    assert go(*place("trim(l->on")) == [("t/main.c", place("int trim(int size) {")[0])] and go(*place("deep--")) == [("t/main.c", place("int deep")[0])]
    assert set(go(*place("\nlong size;", 6))) == {("t/tree.h", 0), ("t/main.c", 1)}  # the members of that name, but not the place itself
    assert [x.path for x in T.declaration(store, r, "t/main.c", *place("trim(l->on")).collect()] == ["t/tree.h"]
    shown = T.hover(store, r, texts, "t/main.c", *place("sprout(b)")).collect()
    assert [(x.kind, x.comment) for x in shown] == [("prototype", None)]
    assert [(x.kind, x.callers) for x in T.hover(store, r, texts, "t/main.c", *place("trim(l->on")).collect()] == [("function", 1)]
    assert [x.signature for x in T.hover(store, r, texts, "t/main.c", *place("deep--")).collect()] == ["int deep"]


def test_context_view(found):
    store, local, r, texts = found
    got = T.context(store, r, texts, "t/main.c", *place("trunk.size"))
    assert [(x.kind, x.path) for x in got.definition.collect()] == [("variable", "t/main.c")]
    assert [(x.name, x.kind) for x in got.type.collect()] == [("stem", "struct")] and [x.name for x in got.type_members.collect()] == ["first", "size"]
    assert {(x.line, x.hidden) for x in got.uses.collect()} == {(place("trunk.size")[0], False), (place("trunk.first")[0], False)}
    size = T.context(store, r, texts, "t/main.c", *place("size++"))
    rows = [(x.line, x.col, x.hidden) for x in size.uses.collect()]
    assert (*place("size++"), False) in rows and (*place("l->size", 3), True) in rows and rows[0][:2] == place("size++")


def test_hierarchies(spark):
    text = "class Top {};\nclass Mid : public Top { void run(); };\nclass Low : public Mid {};\nvoid Mid::run() { other(); }\nvoid other() {}\n"
    rows = [(stable_id("h.cpp"), "h.cpp", 0, len(text), "cpp", text)]
    texts = spark.createDataFrame(rows, FILES + ", text string")
    store = split(texts.drop("text"), parse(texts, Settings()))
    resolved = R.resolve(store, *R.scope_tables(texts)).persist()
    item = T.type_item(store, resolved, "h.cpp", *place("Mid : ", 0, text)).first()
    assert item.qualname == "Mid" and [x.base_qualname for x in T.supertypes(store, item.id).collect()] == ["Top"] and [x.name for x in T.subtypes(store, item.name).collect()] == ["Low"]
    call = T.call_item(store, resolved, "h.cpp", *place("other(); }", 0, text)).first()
    assert call.name == "other" and [x.from_qualname for x in store.incoming_calls(call.name).collect()] == ["Mid::run"]
