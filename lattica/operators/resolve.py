"""Resolution of occurrences, once for a whole project and by joins: locals, members through typed receivers, globals by name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.operators.store import CLASS_KINDS, MEMBER_KINDS, Store
from lattica.sources.cparse import blank_macros
from lattica.sources.scopes import Scopes, receiver_at_end

LOCALS = "path string, name string, type string, kind string, at int, line int, col int, scope_start int, scope_end int"
OCCURRENCES = "path string, name string, at int, line int, col int, call boolean, receiver array<string>"
MAX_STEPS = 5


def scope_tables(texts: DataFrame, ignore_macros: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(locals, occurrences) of files (path, lang, text). Files are independent of each other, so this is one pass of tasks."""

    def rows(which: int, names: list[str], kinds: list):
        def run(batches):
            schema = pa.schema(list(zip(["path", *names], [pa.string(), *kinds], strict=True)))
            for batch in batches:
                for r in batch.to_pylist():
                    found = Scopes(blank_macros(r["text"] or "", list(ignore_macros)), r["lang"]).run_scopes()[which]
                    if found:
                        yield pa.RecordBatch.from_pylist([{"path": r["path"]} | {n: getattr(x, n) for n in names} for x in found], schema)

        return run

    i32, text = pa.int32(), pa.string()
    files = texts.select("path", "lang", "text")
    local = files.mapInArrow(rows(0, ["name", "type", "kind", "at", "line", "col", "scope_start", "scope_end"], [text, text, text, i32, i32, i32, i32, i32]), LOCALS)
    return local, files.mapInArrow(rows(1, ["name", "at", "line", "col", "call", "receiver"], [text, i32, i32, i32, pa.bool_(), pa.list_(text)]), OCCURRENCES)


def _nearest(occ: DataFrame, local: DataFrame, name: str) -> DataFrame:
    """occ with the innermost declaration of `name` that is in scope and stands before the use: l_kind, l_type, l_at, l_line."""
    d = local.select("path", F.col("name").alias(name), *(F.col(c).alias("l_" + c) for c in ("kind", "type", "at", "line", "scope_start", "scope_end")))
    j = occ.join(d, ["path", name]).where("at between l_scope_start and l_scope_end and l_at <= at")
    w = Window.partitionBy("path", "at").orderBy(F.desc("l_scope_start"), F.desc("l_at"))
    best = j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("path", "at", "l_kind", "l_type", "l_at", "l_line")
    return occ.join(best, ["path", "at"], "left")


def aliases(symbols: DataFrame) -> DataFrame:
    """(name, target): typedef names and the type that each stands for, from their signatures."""
    s = symbols.where("kind = 'typedef'")
    tag = F.regexp_extract("signature", rf"^typedef\s+(?:const\s+)?(?:(?:struct|class|union|enum)\s+)?({X.IDENTIFIER})", 1)
    return s.select("name", tag.alias("target")).where("target <> '' and target <> name and target not in ('struct', 'class', 'union', 'enum')").distinct()


def member_types(symbols: DataFrame) -> DataFrame:
    """(owner, name, type, qualname, path, line): members with the last segment of their owner and their own or returned type."""
    s = symbols.where(F.col("qualname").contains("::") & F.col("kind").isin("field", "method", "prototype", "function"))
    owner = F.regexp_extract("qualname", rf"({X.IDENTIFIER})::[^:]*$", 1)
    return s.select(owner.alias("owner"), "name", _type_of("signature").alias("type"), "qualname", "path", "line")


def _type_of(signature: str):
    head = F.regexp_extract(signature, rf"^(?:(?:static|extern|inline|const|volatile|struct|class|union|enum|virtual|unsigned|signed)\s+)*((?:{X.IDENTIFIER}::)*{X.IDENTIFIER})", 1)
    return F.regexp_extract(head, rf"({X.IDENTIFIER})$", 1)


class _Members:
    """What is needed to follow receivers: members by owner, typedefs, types of globals and results."""

    def __init__(self, store: Store):
        s = store.symbols
        self.alias = aliases(s).groupBy("name").agg(F.min("target").alias("target"))
        members = member_types(s)
        self.best = members.groupBy("owner", "name").agg(F.min_by(F.struct("qualname", "type", "path", "line"), F.struct("path", "line")).alias("m"))
        self.owners = members.select("owner").distinct().withColumn("known", F.lit(True))
        self.free = s.where(~F.col("qualname").contains("::")).where("kind in ('variable', 'function', 'prototype')").groupBy(F.col("name").alias("first")).agg(F.min(_type_of("signature")).alias("g_type"))

    def through(self, df: DataFrame) -> DataFrame:
        """Types that have no members of their own are followed through a typedef."""
        j = df.join(self.owners.withColumnRenamed("owner", "type"), "type", "left").join(self.alias.withColumnRenamed("name", "type"), "type", "left")
        return j.withColumn("type", F.when(F.col("known").isNull() & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("type"))).drop("known", "target")

    def typed(self, occurrences: DataFrame, local: DataFrame) -> DataFrame:
        """OCCURRENCES behind '.' or '->' with the type of their receiver. Only those with further steps take part in a step's joins."""
        behind = occurrences.withColumns({"step": F.get("receiver", F.lit(0))}).withColumns({"way": F.substring_index("step", ":", 1), "first": F.substring_index("step", ":", -1)})
        typed = _nearest(behind, local, "first").join(self.free, "first", "left")
        kind = F.when(F.col("way") == "type", F.col("first")).when(F.col("way") == "var", F.coalesce("l_type", "g_type")).when(F.col("way") == "call", F.col("g_type"))
        now = self.through(typed.select("path", "name", "at", "line", "col", "call", "receiver", F.regexp_extract(kind, rf"({X.IDENTIFIER})$", 1).alias("type")))
        done = None
        for k in range(1, MAX_STEPS):
            ready, now = now.where(F.size("receiver") <= k), now.where(F.size("receiver") > k)
            done = ready if done is None else done.unionByName(ready)
            field = F.substring_index(F.get("receiver", F.lit(k)), ":", -1)
            step = self.best.select(F.col("owner").alias("type"), F.col("name").alias("field"), F.col("m.type").alias("next"))
            now = now.withColumn("field", field).join(step, ["type", "field"], "left")
            now = self.through(now.withColumn("type", F.col("next")).drop("next", "field"))
        return done.unionByName(now)


def resolve(store: Store, local: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each occurrence with res_kind 'local', 'member', 'symbol' or null, and what it stands for.

    Behind '.' or '->' the receiver's type is found step by step (locals, globals, casts, results of calls, fields; at most five
    steps), through one typedef a step, and the name is looked up among that type's members. A receiver whose type is not found
    falls back to the name among all symbols, as does a name that is not local; definitions in the same file come first. decl_line
    is the line of the declaration.
    """
    m = _Members(store)
    plain = _nearest(occurrences.where("size(receiver) = 0"), local, "name")
    own = store.symbols.where("kind in ('field', 'method', 'prototype')").where(F.col("qualname").contains("::")).select("path", "name", "line", "col", F.col("qualname").alias("own"))
    plain = plain.join(own, ["path", "name", "line", "col"], "left")  # a member's own declaration
    behind = m.typed(occurrences.where("size(receiver) > 0"), local)
    member = behind.join(m.best.select(F.col("owner").alias("type"), "name", "m"), ["type", "name"], "left")
    s = store.symbols
    order = F.struct((F.col("kind") == "prototype").cast("int").alias("p"), X.kind_rank(F.col("kind")).alias("r"), (F.col("line") - F.col("end_line")).alias("n"), "path", "line", "col")
    found = F.struct("qualname", "path", "line")
    by_name = s.groupBy("name").agg(F.min_by(found, order).alias("b"), F.max(F.col("kind") != "prototype").alias("real"))
    in_file = s.groupBy("name", "path").agg(F.min_by(found, order).alias("f"), F.max(F.col("kind") != "prototype").alias("f_real"))

    def named(df: DataFrame) -> DataFrame:
        """With d, the definition that the name means in the file. A prototype in the file gives way to a definition elsewhere."""
        j = df.join(by_name, "name", "left").join(in_file, ["name", "path"], "left")
        return j.withColumn("d", F.when(F.col("f_real") | ~F.col("real"), F.coalesce("f", "b")).otherwise(F.col("b")))

    columns = ("path", "name", "line", "col", "call")
    is_local, nothing = F.col("l_at").isNotNull(), F.lit(None).cast("string")
    a = named(plain).select(*columns, F.when(is_local, "local").when(F.col("own").isNotNull(), "member").when(F.col("d").isNotNull(), "symbol").alias("res_kind"), F.when(~is_local, F.coalesce("own", "d.qualname")).alias("qualname"), F.when(is_local | F.col("own").isNotNull(), F.col("path")).otherwise(F.col("d.path")).alias("decl_path"), F.when(is_local, F.col("l_line")).when(F.col("own").isNotNull(), F.col("line")).otherwise(F.col("d.line")).alias("decl_line"), "l_type", "l_kind")
    b = named(member).select(*columns, F.when(F.col("m").isNotNull(), "member").when(F.col("d").isNotNull(), "symbol").alias("res_kind"), F.coalesce("m.qualname", "d.qualname").alias("qualname"), F.coalesce("m.path", "d.path").alias("decl_path"), F.coalesce("m.line", "d.line").alias("decl_line"), nothing.alias("l_type"), nothing.alias("l_kind"))
    return a.unionByName(b)


def classified(store: Store, resolved: DataFrame, name: str, qualname: str | None = None) -> DataFrame:
    """Uses of a name (path, line, col, kind, from_symbol) with `hidden`: whether they mean something else.

    Locals that share the name do. For a member, given by its qualname, so do members of other types, and names that lead to fields or
    methods of others only; what is not resolved may mean it. For anything else, so do all members.
    """
    uses = store.refs.where(F.col("name") == name).select("path", "line", "col", "kind", "from_symbol")
    r = resolved.where(F.col("name") == name).select("path", "line", "col", "res_kind", "qualname")
    if qualname and "::" in qualname:
        others = store.symbols.where((F.col("name") == name) & F.col("kind").isin("field", "method")).agg(F.max("qualname").alias("other"), F.max((F.col("qualname") == qualname).cast("int")).alias("own"))
        j = uses.join(r, ["path", "line", "col"], "left").crossJoin(F.broadcast(others))  # one row
        hidden = (F.col("res_kind") == "local") | (F.col("res_kind") == "member") & (F.col("qualname") != qualname) | (F.col("res_kind") == "symbol") & F.col("other").isNotNull() & (F.coalesce("own", F.lit(0)) == 0)
    else:
        j, hidden = uses.join(r, ["path", "line", "col"], "left"), F.col("res_kind").isin("local", "member")
    return j.select("path", "line", "col", "kind", "from_symbol", F.coalesce(hidden, F.lit(False)).alias("hidden"))


def references(store: Store, resolved: DataFrame, name: str, qualname: str | None = None, declarations: bool = False, path: str | None = None) -> DataFrame:
    """(path, line, col) of what means a global, or with the qualname of a member that member; see classified(). declarations: those
    too, for a global without fields of its name. path: only in that file."""
    out = classified(store, resolved, name, qualname).where("not hidden").select("path", "line", "col")
    if declarations:
        s = store.symbols.where(F.col("name") == name)
        s = s.where(F.col("qualname") == qualname) if qualname and "::" in qualname else store._definitions(s).where("kind <> 'field'")
        out = out.unionByName(s.select("path", "line", "col")).distinct()
    return out.where(F.lower("path") == path.lower()) if path else out


def references_at(store: Store, resolved: DataFrame, path: str, line: int, col: int, declarations: bool = False, file_only: bool = False) -> DataFrame:
    """References to what stands at a place; those of a local are where it can be seen."""
    at = resolved.where((F.col("path") == path) & (F.col("line") == line) & F.lit(col).between(F.col("col"), F.col("col") + F.length("name"))).limit(1).collect()
    if not at:
        return resolved.select("path", "line", "col").limit(0)
    x = at[0]
    if x.res_kind == "local":
        own = resolved.where((F.col("path") == path) & (F.col("name") == x.name) & (F.col("res_kind") == "local") & (F.col("decl_line") == x.decl_line))
        first = own.where(F.col("line") == F.col("decl_line")).agg(F.min("col").alias("first"))
        return own.select("path", "line", "col") if declarations else own.crossJoin(F.broadcast(first)).where("not (line = decl_line and col <=> first)").select("path", "line", "col")
    return references(store, resolved, x.name, x.qualname if x.res_kind == "member" else None, declarations, path if file_only else None)


def highlights(resolved: DataFrame, path: str, line: int, col: int) -> DataFrame:
    """Occurrences in the same file that mean what stands at a place."""
    own = resolved.where(F.col("path") == path)
    at = own.where((F.col("line") == line) & F.lit(col).between(F.col("col"), F.col("col") + F.length("name"))).select("name", "res_kind", "decl_path", "decl_line").limit(1)
    same = own.alias("o").join(F.broadcast(at.alias("a")), F.expr("o.name = a.name and o.decl_line <=> a.decl_line and o.decl_path <=> a.decl_path"))
    return same.select("o.*")


def rename_edits(resolved: DataFrame, path: str, line: int, col: int, new: str) -> DataFrame:
    """(path, line, col, length, text) of each edit; locals are renamed where they are seen, others in all files."""
    at = resolved.where((F.col("path") == path) & (F.col("line") == line) & F.lit(col).between(F.col("col"), F.col("col") + F.length("name"))).select("name", "decl_path", "decl_line").limit(1)
    same = resolved.alias("o").join(F.broadcast(at.alias("a")), F.expr("o.name = a.name and o.decl_line <=> a.decl_line and o.decl_path <=> a.decl_path"))
    return same.select("o.path", "o.line", "o.col", F.length("o.name").alias("length"), F.lit(new).alias("text"))


def semantic_tokens(resolved: DataFrame, store: Store) -> DataFrame:
    """(path, line, col, name, token): what is called is a function whatever else it is; then property, parameter, variable (local),
    macro, enumMember, function, variable, namespace or type."""
    kinds = store.best_definitions().select("name", F.col("kind").alias("s_kind"))
    t = resolved.join(kinds, "name", "left")
    token = F.when(F.col("call"), "function").when(F.col("res_kind") == "member", "property").when(F.col("l_kind") == "param", "parameter").when(F.col("res_kind") == "local", "variable").when(F.col("s_kind") == "macro", "macro").when(F.col("s_kind") == "enumerator", "enumMember").when(F.col("s_kind").isin("function", "method", "prototype"), "function").when(F.col("s_kind") == "variable", "variable").when(F.col("s_kind") == "namespace", "namespace").when(F.col("s_kind").isin(*CLASS_KINDS, "enum", "typedef"), "type")
    return t.select("path", "line", "col", "name", token.alias("token")).where("token is not null")


def completion(store: Store, local: DataFrame, path: str, at: int, prefix: str, limit: int = 150) -> DataFrame:
    """(name, source, type) of names that begin with prefix, two letters at least: visible locals win over symbols."""
    if len(prefix) < 2:
        return local.sparkSession.createDataFrame([], "name string, source string, type string")
    seen = local.where((F.col("path") == path) & F.lit(at).between(F.col("scope_start"), F.col("scope_end")) & (F.col("at") < at) & F.col("name").startswith(prefix))
    mine = seen.groupBy("name").agg(F.max_by("type", "at").alias("type")).select("name", F.lit("local").alias("source"), "type")
    names = store.symbols_with_prefix(prefix, limit).select("name", F.col("kind").alias("source"), F.lit(None).cast("string").alias("type"))
    return mine.unionByName(names.join(mine.select("name"), "name", "left_anti")).orderBy("name")


def member_completion(store: Store, local: DataFrame, path: str, at: int, before: str, lang: str = "cpp") -> DataFrame:
    """(name, kind, qualname, signature) of the members of what `before`, the line up to a place, has in front of its last '.' or
    '->', in the order of their declarations. at: the offset of the place."""
    steps, symbols = receiver_at_end(before, lang), store.symbols
    one = symbols.sparkSession.createDataFrame([(path, "", at, 0, 0, False, steps)], OCCURRENCES)
    owner = F.regexp_extract("qualname", rf"({X.IDENTIFIER})::[^:]*$", 1)
    kinds = symbols.where(F.col("kind").isin(*MEMBER_KINDS)).withColumn("type", owner)
    typed = _Members(store).typed(one, local).select("type") if steps else one.select(F.lit("").alias("type"))
    return kinds.join(F.broadcast(typed.where("type <> ''")), "type").orderBy("path", "line", "col").select("name", "kind", "qualname", "signature")
