"""Queries over the tables of a code base. Every method takes settings and returns a DataFrame; nothing is collected.

files (id, path, mtime, size, lang); symbols (id, file_id, path, name, qualname, kind, line, col, end_line, signature);
refs (file_id, path, seq, name, kind 'call' or 'ref', line, col, from_symbol); bases (symbol_id, base, file_id);
includes (file_id, path, line, is_system). symbols and refs carry their file's path, so that no query joins files for it. Where a
project is kept, both are sorted by name, and refs once more by file, so that look-ups read few row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import exprs as X

CLASS_KINDS = ("class", "struct", "union")
BASE_KINDS = ("class", "struct")
MEMBER_KINDS = ("field", "method", "prototype")
CALLABLE = ("function", "method", "macro")
FUNCTIONS = ("function", "method")


def symbol_order() -> list[Column]:
    return [X.kind_rank(F.col("kind")), F.desc(F.col("end_line") - F.col("line")), F.col("path"), F.col("line"), F.col("col")]


@dataclass
class Store:
    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    bases: DataFrame | None = None
    includes: DataFrame | None = None
    refs_by_file: DataFrame | None = None

    @property
    def file_refs(self) -> DataFrame:
        """refs, for look-ups by file or by the symbol that they are in."""
        return self.refs if self.refs_by_file is None else self.refs_by_file

    # files
    def all_files(self) -> DataFrame:
        return self.files.orderBy("path")

    def get_file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path)

    def get_file_by_id(self, file_id: int) -> DataFrame:
        return self.files.where(F.col("id") == file_id)

    def get_symbol(self, symbol_id: int) -> DataFrame:
        return self.symbols.where(F.col("id") == symbol_id)

    def stats(self) -> DataFrame:
        """Rows of files, symbols and refs, in one row."""
        parts = [t.groupBy().agg(F.count("*").alias("n")).select(*[(F.col("n") if k == i else F.lit(0)).cast("long").alias(c) for i, c in enumerate(("files", "symbols", "refs"))]) for k, t in enumerate((self.files, self.symbols, self.refs))]
        return parts[0].union(parts[1]).union(parts[2]).agg(*[F.sum(c).alias(c) for c in ("files", "symbols", "refs")])

    # symbols
    def find_symbols(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name).orderBy(*symbol_order())

    def find_definitions(self, name: str) -> DataFrame:
        """Symbols of the name that are no prototypes, or the prototypes if there is nothing else."""
        return self._definitions(self.symbols.where(F.col("name") == name)).orderBy(*symbol_order())

    def definitions_near(self, name: str, path: str) -> DataFrame:
        """find_definitions(), those in the file itself first."""
        elsewhere = (F.lower("path") != path.lower()).cast("int")
        return self._definitions(self.symbols.where(F.col("name") == name)).orderBy(elsewhere, *symbol_order())

    def declarations(self, name: str) -> DataFrame:
        """Prototypes of the name."""
        return self.symbols.where((F.col("name") == name) & (F.col("kind") == "prototype")).orderBy(*symbol_order())

    def _definitions(self, symbols: DataFrame) -> DataFrame:
        real = symbols.where("kind <> 'prototype'")
        return real.unionByName(symbols.where("kind = 'prototype'").join(real.select("name").distinct(), "name", "left_anti").select(*symbols.columns))

    def best_definitions(self, names: DataFrame | None = None, first: tuple[str, ...] = ()) -> DataFrame:
        """One symbol a name, of all or of those in names (name): what find_definitions() lists first, kinds in `first` before all
        others. An aggregate, so that a name with very many symbols is combined before it is shuffled."""
        s = self.symbols if names is None else self.symbols.join(names.select("name").distinct(), "name", "left_semi")
        ahead = [(~F.col("kind").isin(*first)).cast("int").alias("_f")] if first else []
        order = F.struct((F.col("kind") == "prototype").cast("int").alias("_p"), *ahead, X.kind_rank(F.col("kind")).alias("_r"), (F.col("line") - F.col("end_line")).alias("_n"), "path", "line", "col", "id")
        return s.groupBy("name").agg(F.min_by(F.struct(*(c for c in s.columns if c != "name")), order).alias("_s")).select("name", "_s.*").select(*s.columns)

    def search_symbols(self, query: str, limit: int = 200) -> DataFrame:
        """Names with query in them, whatever the case of ASCII letters: earlier places, shorter names, kinds, names. Blank: nothing."""
        query = query.strip()
        s = self.symbols.where(F.lit(bool(query)))
        at = X.contains_ignoring_ascii_case(F.col("name"), query or "x")
        return s.withColumn("_at", at).where("_at > 0").orderBy("_at", F.length("name"), X.kind_rank(F.col("kind")), "name", "path", "line", "col").limit(limit).drop("_at")

    def symbols_with_prefix(self, prefix: str, limit: int = 150) -> DataFrame:
        """One symbol for each name that begins with prefix, kinds in their order, then by name. No prefix: nothing."""
        s = Store(self.files, self.symbols.where(F.col("name").startswith(prefix) if prefix else F.lit(False)), self.refs)
        order = F.struct(X.kind_rank(F.col("kind")).alias("_r"), (F.col("line") - F.col("end_line")).alias("_n"), "path", "line", "col", "id")
        one = s.symbols.groupBy("name").agg(F.min_by(F.struct(*(c for c in s.symbols.columns if c != "name")), order).alias("_s")).select("name", "_s.*")
        return one.select(*s.symbols.columns).orderBy(X.kind_rank(F.col("kind")), "name").limit(limit)

    def names_of_kind(self, *kinds: str) -> DataFrame:
        return self.symbols.where(F.col("kind").isin(*kinds)).select("name").distinct()

    def symbols_by_kind(self, kind: str, limit: int = 5000) -> DataFrame:
        return self.symbols.where(F.col("kind") == kind).orderBy("name", "path", "line", "col").limit(limit)

    def kind_counts(self) -> DataFrame:
        return self.symbols.groupBy("kind").agg(F.count("*").alias("count")).orderBy("kind")

    def file_symbols(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("path") == path).orderBy("line", "col")

    def enclosing_function(self, path: str, line: int) -> DataFrame:
        """The innermost function whose lines hold `line`."""
        s = self.symbols.where((F.col("path") == path) & F.col("kind").isin(*FUNCTIONS) & F.lit(line).between(F.col("line"), F.col("end_line")))
        return s.orderBy(F.desc("line"), F.desc("col")).limit(1)

    def enclosing_functions(self, places: DataFrame) -> DataFrame:
        """enclosing_function() for all places (path, spot): joined by path, then by range; the innermost one by rank."""
        f = self.symbols.where(F.col("kind").isin(*FUNCTIONS)).select("path", "name", "line", "col", "end_line")
        near = places.join(f, "path").where("spot between line and end_line")
        return near.withColumn("_r", F.row_number().over(Window.partitionBy("path", "spot").orderBy(F.desc("line"), F.desc("col")))).where("_r = 1").drop("_r")

    def members_of(self, qualname: str, *kinds: str) -> DataFrame:
        """Symbols one level below qualname: fields, methods and prototypes, or those of the kinds given."""
        head = qualname + "::"
        s = self.symbols.where(F.col("qualname").startswith(head) & ~F.substring(F.col("qualname"), len(head) + 1, 1 << 20).contains("::"))
        return s.where(F.col("kind").isin(*(kinds or MEMBER_KINDS))).orderBy("path", "line", "col")

    # refs
    def _with_from(self, refs: DataFrame, few: bool = False) -> DataFrame:
        """refs with the symbol that each is in. few: refs are bounded by a limit, so their symbols are picked out first."""
        s = self.symbols.select(F.col("id").alias("from_symbol"), F.col("name").alias("from_name"), F.col("qualname").alias("from_qualname"), F.col("kind").alias("from_kind"), F.col("line").alias("from_line"), F.col("path").alias("from_path"))
        if few:
            s = F.broadcast(s.join(F.broadcast(refs.select("from_symbol").distinct()), "from_symbol", "left_semi"))
        return refs.join(s, "from_symbol", "left")

    def callers_of(self, name: str, limit: int = 100_000) -> DataFrame:
        r = self.refs.where((F.col("name") == name) & (F.col("kind") == "call")).orderBy("path", "line", "col").limit(limit)
        return self._with_from(r, True).orderBy("path", "line", "col")

    def caller_count(self, name: str) -> DataFrame:
        return self.refs.where((F.col("name") == name) & (F.col("kind") == "call")).agg(F.count("*").alias("count"))

    def references_of(self, name: str, limit: int = 200_000) -> DataFrame:
        r = self.refs.where(F.col("name") == name).orderBy("path", "line", "col").limit(limit)
        return self._with_from(r, True).orderBy("path", "line", "col")

    def callees_of(self, symbol_id: int) -> DataFrame:
        """Names called in a symbol: first line and first column, each on its own, and how often; with what is called, the best
        definition, functions, methods and macros first."""
        c = self.file_refs.where((F.col("from_symbol") == symbol_id) & (F.col("kind") == "call")).groupBy("name").agg(F.min("line").alias("line"), F.min("col").alias("col"), F.count("*").alias("count"))
        d = self.best_definitions(c, CALLABLE).select("name", F.col("kind").alias("target_kind"), F.col("path").alias("target_path"), F.col("line").alias("target_line"))
        return c.join(d, "name", "left").orderBy("line", "name")

    def reference_files(self, name: str) -> DataFrame:
        calls = F.sum(F.when(F.col("kind") == "call", 1).otherwise(0))
        return self.refs.where(F.col("name") == name).groupBy("path").agg(F.count("*").alias("total"), calls.alias("calls")).orderBy(F.desc("total"), "path")

    def references_in_file(self, name: str, path: str, limit: int = 500) -> DataFrame:
        r = self.file_refs.where((F.col("name") == name) & (F.col("path") == path)).orderBy("line", "col").limit(limit)
        return self._with_from(r, True).select("line", "col", "kind", "from_qualname").orderBy("line", "col")

    def functions_using_all(self, names: list[str], limit: int = 200) -> DataFrame:
        """Symbols whose bodies name all of names, most hits first. A name given twice finds nothing."""
        hit = self.refs.where(F.col("name").isin(*names) & F.col("from_symbol").isNotNull()).groupBy("from_symbol").agg(F.size(F.collect_set("name")).alias("n"), F.count("*").alias("hits"))
        s = self.symbols.withColumnRenamed("id", "from_symbol").select("from_symbol", "name", "qualname", "kind", "path", "line")
        return hit.where(F.col("n") == len(names)).join(s, "from_symbol").orderBy(F.desc("hits"), "path", "line").limit(limit).select("name", "qualname", "kind", "path", "line", "hits")

    def incoming_calls(self, name: str) -> DataFrame:
        """Functions that call name, each with the places of the calls."""
        r = self._with_from(self.refs.where((F.col("name") == name) & (F.col("kind") == "call") & F.col("from_symbol").isNotNull()))
        return r.groupBy("from_symbol", "from_qualname", "from_path", "from_line").agg(F.sort_array(F.collect_list(F.struct("line", "col"))).alias("ranges"), F.count("*").alias("count"))

    def outgoing_calls(self, symbol_id: int) -> DataFrame:
        return self.callees_of(symbol_id).where("target_path is not null")

    def callers_grouped(self, name: str, root: str = "", threshold: int = 24) -> DataFrame:
        """Calling functions by directory; groups matter where there are more callers than threshold."""
        r = self._with_from(self.refs.where((F.col("name") == name) & (F.col("kind") == "call") & F.col("from_symbol").isNotNull()))
        one = r.groupBy("from_symbol", "from_path").agg(F.count("*").alias("count"))
        g = one.groupBy(X.dir_of(F.col("from_path"), root).alias("dir")).agg(F.count("*").alias("size"), F.sum("count").alias("count"))
        return g.crossJoin(F.broadcast(one.agg((F.count("*") > threshold).alias("folded"))))  # one row

    def uses_summary(self, name: str, files_listed: int = 60) -> DataFrame:
        """Files, references and calls of a name, and the references in files beyond those listed."""
        f, none = self.reference_files(name), F.lit(0).cast("long")
        every = f.agg(F.count("*").alias("files"), F.sum("total").alias("refs"), F.sum("calls").alias("calls"), F.sum("total").alias("hidden"))
        listed = f.limit(files_listed).agg((-F.sum("total")).alias("hidden")).select(none.alias("files"), none.alias("refs"), none.alias("calls"), "hidden")
        return every.unionByName(listed).agg(*(F.coalesce(F.sum(c), none).alias(c) for c in every.columns))

    def closest_files(self, name: str, here: str, limit: int = 60) -> DataFrame:
        """Files that use a name, those near `here` first."""
        return self.reference_files(name).withColumn("distance", X.distance(F.col("path"), here)).orderBy("distance", F.desc("total"), "path").limit(limit)

    def member_usage(self, qualname: str) -> DataFrame:
        """References and files of each member's name, and its three most frequent files."""
        m = self.members_of(qualname).select("name").distinct()
        f = self.refs.join(m, "name", "left_semi").groupBy("name", "path").agg(F.count("*").alias("total"))
        w = Window.partitionBy("name").orderBy(F.desc("total"), "path")
        top = f.withColumn("_r", F.row_number().over(w)).groupBy("name").agg(F.sum("total").alias("refs"), F.count("*").alias("files"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= 3, F.struct("_r", X.base_name(F.col("path")).alias("b"))))), lambda x: x["b"])).alias("top_files"))
        return m.join(top, "name", "left").select("name", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("top_files", F.lit("")).alias("top_files"))

    def outline(self, path: str) -> DataFrame:
        """Symbols of a file with the innermost container around each; equal ranges are siblings."""
        s = self.symbols.where(F.col("path") == path).select("id", "name", "kind", "line", "col", "end_line")
        box = s.where(F.col("kind").isin("struct", "class", "union", "enum", "namespace", *FUNCTIONS)).select(*[F.col(c).alias("p_" + c) for c in s.columns])
        inside = (F.col("p_line") <= F.col("line")) & (F.col("p_end_line") >= F.col("end_line")) & ((F.col("p_line") < F.col("line")) | (F.col("p_end_line") > F.col("end_line")))
        j = s.join(box, inside, "left")
        w = Window.partitionBy("id").orderBy(F.desc("p_line"), "p_end_line", F.desc("p_col"))
        return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "kind", "line", "end_line", F.col("p_name").alias("parent"), F.col("p_line").alias("parent_line")).orderBy("line", "name")

    # bases
    def bases_of(self, symbol_id) -> DataFrame:
        """Bases of a class with the class symbol of that name, null if there is none."""
        return self._base_edges(self.bases.where(F.col("symbol_id") == symbol_id)).orderBy("base")

    def _base_edges(self, bases: DataFrame) -> DataFrame:
        c = self.best_classes().select(F.col("name").alias("base"), F.col("id").alias("base_id"), F.col("qualname").alias("base_qualname"))
        return bases.join(c, "base", "left").select("symbol_id", "base", "base_id", "base_qualname")

    def best_classes(self) -> DataFrame:
        s = Store(self.files, self.symbols.where(F.col("kind").isin(*BASE_KINDS)), self.refs)
        return s.best_definitions()

    def derived_of(self, name: str) -> DataFrame:
        b = self.bases.where(F.col("base") == name).select(F.col("symbol_id").alias("id"))
        return self.symbols.join(b, "id").orderBy("name", "path")

    # includes
    def includes_of(self, path: str) -> DataFrame:
        own = self.files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
        return self.resolved_includes(self.includes.join(F.broadcast(own), "file_id")).select("path", "line", "is_system", "resolved").orderBy("line")

    def resolved_includes(self, includes: DataFrame | None = None) -> DataFrame:
        """Each include with the file that it names: the shortest path that ends with '/' and it, ties by path. Joined by base name."""
        i = self.includes if includes is None else includes
        names = i.select("path").distinct().withColumn("_b", F.lower(X.base_name(F.col("path"))))
        f = self.files.select(F.col("path").alias("resolved"), F.lower(F.col("path")).alias("_p"), F.lower(X.base_name(F.col("path"))).alias("_b"))
        j = names.join(f, "_b").where(F.endswith(F.col("_p"), F.concat(F.lit("/"), F.lower("path"))))
        best = j.groupBy("path").agg(F.min_by("resolved", F.struct(F.length("resolved"), "resolved")).alias("resolved"))
        return i.join(best, "path", "left")

    def included_by(self, path: str) -> DataFrame:
        """Files whose includes name the end of path."""
        tail = path.lower()
        i = self.includes.where((F.lower(X.base_name(F.col("path"))) == tail.rsplit("/", 1)[-1]) & F.endswith(F.lit(tail), F.concat(F.lit("/"), F.lower("path"))))
        return i.select("file_id", "line").join(self.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "line").orderBy("path", "line")


def removed_files(known: DataFrame, present: DataFrame) -> DataFrame:
    return known.join(present.select("path"), "path", "left_anti")


def changed_files(known: DataFrame, present: DataFrame) -> DataFrame:
    """Files that are new or differ in time or size."""
    return present.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def not_excluded(files: DataFrame, excluded: list[str]) -> DataFrame:
    """Files neither equal to nor under one of the excluded paths, whatever their case. The list is part of the settings."""
    p = F.lower(X.normalize_path(F.col("path")))
    out = files
    for x in excluded:
        x = x.replace("\\", "/").rstrip("/").lower()
        out = out.where((p != x) & ~p.startswith(x + "/"))
    return out


def latest_events(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
