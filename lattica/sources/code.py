"""Source trees as tables: scanning, reading, parsing in parallel, and buckets of Parquet behind a manifest.

A project's tables are dealt into buckets by file. A sync parses only what is new or changed and writes only the buckets of those
files, as a new generation (<table>/gen-N/bucket=K); then it swaps manifest.json, which names the generation of each bucket, so
readers see whole states. Files of the last generations stay, so that tables which are being read stay whole. The folder is on any
file system that Hadoop knows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.exprs import EXTENSIONS
from lattica.operators.store import Store, changed_files, not_excluded
from lattica.sources.cparse import index_text
from lattica.sources.shared import hadoop_path

SCHEMA_VERSION = "8"
#: Buckets of a new project; generations of a bucket that stay besides the current one.
BUCKETS, OLD_GENERATIONS = 16, 3
EXTERNAL_LIMIT = 50_000
# Folders that scans do not enter, by default and in external trees.
EXCLUDED = (".git", "node_modules", "build", "out", "dist", ".cache")
EXTERNAL_EXCLUDED = (".git", "node_modules")

FILES = "id long, path string, mtime long, size long, lang string"
RECORDS = "rec string, id long, file_id long, path string, name string, qualname string, kind string, line int, col int, end_line int, signature string, seq int, from_symbol long, is_system boolean, error string"
COLUMNS = {c.split()[0]: {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in RECORDS.split(", ")}
#: Rows that a task turns into one Arrow batch.
BATCH_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    """What changes the rows of a file."""

    header_lang: str = "cpp"
    index_references: bool = True
    ignore_macros: tuple[str, ...] = ()
    encoding: str = "utf-8"

    def mark(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def stable_id(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "little", signed=True)


def lang_of(path: str, header_lang: str = "cpp") -> str | None:
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return header_lang if ext == "h" else EXTENSIONS.get(ext)


def glob_pattern(glob: str) -> str:
    """A regular expression for paths below a root: '**/' any folders, '*' and '?' within a name, '{a,b}' either."""
    signs = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    return "".join(signs.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|.", glob))


def walk(folder: str, root: str, header_lang: str, excluded: tuple[str, ...], include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), deep: bool = True):
    """(id, path, mtime in ms, size, lang) of source files in a folder and, if deep, in those below; see scan()."""
    wanted, unwanted = (re.compile("|".join(map(glob_pattern, g)) or "$.") for g in (include, exclude))
    for at, dirs, names in os.walk(folder, onerror=lambda _: None):
        dirs[:] = sorted(d for d in dirs if d not in excluded) if deep else []
        for n in sorted(names):
            path = f"{at}/{n}".replace("\\", "/")
            below = path[len(root) :].lstrip("/")
            lang = lang_of(path, header_lang)
            if lang is None or include and not wanted.fullmatch(below) or unwanted.fullmatch(below):
                continue
            try:
                s = os.stat(path)
            except OSError:
                continue
            yield stable_id(path), path, int(s.st_mtime * 1000), s.st_size, lang


def scan(spark: SparkSession, roots: list[str], header_lang: str = "cpp", excluded: tuple[str, ...] = EXCLUDED, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """FILES of the source files under roots, which tasks walk through, a folder below a root each.

    Folders named in `excluded` are not entered, nor those that cannot be read. include, exclude: globs of paths below a root; limit:
    how many files a root gives at most, by path.
    """
    names = [c.split()[0] for c in FILES.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    top = []
    for root in roots:
        below = sorted(e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and e.name not in excluded) if os.path.isdir(root) else []
        top += [(root, root, False), *((root, f, True) for f in below)]

    def run(batches):
        for batch in batches:
            for root, folder, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(walk(folder, root, header_lang, excluded, include, exclude, deep))
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([root] * len(rows), pa.string())], [*names, "root"])

    folders = spark.createDataFrame(top, "root string, folder string, deep boolean")
    found = folders.repartition(max(1, min(len(top), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, FILES + ", root string")
    if limit:
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy("path"))).where(F.col("_r") <= limit)
    return found.select(*names).dropDuplicates(["id"])


def external_files(spark: SparkSession, roots: list[str], header_lang: str = "cpp") -> DataFrame:
    return scan(spark, roots, header_lang, EXTERNAL_EXCLUDED, limit=EXTERNAL_LIMIT)


class Rows:
    """Rows of RECORDS in columns."""

    def __init__(self):
        self.columns: dict[str, list] = {c: [] for c in COLUMNS}
        self.n = 0

    def add(self, count: int, **columns) -> None:
        """count rows; what is no list is the same in all of them."""
        for c, held in self.columns.items():
            x = columns.get(c)
            held.extend(x if isinstance(x, list) else [x] * count)
        self.n += count

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, COLUMNS[c]) for c, x in self.columns.items()], list(COLUMNS))
        self.__init__()
        return out


def add_file(rows: Rows, path: str, lang: str, text: str, settings: Settings) -> None:
    """All rows of one file."""
    x, own = index_text(text, lang, list(settings.ignore_macros), settings.index_references), {"file_id": stable_id(path), "path": path}
    s, r = x.symbols, x.refs
    ids = [stable_id(path, y.at, y.end, y.kind, y.qualname) for y in s]
    pick = lambda found, *names: {n: [getattr(y, n) for y in found] for n in names}
    rows.add(len(s), rec="symbol", id=ids, **own, **pick(s, "name", "qualname", "kind", "line", "col", "end_line", "signature"))
    rows.add(len(r), rec="ref", **own, seq=list(range(len(r))), from_symbol=[ids[y.owner] if y.owner >= 0 else None for y in r], **pick(r, "name", "kind", "line", "col"))
    rows.add(len(x.bases), rec="base", **own, id=[ids[k] for k, _ in x.bases], name=[b for _, b in x.bases])
    rows.add(len(x.includes), rec="include", **own, name=[p for p, _, _ in x.includes], line=[n for _, n, _ in x.includes], is_system=[y for _, _, y in x.includes])


def parse(files: DataFrame, settings: Settings) -> DataFrame:
    """Rows of RECORDS for files (path, lang); a file that cannot be read or decoded has one row of rec 'error'. Texts may come along
    in a column `text`; else tasks read the paths, which have to be on a file system that all executors share."""
    with_text = "text" in files.columns

    def run(batches):
        rows = Rows()
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    text = row["text"] if with_text else Path(row["path"]).read_bytes().decode(settings.encoding, "replace")
                    add_file(rows, row["path"], row["lang"], text or "", settings)
                except (OSError, LookupError, RecursionError) as error:
                    rows.add(1, rec="error", file_id=stable_id(row["path"]), path=row["path"], error=f"{type(error).__name__}: {error}")
                if rows.n >= BATCH_ROWS:
                    yield rows.batch()
        if rows.n:
            yield rows.batch()

    return files.select("path", "lang", *(["text"] if with_text else [])).mapInArrow(run, RECORDS)


def split(files: DataFrame, rows: DataFrame) -> Store:
    """The store's tables of parsed rows."""
    return Store(
        files,
        rows.where("rec = 'symbol'").select("id", "file_id", "path", "name", "qualname", "kind", "line", "col", "end_line", "signature"),
        rows.where("rec = 'ref'").select("file_id", "path", "seq", "name", "kind", "line", "col", "from_symbol"),
        rows.where("rec = 'base'").select(F.col("id").alias("symbol_id"), F.col("name").alias("base"), "file_id"),
        rows.where("rec = 'include'").select("file_id", F.col("name").alias("path"), "line", "is_system"),
    )


#: Tables with the column of the file's id and the order inside a bucket.
TABLES = {"files": ("id", "path"), "symbols": ("file_id", "name"), "refs": ("file_id", "name"), "bases": ("file_id", "base"), "includes": ("file_id", "path"), "errors": ("file_id", "path")}
ERRORS = "file_id long, path string, error string"


class Project:
    """Tables of a code base in a folder."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.settings, self.buckets = spark, str(folder).rstrip("/"), settings or Settings(), buckets
        self.fs, self.top = hadoop_path(spark, self.folder)
        self.fs.mkdirs(self.top)
        empty = split(spark.createDataFrame([], FILES), spark.createDataFrame([], RECORDS))
        self.schemas = {t: spark.createDataFrame([], ERRORS).schema if t == "errors" else getattr(empty, t).schema for t in TABLES}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def manifest(self) -> dict:
        """What is current; a manifest that cannot be read or has another schema version counts as none."""
        path = self._path("manifest.json")
        if not self.fs.exists(path):
            return {}
        stream = self.fs.open(path)
        try:
            found = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        except ValueError:
            return {}
        finally:
            stream.close()
        return found if found.get("schema_version") == SCHEMA_VERSION else {}

    def _table(self, manifest: dict, t: str, buckets: set[int] | None = None) -> DataFrame:
        """A table of a manifest, or some buckets of it."""
        paths = [f"{self.folder}/{t}/gen-{g}/bucket={k}" for k, g in manifest["tables"][t].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(self.schemas[t]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[t])

    def store(self) -> Store | None:
        m = self.manifest()
        return Store(*(self._table(m, t) for t in TABLES if t != "errors")) if m else None

    def errors(self) -> DataFrame:
        """(file_id, path, error) of files that could not be read."""
        m = self.manifest()
        return self._table(m, "errors") if m else self.spark.createDataFrame([], ERRORS)

    def _bucket(self, column: str, n: int):
        return F.pmod(F.col(column), F.lit(n)).cast("int")

    def replace(self, gone: DataFrame, files: DataFrame, rows: DataFrame, anew: bool = False) -> Store:
        """Drops all rows of the paths in `gone` and adds those of files; only the buckets of both are written. anew: nothing is
        carried over."""
        old = {} if anew else self.manifest()
        n = old.get("buckets", self.buckets)
        g = self.manifest().get("generation", 0) + 1
        new = {t: rows.where("rec = 'error'").select("file_id", "path", "error") if t == "errors" else getattr(split(files, rows), t) for t in TABLES}
        ids = files.select(F.col("id").alias("file_id"))
        if old:
            lost = gone.select("path").join(self._table(old, "files"), "path").select(F.col("id").alias("file_id"))
            ids = ids.unionByName(lost)
        touched = {r.b for r in ids.select(self._bucket("file_id", n).alias("b")).distinct().collect()}
        tables = {}
        for t, (key, order) in TABLES.items():
            df = new[t]
            if old:
                df = self._table(old, t, touched).join(ids.withColumnRenamed("file_id", key).distinct(), key, "left_anti").select(*df.columns).unionByName(df)
            dealt = df.withColumn("bucket", self._bucket(key, n)).repartition(min(n, max(1, len(touched))), "bucket").sortWithinPartitions("bucket", order)
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{t}/gen-{g}")
            written = [x.getPath().getName() for x in self.fs.listStatus(self._path(t, f"gen-{g}"))]
            kept = {k: x for k, x in old.get("tables", {}).get(t, {}).items() if int(k) not in touched}
            tables[t] = kept | {x.split("=")[1]: g for x in written if x.startswith("bucket=")}
        self._swap({"schema_version": SCHEMA_VERSION, "generation": g, "buckets": n, "settings": self.settings.mark(), "tables": tables})
        self._clean(g, tables)
        return self.store()

    def _swap(self, manifest: dict) -> None:
        jvm = self.spark._jvm
        new, to = self._path("manifest.tmp"), self._path("manifest.json")
        out = self.fs.create(new, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        qualified = self.fs.makeQualified(to)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(new), qualified, how)

    def _clean(self, generation: int, tables: dict) -> None:
        """Deletes buckets of old generations that the manifest does not name any more."""
        for t, named in tables.items():
            for gen in self.fs.listStatus(self._path(t)):
                g = int(gen.getPath().getName().split("-")[1])
                if g > generation - OLD_GENERATIONS:
                    continue
                stay = {int(k) for k, x in named.items() if x == g}
                if not stay:
                    self.fs.delete(gen.getPath(), True)
                    continue
                for b in self.fs.listStatus(gen.getPath()):
                    name = b.getPath().getName()
                    if name.startswith("bucket=") and int(name.split("=")[1]) not in stay:
                        self.fs.delete(b.getPath(), True)

    def sync(self, roots: list[str], external: list[str] = (), excluded: list[str] = (), force: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Store:
        """Brings the tables in line with the trees: drops what vanished or is excluded, parses what is new or changed. force, or
        other settings than before, parses all. include, exclude: globs of paths below the roots."""
        lang = self.settings.header_lang
        found = scan(self.spark, list(roots), lang, include=include, exclude=exclude)
        if external:
            found = found.unionByName(external_files(self.spark, list(external), lang)).dropDuplicates(["id"])
        present = not_excluded(found, list(excluded)).persist()
        try:
            old = self.store()
            if old is None or force or self.manifest().get("settings") != self.settings.mark():
                return self._parsed(present, present.select("path"), True)
            todo = changed_files(old.files, present).select(*present.columns)
            vanished = old.files.join(present, "path", "left_anti").select("path")
            if not todo.limit(1).count() and not vanished.limit(1).count():
                return old
            return self._parsed(todo, vanished.union(todo.select("path")))
        finally:
            present.unpersist()

    def _parsed(self, todo: DataFrame, gone: DataFrame, anew: bool = False) -> Store:
        todo = todo.repartition(max(1, min(self.spark.sparkContext.defaultParallelism * 4, todo.count())), "path")
        rows = parse(todo, self.settings).persist()
        try:
            return self.replace(gone, todo, rows, anew)
        finally:
            rows.unpersist()

    def index_text(self, path: str, text: str, mtime: int = 0) -> Store:
        lang = lang_of(path, self.settings.header_lang)
        files = self.spark.createDataFrame([(stable_id(path), path, mtime, len(text.encode()), lang)], FILES)
        return self.replace(files.select("path"), files, parse(files.withColumn("text", F.lit(text)), self.settings))

    def remove_file(self, path: str) -> Store:
        gone = self.spark.createDataFrame([(path,)], "path string")
        return self.replace(gone, self.spark.createDataFrame([], FILES), self.spark.createDataFrame([], RECORDS))

    def clear(self) -> Store:
        return self.replace(self.spark.createDataFrame([], "path string"), self.spark.createDataFrame([], FILES), self.spark.createDataFrame([], RECORDS), True)
