"""Projects over the driver's tables, as views: a text project, a star project with call edges, and web includes.

Each has the tables that the store works on, so the same queries run on them and on parsed code. Like an index, the tables of a
project are written once, sorted by what they are looked up by, and used by all queries of an application while the inputs stay as
they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.operators.store import Store
from lattica.sources.shared import folder, hadoop_path

TEXT_KINDS = ("function", "prototype", "macro", "struct", "variable", "field")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(spark: SparkSession, sf_dir: str, inputs: tuple[str, ...], name: str, make: Callable[[], DataFrame], *by: str, spread: bool = True) -> DataFrame:
    """make() as Parquet in the shared folder, in ranges of the columns `by`; written when first asked for, and anew when an input was.
    spread=False: rows stay in the partitions that they come in, sorted in each, without a shuffle."""
    mark = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir}".encode())
    for t in inputs:
        fs, path = hadoop_path(spark, f"{sf_dir}/{t}.parquet")
        at = fs.getFileStatus(path)
        mark.update(f" {t} {at.getModificationTime()} {fs.getContentSummary(path).getLength()}".encode())
    place = f"{folder(spark)}/projects/{mark.hexdigest()[:20]}/{name}"
    fs, done = hadoop_path(spark, f"{place}/_SUCCESS")
    if not fs.exists(done):
        df = make()
        df = df.repartitionByRange(*by) if by and spread else df
        (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, line, txt): lines of documents, numbered from 0."""
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.col("doc_id").alias("file_id"), path.alias("path"), "source", F.posexplode(F.split("text", "\r?\n")).alias("line", "txt"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, text) of documents."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return read(spark, sf_dir, "documents").select(path.alias("path"), "lang", "text")


def line_id(file_id, line):
    return file_id * 1_000_000 + line


def text_store(spark: SparkSession, sf_dir: str) -> Store:
    """Documents as files; each line with an identifier as a symbol named by its first one; identifiers as references, the
    first of a line as a call, all from the line's symbol. Kinds go round by line."""
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = d.select(F.col("doc_id").alias("id"), path.alias("path"), F.lit(0).cast("long").alias("mtime"), F.col("n_chars").alias("size"), "lang")
    t = text_lines(spark, sf_dir).withColumn("names", F.regexp_extract_all("txt", F.lit(f"({X.IDENTIFIER})"), 1)).where(F.size("names") > 0)
    i = line_id(F.col("file_id"), F.col("line"))
    kind = F.get(F.array(*map(F.lit, TEXT_KINDS)), F.pmod(F.col("line"), F.lit(len(TEXT_KINDS))))
    name = F.get("names", F.lit(0))
    symbols = t.select(i.alias("id"), "file_id", "path", name.alias("name"), F.concat("source", F.lit("::"), name).alias("qualname"), kind.alias("kind"), "line", F.lit(0).alias("col"), (F.col("line") + F.pmod(F.length("txt"), F.lit(4))).alias("end_line"), X.collapse(F.col("txt"), 40).alias("signature"))
    refs = t.select("file_id", "path", "line", i.alias("from_symbol"), F.posexplode("names").alias("col", "name")).withColumns({"kind": F.when(F.col("col") == 0, "call").otherwise("ref"), "seq": F.col("col")})
    includes = d.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.concat((F.col("doc_id") + 20).cast("string"), F.lit(".txt"))).alias("path"), F.lit(0).alias("line"), F.lit(False).alias("is_system"))
    own = lambda n, df, *by, spread=True: kept(spark, sf_dir, ("documents",), f"text-{n}", lambda: df, *by, spread=spread)
    by_file = own("refs_by_file", refs, "path", "line", "col", spread=False)
    return Store(own("files", files, "path"), own("symbols", symbols, "name", "path", "line"), own("refs", by_file, "name", "path", "line"), None, own("includes", includes), by_file)


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, count, line): customers call the parts they order, parts call their suppliers."""
    return kept(spark, sf_dir, ("lineitem", "orders"), "star-edges", lambda: _star_edges(spark, sf_dir), "src", "dst")


def _star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cp = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("count"), F.min("l_linenumber").alias("line"))
    ps = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("count"), F.min("l_linenumber").alias("line"))
    name = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    return cp.select(name("c:", "o_custkey").alias("src"), name("p:", "l_partkey").alias("dst"), "count", "line").unionByName(ps.select(name("p:", "l_partkey").alias("src"), name("s:", "l_suppkey").alias("dst"), "count", "line"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, count, line): nations call the three nations that their suppliers sell most line items to, and themselves."""
    return kept(spark, sf_dir, ("lineitem", "orders", "customer", "supplier"), "trade-edges", lambda: _trade_edges(spark, sf_dir))


def _trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sold = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = sold.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count("*").alias("count"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("count"), "b"))).where("r <= 3 or a = b")
    name = lambda x: F.concat(F.lit("n:"), F.col(x).cast("string"))
    return top.select(name("a").alias("src"), name("b").alias("dst"), "count", F.col("r").alias("line"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, kind, dir) of nations."""
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("function").alias("kind"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dir"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, kind, dir): customers, parts and suppliers; parts are functions, suppliers macros."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("dir"))
    c = read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"), F.lit("function").alias("kind"), "dir")
    s = read(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"), F.lit("macro").alias("kind"), "dir")
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.lit("function").alias("kind"), F.col("p_brand").alias("dir"))
    return c.unionByName(p).unionByName(s)


def star_bases(spark: SparkSession, sf_dir: str) -> Store:
    """Customers derive from their nation, nations from their region, which derive from a base that nobody defines."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    row = lambda i, name, qual, path: (i.cast("string").alias("id"), name.alias("name"), qual.alias("qualname"), F.lit("class").alias("kind"), path.alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(0).alias("end_line"))
    s = r.select(*row(F.concat(F.lit("r:"), "r_regionkey"), F.col("r_name"), F.col("r_name"), F.lit("world")))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.unionByName(nr.select(*row(F.concat(F.lit("n:"), "n_nationkey"), F.col("n_name"), F.concat_ws("::", "r_name", "n_name"), F.col("r_name"))))
    s = s.unionByName(c.join(nr, F.col("c_nationkey") == F.col("n_nationkey")).select(*row(F.concat(F.lit("c:"), "c_custkey"), F.col("c_name"), F.concat_ws("::", "r_name", "n_name", "c_name"), F.concat_ws("/", "r_name", "n_name"))))
    b = nr.select(F.concat(F.lit("n:"), "n_nationkey").alias("symbol_id"), F.col("r_name").alias("base"))
    b = b.unionByName(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c:"), "c_custkey").alias("symbol_id"), F.col("n_name").alias("base")))
    b = b.unionByName(r.select(F.concat(F.lit("r:"), "r_regionkey").alias("symbol_id"), F.lit("World").alias("base")))
    return Store(n, s, n, b)


def web_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, raw): values of href attributes of pages."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("raw"))
