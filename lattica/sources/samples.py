"""A C and C++ project made from the driver's tables, so that parsed code can be compared with SQL: a C file for each supplier, a header
and a C file for each nation, a C++ file for each region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import resolve as R
from lattica.operators.store import Store
from lattica.sources import projects as P
from lattica.sources.code import Settings, parse, split

SUPPLIER = """#include "parts/n{N}.h"
#include <stdio.h>
#define LIMIT_{K} 10
typedef struct box_{K} { int wide; long high; } box_{K}_t;
enum tone_{K} { DARK_{K}, PALE_{K} = 4 };
int area_{K}(struct box_{K} *b, int times);
static int seen_{K} = 0;
/* what it counts */
int area_{K}(struct box_{K} *b, int times)
{
    int sum = times;
    seen_{K} += b->wide;
    sum += scale_{N}(b->high, LIMIT_{K});
    return sum;
}
int twice_{K}(struct box_{K} *b) { return area_{K}(b, 2) + area_{K}(b, 1); }
"""
HEADER = "#pragma once\nint scale_{N}(int x, int y);\n"
NATION = '#include "n{N}.h"\nint scale_{N}(int x, int y) { return x * y; }\n'
REGION = """namespace geo_{R} {
class Base_{R} {
public:
  void run_{R}();
  int size_{R};
};
class Land_{R} : public Base_{R}, private Other<int> {
  int size_{R};
};
union Either_{R} { int whole; float part; };
}
void geo_{R}::Base_{R}::run_{R}() { scale_00(size_{R}, 1); }
"""


def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, mtime, size, lang, text) of the files."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    s = P.read(spark, sf_dir, "supplier").select(pad("s_suppkey", 6).alias("k"), pad("s_nationkey", 2).alias("n"))
    n = P.read(spark, sf_dir, "nation").select(pad("n_nationkey", 2).alias("n"))
    r = P.read(spark, sf_dir, "region").select(pad("r_regionkey", 1).alias("r"))

    def files(df: DataFrame, head: str, key: str, tail: str, lang: str, text: str) -> DataFrame:
        body = F.lit(text)
        for c in df.columns:
            body = F.replace(body, F.lit("{" + c.upper() + "}"), F.col(c))
        return df.select(F.concat(F.lit(head), F.col(key), F.lit(tail)).alias("path"), F.lit(lang).alias("lang"), body.alias("text"))

    every = files(s, "app/s", "k", ".c", "c", SUPPLIER).unionByName(files(n, "parts/n", "n", ".h", "cpp", HEADER)).unionByName(files(n, "parts/n", "n", ".c", "c", NATION)).unionByName(files(r, "geo/r", "r", ".cpp", "cpp", REGION))
    return every.select(F.xxhash64("path").alias("id"), "path", F.lit(0).cast("long").alias("mtime"), F.length("text").cast("long").alias("size"), "lang", "text")


@dataclass
class Code:
    """A parsed project: its store, locals, resolved occurrences and texts."""

    store: Store
    local: DataFrame
    resolved: DataFrame
    texts: DataFrame


def code(spark: SparkSession, sf_dir: str) -> Code:
    own = lambda n, make, *by: P.kept(spark, sf_dir, ("supplier", "nation", "region"), f"code-{n}", make, *by)
    texts = own("texts", lambda: code_texts(spark, sf_dir), "path")
    rows = own("rows", lambda: parse(texts, Settings()))
    store = split(texts.drop("text"), rows)
    store = Store(store.files, own("symbols", lambda: store.symbols, "name", "path"), own("refs", lambda: store.refs, "name", "path"), store.bases, store.includes)
    local = own("locals", lambda: R.scope_tables(texts)[0], "path")
    resolved = own("resolved", lambda: R.resolve(store, local, R.scope_tables(texts)[1]), "path", "line")
    return Code(store, local, resolved, texts)
