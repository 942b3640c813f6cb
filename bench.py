"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Like an index, a project's tables are built first (build_* entries, part of the total) and then used by the queries.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
HEADLINE = ("reference_files", "kind_counts", "find_definitions", "best_definitions", "search_symbols", "references_of", "callers_of", "functions_using_all", "member_usage", "enclosing_functions", "resolve_include", "call_graph_edges", "class_graph", "dedup_events")
#: Files of the generated tree: about a million lines.
FILES = 3_520


def tree(top: str) -> int:
    """Writes C files; their lines."""
    lines = 0
    for k in range(FILES):
        text = f'#include "h{k % 20}.h"\n#define LIMIT_{k} {k}\ntypedef struct s{k} {{ int a; int b; }} s{k}_t;\nstatic int g{k} = 0;\n'
        text += "".join(f"int f{k}_{n}(s{k}_t *p, int x)\n{{\n    int y = f{(k * 7 + n) % FILES}_{(n + 1) % 40}(p, x + {n});\n    if (y > LIMIT_{k})\n        g{k} += p->a * y;\n    return helper(y, p->b);\n}}\n" for n in range(40))
        lines += text.count("\n")
        Path(top, f"d{k % 64}").mkdir(exist_ok=True)
        Path(top, f"d{k % 64}", f"f{k}.c").write_text(text)
    return lines


def main() -> None:
    from pyspark.sql import SparkSession

    from lattica.catalog import QUERIES
    from lattica.sources import projects
    from lattica.sources.code import Project

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").count().collect()  # the JVM is warm then
    seconds = {}

    def timed(name, f):
        t = time.time()
        f()
        seconds[name] = round(time.time() - t, 3)

    timed("build_text_store", lambda: projects.text_store(spark, sf_dir))
    timed("build_star_edges", lambda: projects.star_edges(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    with tempfile.TemporaryDirectory() as top:
        lines = tree(f"{top}")
        project = Project(spark, f"{top}/.db")
        timed("index_tree", lambda: project.sync([top]))
        timed("sync_unchanged", lambda: project.sync([top]))
        Path(top, "d0", "f0.c").write_text("int changed(void) { return 1; }\n")
        timed("sync_one_file", lambda: project.sync([top]))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "index_lines": lines, "index_lines_per_second": round(lines / seconds["index_tree"])}))
    spark.stop()


if __name__ == "__main__":
    main()
