"""Keeping a project in line with its trees by micro-batches of file events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.store import changed_files, latest_events
from lattica.sources.code import FILES, Project, parse, scan

EVENTS = "event_id long, op string, id long, path string, mtime long, size long, lang string"


def changes(project: Project, roots: list[str], event_id: int) -> DataFrame:
    """EVENTS that lead from a project's tables to what is on disk now: a source of events where nothing reports them."""
    present, old = scan(project.spark, roots, project.settings.header_lang), project.store()
    known = old.files if old is not None else project.spark.createDataFrame([], FILES)
    new = changed_files(known, present).withColumn("op", F.lit("upsert"))
    gone = known.join(present, "path", "left_anti").withColumn("op", F.lit("delete"))
    return new.unionByName(gone).select(F.lit(event_id).cast("long").alias("event_id"), "op", "id", "path", "mtime", "size", "lang")


def apply_events(project: Project, events: DataFrame) -> None:
    """Takes the last event of each path ('upsert' or 'delete'); files whose time and size are known already are left alone."""
    last = latest_events(events, "path", ["event_id"]).persist()
    old = project.store()
    new = last.where("op <> 'delete'")
    if old is not None:
        new = new.join(old.files.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
    new = new.select("id", "path", "mtime", "size", "lang").persist()
    gone = last.where("op = 'delete'").select("path").union(new.select("path"))
    if gone.limit(1).count():
        rows = parse(new, project.settings).persist()
        project.replace(gone, new, rows)
        rows.unpersist()
    new.unpersist()
    last.unpersist()


def follow(project: Project, events: DataFrame, checkpoint: str, trigger: dict | None = None, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Applies a stream of EVENTS, batch after batch; the trigger's interval takes the place of a debounce."""

    def batch(df: DataFrame, number: int) -> None:
        apply_events(project, df)
        if then:
            then(number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()
