"""Runs of stages that resume: each stage's table stands in the shared folder with a manifest, and a run goes on from the last good ones.

A stage names what it needs, so that stages which don't need each other run side by side, as Spark jobs from threads of
the driver; what they compute is Spark's alone. A table counts once its manifest is written, which is the last thing a stage does: a run that
breaks off, at whatever point, leaves either a whole stage or none. A stage is done again if its own version, or anything it needs, has
changed since its manifest was written. An optional stage that fails gives an empty table and a row in the log; another one ends the run,
once the stages beside it are done.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]
_MANIFEST = "stage string, print string, table string, columns string, n_rows long, seconds double, error string, written_at timestamp"


@dataclass(frozen=True)
class Stage:
    """``run`` makes the stage's table from those that it needs. ``empty`` is the schema of what an optional stage gives if it fails."""

    name: str
    needs: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    version: str = "1"
    empty: str | None = None


class Broken(RuntimeError):
    """A run that a stage ended: what failed, by stage. Running it again goes on from what is there."""

    def __init__(self, errors: dict[str, str]) -> None:
        super().__init__("; ".join(f"{k}: {v}" for k, v in errors.items()))
        self.errors = errors


@dataclass
class Run:
    """Stages in a folder that driver and executors share. ``prints`` names the inputs' versions; another version makes what needs it anew."""

    spark: SparkSession
    folder: str
    stages: Sequence[Stage]
    side_by_side: int = 4
    made: list[str] = field(default_factory=list)

    def _manifests(self) -> dict[str, dict]:
        """The newest manifest of each stage; none where the folder is new."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests/*").orderBy("written_at").collect()  # a row a stage and run
        return {r["stage"]: r.asDict() for r in rows}

    def _note(self, **row: object) -> None:
        from datetime import datetime, timezone

        row["written_at"] = datetime.now(timezone.utc)
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        self.spark.createDataFrame([tuple(row.get(c) for c in names)], _MANIFEST).coalesce(1).write.json(f"{self.folder}/manifests/{row['stage']}-{uuid.uuid4().hex}")  # a folder each: writers side by side don't meet

    def _done(self, stage: Stage, tables: Tables, stamp: str) -> DataFrame:
        began, path, error = time.time(), f"{self.folder}/{stage.name}-{uuid.uuid4().hex}", None
        try:
            stage.run(tables).write.parquet(path)
        except Exception as e:  # noqa: BLE001  whatever a stage raises is its error
            error = f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"
            if stage.empty is None:
                self._note(stage=stage.name, print="", error=error, seconds=time.time() - began)
                raise
            self.spark.createDataFrame([], stage.empty).write.parquet(path)
        table = self.spark.read.parquet(path)
        # a failed optional stage has no print, so the next run tries it again
        self._note(stage=stage.name, print="" if error else stamp, table=path, columns=",".join(table.columns), n_rows=table.count(), seconds=time.time() - began, error=error)
        self.made.append(stage.name)
        return table

    def execute(self, inputs: Tables, prints: dict[str, str]) -> Tables:
        """All tables by name, the inputs among them; ``made`` then names the stages that were done in this run."""
        self.made.clear()
        by_name = {s.name: s for s in self.stages}
        order = TopologicalSorter({s.name: [n for n in s.needs if n in by_name] for s in self.stages})
        order.prepare()
        tables, stamps, errors, known = dict(inputs), dict(prints), {}, self._manifests()
        with ThreadPoolExecutor(self.side_by_side) as pool:
            running: dict[Future, str] = {}
            while order.is_active():
                for name in order.get_ready() if not errors else ():
                    stage = by_name[name]
                    stamps[name] = hashlib.sha256("|".join([name, stage.version, *(f"{n}={stamps[n]}" for n in stage.needs)]).encode()).hexdigest()
                    old = known.get(name)
                    if old and old["print"] == stamps[name]:
                        tables[name] = self.spark.read.parquet(old["table"])
                        order.done(name)
                    else:
                        running[pool.submit(self._done, stage, {n: tables[n] for n in stage.needs}, stamps[name])] = name
                if not running:
                    if errors:
                        break
                    continue
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(f)
                    if f.exception() is None:
                        tables[name] = f.result()
                        order.done(name)
                    else:
                        errors[name] = f"{type(f.exception()).__name__}: {f.exception()}"[:300]
        if errors:
            raise Broken(errors)
        return tables

    def log(self) -> DataFrame:
        """(stage, n_rows, seconds, error, written_at): what every stage of every run came to."""
        return self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests/*").select("stage", "n_rows", "seconds", "error", "written_at")


def annotation_stages(labels: DataFrame, classes: DataFrame) -> list[Stage]:
    """The annotation of documents ("documents": doc_id, text) as stages: text, sentences, annotations, individuals and properties side by side, then what each document has of them."""
    from pyspark.sql import functions as F

    from lexspan.operators import sentences
    from lexspan.plans import annotate, stages

    def summary(t: Tables) -> DataFrame:
        out = t["text"].select("doc_id", F.length("text").cast("long").alias("n_chars"))
        for name in ("sentences", "annotations", "individuals"):
            out = out.join(t[name].groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "doc_id", "left")
        return out.na.fill(0)

    return [
        Stage("text", ("documents",), lambda t: annotate.canonical(t["documents"])),
        Stage("sentences", ("text",), lambda t: sentences.split(t["text"], sentences.learned(t["text"]))),
        Stage("annotations", ("text",), lambda t: annotate.annotated(t["text"], labels)),
        Stage("individuals", ("text",), lambda t: stages.early_individuals(t["text"], classes)),
        Stage("summary", ("text", "sentences", "annotations", "individuals"), summary),
    ]
