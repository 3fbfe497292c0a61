"""Benchmark samples: scan with checks, judged ids against an index, counts, annotation rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SAMPLE = (
    "id string, split string, task string, query string, language string, difficulty string, retrieval_k int, relevance array<struct<evidence_id:string,grade:int,required:boolean,rationale:string>>, "
    "coverage_groups array<struct<name:string,evidence_ids:array<string>,min_hits:int>>, expected_limitations array<string>, tags array<string>, annotation struct<status:string,method:string,reviewer:string,reviewed_at:string>"
)
#: Fixed values that a sample may have.
SPLITS, TASKS, DIFFICULTIES, STATUSES = ("dev", "test"), ("exact_law", "case_search", "compare", "risk"), ("easy", "medium", "hard"), ("draft", "silver", "gold")


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def problems(samples: DataFrame) -> DataFrame:
    """samples with an array of what is wrong with each (V5); a sound sample's is empty."""
    ids = F.transform("relevance", lambda r: r["evidence_id"])
    required = F.transform(F.filter("relevance", lambda r: r["required"]), lambda r: r["evidence_id"])
    groups = F.coalesce("coverage_groups", F.array().cast("array<struct<name:string,evidence_ids:array<string>,min_hits:int>>"))
    gold = F.coalesce(F.col("annotation.status") == "gold", F.lit(False))
    one_of = lambda column, values: ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    checks = {
        "id is blank": _blank(F.col("id")),
        "query is blank": _blank(F.col("query")),
        "split is unknown": one_of("split", SPLITS),
        "task is unknown": one_of("task", TASKS),
        "difficulty is unknown": one_of("difficulty", DIFFICULTIES),
        "annotation status is unknown": one_of("annotation.status", STATUSES),
        "retrieval_k is not 1 to 50": ~F.coalesce(F.col("retrieval_k").between(1, 50), F.lit(False)),
        "relevance is empty": F.coalesce(F.size("relevance"), F.lit(0)) < 1,
        "a grade is not 1 to 3": F.exists("relevance", lambda r: ~F.coalesce(r["grade"].between(1, 3), F.lit(False))),
        "an evidence id is blank": F.exists("relevance", lambda r: _blank(r["evidence_id"])),
        "an evidence id is judged twice": F.size(F.array_distinct(ids)) < F.size(ids),
        "a coverage group is unjudged": F.exists(groups, lambda g: F.size(F.array_except(g["evidence_ids"], ids)) > 0),
        "a coverage group's min_hits is out of range": F.exists(groups, lambda g: ~F.coalesce(g["min_hits"].between(1, F.size(g["evidence_ids"])), F.lit(False))),
        "a coverage group of one is not required": F.exists(groups, lambda g: (F.size(g["evidence_ids"]) == 1) & ~F.arrays_overlap(g["evidence_ids"], required)),
        "gold needs a reviewer": gold & _blank(F.col("annotation.reviewer")),
        "gold needs a date": gold & F.try_to_date(F.col("annotation.reviewed_at"), "yyyy-MM-dd").isNull(),
    }
    return samples.withColumn("problems", F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()))))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Checked samples of a line-delimited file; reading a wrong one fails and names its place."""
    from ..sources.jsonl import parse_lines, read_lines

    checked = problems(parse_lines(read_lines(spark, path), SAMPLE))
    place = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.array_join("problems", "; "))
    sound = F.when(F.size("problems") > 0, F.raise_error(place).cast("string")).otherwise(F.col("id"))
    return checked.withColumn("id", sound).drop("problems", "file", "line_no")


def unknown_ids(samples: DataFrame, index: DataFrame) -> DataFrame:
    """(id, evidence_id) judged but not in index(evidence_id) (V6)."""
    return samples.select("id", F.explode("relevance.evidence_id").alias("evidence_id")).distinct().join(index.select("evidence_id").distinct(), "evidence_id", "left_anti").select("id", "evidence_id")


def counts(samples: DataFrame) -> DataFrame:
    """Samples by task, by split and by status, in one pass."""
    rows = samples.select("task", "split", F.col("annotation.status").alias("status"))
    return rows.groupingSets([[F.col("task")], [F.col("split")], [F.col("status")]], F.col("task"), F.col("split"), F.col("status")).agg(F.count("*").alias("n"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(id, ranking, failed): of repeated results a success before a failure, else the later line, of several files that of the later name."""
    from ..sources.jsonl import parse_lines, read_lines
    from .ranking import keep_success

    rows = parse_lines(read_lines(spark, path), "id string, evidence array<struct<evidence_id:string>>, error struct<type:string,message:string>")
    ids = F.filter(F.transform(F.coalesce("evidence", F.array().cast("array<struct<evidence_id:string>>")), lambda e: F.trim(e["evidence_id"])), lambda x: x.isNotNull() & (x != ""))
    shown = rows.select("id", F.struct("file", "line_no").alias("at"), ids.alias("ranking"), F.col("error").isNotNull().alias("failed"))
    return keep_success(shown, ["id"], F.col("failed"), "at").select("id", "ranking", "failed")


def annotation_rows(samples: DataFrame, evidence: DataFrame, limit: int = 500) -> DataFrame:
    """A row for each judgement with the evidence's text and two blank columns for a reviewer (K11); texts are joined after all ids are known to exist."""
    rows = samples.select(F.col("id").alias("sample_id"), "query", F.explode("relevance").alias("r")).select("sample_id", "query", "r.evidence_id", "r.grade")
    text = evidence.select("evidence_id", (F.substring("text", 1, limit) if limit else F.col("text")).alias("text"))
    return rows.join(text, "evidence_id").select("sample_id", "query", "evidence_id", "text", "grade", F.lit("").alias("reviewer_grade"), F.lit("").alias("reviewer_note"))


def selected(samples: DataFrame, task: str | None = None, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Samples of a task and a split, the first `limit` by id."""
    for column, value in (("task", task), ("split", split)):
        if value is not None:
            samples = samples.where(F.col(column) == value)
    return samples if limit is None else samples.orderBy("id").limit(limit)


def pending(samples: DataFrame, done: DataFrame | None) -> DataFrame:
    """Samples without a successful result in done(id, failed)."""
    return samples if done is None else samples.join(done.where("not failed").select("id"), "id", "left_anti")


def run_samples(spark: SparkSession, samples: DataFrame, ask: Callable[[dict], dict], path: str, *, resume: bool = True) -> int:
    """Asks for each sample and appends its result, or its error, as one more file of the folder at once; returns how many were asked.

    A sample costs model calls, so samples go one by one on the driver, and a run that is broken off goes on where it was.
    """
    import json
    import uuid

    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not resume:
        store.delete(folder, True)
    store.mkdirs(folder)
    have = results(spark, f"{path}/*.jsonl") if any(f.getPath().getName().endswith(".jsonl") for f in store.listStatus(folder)) else None
    n = 0
    for row in pending(samples, have).orderBy("id").toLocalIterator():
        sample = row.asDict(recursive=True)
        try:
            line = {"id": sample["id"], **ask(sample), "error": None}
        except Exception as e:
            line = {"id": sample["id"], "evidence": [], "error": {"type": type(e).__name__, "message": str(e)}}
        out = store.create(hadoop.Path(f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex}.jsonl"))
        out.write(bytearray((json.dumps(line, ensure_ascii=False, sort_keys=True) + "\n").encode()))
        out.close()
        n += 1
    return n


def write_annotation_csv(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Annotation rows as one CSV file with a byte order mark and plain line ends, as spreadsheets want it (K11); returns the number of rows.

    The tasks write the lines in parts beside the file; the driver's JVM copies these, one after the other, through a buffer.
    """
    import csv
    import io
    import uuid

    hadoop = spark._jvm.org.apache.hadoop
    configuration = spark._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(path)
    store = at.getFileSystem(configuration)
    parts = hadoop.fs.Path(at.getParent(), f".parts-{uuid.uuid4().hex}")
    names = rows.columns

    def text(values: list) -> str:
        held = io.StringIO()
        csv.writer(held, lineterminator="\n").writerow(["" if x is None else x for x in values])
        return held.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text(row)[:-1] for row in zip(*(b.column(c).to_pylist() for c in names), strict=True)], pa.string())], names=["value"])

    counted = Observation()
    rows.orderBy("sample_id", "evidence_id").mapInArrow(run, "value string").observe(counted, F.count(F.lit(1)).alias("n")).write.text(parts.toString())
    out = store.create(at, True)
    out.write(bytearray(b"\xef\xbb\xbf" + text(names).encode()))
    for part in sorted((f.getPath() for f in store.listStatus(parts) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
        source = store.open(part)
        hadoop.io.IOUtils.copyBytes(source, out, configuration, False)
        source.close()
    out.close()
    store.delete(parts, True)
    return counted.get["n"]
