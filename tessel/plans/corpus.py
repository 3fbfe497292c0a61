"""A corpus folder: checks of its tables and files, and publishing of a new version beside the old one (V4, V8, K6, K7, Q13, Q14)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import missing_parents, repeated_keys
from ..sources.jsonl import manifest, read_jsonl, sorted_json
from .index import CASE_RELATIONS, CASES, LAW_RELATIONS, LAWS, LEGAL_UNITS

TABLES = {"laws": LAWS, "legal_units": LEGAL_UNITS, "gdprhub_cases": CASES, "case_law_relations": CASE_RELATIONS, "law_relations": LAW_RELATIONS}
KEYS = {"laws": "doc_id", "legal_units": "unit_id", "gdprhub_cases": "case_id"}


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a corpus folder."""
    return {name: read_jsonl(spark, f"{folder}/{name}.jsonl", schema) for name, schema in TABLES.items()}


def errors(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row (check, value, n_rows) for each repeated or missing key and each link to nowhere; a null target is allowed."""
    units, out = tables["legal_units"], None
    found = [repeated_keys(tables[t], [k]).select(F.lit(f"{t}: {k} repeated or missing").alias("check"), F.col(k).cast("string").alias("value"), "n_rows") for t, k in KEYS.items()]
    found.append(missing_parents(units, "source_doc_id", tables["laws"], "doc_id", "legal_units: no such law"))
    found.append(missing_parents(tables["case_law_relations"], "case_id", tables["gdprhub_cases"], "case_id", "case_law_relations: no such case"))
    found += [missing_parents(tables[t], c, units, "unit_id", f"{t}: no such unit") for t, c in (("case_law_relations", "target_unit_id"), ("law_relations", "source_unit_id"), ("law_relations", "target_unit_id"))]
    for one in found:
        out = one if out is None else out.unionByName(one)
    return out


def file_errors(spark: SparkSession, folder: str) -> list[str]:
    """What the folder's files differ in from its manifest; names that leave the folder are errors too. One row a file goes to the driver."""
    stated = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/manifest.json").collect()))["files"]
    have = {r["path"]: r for r in manifest(spark, f"{folder}/*.jsonl").collect()}
    plain = lambda p: p.split("/")[-1] not in ("", ".", "..") and (PurePosixPath(p).name == p or len(PurePosixPath(p).parts) == 2 and PurePosixPath(p).parts[0] in {f"{t}.jsonl" for t in TABLES})
    out = [f"{f['path']}: not a plain file name" for f in stated if not plain(f["path"])]
    for f in stated:
        got = have.get(f["path"])
        if got is None:
            out.append(f"{f['path']}: missing")
        else:
            out += [f"{f['path']}: {what} differ{'s' if what == 'sha256' else ''}" for what in ("bytes", "sha256") if got[what] != f[what]]
    return sorted(out)


def validate(spark: SparkSession, folder: str) -> dict:
    """valid, the tables' counts and all errors (at most 20 values of each check are shown, with how many there are)."""
    tables = read(spark, folder)
    grouped = errors(tables).groupBy("check").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.coalesce("value", F.lit("null")))), 1, 20).alias("values"))
    wrong = [f"{r['check']}: {', '.join(r['values'])}" + (f" and {r['n'] - 20} more" if r["n"] > 20 else "") for r in grouped.collect()]
    wrong = sorted(wrong) + file_errors(spark, folder)
    return {"valid": not wrong, "counts": {name: df.count() for name, df in tables.items()}, "errors": wrong}


def _size(df: DataFrame) -> int | None:
    """What the optimizer takes a table's bytes to be; None if it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if 0 <= size < 1 << 56 else None


#: Bytes of a table that go to one file; a larger table is a folder of parts, in order. One task sorts and writes a file, and one task holds it to take its digest.
FILE_BYTES = 16 << 20


def publish(spark: SparkSession, base: str, new: Mapping[str, DataFrame], out: str, *, file_bytes: int = FILE_BYTES) -> dict:
    """Writes base with the rows of new to another folder and returns its validation; ids that base has are refused, and base stays as it is (Q13)."""
    if out.rstrip("/") == base.rstrip("/"):
        raise ValueError("the output folder must not be the base folder")
    old = read(spark, base)
    taken = [r[KEYS[t]] for t in KEYS if t in new for r in new[t].select(KEYS[t]).join(old[t].select(KEYS[t]), KEYS[t], "left_semi").distinct().limit(20).collect()]
    if taken:
        raise ValueError(f"already in the base: {', '.join(sorted(taken))}")
    order = {"laws": ["doc_id"], "legal_units": ["source_doc_id", "unit_id"], "gdprhub_cases": ["case_id"], "case_law_relations": ["case_id", "citation"], "law_relations": ["source_unit_id", "target_unit_id"]}
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(out)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(root) and store.listStatus(root):
        raise ValueError("the output folder is not empty")
    for name, df in old.items():
        whole = df.unionByName(new[name], allowMissingColumns=True) if name in new else df
        if (size := _size(whole)) is None:  # written once to know
            whole.write.parquet(f"{out}/.rows-{name}")
            whole = spark.read.schema(whole.schema).parquet(f"{out}/.rows-{name}")
            size = store.getContentSummary(hadoop.Path(f"{out}/.rows-{name}")).getLength()
        parts = max(1, -(-size // file_bytes))
        ordered = whole.repartitionByRange(parts, *order[name]).sortWithinPartitions(*order[name]) if parts > 1 else whole.coalesce(1).sortWithinPartitions(*order[name])
        ordered.select(sorted_json(whole).alias("value")).write.text(f"{out}/.{name}")
        made = sorted(f.getPath().getName() for f in store.listStatus(hadoop.Path(f"{out}/.{name}")) if f.getPath().getName().startswith("part-"))
        target = hadoop.Path(f"{out}/{name}.jsonl")
        if len(made) > 1:
            store.mkdirs(target)
            for i, part in enumerate(made):
                store.rename(hadoop.Path(f"{out}/.{name}/{part}"), hadoop.Path(f"{out}/{name}.jsonl/{i:05d}.jsonl"))
        elif made:
            store.rename(hadoop.Path(f"{out}/.{name}/{made[0]}"), target)
        else:
            store.create(target).close()
        for left in (f".{name}", f".rows-{name}"):
            store.delete(hadoop.Path(f"{out}/{left}"), True)
    files = [r.asDict() for r in manifest(spark, f"{out}/*.jsonl").orderBy("path").collect()]  # a row for each file
    with_store = store.create(hadoop.Path(f"{out}/manifest.json"))
    with_store.write(bytearray(json.dumps({"schema_version": "2.0.0", "files": files}, sort_keys=True).encode()))
    with_store.close()
    return validate(spark, out)
