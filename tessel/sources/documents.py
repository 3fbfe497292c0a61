"""Source documents: catalogue rows with the texts of their raw files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import require_no_conflicts, without_superseded
from .extract import read_file_list, read_revision_list

COLUMNS = ("doc_id", "jurisdiction", "law_family", "source_type", "title", "version_date", "effective_date", "source_url", "language", "raw_text")
#: A document, and the more complete one that takes its place.
SUPERSEDED = {"us_ccpa_cpra_1798_100": "us_ca_ccpa_cpra_civ_1798_100_199"}


def source_documents(spark: SparkSession, sources: Sequence[Mapping[str, str]], *, require: bool = False) -> DataFrame:
    """A document for each source whose raw file exists, with section_titles of British statutes; with require, a missing file is an error.

    Repeats of a document are one if they agree, else an error; a superseded one goes if its successor is here.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    here = []
    for s in sources:
        path = fs.Path(s["target_path"])
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(path):
            here.append((str(store.makeQualified(path).toString()).replace("file:///", "file:/"), s))
        elif require:
            raise FileNotFoundError(f"the raw file of {s['doc_id']} is missing: {s['target_path']}")
    if not here:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS) + ", section_titles map<string,string>")
    known = spark.createDataFrame([(p, s["doc_id"], s["jurisdiction"], s["law_family"], s["source_type"], s["title"], s["version_date"] or None, s["effective_date"] or None, s["url"], s["language"]) for p, s in here], "path string, doc_id string, jurisdiction string, law_family string, source_type string, title string, version_date string, effective_date string, source_url string, language string")
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    paths = sorted({p for p, _ in here})
    texts = read_file_list(spark, paths).withColumn("path", plain).withColumnRenamed("text", "raw_text")
    xml = [p for p in paths if p.endswith(".xml")]
    rows = known.join(texts, "path")
    if xml:
        titles = read_revision_list(spark, xml).withColumn("path", plain).where("title is not null").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("section", "title"))).alias("section_titles"))
        rows = rows.join(titles, "path", "left")
    else:
        rows = rows.withColumn("section_titles", F.lit(None).cast("map<string,string>"))
    content = [c for c in COLUMNS if c != "doc_id"]
    unique = require_no_conflicts(rows, ["doc_id"], content).join(rows.groupBy("doc_id").agg(F.first("section_titles", ignorenulls=True).alias("section_titles")), "doc_id")
    pairs = spark.createDataFrame(list(SUPERSEDED.items()), "doc_id string, successor string")
    return without_superseded(unique, "doc_id", pairs).select(*COLUMNS, "section_titles")
