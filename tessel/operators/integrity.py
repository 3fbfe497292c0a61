"""Checks of tables: foreign keys, repeated keys, conflicting repeats, differences (V1 to V4, U2s to U4s, F6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str, check: str) -> DataFrame:
    """Values of a child column that the parent lacks (null is allowed), with their rows."""
    rows = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    return rows.join(parent.select(F.col(key).alias("value")).distinct(), "value", "left_anti").select(F.lit(check).alias("check"), F.col("value").cast("string").alias("value"), "n_rows")


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or are null, with their rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)).cast("boolean"))


def conflicts(rows: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys whose repeats differ, with the number of rows, of different contents and the names of the differing columns."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content}
    differ = F.array_compact(F.array(*(F.when(F.min(x) != F.max(x), F.lit(c)) for c, x in text.items())))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(F.sha2(F.concat_ws("\x1f", *text.values()), 256)).alias("n_versions"), differ.alias("fields"))
    return found.where("n_versions > 1")


def require_no_conflicts(rows: DataFrame, keys: Sequence[str], content: Sequence[str], *, described: Column | None = None) -> DataFrame:
    """rows without identical repeats; reading it fails if repeats of a key differ, and says how they are described."""
    shown = F.array_join(F.sort_array(F.collect_set(described)), " / ") if described is not None else F.lit("")
    checked = rows.groupBy(*keys).agg(F.count_distinct(F.struct(*content)).alias("_n"), F.first(F.struct(*content)).alias("_v"), shown.alias("_d"))
    named = F.concat(F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)), F.when(F.col("_d") != "", F.concat(F.lit(": "), "_d")).otherwise(F.lit("")))
    good = F.when(F.col("_n") <= 1, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("conflicting rows for "), named)))
    return checked.select(*keys, good.alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in content))


def unique_units(units: DataFrame) -> DataFrame:
    """Units without identical repeats; of a conflict the lengths and digests of the texts are told (V2)."""
    text = F.coalesce("text", F.lit(""))
    return require_no_conflicts(units, ["unit_id"], [c for c in units.columns if c != "unit_id"], described=F.concat(F.length(text).cast("string"), F.lit(" characters "), F.substring(F.sha2(text, 256), 1, 12))).select(*units.columns)


def unique_cases(cases: DataFrame, ignored: Sequence[str] = ("retrieved_at", "jurisdiction")) -> DataFrame:
    """Cases without repeats that differ at most in when they were fetched and in a jurisdiction that follows from the rest: the one fetched last stays; any other difference is an error (V3)."""
    content = [c for c in cases.columns if c != "case_id" and c not in ignored]
    same = require_no_conflicts(cases, ["case_id"], content)
    order = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ignored))
    last = cases.groupBy("case_id").agg(F.max_by(F.struct(*ignored), order).alias("_l"))
    return same.join(last, "case_id").select("case_id", *content, *(F.col(f"_l.{c}").alias(c) for c in ignored)).select(*cases.columns)


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of only one side, with the side: missing or unexpected."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def changes(old: DataFrame, new: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """For each key of either side: added, removed, changed or same (U4s)."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)), 256)
    a, b = old.select(key, digest.alias("_a")), new.select(key, digest.alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def without_superseded(rows: DataFrame, key: str, successors: DataFrame) -> DataFrame:
    """Rows whose successor (successors: key, successor) is not in the table too."""
    here = rows.select(F.col(key).alias("successor")).distinct()
    gone = successors.join(here, "successor", "left_semi").select(key).distinct()
    return rows.join(gone, key, "left_anti")


def kind_counts(units: DataFrame, doc: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """How many units of each of some kinds a document has, a column for each kind."""
    return units.groupBy(doc).pivot(kind, list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table, as table and n_rows."""
    out: DataFrame | None = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


#: How many units of its main kinds a law has when its text is whole.
PRIMARY_UNITS = {
    "eu_gdpr_2016_679": {"recital": 173, "article": 99}, "eu_ai_act_2024_1689": {"recital": 180, "article": 113}, "china_pipl_2021": {"article": 74}, "china_data_security_law_2021": {"article": 55},
    "us_hipaa_45_cfr_part_164": {"section": 41}, "us_coppa_16_cfr_part_312": {"section": 13}, "us_glba_16_cfr_part_314": {"section": 6}, "singapore_pdpa_2012": {"section": 83, "schedule_clause": 10},
    "hong_kong_pdpo_cap486": {"section": 104, "schedule_clause": 11}, "india_dpdp_act_2023": {"section": 44, "schedule_clause": 7}, "uk_data_protection_act_2018": {"section": 257, "schedule_clause": 881},
    "canada_pipeda_current": {"section": 68, "schedule_clause": 56}, "australia_privacy_act_1988_current": {"section": 262, "schedule_clause": 101}, "china_cybersecurity_law_2016": {"article": 79},
    "japan_appi_current_en": {"article": 185}, "korea_pipa_current_en": {"article": 126}, "brazil_lgpd_law_13709_en": {"article": 80}, "south_africa_popia_act_2013": {"section": 115},
    "philippines_data_privacy_act_2012": {"section": 45}, "malaysia_pdpa_2010": {"section": 146}, "us_ca_ccpa_cpra_civ_1798_100_199": {"section": 46}, "eu_data_act_2023_2854": {"recital": 119, "article": 50},
    "eu_data_governance_act_2022_868": {"recital": 63, "article": 38}, "eu_digital_services_act_2022_2065": {"recital": 156, "article": 93}, "eu_nis2_directive_2022_2555": {"recital": 144, "article": 46},
}


def law_report(documents: DataFrame, units: DataFrame, expected: Mapping[str, Mapping[str, int]] = PRIMARY_UNITS) -> DataFrame:
    """A row for each of documents(doc_id, version_date, raw_text) on its units(unit_id, source_doc_id, parent_id, unit_type, text): counts, the share of units whose text stands in the document, and what is wrong.

    A document's units are gathered beside its text, of which they are slices, so a row is a few times as long as the document.
    """
    own = units.groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.collect_list(F.struct("unit_id", "parent_id", "unit_type", F.coalesce("text", F.lit("")).alias("text"))).alias("units"))
    rows = documents.select("doc_id", "version_date", F.coalesce("raw_text", F.lit("")).alias("raw")).join(own, "doc_id", "left").withColumn("units", F.coalesce("units", F.array().cast(own.schema["units"].dataType)))
    ids = F.transform("units", lambda u: u["unit_id"])
    counted = F.aggregate(
        F.array_distinct(F.transform("units", lambda u: u["unit_type"])), F.expr("cast(map() as map<string,int>)"), lambda m, t: F.map_concat(m, F.map_from_arrays(F.array(t), F.array(F.size(F.filter("units", lambda u: u["unit_type"] == t)))))
    )
    rows = rows.withColumns({"unit_count": F.size("units"), "exact_anchors": F.size(F.filter("units", lambda u: F.contains("raw", u["text"]))), "type_counts": counted})
    wanted = [F.when(F.col("doc_id") == d, F.greatest(*(F.coalesce(F.try_element_at("type_counts", F.lit(t)), F.lit(0)) != n for t, n in kinds.items()), F.lit(False))) for d, kinds in expected.items()]
    checks = {
        "empty_source_text": F.trim("raw") == "", "no_legal_units": F.col("unit_count") == 0, "empty_legal_unit_text": F.exists("units", lambda u: F.trim(u["text"]) == ""),
        "missing_parent_unit": F.exists("units", lambda u: u["parent_id"].isNotNull() & (u["parent_id"] != "") & ~F.array_contains(ids, u["parent_id"])), "normalized_or_composed_unit_text": F.col("exact_anchors") != F.col("unit_count"),
        "primary_structure_count_mismatch": F.coalesce(*wanted, F.lit(False)), "version_not_date_pinned": F.col("version_date") == "current",
    }
    issues = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items())))
    ratio = F.when(F.col("unit_count") > 0, F.round(F.col("exact_anchors") / F.col("unit_count"), 6)).otherwise(F.lit(0.0))
    out = rows.select("doc_id", F.length("raw").alias("source_text_chars"), F.sha2("raw", 256).alias("content_sha256"), "unit_count", "exact_anchors", ratio.alias("exact_anchor_ratio"), "type_counts", issues.alias("issues"))
    return out.withColumn("status", F.when(F.size("issues") == 0, "pass").otherwise("warning"))
