"""Reading and writing corpus bundles: declared schemas, staged promotion, checksums, sidecars."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schema versions that a bundle may have.
SCHEMA_VERSION = 5
SECTION = """kind string, id string, display_label string, title string, text string,
citations array<struct<display_text:string,target:struct<kind:string,module_id:string,section_id:string,anchor_id:string,subsection:string,level:string,number:string,raw:string,appendix_id:string>>>,
defined_terms array<string>, hierarchy array<string>, editorial_status string, redirect_to string, body string,
article struct<id:string,title:string,parents:array<struct<kind:string,id:string>>>"""
DEFINITION = "id string, term string, defined_in string, body_anchor struct<start:int,end:int>, excerpt string, scope struct<kind:string,prefix:array<string>,module_id:string>, extracted_by string"
BILL = """file_no string, module_id string, short_title string, long_title string, sponsor string, introduced_at string, legistar_url string, legistar_status string, bill_status string,
section_outcomes array<struct<section_id:string,status:string,detail:string>>, diff_chunks array<struct<op:string,text:string,section_id:string>>, parse_status string, structural_change_scope string, body string"""
INDEX = "file_no string, short_title string, introduced_at string, bill_status string, section_ids array<string>"
META = "module_id string, module_version string, schema_version int, jurisdiction string, checksum string"


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One row per JSON file under ``path`` (any depth), with the declared schema and the file's path.

    A file that does not fit the schema fails the read if ``strict``, else gives null columns.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    return reader.json(path).withColumn("file_path", F.col("_metadata.file_path"))


def read_sections(spark: SparkSession, root: str) -> DataFrame:
    """All sections of a corpus, with the module that their folder names."""
    rows = read_json(spark, f"{root.rstrip('/')}/*/sections", SECTION)
    return rows.withColumn("module_id", F.regexp_extract("file_path", "/([^/]+)/sections/", 1))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Modules' sidecars; a bundle with another schema version fails, one without a version passes."""
    rows = read_json(spark, f"{root.rstrip('/')}/*/corpus-meta.json", META)
    wrong = F.coalesce(F.col("schema_version"), F.lit(SCHEMA_VERSION)) != SCHEMA_VERSION
    return rows.withColumn("schema_version", F.when(wrong, F.raise_error(F.concat(F.lit("schema version of "), F.col("module_id")))).otherwise(F.col("schema_version")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may hold wildcards, names a file, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _entries(spark: SparkSession, path: str, name: str, entry: str) -> DataFrame:
    """Entries of files that hold a list, no rows where no file is there; a file that doesn't fit the schema fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], entry)
    files = spark.read.schema(f"{name} array<struct<{_fields(entry)}>>").option("mode", "FAILFAST").option("multiLine", "true").json(path)
    return files.select(F.inline(name))


def _fields(ddl: str) -> str:
    """A schema's columns as the fields of a struct."""
    kind = StructType.fromDDL(ddl).simpleString()
    return kind[len("struct<") : -1]


def read_definitions(spark: SparkSession, root: str) -> DataFrame:
    """Definitions of all modules, one file each with a list; modules without one have none."""
    path = f"{root.rstrip('/')}/*/definitions-v2.json"
    if not exists(spark, path):
        return spark.createDataFrame([], DEFINITION)
    return spark.read.schema(DEFINITION).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def read_bills(spark: SparkSession, path: str) -> DataFrame:
    """Bills of a session, a file each, by number; none if there is no folder."""
    return read_json(spark, path, BILL).orderBy("file_no") if exists(spark, path) else spark.createDataFrame([], BILL)


def read_bills_index(spark: SparkSession, path: str) -> DataFrame:
    """The bills that an index file lists, none without it."""
    return _entries(spark, path, "bills", INDEX)


def session_bills(listed: DataFrame, details: DataFrame, first: str, last: str, limit: int | None = None) -> DataFrame:
    """Listed ordinances (file_no, type) with their details (file_no, introduced_at) in a session's dates; ``limit`` holds for the listing, newest number first."""
    chosen = listed.where(F.lower(F.trim("type")) == "ordinance")
    chosen = chosen if limit is None else chosen.orderBy(F.desc("file_no")).limit(limit)
    return chosen.join(details, "file_no").where(F.col("introduced_at").between(first, last))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """One row per HTML file: path and text; bytes that are no UTF-8 become replacement characters."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))


def canonical_json(*columns: str) -> Column:
    """A row as JSON with its keys in order; null fields are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def row_checksum(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Per key a SHA-256 over its rows' own digests in order: independent of partitions and order of arrival.

    Digests that begin alike are digested first (three hexadecimal digits, 4,096 slices), then the slices'
    digests, so a key with a large share of all rows is no one task.
    """
    digests = rows.select(key, F.sha2(content, 256).alias("d"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    slices = digests.groupBy(key, F.left("d", F.lit(3)).alias("slice")).agg(joined("d").alias("part"))
    return slices.groupBy(key).agg(joined(F.concat_ws(":", "slice", "part")).alias("checksum"))


def corpus_hash(modules: DataFrame) -> DataFrame:
    """Twelve digits over the sorted ``id@version`` of all modules (one small row per module)."""
    pair = F.concat_ws("@", "module_id", "module_version")
    return modules.agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256), F.lit(12)).alias("corpus_hash"))


def write_modules(sections: DataFrame, path: str, max_skips: int = 0, skipped: DataFrame | None = None) -> DataFrame:
    """Write sections as Parquet by module, without the modules that a gate refuses, and return the refused.

    A module is refused if it repeats a section id or has more than ``max_skips`` rows in
    ``skipped``. The table is written to a folder beside ``path`` and renamed into its place by
    :func:`promote`.
    """
    spark = sections.sparkSession
    twice = sections.groupBy("module_id", "section_id").agg(F.count("*").alias("n")).where("n > 1").select("module_id", F.lit("duplicate_ids").alias("reason"))
    refused = twice
    if skipped is not None:
        refused = refused.union(skipped.groupBy("module_id").agg(F.count("*").alias("n")).where(F.col("n") > max_skips).select("module_id", F.lit("too_many_skips").alias("reason")))
    refused = refused.distinct()
    good = sections.join(refused.select("module_id").distinct(), "module_id", "left_anti")
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    good.repartition("module_id", F.pmod(F.xxhash64("section_id"), F.lit(16))).write.partitionBy("module_id").parquet(fresh)
    promote(spark, fresh, path)
    return refused


def recover(spark: SparkSession, path: str) -> bool:
    """Put the former table back where a promotion broke off between its two renames; whether there was one."""
    jvm = spark._jvm
    live, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old"))
    fs = live.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(not fs.exists(live) and fs.exists(old) and fs.rename(old, live))


def promote(spark: SparkSession, fresh: str, path: str) -> None:
    """Rename a finished folder into place; the one that was there is kept as ``.old`` until the rename is done.

    Between the two renames no table is live: one that broke off there is put back first, here or by :func:`recover`.
    One writer at a time; there is no lock.
    """
    jvm = spark._jvm
    recover(spark, path)
    new, live, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path, f"{path}.old"))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(live):
        fs.delete(old, True)
        fs.rename(live, old)
    if not fs.rename(new, live):
        if fs.exists(old):
            fs.rename(old, live)
        raise OSError(f"cannot rename {fresh} to {path}")
    fs.delete(old, True)


def stale(present: DataFrame, keep: DataFrame, key: str = "file_no") -> DataFrame:
    """Rows of ``present`` that a purge removes: their key is not kept."""
    return present.join(keep.select(key).distinct(), key, "left_anti")
