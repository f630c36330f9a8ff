"""A run over upgrade records, one or many: their logs found, classified, and the results kept by project and commit."""

from __future__ import annotations

import os
import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.categories import matches
from faultline.operators import buildlog, lookup
from faultline.schemas import PROCESSED
from faultline.sources import readers, writers


def logs_of(spark: SparkSession, records: DataFrame, projects: str, threads: int | None = None) -> DataFrame:
    """project, breakingCommit, logPath and content of the log of each record that has one, below projects/<commit>."""
    files = readers.listing(spark, projects, "*.log")
    root = re.sub(r"^\w+:/+", "/", projects).rstrip("/") + "/"
    parts = F.split(F.substring(F.col("path"), F.instr("path", root) + len(root), F.length("path")), "/")
    found = files.where(F.size(parts).isin(2, 3)).select("path", parts[0].alias("commit"), F.when(F.size(parts) == 3, parts[1]).otherwise(readers.ROOT).alias("directory"), F.element_at(parts, -1).alias("name"))
    named = records.select(F.col("breakingCommit").alias("commit"), F.coalesce("project", F.lit("")).alias("project")).distinct()
    picked = readers.pick_log(found.join(named, "commit"))
    content = readers.logs(spark, projects, recursive=True).select(F.col("log_id").alias("path"), "content")
    content = content.coalesce(threads) if threads else content
    return picked.join(content, "path").select("project", F.col("commit").alias("breakingCommit"), F.col("path").alias("logPath"), "content")


#: What tells results apart: projects may share a commit.
KEY = ("project", "breakingCommit")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with _key; a record without a project is one of the project ""."""
    return rows.withColumn("_key", F.struct(F.coalesce("project", F.lit("")).alias("project"), "breakingCommit"))


def kept_results(spark: SparkSession, output: str) -> DataFrame:
    """The results of the runs before. Where one was lost between taking away the old table and naming the new one, the new one is whole and counts."""
    where, path = fs.FileSystem.from_uri(_uri(output))
    done = where.get_file_info(f"{path}/results-new/_SUCCESS").type == fs.FileType.File
    there = where.get_file_info(f"{path}/results").type == fs.FileType.Directory
    if done and not there:
        where.move(f"{path}/results-new", f"{path}/results")
    return readers.earlier_results(spark, f"{output}/results", PROCESSED)


def _uri(path: str) -> str:
    return path if re.match(r"\w+:", path) else f"file://{os.path.abspath(path)}"


def _replace(results: DataFrame, output: str) -> None:
    """The results written whole beside the old ones first, then named as they."""
    where, path = fs.FileSystem.from_uri(_uri(output))
    writers.write_json(results, f"{output}/results-new")
    if where.get_file_info(f"{path}/results").type == fs.FileType.Directory:
        where.delete_dir(f"{path}/results")
    where.move(f"{path}/results-new", f"{path}/results")


def run(spark: SparkSession, source: str, projects: str, output: str, category: str | None = None, only: str | None = None, force: bool = False, attempts: int = 1, threads: int | None = None, clean: bool = False) -> tuple[DataFrame, DataFrame]:
    """The results kept below output after the run, and the records that it rejected with a reason.

    source: a folder of records, or a file; only: the name of one file in it. Records of
    another category, if one is given, and those that output has a result for are left
    out; force does the latter anew, and of those whose build failed so do more attempts
    than they have had. threads: how many tasks read logs at once. clean: forget what was kept before. A project's commit has one result: of records that
    share both one is kept where they agree, and all are rejected where they don't.
    """
    records = readers.records(spark, f"{source.rstrip('/')}/{only}.json" if only else source)
    if category:
        records = records.where(matches(F.col("failureCategory"), category))
    before = spark.createDataFrame([], PROCESSED) if clean else kept_results(spark, output)
    records = _keyed(records)
    if not force:
        done = (F.col("failureCategory") == "BUILD_SUCCESS") | (F.coalesce("attempts", F.lit(1)) >= attempts)
        records = lookup.unprocessed(records, _keyed(before.where(F.coalesce(done, F.lit(True)))), "_key")
    same = records.groupBy("_key").agg(F.count_distinct(F.to_json(F.struct(*records.drop("_key").columns))).alias("_n"))
    told = records.dropDuplicates(["_key"]).join(same, "_key")
    clashing = told.where("_n > 1").select("project", "breakingCommit", F.lit("records clash").alias("reason"))
    results, rejected = buildlog.processed(told.where("_n = 1").drop("_key", "_n"), logs_of(spark, records, projects, threads))
    tried = _keyed(before).select("_key", F.coalesce("attempts", F.lit(1)).alias("_tried"))
    now = _keyed(results).join(tried, "_key", "left").withColumn("attempts", F.coalesce("_tried", F.lit(0)) + 1).select(*before.columns)
    kept = _keyed(before).join(_keyed(now).select("_key"), "_key", "left_anti").select(*before.columns).unionByName(now)
    writers.write_json(rejected.select("project", "breakingCommit", "reason").unionByName(clashing), f"{output}/rejected")
    _replace(kept, output)
    return readers.earlier_results(spark, f"{output}/results", PROCESSED), spark.read.schema("project STRING, breakingCommit STRING, reason STRING").json(f"{output}/rejected")
