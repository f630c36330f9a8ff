"""Command line: classify logs, compare API snapshots, report impacts, run over records, take jars apart, count version combinations.

    python -m faultline.cli classify LOG [-j OUT]
    python -m faultline.cli diff OLD NEW [OUT]
    python -m faultline.cli impact USAGES CLASSES [-o OUT] [--simple-names] [--dependency TEXT]
    python -m faultline.cli report --project DIR --file FILE --line N --changes CLASSES --old JAR --new JAR [--classpath JARS] [-o OUT]
    python -m faultline.cli lines --project DIR [--file FILE] [--line N] [--classpath JARS] [--dependency TEXT]
    python -m faultline.cli run -i RECORDS -p PROJECTS -o OUT [-c CATEGORY] [-f NAME] [-j OUT] [--force] [-a N] [-t N] [--clean] [--verbose] [--no-classify]
    python -m faultline.cli extract JARS OUT
    python -m faultline.cli combinations RECORDS [-c CATEGORY] [-o OUT]

Inputs are logs, or JSON with the schemas in faultline.schemas; snapshots are JSON rows
with fullyQualifiedName and columns to compare, or both are jars, whose classes are
compared with all that they inherit. JARS is a folder of jars, in which the types of
constructs are looked for; the project's own come first. A run tries
records whose build failed again until they had -a attempts, reads logs in -t tasks at
once, and with --clean forgets the results of runs before. At most --rows rows are printed; files
hold all. Exit: 1 for wrong arguments, 2 for a failure.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import apidiff, buildlog, combos, constructs, impact, resolve
from faultline.plans import batch
from faultline.sources import classfiles, readers, writers


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{message}\n")


def parser() -> argparse.ArgumentParser:
    out = _Parser(prog="faultline")
    out.add_argument("--rows", type=int, default=1000)
    kinds = out.add_subparsers(dest="what", required=True, parser_class=_Parser)
    p = kinds.add_parser("classify")
    p.add_argument("log")
    p.add_argument("-j", "--json")
    p = kinds.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("output", nargs="?")
    p = kinds.add_parser("impact")
    p.add_argument("usages")
    p.add_argument("classes")
    p.add_argument("-o", "--output")
    p.add_argument("--simple-names", action="store_true")
    p.add_argument("--dependency")
    p = kinds.add_parser("report")
    for name in ("project", "file", "changes", "old", "new"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--line", type=int, required=True)
    p.add_argument("--classpath")
    p.add_argument("-o", "--output")
    p = kinds.add_parser("lines")
    p.add_argument("--project", required=True)
    p.add_argument("--file")
    p.add_argument("--line", type=int)
    p.add_argument("--classpath")
    p.add_argument("--dependency")
    p = kinds.add_parser("run")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-p", "--projects", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-c", "--category", type=_category)
    p.add_argument("-f", "--file")
    p.add_argument("-j", "--json-output")
    p.add_argument("-a", "--attempts", type=_at_least_one, default=1)
    p.add_argument("-t", "--threads", type=_at_least_one, default=None)
    p.add_argument("--force", action="store_true")
    p.add_argument("--clean", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--no-classify", action="store_true")
    p = kinds.add_parser("extract")
    p.add_argument("jars")
    p.add_argument("output")
    p = kinds.add_parser("combinations")
    p.add_argument("records")
    p.add_argument("-c", "--category")
    p.add_argument("-o", "--output")
    return out


def _category(name: str) -> str:
    if name.upper() not in schemas.RECORD_CATEGORIES:
        raise argparse.ArgumentTypeError(f"no failure category: {name}")
    return name.upper()


def _at_least_one(n: str) -> int:
    if int(n) < 1:
        raise argparse.ArgumentTypeError("must be >= 1")
    return int(n)


def _constructs(spark: SparkSession, project: str, file: str | None, line: int | None, jars: str | None = None, dependency: str | None = None) -> DataFrame:
    every = readers.source_files(spark, project)
    sources = every
    if file:
        sources = every.where(F.col("file").endswith("/" + file.lstrip("./")))
        found = [r.file for r in sources.select("file").limit(9).collect()]
        if len(found) > 1:
            raise ValueError(f"several files are named {file}: {', '.join(sorted(found))}")
    found = constructs.scan(sources)
    found = found if line is None else found.where(F.col("lineNumber") == line)
    artifacts = readers.classpath(spark, jars) if jars else spark.createDataFrame([], "package string, position string, path string, groupId string, artifactId string, version string")
    return impact.filter_dependency(resolve.with_dependencies(found, artifacts, constructs.declared_types(every)), dependency)


def _classes(spark: SparkSession, jar: str) -> DataFrame:
    return classfiles.classes(readers.archive_entries(readers.archives(spark, jar)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("faultline").getOrCreate()

    def _show(rows: DataFrame, column: str | None = None) -> None:
        n = 0
        for row in rows.limit(a.rows + 1).toLocalIterator():
            n += 1
            if n <= a.rows:
                print(row[column] if column else row.asDict(recursive=True))
        if n > a.rows:
            print(f"only the first {a.rows} rows are shown", file=sys.stderr)

    try:
        if a.what == "classify":
            found = buildlog.reports(readers.logs(spark, a.log))
            writers.write_json(found, a.json)
            _show(found.select("originalFailurePath", "failureCategory"))
            _show(writers.printed(found.withColumnRenamed("originalFailurePath", "log_id")), "line")
        elif a.what == "diff":
            if a.old.endswith(".jar") and a.new.endswith(".jar"):
                found = classfiles.compare_archives(_classes(spark, a.old), _classes(spark, a.new))
            else:
                old, new = spark.read.json(a.old), spark.read.json(a.new)
                values = [c for c in old.columns if c in new.columns and c != "fullyQualifiedName"]
                found = apidiff.compare(old, new, ["fullyQualifiedName"], values)
            writers.write_json(found, a.output)
            _show(found)
        elif a.what == "impact":
            usages = impact.filter_dependency(spark.read.schema(schemas.CONSTRUCT_USAGE).json(a.usages), a.dependency)
            found = impact.impacts(usages, spark.read.schema(schemas.CLASS_CHANGE).json(a.classes), a.simple_names)
            writers.write_json(found, a.output)
            _show(found)
        elif a.what == "report":
            usages = _constructs(spark, a.project, a.file, None, a.classpath).withColumn("file", F.lit(a.file))
            asked = spark.createDataFrame([(a.project, a.file, a.line, a.old, a.new)], "project string, file string, lineNumber int, oldJar string, newJar string")
            good, bad = impact.requests(asked)
            for row in bad.collect():  # one at most
                raise ValueError(row["reason"])
            found = impact.reports(good, usages, spark.read.schema(schemas.CLASS_CHANGE).json(a.changes))
            writers.write_json(found, a.output, pretty=True)
            _show(found)
        elif a.what == "lines":
            _show(_constructs(spark, a.project, a.file, a.line, a.classpath, a.dependency))
        elif a.what == "extract":
            folder = a.output if "://" in a.output else f"file://{os.path.abspath(a.output)}"
            files = readers.extract(readers.archive_entries(readers.archives(spark, a.jars)), folder)
            _show(files.groupBy("path").agg(F.count("*").alias("files")).orderBy("path"))
        elif a.what == "run":
            if a.no_classify:
                _show(readers.records(spark, f"{a.input}/{a.file}.json" if a.file else a.input))
            else:
                results, rejected = batch.run(spark, a.input, a.projects, a.output, a.category, a.file, a.force or a.clean, a.attempts, a.threads, a.clean)
                if a.verbose:
                    for row in results.groupBy("failureCategory").count().orderBy("failureCategory").collect():  # a row a category
                        print(f"{row[0]}: {row[1]}", file=sys.stderr)
                writers.write_json(results, a.json_output, pretty=True)
                _show(results)
                _show(rejected.select("breakingCommit", "reason"))
        else:
            found = combos.combinations(readers.records(spark, a.records), a.category)
            writers.write_json(found, a.output)
            _show(found)
    except Exception as e:  # noqa: BLE001
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
