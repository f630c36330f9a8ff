"""Sources: record reports, build logs, archives, configuration and source trees."""

from __future__ import annotations

import fnmatch
import io
import json
import os
import re
import zipfile
from collections.abc import Generator, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.categories import blank
from faultline.functions.text import strip_trailing, truth
from faultline.operators.lookup import first_ranked
from faultline.schemas import RESULT, UPGRADE_RECORD


#: Files of a folder that a task reads, about, and bytes of them that it holds at a time, but for a file that is larger.
FILES = 2000
FILE_BYTES = 1 << 23


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """path as the operating system names it, if it is a folder there."""
    scheme = re.match(r"([A-Za-z][\w+.-]*):", path)
    if (scheme[1] != "file") if scheme else not spark.conf.get("spark.hadoop.fs.defaultFS", "file:").startswith("file:"):
        return None
    root = os.path.abspath(re.sub("^file:/*", "/", path))
    return root if os.path.isdir(root) else None


def folder_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """file_path, as _metadata has it, and name of each file right below root, a folder that all executors reach, as Spark's readers see them.

    A task goes through the folder, block by block, and the names are dealt by ranges, FILES a task, in order; the driver
    gets their number alone.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            paths = [re.sub(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", lambda m: quote(m[0]), f"{root.rstrip('/')}/{x}") for x in names]
            return pa.RecordBatch.from_arrays([pa.array([f"file:{x}" for x in paths], pa.string()), pa.array(names, pa.string())], ["file_path", "name"])

        names: list[str] = []
        for batch in batches:
            for _ in range(batch.num_rows):
                with os.scandir(root) as entries:
                    for entry in entries:
                        hidden = entry.name.startswith(".") or entry.name.startswith("_") and "=" not in entry.name
                        if not hidden and fnmatch.fnmatchcase(entry.name, glob) and entry.is_file():
                            names.append(entry.name)
                            if len(names) == 4096:
                                yield block()
                                names.clear()
        yield block()

    found = spark.range(0, 1, 1, 1).mapInArrow(read, "file_path string, name string")
    return found.repartitionByRange(found.count() // FILES + 1, "file_path").sortWithinPartitions("file_path")


_JSON = json.JSONDecoder()


def _bare(text: str, at: int, kind: T.DataType | None) -> Generator[tuple[int, int], None, int]:
    """Spans of the values that aren't text but belong to string fields, in the JSON value of that kind that begins at; where it ends."""
    after = lambda i: re.compile(r"[ \t\r\n]*").match(text, i).end()
    inside = {"{": (T.StructType, T.MapType), "[": T.ArrayType}.get(text[at])
    if inside is None or not isinstance(kind, inside):
        value, end = _JSON.raw_decode(text, at)
        if isinstance(kind, T.StringType) and value is not None and not isinstance(value, str):
            yield at, end
        return end
    of = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    item = kind.valueType if isinstance(kind, T.MapType) else kind.elementType if isinstance(kind, T.ArrayType) else None
    named, at = text[at] == "{", after(at + 1)
    while text[at] not in "}]":
        key = None
        if named:
            key, at = _JSON.raw_decode(text, at)
            at = after(after(at) + 1)
        at = after((yield from _bare(text, at, of.get(key, item))))
        if text[at] == ",":
            at = after(at + 1)
    return at + 1


def _exact(text: str, kind: T.StructType) -> str:
    """text with the values of string fields that aren't text quoted as they stand (1.10 is "1.10"); what is malformed stays."""
    out, done = [], 0
    try:
        at = len(text) - len(text.lstrip(" \t\r\n"))
        for start, end in _bare(text, at, T.ArrayType(kind) if text[at] == "[" else kind):
            out += [text[done:start], json.dumps(text[start:end])]
            done = end
    except (ValueError, IndexError, RecursionError, TypeError):
        return text
    return "".join([*out, text[done:]])


def _json_texts(files: DataFrame, root: str, kind: T.StructType) -> DataFrame:
    """file_path and content, for records of that kind, of the files below root that aren't blank, whatever Unicode they are in; null where they are in none."""

    def text(content: bytes) -> str | None:
        try:
            return _exact(content.decode(json.detect_encoding(content)), kind)
        except UnicodeError:
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str | None]] = []
        size = 0
        for batch in batches:
            for where, name in zip(*(c.to_pylist() for c in batch.columns)):
                with open(f"{root}/{name}", "rb") as f:
                    content = f.read()
                if content.strip(b" \t\r\n"):
                    rows.append((where, text(content)))
                    size += len(content)
                if size >= FILE_BYTES or len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["file_path", "content"])
                    rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["file_path", "content"])

    return files.mapInArrow(read, "file_path string, content string")


def report_files(spark: SparkSession, path: str, schema: str = UPGRADE_RECORD) -> DataFrame:
    """file_path and record of each *.json right below a directory, or of one file, by path.

    Unknown fields are dropped; the first malformed file ends the scan. A folder in a file system that is mounted may hold
    any number of files: tasks list and read it. Other file systems, patterns and single files are left to Spark's
    reader, which lists them in the driver.
    """
    root = _local_folder(spark, path)
    if root is None:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
        return rows.select(F.col("_metadata.file_path").alias("file_path"), F.struct(*rows.columns).alias("record")).orderBy("file_path")
    texts = _json_texts(folder_files(spark, root, "*.json"), root, T.StructType.fromDDL(schema))
    malformed = F.raise_error(F.concat(F.lit("MALFORMED_RECORD_IN_PARSING: no record in "), "file_path"))
    # As the file reader has it: a list at the top is a row an item.
    found = F.from_json("content", f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    rows = texts.select("file_path", F.explode(F.coalesce(found, malformed)).alias("record"))
    return rows.select("file_path", F.coalesce("record", malformed).alias("record"))


def records(spark: SparkSession, path: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """The records alone; renamed maps names in the files to names of columns."""
    return report_files(spark, path).select("record.*").withColumnsRenamed(renamed or {})


def split_lines(text: Column) -> Column:
    """Lines as readers see them: cut at CR, LF and CRLF, without an empty last one, trailing white space gone."""
    cut = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    kept = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return F.transform(kept, strip_trailing)


def numbered_lines(texts: DataFrame, key: str = "log_id", text: str = "content") -> DataFrame:
    """key, n (from 0) and line."""
    return texts.select(key, F.posexplode(split_lines(F.col(text))).alias("n", "line"))


def logs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """log_id (its path) and content of each log; the scan fails where path isn't there."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("content"))


def long_logs(spark: SparkSession, path: str) -> DataFrame:
    """log_id, segment, n and line of logs of any length: a segment is a split of the file, so many tasks read one log.

    segment orders a log's splits and n the lines of a split; see operators.segments.
    """
    source = F.col("_metadata")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").text(path)
    return rows.select(source["file_path"].alias("log_id"), source["file_block_start"].alias("segment"), F.monotonically_increasing_id().alias("n"), strip_trailing(F.col("value")).alias("line"))


def source_files(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    """file and content of the files below path at any depth."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, directory, name and size of the files below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("directory"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"))


#: Names of logs, in the order in which they are looked for after the commit's own.
LOG_NAMES = ("build.log", "maven.log", "mavenLog.log", "output.log")
ROOT = ""


def pick_log(files: DataFrame, project: str = "project", commit: str = "commit") -> DataFrame:
    """One row of files (project, commit, directory, name) for each project and commit that has a log.

    directory is that below the extraction, or ROOT for files right in it. The directory
    named as the project comes first, else the first one by name, then the root; other
    directories aren't looked into. In each the commit's log comes first, then known
    names, then any other log by name.
    """
    named = F.max(F.when(F.col("directory") == F.col(project), F.col("directory")))
    first = F.min(F.when(F.col("directory") != ROOT, F.col("directory")))
    own = files.groupBy(project, commit).agg(F.coalesce(named, first).alias("_own"))
    logs = files.where(F.col("name").endswith(".log")).join(own, [project, commit]).where((F.col("directory") == F.col("_own")) | (F.col("directory") == ROOT))
    known = F.array_position(F.array(*[F.lit(x) for x in LOG_NAMES]), F.col("name"))
    rank = F.when(F.col("name") == F.concat(commit, F.lit(".log")), 0).when(known > 0, known).otherwise(F.lit(len(LOG_NAMES) + 1))
    return first_ranked(logs.drop("_own"), [project, commit], (F.col("directory") == ROOT).cast("int"), rank, F.col("name"))


def pick_directory(projects: DataFrame, directories: DataFrame, skip: tuple[str, ...] = ("m2",)) -> DataFrame:
    """project, input and directory, of each row of projects (project, input): the directory below its input that is
    named as the project, else the first other one by name that isn't skipped, else the input itself.

    directories: input, directory.
    """
    met = projects.join(directories, "input", "left")
    named = F.max(F.when(F.col("directory") == F.col("project"), F.col("directory")))
    first = F.min(F.when(~F.col("directory").isin(*skip), F.col("directory")))
    return met.groupBy("project", "input").agg(F.coalesce(named, first).alias("_d")).select("project", "input", F.coalesce("_d", "input").alias("directory"))


def earlier_results(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """The keyed results that a run before has written as JSON; empty where there are none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def config(spark: SparkSession, path: str) -> DataFrame:
    """One row whose settings map upper-cased keys to values; the last of a key wins.

    Blank lines, comments, and lines without a key before their first = are skipped.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(split_lines(F.col("value"))).alias("n", "line"))
    return parsed_config(lines)


def parsed_config(lines: DataFrame) -> DataFrame:
    """lines: n, line."""
    trimmed = F.regexp_replace("line", r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    pairs = lines.select("n", trimmed.alias("line")).where("line != '' AND NOT startswith(line, '#') AND instr(line, '=') > 1")
    pairs = pairs.select("n", F.upper(F.trim(F.substring_index("line", "=", 1))).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))
    last = pairs.groupBy("key").agg(F.max_by("value", "n").alias("value"))
    return last.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))


def setting(settings: Column, key: str, default: str | None = None, required: bool = False) -> Column:
    """A setting by its name in any case; a required one may not be blank."""
    value = F.coalesce(F.try_element_at(settings, F.lit(key.upper())), F.lit(default))
    if required:
        return F.when(value.isNull() | (F.trim(value) == ""), F.raise_error(F.lit(f"{key.upper()} isn't set"))).otherwise(value)
    return value


#: Names of settings, their types and what they are where they aren't set.
SETTINGS = {
    "MAX_REPAIR_ATTEMPTS": ("int", "3"),
    "VERBOSE": ("boolean", "false"),
    "EXTRACT": ("boolean", "true"),
    "CLASSIFY": ("boolean", "true"),
    "CLEAN": ("boolean", "false"),
    "LLM_MODEL": ("string", "default_model"),
    "LLM_CLIENT_PY": ("string", "llm/llm_client.py"),
    "PROMPT_CLASSES": ("string", "default"),
    "SKIP_PROMPT_GENERATION": ("boolean", "false"),
    "SPECIFIC_FILE": ("string", None),
    "CATEGORY": ("string", None),
    "JSON_OUTPUT": ("string", None),
    "SPOON_JAR": ("string", None),
}


def typed_settings(settings: Column) -> list[Column]:
    """All SETTINGS as typed columns, by their defaults where they aren't set; a blank file counts as none."""
    out = []
    for name, (kind, default) in SETTINGS.items():
        value = setting(settings, name, default)
        value = F.when(~blank(value), value) if name == "SPECIFIC_FILE" else value
        out.append((truth(value) if kind == "boolean" else value.cast(kind)).alias(name.lower()))
    return out


def archives(spark: SparkSession, path: str, glob: str = "*.jar") -> DataFrame:
    """path and content of the archives below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def jar_coordinates(jars: DataFrame) -> DataFrame:
    """path, group_id, artifact_id and version of each jar (path, content), from its first pom.properties that has group and artifact.

    A content is opened where it lies in its Arrow batch, one at a time.
    """

    def of(content: bytes | None) -> tuple[str | None, str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                for name in z.namelist():
                    if name.startswith("META-INF/maven/") and name.endswith("/pom.properties"):
                        text = z.read(name).decode("utf-8", "replace")
                        found = dict(x.strip().split("=", 1) for x in text.splitlines() if "=" in x and not x.startswith("#"))
                        if found.get("groupId") and found.get("artifactId"):
                            return found["groupId"], found["artifactId"], found.get("version")
        except zipfile.BadZipFile:
            pass
        return None, None, None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(x.as_buffer() if x.is_valid else None) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], ["path", "group_id", "artifact_id", "version"])

    return jars.select("path", "content").mapInArrow(read, "path string, group_id string, artifact_id string, version string")


def archive_packages(jars: DataFrame) -> DataFrame:
    """path and package, of each package that a jar (path, content) has classes in; no class is unpacked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer() if content.is_valid else b"")) as z:
                        names = {x.rpartition("/")[0] for x in z.namelist() if x.endswith(".class") and "/" in x and not x.startswith("META-INF/")}
                except zipfile.BadZipFile:
                    continue
                rows += [(where, x.replace("/", ".")) for x in sorted(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["path", "package"])

    return jars.select("path", "content").mapInArrow(read, "path string, package string")


def classpath(spark: SparkSession, path: str) -> DataFrame:
    """package, position, path, groupId, artifactId and version of the jars below a folder, in the order of their paths."""
    jars = archives(spark, path)
    known = jar_coordinates(jars).select("path", F.col("group_id").alias("groupId"), F.col("artifact_id").alias("artifactId"), "version")
    return archive_packages(jars).join(known, "path", "left").select("package", F.col("path").alias("position"), "path", "groupId", "artifactId", "version")


def archive_entries(found: DataFrame, at_once: int = 1 << 23) -> DataFrame:
    """path, entry and content of the files of archives (path, content); entries that would leave the target are skipped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "entry", "content"])
            rows.clear()
            return out

        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for name in z.namelist():
                        if not name.endswith("/") and not name.startswith("/") and ".." not in name.split("/"):
                            rows.append((where, name, z.read(name)))
                            size += len(rows[-1][2])
                            if size >= at_once:
                                yield flush()
                                size = 0
        if rows:
            yield flush()

    return found.select("path", "content").mapInArrow(read, "path string, entry string, content binary")


def extract(entries: DataFrame, folder: str) -> DataFrame:
    """Write the entries of archives as files below folder, a URI that all executors reach; path, entry and file of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for path, entry, content in zip(*(c.to_pylist() for c in batch.columns)):
                target = f"{root}/{path.rsplit('/', 1)[-1]}/{entry}"
                where.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(target) as f:
                    f.write(content)
                out.append(target)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("entry"), pa.array(out, pa.string())], ["path", "entry", "file"])

    return entries.select("path", "entry", "content").mapInArrow(write, "path string, entry string, file string")
