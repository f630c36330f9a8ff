import json
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import categories, text
from faultline.functions.python import Registry, unified_diff
from faultline.operators import apidiff, buildlog, combos, impact, lookup, rewrite, segments, state
from faultline.sources import readers, writers
from faultline.streaming import upserts

E = "[ERROR] /project/src/Foo.java:[10,5] cannot find symbol"
LOGS = {
    "inline": f"{E}\n[ERROR]   symbol:   class Bar\n[ERROR]   location: class Foo\nCOMPILATION ERROR\n",
    "marked": f"[INFO] x\n{E}\n[WARNING] For more or less details, use\n[WARNING] more\n[WARNING] still\n[ERROR] B.java:[3] no column  \n[ERROR]\n[ERROR] -> see\n{E}\n[ERROR] Failed to execute goal y: -> [Help 1]\n[ERROR] -> [Help 1]\n[ERROR] C.java:[1,1] late\n",
    "marker at the end": f"{E}\n[WARNING] For more or less details",
    "listed twice": f"{E}\n[ERROR] one\n{E}\n[ERROR] one",
    "crlf": f"{E}\r\n[ERROR] d \t\r\n",
    "none": "BUILD SUCCESS\nCOMPILATION ERROR",
    "end first": f"[ERROR] -> [Help 1]\n{E}\n[WARNING] For more or less details\nnext\n{E}",
    "empty": "",
    "null": None,
}


def plain(content):
    """A restatement in plain Python."""
    lines = [x.rstrip() for x in re.split(r"\r\n|\r|\n", content or "")]
    if lines and lines[-1] == "":
        lines.pop()
    start = next((i for i, x in enumerate(lines) if buildlog.START in x), None)
    if start is None:
        start = 0
    else:
        start += 1
        while start < len(lines) and lines[start].startswith("[WARNING]"):
            start += 1
    end = next((i for i in range(start, len(lines)) if lines[i].startswith(buildlog.END)), len(lines))
    out = []
    for x in lines[start:end]:
        if m := re.fullmatch(buildlog.HEADER, x):
            out.append((m[1], int(m[2]), int(m[3]) if m[3] else None, m[4], []))
        elif x.startswith("[ERROR]") and out and (d := x[7:].lstrip()) and not d.startswith("->"):
            out[-1][4].append(d)
    return out


def test_errors_and_reports(spark):
    logs = spark.createDataFrame(list(LOGS.items()), "log_id string, content string")
    lines = readers.numbered_lines(logs)
    ways = [buildlog.errors(lines), buildlog.errors_of(logs), *(segments.errors(segments.segmented(lines, size=k)) for k in (1, 2, 3, 100))]
    for found in ways:
        got = {}
        for r in found.orderBy("log_id", "seq").collect():
            got.setdefault(r.log_id, []).append((r.filePath, r.lineNumber, r.columnNumber, r.message, list(r.details)))
        assert got == {k: v for k, c in LOGS.items() if (v := plain(c))}
    reports = {r.originalFailurePath: r for r in buildlog.reports(logs).collect()}
    assert {k: r.failureCategory for k, r in reports.items()} == {k: "COMPILATION_FAILURE" if k == "inline" else "BUILD_SUCCESS" if k == "none" else "UNKNOWN" for k in LOGS}
    assert reports["empty"].errorsByFile == [] and [f.filePath for f in reports["marked"].errorsByFile] == ["B.java", "/project/src/Foo.java"]
    counts = {r.k: r.m for r in buildlog.reports(logs).select(F.col("originalFailurePath").alias("k"), buildlog.errors_by_file(F.col("errorsByFile")).alias("m")).collect()}
    assert counts["listed twice"] == {"/project/src/Foo.java": 2} and counts["none"] is None
    lines = [r.line for r in writers.printed(buildlog.by_file(buildlog.errors(readers.numbered_lines(logs)))).where("log_id = 'inline'").collect()]
    assert lines == ["/project/src/Foo.java (1)", "  line 10: cannot find symbol", "    symbol:   class Bar", "    location: class Foo"]


@pytest.mark.parametrize("line,want", [
    ("bad class file: X class file version 61", "JAVA_VERSION_FAILURE"), ("bad class file:\nwrong version", "UNKNOWN"), ("class file has wrong version 55.0, should be 52.0", "JAVA_VERSION_FAILURE"), ("[error] tests run: 3", "TEST_FAILURE"), ("warnings found and -Werror specified", "WERROR_FAILURE"),
    ("Failed to execute goal org.jenkins-ci.tools:maven-hpi-plugin", "ENFORCER_FAILURE"), ("Could not resolve dependencies", "DEPENDENCY_RESOLUTION_FAILURE"), ("Failed to execute goal se.vandmo:dependency-lock-maven-plugin:1:check", "DEPENDENCY_LOCK_FAILURE"), ("Exit code: COMPILATION_ERROR", "COMPILATION_FAILURE"), (None, "UNKNOWN"),
])
def test_categories(spark, line, want):
    assert spark.createDataFrame([(line,)], "t string").select(categories.first_match(F.col("t"))).first()[0] == want


DEP = {"dependencyGroupID": "g", "dependencyArtifactID": "a", "previousVersion": "1", "newVersion": "2"}


def test_reports_combinations_and_sinks(spark, tmp_path):
    rows = [
        {"project": "p", "breakingCommit": "c1", "failureCategory": "test_failure", "updatedDependency": DEP, "extra": 1},
        {"project": "p", "breakingCommit": "c2", "failureCategory": "odd", "updatedDependency": DEP},
        {"project": "q", "breakingCommit": "c2", "failureCategory": None, "updatedDependency": {**DEP, "newVersion": "\t "}},
        {"project": "q", "breakingCommit": " ", "updatedDependency": None},
    ]
    for i, r in enumerate(rows):
        (tmp_path / f"{i}.json").write_text(json.dumps(r, indent=1))
    (tmp_path / "no.txt").write_text("{")
    records = readers.records(spark, str(tmp_path))
    (got,) = combos.combinations(records, with_rows=True).collect()
    assert (got["count"], got.projects, got.breakingCommits, got.failureCategories, len(got.records)) == (2, ["p"], ["c1", "c2"], ["odd", "test_failure"], 2)
    assert tuple(combos.totals(records, "UNKNOWN_FAILURE").first()) == (4, 3, 1)
    good, bad = state.validated(records)
    assert good.count() == 0 and {r.reason for r in bad.collect()} == {"no commit", "no command"}
    assert records.select(writers.as_json("project", "failureCategory").alias("j")).where("project = 'q'").first().j.count("null") == 0
    assert [r.record.breakingCommit for r in readers.report_files(spark, str(tmp_path / "1.json")).collect()] == ["c2"]
    assert {r.organisation for r in readers.records(spark, str(tmp_path), {"projectOrganisation": "organisation"}).collect()} == {None}
    writers.write_json(records.select("project", "breakingCommit"), str(tmp_path / "pretty"), pretty=True)
    shown = "".join(p.read_text() for p in sorted((tmp_path / "pretty").glob("part-*")))
    assert '{\n  "project" : "p",\n  "breakingCommit" : "c1"\n}' in shown
    (tmp_path / "9.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        readers.records(spark, str(tmp_path)).collect()


def test_config(spark, tmp_path):
    (tmp_path / "env").write_text("# c\n\nkey = a=b\n=x\nnone\nKey= last \nflag=1\npaths=a:, b\n")
    conf = readers.config(spark, str(tmp_path / "env"))
    s = F.col("settings")
    row = conf.select(readers.setting(s, "key").alias("key"), readers.setting(s, "zz", "d").alias("d"), text.truth(readers.setting(s, "Flag")).alias("flag"), text.path_list(readers.setting(s, "paths")).alias("paths")).first()
    assert tuple(row) == ("last", "d", True, ["a", "b"])
    with pytest.raises(Exception):  # noqa: B017
        conf.select(readers.setting(s, "zz", required=True)).collect()


def test_archives_and_listing(spark, tmp_path):
    def jar(path, files):
        path.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)

    jar(tmp_path / "p" / "a.jar", {"META-INF/maven/x/pom.properties": "groupId=\n", "META-INF/maven/y/pom.properties": "#c\ngroupId=g\nartifactId=a\nversion=1", "../evil": "x"})
    (tmp_path / "p" / "b.jar").write_bytes(b"no archive")
    got = {r.path.rsplit("/", 1)[1]: (r.group_id, r.artifact_id, r.version) for r in readers.jar_coordinates(readers.archives(spark, str(tmp_path))).collect()}
    assert got == {"a.jar": ("g", "a", "1"), "b.jar": (None, None, None)}
    assert {r.entry for r in readers.archive_entries(readers.archives(spark, str(tmp_path), "a.jar")).collect()} == {"META-INF/maven/x/pom.properties", "META-INF/maven/y/pom.properties"}
    assert {(r.directory, r.name) for r in readers.listing(spark, str(tmp_path)).collect()} == {("p", "a.jar"), ("p", "b.jar")}
    files = spark.createDataFrame([("p", "c", "", "build.log"), ("p", "c", "p", "z.log"), ("p", "c", "p", "output.log"), ("q", "c", "", "c.log"), ("q", "c", "", "build.log"), ("r", "c", "a", "x.log"), ("r", "c", "b", "c.log"), ("r", "c", "", "c.log"), ("s", "c", "a", "x.txt")], "project string, commit string, directory string, name string")
    assert {r.project: (r.directory, r.name) for r in readers.pick_log(files).collect()} == {"p": ("p", "output.log"), "q": ("", "c.log"), "r": ("a", "x.log")}
    assert readers.earlier_results(spark, str(tmp_path / "none")).count() == 0


def test_api_changes_and_impacts(spark):
    old = spark.createDataFrame([("A", "1", None), ("B", "1", "x"), ("C", "1", "x")], "k string, v string, w string")
    new = spark.createDataFrame([("A", "1", None), ("B", "2", "x"), ("D", "1", "x")], "k string, v string, w string")
    got = {r.k: (r.changeStatus, r.v.changed) for r in apidiff.compare(old, new, ["k"], ["v", "w"], keep_unchanged=True).collect()}
    assert got == {"A": ("UNCHANGED", False), "B": ("MODIFIED", True), "C": ("REMOVED", True), "D": ("NEW", True)}
    member = lambda kind, name, types: {"memberType": kind, "name": name, "changeStatus": "REMOVED", "binaryCompatible": False, "compatibilityChanges": [{"type": "METHOD_REMOVED", "semanticVersionImpact": "MAJOR"}], "parameterTypes": types}
    classes = [
        {"fullyQualifiedName": "x.A", "elementType": "CLASS", "changeStatus": "UNCHANGED", "changedMemberCount": 1, "detail": None},
        {"fullyQualifiedName": "x.A", "elementType": "CLASS", "changeStatus": "MODIFIED", "changedMemberCount": 2, "detail": {"constructors": [], "methods": [member("METHOD", "m", ["int"]), member("METHOD", "m", None)], "fields": [member("FIELD", "f", None)]}},
        {"fullyQualifiedName": "x.B", "elementType": "CLASS", "changeStatus": "MODIFIED", "detail": {"methods": [member("METHOD", "m", [])]}},
    ]
    df = spark.createDataFrame(classes, schemas.CLASS_CHANGE).withColumn("n", F.when(F.col("changeStatus") == "UNCHANGED", 0).otherwise(1))
    usages = spark.createDataFrame([{"constructType": "METHOD_INVOCATION", "fullyQualifiedName": None, "memberQualifiedName": "x.A.m", "file": "F", "lineNumber": 3, "codeLine": " a "}, {"constructType": "IMPORT", "fullyQualifiedName": "x.A", "file": "F", "lineNumber": 3, "codeLine": "a"}, {"constructType": "IMPORT", "fullyQualifiedName": "z"}], schemas.CONSTRUCT_USAGE)
    got = {(r.fullyQualifiedName, r.memberQualifiedName): [m.qualifiedSignature for m in r.apiChanges] for r in impact.impacts(usages, df, order="n").collect()}
    assert got == {(None, "x.A.m"): ["x.A.m()", "x.A.m(int)"], ("x.A", None): ["x.A"], ("z", None): []}
    wide = impact.impacts(usages, df, by_simple_name=True, order="n").where("memberQualifiedName IS NOT NULL").first()
    assert [m.qualifiedSignature for m in wide.apiChanges] == ["x.A.m()", "x.A.m(int)", "x.B.m()"]
    line = impact.impacts(usages, df, order="n").select(F.explode("apiChanges").alias("m")).select(text.change_line(F.col("m")).alias("t")).where("t LIKE '%m(int)%'").first().t
    assert line == "- METHOD x.A.m(int) [status=REMOVED, binaryCompatible=false, sourceCompatible=null] changes=METHOD_REMOVED(MAJOR)"
    assert impact.distinct_usages(usages.unionByName(usages)).count() == 3
    assert tuple(apidiff.summary(df).first()) == (3, 2, 3)


def test_text_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    n = F.lit(None).cast("string")
    assert one(text.container_path(n), text.container_path(F.lit("a")), text.container_path(F.lit("/a"))) == ("/project", "/a", "/a")
    assert one(text.parameters(F.array(F.lit("a"), n)), text.parameters(F.lit(None).cast("array<string>"))) == ("(a, null)", "()")
    assert one(text.describe_executable(n, F.lit("m"), F.array(F.lit("int"))), text.describe_type(n), text.describe_field(n, n)) == ("<unknown type>#m(int)", "<unknown type>", "<unknown field>")
    assert one(text.artifact_path(F.lit("a.b"), F.lit("c"), F.lit("1"))) == ("a/b/c/1/c-1.jar",)
    yaml = "x\n```yaml\ntype: specs.openrewrite.org/v1beta/recipe\nname: q\n```"
    java = "```java\npackage a.b;\npublic class Q extends Recipe { }\n```"
    assert one(text.recipe(F.lit(yaml)), text.class_name(text.recipe_java(F.lit(java)))) == ("type: specs.openrewrite.org/v1beta/recipe\nname: q", "Q")
    with pytest.raises(Exception):  # noqa: B017
        one(text.recipe(F.lit("nothing")))
    assert one(text.attempt_branch(F.lit(2), F.lit("p")), text.repair_branch(F.lit("X"), F.lit("p")), text.rule_generator(F.lit(" "))) == ("attempt_2-p", "repair/x-p", "spoon")
    t, f = F.lit(True), F.lit(False)
    assert one(text.origin(t, f, n, n, F.lit(None).cast("boolean"), n), text.origin(f, t, F.lit("java.base"), n, F.lit(None).cast("boolean"), n), text.origin(f, t, n, F.lit("file:/a.jar"), F.lit(None).cast("boolean"), F.lit("g:a"))) == ("PROJECT_SOURCE", "JDK", "MAVEN_DEPENDENCY")
    diff = spark.createDataFrame([("a\nb\n", "a\nc\n"), ("x", "x")], "a string, b string").select(unified_diff("a", "b").alias("d")).collect()
    assert "-b\n+c" in diff[0].d and diff[1].d == "Files are identical.\n"
    assert re.fullmatch("[0-9a-f]{8}", one(text.short_id())[0])
    r = Registry()
    r.register("spoon")(lambda: 1)
    r.register("agent", "spoon")(lambda: 2)
    assert r.find("Agent", "SPOON")() == 2 and r.find("other", "spoon")() == 1
    with pytest.raises(KeyError):
        r.find("x")


def test_state_lookup_and_rewrites(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert {(r.k, r.v) for r in state.latest(rows, "k", "t").collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.t) for r in state.upsert(rows, rows.withColumn("t", F.col("t") + 5), "k", "t").collect()} == {("a", 7), ("b", 6)}
    assert {r.k for r in lookup.unprocessed(rows, rows.where("k = 'a'"), "k").collect()} == {"b"}
    assert {r.v2 for r in lookup.memoised(rows, "k", lambda k: k.withColumn("v2", F.upper("k"))).collect()} == {"A", "B"}
    assert {(r.k, r.t) for r in lookup.first_ranked(rows, "k", -F.col("t")).collect()} == {("a", 2), ("b", 1)}
    assert tuple(state.progress(rows.select((F.col("t") == 1).alias("successful"))).first()) == (3, 2, 1)
    nodes = spark.createDataFrame([(1, "call", "old", "old(a)", ["a", "b"], ["i"]), (2, "field", "f", "f", [], ["i"])], "node_id int, node_type string, name string, code string, arguments array<string>, imports array<string>")
    call = F.col("node_type") == "call"
    out = rewrite.add_import(rewrite.remove_argument(rewrite.set_argument(rewrite.add_argument(rewrite.rename(nodes, {"old": "new"}), call, "c"), call, 0, "z"), call, 1), "j")
    got = {r.node_id: (r.name, r.arguments, r.imports) for r in out.collect()}
    assert got == {1: ("new", ["z", "c"], ["i", "j"]), 2: ("f", [], ["i", "j"])}
    assert rewrite.delete(nodes, call).count() == rewrite.of_type(nodes, "call").count() == 1
    assert rewrite.replace(rewrite.replace_text(nodes, "old", "x"), ~call, F.lit("q")).orderBy("node_id").select("code").collect() == [("x(a)",), ("q",)]


def test_streams(spark, tmp_path):
    schema = "k string, t int, v string"
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("a", i, f"v{i}"), (f"k{i}", 1, "w")], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    upserts.each_batch(stream, upserts.upsert_into(f"file://{tmp_path}/out", "k", "t"), str(tmp_path / "cp"), once=True).awaitTermination()
    table = upserts.KeyedTable(f"file://{tmp_path}/out", "k", "t")
    held = spark.read.parquet(src).schema
    assert {(r.k, r.v) for r in table.read(spark, held).collect()} == {("a", "v2"), ("k0", "w"), ("k1", "w"), ("k2", "w")}
    again = spark.createDataFrame([("a", 9, "v9"), ("a", 10, "v10"), ("k1", 0, "old")], schema)
    for _ in range(2):  # a batch that repeats changes nothing more
        table(again, 3)
    assert {(r.k, r.v) for r in table.read(spark, held).collect()} == {("a", "v10"), ("k0", "w"), ("k1", "w"), ("k2", "w")}
    for epoch in range(4, 8):
        table(spark.createDataFrame([("a", 20 + epoch, "w")], schema), epoch)
    kept = [p for p in (tmp_path / "out" / "data").glob("*/bucket=*")]
    assert len(kept) <= 6 and table.read(spark, held).count() == 4  # replaced files are gone
    q = upserts.latest_in_state(stream, "k", "v", "t").writeStream.outputMode("update").format("memory").queryName("latest_rows").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("a", "v2", 2) in {tuple(r) for r in spark.sql("SELECT k, v, t FROM latest_rows").collect()}


def test_state_is_ordered_by_number_and_time(spark, tmp_path):
    rows = [("a", 9, datetime(2020, 1, 9)), ("a", 10, datetime(2020, 1, 10)), ("b", 1, None), ("a", 2, datetime(2020, 1, 2))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k string, t int, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i % 2}")
    for order, want in (("t", {("a", 10), ("b", 1)}), ("at", {("a", datetime(2020, 1, 10))})):
        stream = spark.readStream.schema("k string, t int, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
        value = "at" if order == "t" else "t"
        q = upserts.latest_in_state(stream, "k", value, order).writeStream.outputMode("update").format("memory").queryName(f"by_{order}").option("checkpointLocation", f"{tmp_path}/cp_{order}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in state.latest(spark.table(f"by_{order}"), "k", order).select("k", order).collect()} == want
