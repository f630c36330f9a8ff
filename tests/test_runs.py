import ast
import json
import re
import time
import zipfile
from pathlib import Path

import pyspark
import pytest

from faultline import cli
from faultline.plans import batch, runner
from faultline.plans.workflows import _class_bytes
from faultline.sources import classfiles


def test_runner(spark):
    assert spark.range(10).count() == 10  # the first job of a session takes longer
    seen = []
    jobs = [("a", lambda: spark.range(10).count()), ("b", lambda: 1 / 0), ("c", lambda: time.sleep(60))]
    got = {o.key: o for o in runner.run(spark, jobs, threads=3, limit=5, each=seen.append)}
    assert got["a"].value == 10 and got["a"].successful
    assert isinstance(got["b"].error, ZeroDivisionError) and isinstance(got["c"].error, TimeoutError) and len(seen) == 3


def test_stop_all(spark):
    def stop():
        raise runner.StopAll("limit")

    got = [o for o in runner.run(spark, [(0, stop), *((i, lambda: time.sleep(0.2)) for i in range(1, 6))], threads=1)]
    assert len(got) == 6 and sum(isinstance(o.error, runner.StopAll) for o in got) >= 2


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "build.log").write_text("[ERROR] A.java:[1,2] bad\n[ERROR] why\nCOMPILATION ERROR")
    assert cli.main(["classify", str(tmp_path / "build.log"), "-j", str(tmp_path / "out")], spark) == 0
    (part,) = (tmp_path / "out").glob("*.json")
    report = json.loads(part.read_text())
    assert report["failureCategory"] == "COMPILATION_FAILURE" and report["errorsByFile"][0]["errors"][0]["details"] == ["why"]
    assert "line 1: bad" in capsys.readouterr().out
    for name, v in (("old", 1), ("new", 2)):
        (tmp_path / name).write_text(json.dumps({"fullyQualifiedName": "A", "v": v}))
    assert cli.main(["diff", str(tmp_path / "old"), str(tmp_path / "new")], spark) == 0 and "MODIFIED" in capsys.readouterr().out
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "1.json").write_text(json.dumps({"project": "p", "updatedDependency": {"dependencyGroupID": "g", "dependencyArtifactID": "a", "previousVersion": "1", "newVersion": "2"}}))
    assert cli.main(["combinations", str(tmp_path / "rec")], spark) == 0 and "'count': 1" in capsys.readouterr().out
    assert cli.main(["classify", str(tmp_path / "none.log")], spark) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["diff"], spark)
    assert e.value.code == 1


def test_batch_run(spark, tmp_path, capsys):
    """Records to results: logs by their tiers, a filter, a record by itself, what was done before, and rejects."""
    log = "[ERROR] A.java:[1,2] bad\nCOMPILATION ERROR"
    for commit, where in (("c1", "p/build.log"), ("c2", "c2.log"), ("c3", "other/zz.log"), ("c5", "p/build.log")):
        path = tmp_path / "projects" / commit / where
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(log)
    (tmp_path / "projects" / "c1" / "build.log").write_text("BUILD SUCCESS")  # the root comes last
    (tmp_path / "rec").mkdir()
    for i in range(1, 6):
        record = {"project": "p", "breakingCommit": f"c{i}", "breakingUpdateReproductionCommand": "run" if i != 5 else " ", "failureCategory": "TEST_FAILURE" if i == 2 else "COMPILATION_FAILURE"}
        (tmp_path / "rec" / f"r{i}.json").write_text(json.dumps(record))
    rec, projects, out = (str(tmp_path / x) for x in ("rec", "projects", "out"))
    assert cli.main(["run", "-i", rec, "-p", projects, "-o", out, "-c", "test_failure"], spark) == 0
    first = capsys.readouterr().out
    assert "'c2'" in first and "'c1'" not in first
    results, rejected = batch.run(spark, rec, projects, out, only="r1")
    assert {(r.breakingCommit, r.failureCategory, r.totalErrors) for r in results.collect()} == {("c1", "COMPILATION_FAILURE", 1), ("c2", "COMPILATION_FAILURE", 1)}
    results, rejected = batch.run(spark, rec, projects, out)
    assert {r.breakingCommit: r.logPath.rsplit("/", 2)[-2:] for r in results.collect()} == {"c1": ["p", "build.log"], "c2": ["c2", "c2.log"], "c3": ["other", "zz.log"]}
    assert {(r.breakingCommit, r.reason) for r in rejected.collect()} == {("c4", "no log"), ("c5", "no command")}
    assert results.first().errorsByFile == {"A.java": 1} and results.where("finishedAt IS NULL").count() == 0
    with pytest.raises(SystemExit):
        cli.main(["run", "-i", rec, "-p", projects, "-o", out, "-c", "no such"], spark)


def _record(folder, name, project, commit, **more):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps({"project": project, "breakingCommit": commit, "breakingUpdateReproductionCommand": "run", **more}))


def _log(projects, commit, project, text):
    path = projects / commit / project / "build.log"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_projects_that_share_a_commit(spark, tmp_path):
    """Each project gets its own log's result; a run over results of before keeps one a project and commit."""
    rec, projects, out = tmp_path / "rec", tmp_path / "projects", str(tmp_path / "out")
    for name, project, text in (("a", "left", "COMPILATION ERROR"), ("b", "right", "BUILD SUCCESS")):
        _record(rec, name, project, "c1")
        _log(projects, "c1", project, text)
    for force in (False, False, True):
        results, rejected = batch.run(spark, str(rec), str(projects), out, force=force)
        assert sorted((r.project, r.breakingCommit, r.failureCategory, r.logPath.split("/")[-2]) for r in results.collect()) == [("left", "c1", "COMPILATION_FAILURE", "left"), ("right", "c1", "BUILD_SUCCESS", "right")]
        assert rejected.count() == 0


def test_attempts_and_threads(spark, tmp_path, capsys):
    """What failed is tried again until it had its attempts, what succeeded isn't; a clean run begins anew."""
    rec, projects, out = tmp_path / "rec", tmp_path / "projects", str(tmp_path / "out")
    for commit, text in (("c1", "COMPILATION ERROR"), ("c2", "BUILD SUCCESS")):
        _record(rec, commit, "p", commit)
        _log(projects, commit, "p", text)
    run = ["run", "-i", str(rec), "-p", str(projects), "-o", out, "-t", "1"]

    def tried(*more):
        assert cli.main([*run, *more], spark) == 0
        return {r.breakingCommit: r.attempts for r in batch.kept_results(spark, out).collect()}

    assert tried() == tried() == {"c1": 1, "c2": 1}
    assert tried("-a", "3") == {"c1": 2, "c2": 1}
    assert tried("-a", "3") == tried("-a", "3") == {"c1": 3, "c2": 1}
    _log(projects, "c1", "p", "BUILD SUCCESS")
    assert tried("-a", "9") == {"c1": 4, "c2": 1} and tried("-a", "9") == {"c1": 4, "c2": 1}
    capsys.readouterr()
    assert tried("--clean", "--verbose") == {"c1": 1, "c2": 1} and "BUILD_SUCCESS: 2" in capsys.readouterr().err


def test_records_that_repeat_or_clash(spark, tmp_path):
    rec, projects = tmp_path / "rec", tmp_path / "projects"
    _record(rec, "a", "p", "c1")
    _record(rec, "b", "p", "c1")
    _record(rec, "c", "p", "c2", failureCategory="TEST_FAILURE")
    _record(rec, "d", "p", "c2", failureCategory="ENFORCER_FAILURE")
    for c in ("c1", "c2"):
        _log(projects, c, "p", "BUILD SUCCESS")
    results, rejected = batch.run(spark, str(rec), str(projects), str(tmp_path / "out"))
    assert [r.breakingCommit for r in results.collect()] == ["c1"]
    assert [(r.breakingCommit, r.reason) for r in rejected.collect()] == [("c2", "records clash")]


def test_results_survive_a_driver_lost_while_they_are_replaced(spark, tmp_path):
    rec, projects, out = tmp_path / "rec", tmp_path / "projects", tmp_path / "out"
    _record(rec, "a", "p", "c1")
    _log(projects, "c1", "p", "BUILD SUCCESS")
    batch.run(spark, str(rec), str(projects), str(out))
    (out / "results").rename(out / "results-new")  # lost behind the removal of the old table
    _record(rec, "b", "p", "c2")
    _log(projects, "c2", "p", "COMPILATION ERROR")
    results, _ = batch.run(spark, str(rec), str(projects), str(out))
    assert {r.breakingCommit for r in results.collect()} == {"c1", "c2"}
    (out / "results-new").mkdir()  # lost while the new table was written
    (out / "results-new" / "part-0.json").write_text("{")
    results, _ = batch.run(spark, str(rec), str(projects), str(out))
    assert {r.breakingCommit for r in results.collect()} == {"c1", "c2"}


def test_files_are_told_by_whole_names(spark, tmp_path, capsys):
    for name in ("x/A.java", "x/BA.java", "y/B.java", "z/B.java"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"import {name[0]}.{name[2:-5]};\n" * 2)
    asked = ["lines", "--project", str(tmp_path), "--file"]
    assert cli.main([*asked, "A.java"], spark) == 0
    shown = capsys.readouterr().out
    assert "'x.A'" in shown and "x.BA" not in shown
    assert cli.main([*asked, "B.java"], spark) == 2 and "several files" in capsys.readouterr().err
    assert cli.main([*asked, "y/B.java"], spark) == 0 and "'y.B'" in capsys.readouterr().out
    assert cli.main(["--rows", "1", *asked, "A.java"], spark) == 0
    shown = capsys.readouterr()
    assert shown.out.count("constructType") == 1 and "only the first 1 rows" in shown.err


def test_lines_and_reports(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "App.java").write_text("import x.Helper;\nclass App {\n  int m() { return Helper.make(new Helper()); }\n}")
    changes = {"fullyQualifiedName": "x.Helper", "elementType": "CLASS", "changeStatus": "MODIFIED", "detail": {"constructors": [], "methods": [{"memberType": "METHOD", "name": "make", "changeStatus": "REMOVED", "parameterTypes": ["x.Helper"]}], "fields": []}}
    (tmp_path / "changes.json").write_text(json.dumps(changes))
    assert cli.main(["lines", "--project", str(tmp_path / "src"), "--line", "1"], spark) == 0
    assert "'signature': 'x.Helper'" in capsys.readouterr().out
    asked = ["report", "--project", str(tmp_path / "src"), "--file", "App.java", "--changes", str(tmp_path / "changes.json"), "--old", "o.jar", "--new", "n.jar"]
    assert cli.main([*asked, "--line", "3", "-o", str(tmp_path / "out")], spark) == 0
    shown = capsys.readouterr().out
    assert "x.Helper.make(x.Helper)" in shown and "'matchType': 'CLASS'" in shown and "generatedAt" in shown
    (part,) = (tmp_path / "out").glob("part-*")
    assert json.loads(part.read_text())["constructs"]
    assert cli.main([*asked, "--line", "0"], spark) == 2


def _jar(path, classes, coordinates=None):
    with zipfile.ZipFile(path, "w") as z:
        for name, up, methods in classes:
            z.writestr(f"{name}.class", _class_bytes(name, up, methods))
        if coordinates:
            z.writestr("META-INF/maven/a/pom.properties", "groupId={}\nartifactId={}\nversion={}\n".format(*coordinates))


def test_two_archives(spark, tmp_path, capsys):
    """A method that moves to a superclass isn't removed; one that goes is; jars of the box are read as they are."""
    _jar(tmp_path / "old.jar", [("x/Base", None, ["own"]), ("x/Sub", "x/Base", ["up", "gone"])])
    _jar(tmp_path / "new.jar", [("x/Base", None, ["own", "up"]), ("x/Sub", "x/Base", [])])
    assert cli.main(["diff", str(tmp_path / "old.jar"), str(tmp_path / "new.jar"), str(tmp_path / "out")], spark) == 0
    rows = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert {(r["type"], r["name"], r["changeStatus"]) for r in rows} == {("x.Sub", "gone", "REMOVED"), ("x.Sub", "up", "UNCHANGED"), ("x.Base", "up", "NEW")}
    capsys.readouterr()
    real = next(p for p in (Path(pyspark.__file__).parent / "jars").glob("jackson-annotations*.jar"))
    with zipfile.ZipFile(real) as z:
        found = [classfiles.parsed(z.read(n)) for n in z.namelist() if n.endswith(".class")]
    assert all(found) and {"com.fasterxml.jackson.annotation.JsonInclude", "com.fasterxml.jackson.annotation.ObjectIdGenerator"} <= {c["type"] for c in found}
    one = next(c for c in found if c["type"].endswith(".ObjectIdGenerator"))
    assert {"canUseFor", "forScope"} <= {m["name"] for m in one["members"]} and one["supers"][0] == "java.lang.Object"
    assert classfiles.parsed(b"no class") is None and classfiles.parsed(b"") is None


def test_extract(spark, tmp_path, capsys):
    (tmp_path / "jars").mkdir()
    _jar(tmp_path / "jars" / "a.jar", [("x/A", None, []), ("x/B", None, [])], ("org", "a", "1"))
    assert cli.main(["extract", str(tmp_path / "jars"), str(tmp_path / "out")], spark) == 0
    assert "'files': 3" in capsys.readouterr().out
    assert {p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.*") if p.is_file()} == {"a.jar/x/A.class", "a.jar/x/B.class", "a.jar/META-INF/maven/a/pom.properties"}


def test_dependencies_of_lines(spark, tmp_path, capsys):
    """Types of jars, of the project itself and of the platform; a filter by dependency."""
    for folder in ("src/app", "jars"):
        (tmp_path / folder).mkdir(parents=True)
    _jar(tmp_path / "jars" / "wide.jar", [("org/x/A", None, [])], ("org", "wide", "1"))
    _jar(tmp_path / "jars" / "deep.jar", [("org/x/y/B", None, [])], ("org", "deep", "2"))
    (tmp_path / "src" / "app" / "Own.java").write_text("package app;\npublic class Own { }\n")
    (tmp_path / "src" / "app" / "Main.java").write_text("package app;\nimport org.x.A;\nimport org.x.y.B;\nimport app.Own;\nimport java.util.List;\nimport no.Such;\nclass Main { A a = new A(); int b = B.make(new Own()); }\n")
    asked = ["lines", "--project", str(tmp_path / "src"), "--file", "Main.java", "--classpath", str(tmp_path / "jars")]
    assert cli.main(asked, spark) == 0
    shown = [ast.literal_eval(x) for x in capsys.readouterr().out.splitlines()]
    found = {(r["constructType"], r["signature"], r["lineNumber"]): (r["dependency"]["origin"], r["dependency"]["artifactId"]) for r in shown}
    assert found["IMPORT", "org.x.A", 2] == found["CONSTRUCTOR_CALL", "A", 7] == ("MAVEN_DEPENDENCY", "wide")
    assert found["IMPORT", "org.x.y.B", 3] == found["METHOD_INVOCATION", "B.make", 7] == ("MAVEN_DEPENDENCY", "deep")
    assert found["IMPORT", "app.Own", 4] == found["CONSTRUCTOR_CALL", "Own", 7] == ("PROJECT_SOURCE", None)
    assert found["IMPORT", "java.util.List", 5] == ("JDK", None) and found["IMPORT", "no.Such", 6] == ("UNKNOWN", None)
    assert cli.main([*asked, "--dependency", "deep"], spark) == 0
    assert {ast.literal_eval(x)["lineNumber"] for x in capsys.readouterr().out.splitlines()} == {3, 7}
    (tmp_path / "changes.json").write_text(json.dumps({"fullyQualifiedName": "org.x.A", "elementType": "CLASS", "changeStatus": "MODIFIED", "detail": {"constructors": [], "methods": [], "fields": []}}))
    report = ["report", "--project", str(tmp_path / "src"), "--file", "app/Main.java", "--changes", str(tmp_path / "changes.json"), "--old", "o.jar", "--new", "n.jar", "--line", "7", "--classpath", str(tmp_path / "jars")]
    assert cli.main(report, spark) == 0
    (row,) = [ast.literal_eval(re.sub(r"datetime[.]datetime[(][^)]*[)]", "None", x)) for x in capsys.readouterr().out.splitlines()]
    assert {(c["signature"], c["dependency"]["coordinates"]) for c in row["constructs"]} >= {("A", "org:wide:1"), ("B.make", "org:deep:2")}
