"""Scalar functions over names, coordinates, signatures, templates and replies."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.categories import blank


def or_null_text(c: Column) -> Column:
    """A null becomes the text null, as string concatenation in Java has it."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def strip_trailing(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F]+$", "")


def strip_leading(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\p{Z}\t\n\x0B\f\r\x1C-\x1F]+", "")


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def container_path(c: Column) -> Column:
    """/project if blank; else with a leading slash."""
    return F.when(blank(c), "/project").when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))


def short_coordinates(origin: Column, group: Column, artifact: Column, version: Column) -> Column:
    """origin, g:a or g:a:v, by what is there."""
    return F.when(group.isNull() | artifact.isNull(), origin).when(version.isNull(), F.concat_ws(":", group, artifact)).otherwise(F.concat_ws(":", group, artifact, version))


def classifier(group: Column, artifact: Column) -> Column:
    return F.concat(or_null_text(group), F.lit(":"), or_null_text(artifact))


def descriptor(project: Column, commit: Column) -> Column:
    return F.concat(or_null_text(project), F.lit("-"), or_null_text(commit))


def parameters(types: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.coalesce(types, F.array().cast("array<string>")), ", ", "null"), F.lit(")"))


def qualified_signature(kind: Column, declaring: Column, name: Column, types: Column) -> Column:
    """Fields have no parameters; without a declaring type the bare name stands."""
    own = F.when(F.upper(kind).isin("METHOD", "CONSTRUCTOR"), F.concat(name, parameters(types))).otherwise(name)
    return F.when(blank(declaring), own).otherwise(F.concat(declaring, F.lit("."), own))


def describe_executable(declaring: Column, name: Column, types: Column) -> Column:
    return F.when(name.isNull(), "<unknown executable>").otherwise(F.concat(F.coalesce(declaring, F.lit("<unknown type>")), F.lit("#"), name, parameters(types)))


def describe_field(declaring: Column, name: Column) -> Column:
    return F.when(name.isNull(), "<unknown field>").otherwise(F.concat(F.coalesce(declaring, F.lit("<unknown type>")), F.lit("::"), name))


def describe_type(name: Column) -> Column:
    return F.coalesce(name, F.lit("<unknown type>"))


def change_line(match: Column) -> Column:
    """One line for an API change: a dash, kind, signature, status, compatibility and the changes; empty for null."""
    changes = F.array_join(F.transform(match["compatibilityChanges"], lambda c: F.concat(or_null_text(c["type"]), F.lit("("), or_null_text(c["semanticVersionImpact"]), F.lit(")"))), ", ")
    head = F.format_string(
        "- %s %s [status=%s, binaryCompatible=%s, sourceCompatible=%s]",
        F.coalesce(match["elementType"], F.lit("UNKNOWN")),
        or_null_text(F.coalesce(match["qualifiedSignature"], match["name"])),
        F.coalesce(match["changeStatus"], F.lit("UNKNOWN")),
        or_null_text(match["binaryCompatible"]),
        or_null_text(match["sourceCompatible"]),
    )
    return F.when(match.isNull(), "").otherwise(F.concat(head, F.when(blank(changes), "").otherwise(F.concat(F.lit(" changes="), changes))))


def looked_up(token: Column, names: Mapping[str, str], default: str | None = None) -> Column:
    """names[trimmed, lower-cased token], else the default."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(trimmed(token))), F.lit(default))


#: Tokens of prompts and the prompts they name; a dash reads as an underscore.
PROMPTS = {
    "default": "default", "in_context": "in_context", "context": "in_context", "anthropic": "anthropic_spoon_rules", "anthropic_spoon_rules": "anthropic_spoon_rules",
    "final": "final", "final_spoon_rules": "final", "v2_in_context": "v2_in_context", "baseline": "baseline", "base_line": "baseline",
    "baseline_spoon": "baseline_spoon", "baseline_spoon_rules": "baseline_spoon", "prompt_4": "prompt_4", "prompt4": "prompt_4", "prompt_5": "prompt_5", "prompt5": "prompt_5",
}
#: Prompts whose replies need another reader than the default one.
READERS = {"baseline_spoon": "baseline_spoon", "baseline-spoon": "baseline_spoon", "openrewrite": "openrewrite", "open-rewrite": "openrewrite", "rewrite": "openrewrite"}


def prompt_kind(token: Column) -> Column:
    return looked_up(F.replace(token, F.lit("-"), F.lit("_")), PROMPTS)


def reply_reader(prompt: Column) -> Column:
    return looked_up(prompt, READERS, "default")


def truth(c: Column) -> Column:
    """true or 1, false or 0; anything else is an error."""
    low = F.lower(trimmed(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), or_null_text(c))).cast("boolean"))


def path_list(c: Column) -> Column:
    """Parts between commas and colons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[,:]"), trimmed), lambda x: x != "")


def artifact_path(group: Column, artifact: Column, version: Column) -> Column:
    """Where a repository keeps a jar."""
    return F.format_string("%s/%s/%s/%s-%s.jar", F.replace(group, F.lit("."), F.lit("/")), artifact, version, artifact, version)


def position_key(file: Column, line: Column) -> Column:
    return F.when(file.isNull(), "unknown").otherwise(F.concat(file, F.lit(":"), line.cast("string")))


def normal_line(c: Column) -> Column:
    return strip_leading(strip_trailing(F.coalesce(c, F.lit(""))))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


#: How recipes look in replies, how a class is named, and its name where it has none.
YAML_RECIPE = r"(?s)```(?:yaml|yml)?\s*(type:\s*specs.openrewrite.org/v1beta/recipe.*?)```"
YAML_MARK = "type: specs.openrewrite.org/v1beta/recipe"
JAVA_RECIPE = r"(?s)```(?:java)?\s*(package\s+[\w.]+\s*;.*?public\s+class\s+\w+.*?extends\s+Recipe.*?\})"
CLASS_NAME = r"public\s+class\s+([A-Za-z_][A-Za-z0-9_]*)"
UNNAMED = "OpenRewriteRecipe"


def recipe_yaml(reply: Column) -> Column:
    """A recipe in a fenced block, else the whole text if it names one, else empty."""
    fenced = trimmed(F.regexp_extract(reply, YAML_RECIPE, 1))
    return F.coalesce(first_non_empty(fenced, F.when(F.contains(reply, F.lit(YAML_MARK)), trimmed(reply))), F.lit(""))


def recipe_java(reply: Column) -> Column:
    fenced = trimmed(F.regexp_extract(reply, JAVA_RECIPE, 1))
    raw = trimmed(reply)
    named = F.contains(reply, F.lit("extends Recipe")) | F.contains(reply, F.lit("implements Recipe"))
    return F.coalesce(first_non_empty(fenced, F.when(named & (raw.startswith("package ") | raw.startswith("import ")), raw)), F.lit(""))


def recipe(reply: Column) -> Column:
    """The YAML recipe, else the Java one; an error if the reply has neither."""
    return F.coalesce(first_non_empty(recipe_yaml(reply), recipe_java(reply)), F.raise_error(F.lit("the reply has no recipe")).cast("string"))


def class_name(code: Column, default: str = UNNAMED) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, CLASS_NAME, 1), F.lit("")), F.lit(default))


def recipe_runner(code: Column) -> Column:
    """The lines of a build file that activate a recipe: the name of a YAML one, or the class of a Java one with its package."""
    package = F.nullif(F.regexp_extract(code, r"package\s+([\w.]+)\s*;", 1), F.lit(""))
    named = F.nullif(trimmed(F.regexp_extract(code, r"(?m)^name:\s*(.+)$", 1)), F.lit(""))
    own = F.concat_ws(".", package, class_name(code))
    return F.concat(F.lit("<activeRecipes><recipe>"), F.when(F.contains(code, F.lit(YAML_MARK)), F.coalesce(named, F.lit(UNNAMED))).otherwise(own), F.lit("</recipe></activeRecipes>"))


def section(title: str, body: Column) -> Column:
    """A titled block, or nothing for a blank body."""
    return F.when(blank(body), "").otherwise(F.concat(F.lit(f"## {title}\n"), body, F.lit("\n")))


def template(text: str, values: Mapping[str, Column], defaults: Mapping[str, str] | None = None) -> Column:
    """text with each {name} replaced by its column, or its default where that is null."""
    parts: list[Column] = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", text)):
        parts.append(F.coalesce(values[part].cast("string"), F.lit((defaults or {}).get(part, ""))) if i % 2 else F.lit(part))
    return F.concat(*parts)


def agent_branch(generator: Column, process: Column) -> Column:
    return F.format_string("agent-%s-%s", generator, process)


def repair_branch(category: Column, process: Column) -> Column:
    return F.format_string("repair/%s-%s", F.lower(category), process)


def attempt_branch(n: Column, process: Column) -> Column:
    return F.format_string("attempt_%d-%s", n, process)


def short_id() -> Column:
    return F.substring(F.uuid(), 1, 8)


def dependency_summary(dependency: Column) -> Column:
    """origin, groupId, artifactId, version, coordinates and sourcePath; a null dependency is of origin UNKNOWN."""
    d, unknown = dependency, F.lit("UNKNOWN")
    origin_ = F.when(d.isNull(), unknown).otherwise(d["origin"])
    shown = F.when(d.isNull(), unknown).otherwise(short_coordinates(d["origin"], d["groupId"], d["artifactId"], d["version"]))
    return F.struct(origin_.alias("origin"), *[d[x].alias(x) for x in ("groupId", "artifactId", "version")], shown.alias("coordinates"), d["sourcePath"].alias("sourcePath"))


def derived_dependency(dependency: Column) -> dict[str, Column]:
    """libraryName, baseVersion and newVersion of a record's dependency, null without one."""
    d = dependency
    return {"libraryName": F.when(d.isNotNull(), classifier(d["dependencyGroupID"], d["dependencyArtifactID"])), "baseVersion": d["previousVersion"], "newVersion": d["newVersion"]}


def rule_generator(c: Column) -> Column:
    return F.coalesce(F.lower(F.when(~blank(c), c)), F.lit("spoon"))


def origin(source_in_project: Column, loaded: Column, module: Column, location: Column, directory_in_project: Column, jar_coordinate: Column) -> Column:
    """Where a type comes from: the project's sources, a named module, a jar with a coordinate, or unknown."""
    return (
        F.when(source_in_project, "PROJECT_SOURCE")
        .when(~F.coalesce(loaded, F.lit(False)), "UNKNOWN")
        .when((location.isNull() & module.isNotNull()) | F.lower(location).startswith("jrt:"), "JDK")
        .when(location.isNull(), "UNKNOWN")
        .when(directory_in_project.isNotNull(), F.when(directory_in_project, "PROJECT_SOURCE").otherwise("UNKNOWN"))
        .when(jar_coordinate.isNotNull(), "MAVEN_DEPENDENCY")
        .otherwise("UNKNOWN")
    )
