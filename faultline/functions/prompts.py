"""Formatters of prompts and readers of replies, by id."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.python import Registry
from faultline.functions.text import PROMPTS, READERS, class_name, first_non_empty, recipe_java, recipe_yaml, template, trimmed

#: What a prompt is told about a file, and what stands where a value is missing.
VALUES = {
    "PROJECT": "unknown",
    "BREAKING_COMMIT": "unknown",
    "DATASET_CATEGORY": "unknown",
    "INFERRED_CATEGORY": "unknown",
    "FILE_PATH": "",
    "FILE_ERROR_COUNT": "0",
    "FILE_ERRORS": "",
    "FILE_RELATED_CHANGES": "",
    "BREAKING_CLASSIFIER_REPORT": "",
    "CHANGE_IMPACT_REPORT": "",
    "BREAKING_CHANGES_REPORT": "",
    "DEPENDENCY_CHANGE_DIFF": "",
    "FILE_CONTENT": "",
}
#: The ids of formatters; texts come from a folder of templates, or are these short ones of our own.
IDS = tuple(dict.fromkeys(PROMPTS.values()))
OWN = "Project {PROJECT} at {BREAKING_COMMIT} fails with {INFERRED_CATEGORY} (listed as {DATASET_CATEGORY}).\nFile {FILE_PATH} has {FILE_ERROR_COUNT} errors:\n{FILE_ERRORS}\n{FILE_RELATED_CHANGES}Reports: {BREAKING_CLASSIFIER_REPORT}, {CHANGE_IMPACT_REPORT}, {BREAKING_CHANGES_REPORT}\n"
OWN_DIFF = "What changed in the dependency:\n{DEPENDENCY_CHANGE_DIFF}\nWrite rules that adapt the code.\n"


def templates(folder: str | None = None) -> dict[str, str]:
    """The text of each formatter: that in folder/<id>.txt, with {NAME} for values, else our own. folder: a path or a URI; it has a text for each kind, no more."""
    out = {i: OWN_DIFF if i.startswith("baseline") else OWN for i in IDS}
    if folder:
        where, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        for x in where.get_file_info(fs.FileSelector(path)):
            if x.extension == "txt":
                with where.open_input_stream(x.path) as f:
                    out[x.base_name.removesuffix(".txt")] = f.read().decode()
    return out


def formatters(folder: str | None = None, related_title: str = "Related API changes") -> Registry:
    """A column function for each id, of a map of values; blank related changes leave no section."""
    out = Registry()
    for name, text in templates(folder).items():

        def build(values: Column, text: str = text) -> Column:
            cells = {k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(d)) for k, d in VALUES.items()}
            related = cells["FILE_RELATED_CHANGES"]
            cells["FILE_RELATED_CHANGES"] = F.when(trimmed(related) == "", "").otherwise(F.concat(F.lit(f"\n{related_title}\n"), related, F.lit("\n\n")))
            return template(text, cells)

        out.register(name)(build)
    return out


def rendered(kind: Column, values: Column, folder: str | None = None) -> Column:
    """The prompt of each row's kind; an unknown kind is an error."""
    known, out = formatters(folder), None
    for name in templates(folder):
        text = known.find(name)(values)
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("no formatter for "), F.coalesce(kind, F.lit("null")))).cast("string"))


RULES_SECTION = r"(?s)<spoon_rules>\s*(.*?)\s*</spoon_rules>"
CODE_BLOCK = r"(?s)```(?:java)?\s*\n(.*?)```"


def rules(reply: Column) -> Column:
    """The rules of a reply: its section, else its first block of code, else the text itself."""
    section, block = (trimmed(F.regexp_extract(reply, p, 1)) for p in (RULES_SECTION, CODE_BLOCK))
    return F.coalesce(first_non_empty(section, block, trimmed(reply)), F.lit(""))


def blocks(reply: Column) -> Column:
    """All blocks of code of a reply, joined by empty lines, else the text itself."""
    found = F.array_join(F.transform(F.regexp_extract_all(reply, F.lit(CODE_BLOCK), F.lit(1)), trimmed), "\n\n")
    return F.coalesce(first_non_empty(found, trimmed(reply)), F.lit(""))


def readers() -> Registry:
    """A column function for each reader of replies; asked for another prompt's, the default one answers."""
    out = Registry()
    out.register("default")(rules)
    out.register("baseline_spoon")(blocks)
    out.register("openrewrite")(lambda reply: F.coalesce(first_non_empty(recipe_yaml(reply), recipe_java(reply)), F.lit("")))
    return out


def read(reply: Column, prompt: Column) -> Column:
    """What a reply holds, by the reader that its prompt has."""
    known, kind = readers(), F.lower(trimmed(F.coalesce(prompt, F.lit(""))))
    out = None
    for name, reader in READERS.items():
        text = known.find(reader)(reply)
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out.otherwise(known.find("default")(reply))


def named(code: Column, values: Mapping[str, str] | None = None) -> Column:
    """The name of the class in a reply's code."""
    return class_name(code, (values or {}).get("UNNAMED", "OpenRewriteRecipe"))
