"""Constructs on source lines, told by the shapes of their code: there is no parser, so types are known by their imports only.

Comments, strings, characters and text blocks aren't code; see operators.lexing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import normal_line
from faultline.operators import lexing
from faultline.plans.storage import checkpointed
from faultline.sources.readers import numbered_lines

#: A call's name isn't one of these.
_NO_CALL = r"(?!(?:if|for|while|switch|catch|try|return|synchronized|super|this|assert|throw|new|else|do|case|yield)\b)"
#: A kind, the pattern of its code, and the group that names it.
SHAPES = (
    ("IMPORT", r"^\s*import\s+(?:static\s+)?([\w.]+)", 1),
    ("ANNOTATION_USAGE", r"@([A-Z]\w*)", 1),
    ("CONSTRUCTOR_CALL", r"\bnew\s+([A-Z][\w.]*)\s*\(", 1),
    ("METHOD_INVOCATION", r"\b([A-Za-z_]\w*\.[a-z_]\w*)\s*\(", 1),
    # A call on what another gave, as c in a.b().c(); then one without a qualifier, unless its body shows that it is declared.
    ("METHOD_INVOCATION", r"[)\]]\s*\.\s*([a-z_]\w*)\s*\(", 1),
    ("METHOD_INVOCATION", r"(?:^|[^\w.$\s]|\b(?:return|throw|else|do|case|assert|yield))\s*\b" + _NO_CALL + r"([a-z_]\w*)\s*\((?![^()]*\)\s*(?:\{|throws\b))", 1),
    ("METHOD_REFERENCE", r"\b([A-Za-z_]\w*::\w+)", 1),
    ("CATCH", r"\bcatch\s*\(\s*(?:final\s+)?([A-Z][\w.]*)", 1),
    ("THROW", r"\bthrow\s+new\s+([A-Z][\w.]*)", 1),
    ("TYPE_CAST", r"\(\s*([A-Z]\w*)\s*\)\s*[\w(]", 1),
    ("LAMBDA", r"(\w+)\s*->", 1),
    ("CLASS_DECLARATION", r"\bclass\s+([A-Z]\w*)", 1),
    ("INTERFACE_DECLARATION", r"\binterface\s+([A-Z]\w*)", 1),
    ("ENUM_DECLARATION", r"\benum\s+([A-Z]\w*)", 1),
)


def found(line: Column) -> Column:
    """An array of constructType and signature, by the order of SHAPES and then of the line."""

    def named(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("constructType"), x.alias("signature")))

    return F.flatten(F.array(*[named(*s) for s in SHAPES]))


def imports(lines: DataFrame) -> DataFrame:
    """file, simple and qualified name of each type that a file imports, and of each member that it imports as static; lines: file, n, line."""
    name = lambda i: F.regexp_extract("line", r"^\s*import\s+(static\s+)?([\w.]+)\s*;", i)
    rows = lines.select("file", (name(1) != "").alias("static"), name(2).alias("qualified")).where("qualified != ''")
    return rows.select("file", F.substring_index("qualified", ".", -1).alias("simple"), "qualified", "static").distinct()


def coded(files: DataFrame) -> DataFrame:
    """file, n, line and code of files (file, content), written once, as imports, types and constructs are all looked for in it."""
    return checkpointed(lexing.code_lines(numbered_lines(files, "file", "content")))


def scan(files: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The constructs on the lines asked for (file, lineNumber from 1), or on all, of files (file, content).

    constructType, signature, file, lineNumber, codeLine, fullyQualifiedName and
    memberQualifiedName; the latter two where an import of the file tells the type or
    the member.
    """
    lines = coded(files)
    rows = lines.select("file", (F.col("n") + 1).alias("lineNumber"), "line", "code")
    if asked is not None:
        rows = rows.join(asked.select("file", "lineNumber").distinct(), ["file", "lineNumber"], "left_semi")
    rows = rows.select("file", "lineNumber", normal_line(F.col("line")).alias("codeLine"), F.explode(found(F.col("code"))).alias("x")).select("file", "lineNumber", "codeLine", "x.*")
    member = F.col("constructType").isin("METHOD_INVOCATION", "METHOD_REFERENCE")
    alone = member & ~F.col("signature").rlike(r"\W")
    simple = F.when(member, F.regexp_extract("signature", r"^(\w+)", 1)).otherwise(F.substring_index("signature", ".", -1))
    rows = rows.withColumn("simple", simple).withColumn("static", F.coalesce(alone, F.lit(False)))
    known = rows.join(imports(lines.withColumn("line", F.col("code"))), ["file", "simple", "static"], "left")
    qualified = F.when(F.col("constructType") == "IMPORT", F.col("signature")).otherwise(F.col("qualified"))
    part = F.regexp_extract("signature", r"(\w+)$", 1)
    of_member = F.when(F.col("static"), F.col("qualified")).otherwise(F.concat_ws(".", "qualified", part))
    return known.select("constructType", "signature", "file", "lineNumber", "codeLine", F.when(~member, qualified).alias("fullyQualifiedName"), F.when(member & F.col("qualified").isNotNull(), of_member).alias("memberQualifiedName"))


def declared_types(files: DataFrame) -> DataFrame:
    """fullyQualifiedName and sourcePath of the types that files (file, content) declare; a file's package is that of its first package line."""
    lines = coded(files).select("file", "n", "code")
    package = F.regexp_extract("code", r"^\s*package\s+([\w.]+)\s*;", 1)
    packages = lines.select("file", "n", package.alias("package")).where("package != ''").groupBy("file").agg(F.min_by("package", "n").alias("package"))
    names = F.regexp_extract_all("code", F.lit(r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)"), F.lit(1))
    types = lines.select("file", F.explode(names).alias("name")).join(packages, "file", "left")
    return types.select(F.concat_ws(".", "package", "name").alias("fullyQualifiedName"), F.col("file").alias("sourcePath")).distinct()
