"""Categories of failed builds: ordered patterns over logs, and lenient parsing of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schemas import RECORD_CATEGORIES

#: Ordered patterns of build logs; the first that is found decides. Java and RE2 read them alike.
PATTERNS = (
    ("JAVA_VERSION_FAILURE", r"(?i)(bad class file:.*?(class file version|wrong version)|class file has wrong version (\d+\.\d+), should be (\d+\.\d+))"),
    ("TEST_FAILURE", r"(?i)(\[ERROR\] Tests run:|There are test failures|There were test failures|Failed to execute goal org\.apache\.maven\.plugins:maven-surefire-plugin)"),
    ("WERROR_FAILURE", r"(?i)warnings found and -Werror specified"),
    ("ENFORCER_FAILURE", r"(?i)(Failed to execute goal org\.apache\.maven\.plugins:maven-enforcer-plugin|Failed to execute goal org\.jenkins-ci\.tools:maven-hpi-plugin)"),
    ("DEPENDENCY_RESOLUTION_FAILURE", r"(?i)(Could not resolve dependencies|\[ERROR\] Some problems were encountered while processing the POMs|\[ERROR\] .*?The following artifacts could not be resolved)"),
    ("DEPENDENCY_LOCK_FAILURE", r"(?i)Failed to execute goal se\.vandmo:dependency-lock-maven-plugin:.*?:check"),
    ("BUILD_SUCCESS", r"(?i)BUILD SUCCESS"),
    ("COMPILATION_FAILURE", r"(?i)(COMPILATION ERROR|Failed to execute goal io\.takari\.maven\.plugins:takari-lifecycle-plugin.*?:compile|Exit code: COMPILATION_ERROR)"),
)


#: Lower-case texts of which any match of a pattern holds one, so that most texts are never searched by it.
GUARDS = {
    "JAVA_VERSION_FAILURE": ("class file",),
    "TEST_FAILURE": ("tests run:", "test failures", "maven-surefire-plugin"),
    "WERROR_FAILURE": ("-werror specified",),
    "ENFORCER_FAILURE": ("maven-enforcer-plugin", "maven-hpi-plugin"),
    "DEPENDENCY_RESOLUTION_FAILURE": ("could not resolve dependencies", "processing the poms", "artifacts could not be resolved"),
    "DEPENDENCY_LOCK_FAILURE": ("dependency-lock-maven-plugin",),
    "BUILD_SUCCESS": ("build success",),
    "COMPILATION_FAILURE": ("compilation error", "takari-lifecycle-plugin", "compilation_error"),
}


def first_match(text: Column, patterns: tuple[tuple[str, str], ...] = PATTERNS, otherwise: str = "UNKNOWN") -> Column:
    """The name of the first pattern found in text; a CASE, so later ones aren't tried."""
    text = F.coalesce(text, F.lit(""))
    low, out = F.lower(text), None
    for name, pattern in patterns:
        hit = text.rlike(pattern)
        if patterns is PATTERNS:
            some = F.lit(False)
            for guard in GUARDS[name]:
                some = some | F.contains(low, F.lit(guard))
            hit = some & hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def blank(c: Column) -> Column:
    """Null, or nothing beyond characters up to U+0020."""
    return c.isNull() | c.rlike(r"^[\x00-\x20]*$")


def parsed(name: Column, domain: tuple[str, ...] = RECORD_CATEGORIES, otherwise: str = "UNKNOWN_FAILURE") -> Column:
    """The upper-cased name if the domain has it."""
    return F.when(F.upper(name).isin(*domain), F.upper(name)).otherwise(otherwise)


def matches(name: Column, category: str) -> Column:
    """A null or unknown name matches UNKNOWN_FAILURE."""
    return parsed(name) == category
