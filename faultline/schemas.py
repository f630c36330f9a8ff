"""Schemas of the engine's inputs and outputs, as DDL, and the domains of their enumerations."""

from __future__ import annotations

#: Categories that the log classifier gives.
LOG_CATEGORIES = ("JAVA_VERSION_FAILURE", "TEST_FAILURE", "WERROR_FAILURE", "ENFORCER_FAILURE", "DEPENDENCY_RESOLUTION_FAILURE", "DEPENDENCY_LOCK_FAILURE", "BUILD_SUCCESS", "COMPILATION_FAILURE", "UNKNOWN", "FAILURE_JAVADOC_GENERATION")
#: Categories of records and attempts.
RECORD_CATEGORIES = ("JAVA_VERSION_FAILURE", "TEST_FAILURE", "WERROR_FAILURE", "COMPILATION_FAILURE", "BUILD_SUCCESS", "ENFORCER_FAILURE", "DEPENDENCY_RESOLUTION_FAILURE", "DEPENDENCY_LOCK_FAILURE", "NO_DIFF", "SPOON_FAILURE", "UNKNOWN_FAILURE", "TRANSFORMATION_FAILURE", "MODEL_FAILURE", "FAILURE_JAVADOC_GENERATION")
#: Where a dependency comes from.
ORIGINS = ("PROJECT_SOURCE", "MAVEN_DEPENDENCY", "JDK", "UNKNOWN")
#: Kinds of constructs on a source line.
CONSTRUCTS = ("METHOD_INVOCATION", "CONSTRUCTOR_CALL", "FIELD_ACCESS", "TYPE_REFERENCE", "ANNOTATION_USAGE", "IMPORT", "LAMBDA", "METHOD_REFERENCE", "TYPE_CAST", "ARRAY_ACCESS", "ENUM_VALUE", "VARIABLE_ACCESS", "PACKAGE_REFERENCE", "ARRAY_TYPE_REFERENCE", "WILDCARD_REFERENCE", "TYPE_PARAMETER_REFERENCE", "CAST", "CATCH", "THROW", "LOCAL_VARIABLE", "PARAMETER", "TYPE_PARAMETER", "ARRAY_TYPE", "WILDCARD_TYPE", "CLASS_DECLARATION", "INTERFACE_DECLARATION", "ENUM_DECLARATION")

_DEPENDENCY = "dependencyGroupID STRING, dependencyArtifactID STRING, previousVersion STRING, newVersion STRING, dependencyScope STRING, versionUpdateType STRING, githubCompareLink STRING, mavenSourceLinkPre STRING, mavenSourceLinkBreaking STRING, updatedFileType STRING, dependencySection STRING, licenseInfo STRING, githubRepoSlug STRING"
UPGRADE_RECORD = f"url STRING, project STRING, projectOrganisation STRING, breakingCommit STRING, prAuthor STRING, preCommitAuthor STRING, breakingCommitAuthor STRING, updatedDependency STRUCT<{_DEPENDENCY}>, preCommitReproductionCommand STRING, breakingUpdateReproductionCommand STRING, javaVersionUsedForReproduction STRING, failureCategory STRING, licenseInfo STRING"

_ERROR = "lineNumber INT, columnNumber INT, message STRING, details ARRAY<STRING>"
LOG_LINE = "log_id STRING, n INT, line STRING"
BUILD_ERROR = f"log_id STRING, seq INT, filePath STRING, {_ERROR}, failureCategory STRING"
LOG_REPORT = f"originalFailurePath STRING, failureCategory STRING, errorsByFile ARRAY<STRUCT<filePath STRING, errors ARRAY<STRUCT<{_ERROR}>>>>"

_COMPAT = "STRUCT<type STRING, binaryCompatible BOOLEAN, sourceCompatible BOOLEAN, semanticVersionImpact STRING>"
_CHANGE = "STRUCT<oldValue STRING, newValue STRING, changed BOOLEAN>"
_STATUS = "changeStatus STRING, binaryCompatible BOOLEAN, sourceCompatible BOOLEAN"
_IFACE = f"name STRING, {_STATUS}, compatibilityChanges ARRAY<{_COMPAT}>"
_ANNOT = f"STRUCT<{_IFACE}, elements ARRAY<STRUCT<name STRING, changeStatus STRING, oldValues ARRAY<STRING>, newValues ARRAY<STRING>, compatibilityChanges ARRAY<{_COMPAT}>>>>"
_MEMBER = f"STRUCT<memberType STRING, name STRING, {_STATUS}, compatibilityChanges ARRAY<{_COMPAT}>, signature {_CHANGE}, value {_CHANGE}, oldModifiers ARRAY<STRING>, newModifiers ARRAY<STRING>, annotations ARRAY<{_ANNOT}>, parameterTypes ARRAY<STRING>>"
_DETAIL = f"STRUCT<classType STRING, superclass {_CHANGE}, interfaces ARRAY<STRUCT<{_IFACE}>>, classFileVersion {_CHANGE}, oldModifiers ARRAY<STRING>, newModifiers ARRAY<STRING>, annotations ARRAY<{_ANNOT}>, constructors ARRAY<{_MEMBER}>, methods ARRAY<{_MEMBER}>, fields ARRAY<{_MEMBER}>>"
_CLASS = f"elementType STRING, fullyQualifiedName STRING, simpleName STRING, packageName STRING, {_STATUS}, compatibilityChanges ARRAY<{_COMPAT}>, changedMemberCount INT, detail {_DETAIL}"
CLASS_CHANGE = _CLASS
COMPARISON_REPORT = f"oldJar STRING, newJar STRING, generatedAt STRING, summary STRUCT<totalClasses BIGINT, changedClasses BIGINT, changedMembers BIGINT>, classes ARRAY<STRUCT<{_CLASS}>>"

_ORIGIN = "STRUCT<origin STRING, groupId STRING, artifactId STRING, version STRING, sourcePath STRING>"
DEPENDENCY = _ORIGIN
CONSTRUCT_USAGE = f"constructType STRING, signature STRING, dependency {_ORIGIN}, file STRING, lineNumber INT, codeLine STRING, fullyQualifiedName STRING, memberQualifiedName STRING"
_MATCH = f"STRUCT<matchType STRING, elementType STRING, name STRING, qualifiedName STRING, qualifiedSignature STRING, {_STATUS}, compatibilityChanges ARRAY<STRUCT<type STRING, semanticVersionImpact STRING>>, changedMemberCount INT, signature {_CHANGE}, value {_CHANGE}, parameterTypes ARRAY<STRING>>"
IMPACT_REPORT = f"project STRING, file STRING, lineNumber INT, oldJar STRING, newJar STRING, generatedAt STRING, constructs ARRAY<STRUCT<constructType STRING, signature STRING, dependency {_ORIGIN}, apiChanges ARRAY<{_MATCH}>>>"

VERSION_COMBINATION = "dependencyGroupId STRING, dependencyArtifactId STRING, previousVersion STRING, newVersion STRING, count INT, projects ARRAY<STRING>, breakingCommits ARRAY<STRING>, failureCategories ARRAY<STRING>, apiDiffLines INT"
ATTEMPT = "attemptCount INT, processId STRING, failureCategory STRING, logFileParent STRING, successful BOOLEAN, containerId STRING"
RESULT = f"breakingCommit STRING, processId STRING, fullProcessId STRING, failureCategory STRING, attempts ARRAY<STRUCT<{ATTEMPT}>>"
SUMMARY = f"breakingCommit STRING, project STRING, initialCategory STRING, finalCategory STRING, logPath STRING, reportPath STRING, processId STRING, attempts ARRAY<STRUCT<{ATTEMPT}>>"
#: A result of one record, as a run keeps it; attempts: how often it was tried.
PROCESSED = "project STRING, breakingCommit STRING, containerPath STRING, logPath STRING, failureCategory STRING, totalErrors INT, errorsByFile MAP<STRING, INT>, finishedAt TIMESTAMP, attempts INT"
CONFIG = "key STRING, value STRING"
