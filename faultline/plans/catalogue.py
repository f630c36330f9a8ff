"""Queries of the engine's own operators, each beside its DuckDB oracle.

The driver's tables stand in for the engine's inputs: event types and their numbers
for coordinates, conversations for logs with records, documents for log texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import categories, text
from faultline.operators import apidiff, buildlog, combos, impact, lookup, state
from faultline.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upgrade records: the type is the group, the number in props the artifact, the hour the versions."""
    k = F.get_json_object("props", "$.k")
    hour = F.date_format("ts", "HH")
    dependency = F.struct(F.col("event_type").alias("dependencyGroupID"), k.alias("dependencyArtifactID"), F.when(F.col("value") < 100, "low").when(F.col("value") < 150, " \t").otherwise("high").alias("previousVersion"), hour.substr(1, 1).alias("newVersion"))
    return _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("project"), F.col("event_id").cast("string").alias("breakingCommit"), F.when(F.col("event_type") == "error", "compilation_failure").when(F.col("event_type") == "click", "TEST_FAILURE").when(F.col("event_type") == "view", "no such").alias("failureCategory"), F.when(F.col("event_id") % 17 != 0, dependency).alias("updatedDependency"))


_R = r"""WITH r AS (SELECT cast(user_id AS VARCHAR) AS project, cast(event_id AS VARCHAR) AS commit_id, event_type AS g, json_extract_string(props, '$.k') AS a,
  CASE WHEN value < 100 THEN 'low' WHEN value < 150 THEN ' ' || chr(9) ELSE 'high' END AS p, substr(strftime(ts, '%H'), 1, 1) AS n, event_id % 17 <> 0 AS has,
  CASE event_type WHEN 'error' THEN 'compilation_failure' WHEN 'click' THEN 'TEST_FAILURE' WHEN 'view' THEN 'no such' END AS c FROM events),
u AS (SELECT * FROM r WHERE has AND a IS NOT NULL AND p <> ' ' || chr(9))"""


@query(_R + """ SELECT g AS dependencyGroupID, a AS dependencyArtifactID, p AS previousVersion, n AS newVersion, count(*)::INTEGER AS "count",
  array_to_string(list_sort(list(DISTINCT project)), ',') AS projects, array_to_string(list_sort(list(DISTINCT commit_id)), ',') AS breakingCommits,
  coalesce(array_to_string(list_sort(list(DISTINCT c) FILTER (c IS NOT NULL)), ','), '') AS failureCategories FROM u GROUP BY ALL""")
def combo_counts(spark, sf_dir):
    found = combos.combinations(_records(spark, sf_dir))
    return found.select(*combos.KEY, "count", *[F.array_join(c, ",").alias(c) for c in ("projects", "breakingCommits", "failureCategories")])


@query(_R + """ SELECT (SELECT count(*) FROM r) AS totalRecords, (SELECT count(*) FROM r WHERE c = 'compilation_failure') AS filteredRecords,
  (SELECT count(*) FROM (SELECT DISTINCT g, a, p, n FROM u WHERE c = 'compilation_failure')) AS uniqueCombinations""")
def combo_totals(spark, sf_dir):
    return combos.totals(_records(spark, sf_dir), "COMPILATION_FAILURE")


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\x00-\\x20]*$') AND NOT regexp_matches(lang, '^[\\x00-\\x20]*$')")
def blank_key_filter(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.where(~categories.blank(F.col("text")) & ~categories.blank(F.col("lang"))).select("doc_id", "lang", "source")


_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), 1) - 1 AS n, len(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS m FROM documents),
lines AS (SELECT doc_id, n::INTEGER AS n, regexp_replace(line, '[\s\x0B\x1C-\x1F]+$', '') AS line FROM l WHERE NOT (n = m - 1 AND line = ''))"""


@query(_LINES + " SELECT doc_id, n, line FROM lines")
def line_explode(spark, sf_dir):
    return readers.numbered_lines(_t(spark, sf_dir, "documents"), "doc_id", "text")


def _case(column: str, patterns, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in patterns) + f" ELSE '{otherwise}' END"


_KINDS = (("SHOUT", r"(?i)[A-Z]{4}!!"), ("TABLE", r" \| .*? \| "), ("LICENCE", r"(?i)licensed under (the )?(apache|gnu)"), ("MAIL", r"[a-z]+\.\d\d@mail\d"))


#: What a build would have written below a document.
_ENDING = "CASE doc_id % 10 WHEN 0 THEN 'BAD CLASS FILE: class file version' WHEN 1 THEN 'There were test failures' WHEN 2 THEN 'warnings found and -Werror specified' WHEN 3 THEN 'Failed to execute goal org.apache.maven.plugins:maven-enforcer-plugin' WHEN 4 THEN '[ERROR] x The following artifacts could not be resolved' WHEN 5 THEN 'failed to execute goal se.vandmo:dependency-lock-maven-plugin:2:check' WHEN 6 THEN 'Build success' WHEN 7 THEN 'Exit code: COMPILATION_ERROR' ELSE '' END"
_ENDED = f"text || chr(10) || {_ENDING}"


@query(f"SELECT doc_id, {_case('text', _KINDS, 'UNKNOWN')} AS kind, {_case(_ENDED, categories.PATTERNS, 'UNKNOWN')} AS category, quality FROM documents LEFT JOIN labels USING (doc_id)")
def first_match_category(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", categories.first_match(F.col("text"), _KINDS).alias("kind"), categories.first_match(F.expr(_ENDED)).alias("category"), "quality")


@query("""SELECT o_orderkey, CASE WHEN upper(s) IN ('TEST_FAILURE', 'BUILD_SUCCESS') THEN upper(s) ELSE 'UNKNOWN_FAILURE' END AS category, CASE WHEN upper(s) IN ('TEST_FAILURE', 'BUILD_SUCCESS') THEN false ELSE true END AS is_unknown
  FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'test_failure' WHEN 'O' THEN 'Build_Success' WHEN 'P' THEN ' TEST_FAILURE' END AS s FROM orders)""")
def category_normalise(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "test_failure").when(F.col("o_orderstatus") == "O", "Build_Success").when(F.col("o_orderstatus") == "P", " TEST_FAILURE")
    return _t(spark, sf_dir, "orders").select("o_orderkey", categories.parsed(s).alias("category"), categories.matches(s, "UNKNOWN_FAILURE").alias("is_unknown"))


@query("""WITH i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM conversations)
  SELECT conv_id, record::BIGINT AS record, min(turn) AS opened, count(*) - 1 AS details, string_agg(CASE WHEN role <> 'user' THEN cast(turn AS VARCHAR) END, ',' ORDER BY turn) AS turns FROM i WHERE record > 0 GROUP BY ALL""")
def islands_records(spark, sf_dir):
    rows = buildlog.islands(_t(spark, sf_dir, "conversations"), F.col("role") == "user", "conv_id", "turn")
    detail = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.col("turn")))), lambda x: x.cast("string"))
    return rows.groupBy("conv_id", "record").agg(F.min("turn").alias("opened"), (F.count("*") - 1).alias("details"), F.nullif(F.array_join(detail, ","), F.lit("")).alias("turns"))


@query(_LINES + r""", s AS (SELECT *, min(CASE WHEN regexp_matches(line, '[.]$') THEN n END) OVER w AS st FROM lines WINDOW w AS (PARTITION BY doc_id)),
f AS (SELECT *, CASE WHEN st IS NULL THEN 0 ELSE min(CASE WHEN n > st AND NOT starts_with(line, 'The') THEN n END) OVER w END AS fr FROM s WINDOW w AS (PARTITION BY doc_id)),
t AS (SELECT *, min(CASE WHEN n >= fr AND contains(line, '|') THEN n END) OVER w AS upto FROM f WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, n, line FROM t WHERE n >= fr AND (upto IS NULL OR n < upto)""")
def range_prune(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", readers.split_lines(F.col("text")).alias("lines"))
    kept = buildlog.kept_lines(F.col("lines"), lambda x: x.rlike("[.]$"), lambda x: x.startswith("The"), lambda x: F.contains(x, F.lit("|")))
    rows = lines.select("doc_id", kept.alias("kept")).select("doc_id", "kept.first", F.posexplode("kept.lines").alias("n", "line"))
    return rows.select("doc_id", (F.col("first") + F.col("n")).alias("n"), "line")


@query("""WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first, string_agg(cast(l_linenumber AS VARCHAR) || ':' || cast(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS e FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, string_agg(l_returnflag || '=' || e, ';' ORDER BY first, l_returnflag) AS files FROM f GROUP BY ALL""")
def group_nested(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("log_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("filePath"), F.col("l_linenumber").alias("lineNumber"), F.lit(None).cast("int").alias("columnNumber"), F.col("l_partkey").alias("message"), F.lit("").alias("details"))
    shown = F.transform("errorsByFile", lambda f: F.concat(f["filePath"], F.lit("="), F.array_join(F.transform(f["errors"], lambda e: F.concat(e["lineNumber"].cast("string"), F.lit(":"), e["message"].cast("string"))), ",")))
    return buildlog.by_file(rows).select(F.col("log_id").cast("long").alias("l_orderkey"), F.array_join(shown, ";").alias("files"))


@query("""SELECT l_orderkey, string_agg(l_returnflag || '=' || cast(c AS VARCHAR), ';' ORDER BY first, l_returnflag) AS by_flag, sum(c)::INTEGER AS total
  FROM (SELECT l_orderkey, l_returnflag, count(*) AS c, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def count_map_total(spark, sf_dir):
    flags = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("first"), F.collect_list("l_linenumber").alias("errors"))
    files = flags.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("first", F.col("l_returnflag").alias("filePath"), "errors"))).alias("files"))
    shown = F.array_join(F.transform(F.map_entries(buildlog.errors_by_file(F.col("files"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return files.select("l_orderkey", shown.alias("by_flag"), buildlog.total_errors(F.col("files")).alias("total"))


@query("SELECT conv_id, coalesce(arg_min(role, turn) FILTER (role <> 'user'), 'none') AS first_other FROM conversations GROUP BY conv_id")
def first_non_unknown(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(buildlog.first_known(F.col("role"), F.col("turn"), "user").alias("c"))
    return rows.select("conv_id", F.coalesce("c", F.lit("none")).alias("first_other"))


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS p FROM orders WHERE year(o_orderdate) < 1998 GROUP BY ALL), b AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS p FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY ALL)
  SELECT o_custkey, CASE WHEN a.n IS NULL THEN 'NEW' WHEN b.n IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS status, a.n AS old_n, b.n AS new_n, a.p IS DISTINCT FROM b.p AS priority_changed FROM a FULL JOIN b USING (o_custkey)
  WHERE a.n IS NULL OR b.n IS NULL OR a.n <> b.n OR a.p IS DISTINCT FROM b.p""")
def snapshot_diff(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    side = lambda when: orders.where(when).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("p"))
    found = apidiff.compare(side(F.year("o_orderdate") < 1998), side(F.year("o_orderdate") >= 1998), ["o_custkey"], ["n", "p"])
    return found.select("o_custkey", F.col("changeStatus").alias("status"), F.col("n.oldValue").alias("old_n"), F.col("n.newValue").alias("new_n"), F.col("p.changed").alias("priority_changed"))


@query("""WITH c AS (SELECT p_brand, arg_max(p_type, p_partkey) AS kind FROM part GROUP BY p_brand)
  SELECT p_partkey, p_brand, kind, string_agg(s_name, ',' ORDER BY s_name) AS makers FROM part JOIN c USING (p_brand) LEFT JOIN supplier ON s_suppkey = p_size GROUP BY ALL""")
def multi_index_lookup(spark, sf_dir):
    """Classes are brands, the last part's type wins; members are suppliers by number."""
    part, supplier = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    kinds = impact.last_of(part, "p_brand", "p_partkey").select("p_brand", F.col("p_type").alias("kind"))
    found = part.join(kinds, "p_brand").join(supplier, F.col("s_suppkey") == F.col("p_size"), "left").groupBy("p_partkey", "p_brand", "kind").agg(F.array_sort(F.collect_list("s_name")).alias("m"))
    return found.select("p_partkey", "p_brand", "kind", F.nullif(F.array_join("m", ","), F.lit("")).alias("makers"))


@query("""SELECT c_custkey, coalesce(s.found, n.n_name, r.r_name) AS found, CASE WHEN s.found IS NOT NULL THEN 1 WHEN n.n_name IS NOT NULL THEN 2 WHEN r.r_name IS NOT NULL THEN 3 END AS tier
  FROM customer c LEFT JOIN (SELECT s_suppkey, max(s_name) AS found FROM supplier GROUP BY ALL) s ON s.s_suppkey = c.c_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_custkey % 40 LEFT JOIN region r ON r.r_regionkey = c.c_nationkey % 7""")
def tiered_fallback(spark, sf_dir):
    """Customers by their number among suppliers, else among nations, else by nation among regions; each tier lacks some."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("second"), (F.col("c_nationkey") % 7).alias("third"))
    first = _t(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey").alias("c_custkey")).agg(F.max("s_name").alias("found"))
    second = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("second"), F.col("n_name").alias("found"))
    third = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("third"), F.col("r_name").alias("found"))
    return lookup.tiered(rows, [(first, ["c_custkey"]), (second, ["second"]), (third, ["third"])], "found").select("c_custkey", "found", "tier")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_processed(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.unprocessed(_t(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query(r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), l AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[1:-2] ELSE x END AS x, x[-1] = '' AS ended FROM d),
  e AS (SELECT doc_id, len(x) AS n, ended, x, list_distinct(x) AS y FROM l), f AS (SELECT *, CASE WHEN ended OR n = 0 OR list_position(x, x[-1]) = n THEN 0 ELSE 1 END AS moved FROM e)
  SELECT doc_id, n - len(y) + CASE WHEN n > len(y) THEN moved ELSE 0 END AS removed, CASE WHEN n > len(y) THEN moved ELSE 0 END AS added FROM f""")
def diff_sizes(spark, sf_dir):
    """How many lines the diff of each document against its text without repeated lines takes away and adds: no more than must be.

    What ends a text without a line end differs from the same words within it.
    """
    from faultline.functions.python import unified_diff

    text_ = F.coalesce("text", F.lit(""))
    ended = text_.endswith("\n")
    lines = F.split(F.when(ended, F.expr("substring(coalesce(text, ''), 1, length(text) - 1)")).otherwise(text_), "\n")
    once = F.concat(F.array_join(F.array_distinct(lines), "\n"), F.when(ended, "\n").otherwise(""))
    found = _t(spark, sf_dir, "documents").select("doc_id", F.filter(F.slice(F.split(unified_diff(text_, once), "\n"), 3, 1 << 30), lambda x: ~x.startswith("\\")).alias("x"))
    marked = lambda m: F.size(F.filter("x", lambda x: x.startswith(m))).cast("long")
    return found.select("doc_id", marked("-").alias("removed"), marked("+").alias("added"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return state.latest(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT conv_id, arg_max(role, turn) AS final_role, count(*)::INTEGER AS attempts FROM conversations GROUP BY conv_id")
def last_element(spark, sf_dir):
    attempts = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("failureCategory")))).alias("a"))
    return attempts.select("conv_id", state.final_category(F.col("a"), F.lit("none")).alias("final_role"), F.size("a").alias("attempts"))


@query(r"SELECT DISTINCT source, md5(regexp_replace(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F]+$', ''), '^[\s\x0B\x1C-\x1F]+', '')) AS line FROM documents")
def dedupe_normalised(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("source", F.md5(text.normal_line(F.col("text"))).alias("line")).dropDuplicates()


@query("SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'nation', n_name FROM nation WHERE n_regionkey = 1")
def bag_union(spark, sf_dir):
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    one = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    return one(nation, "nation", "n_name").unionByName(one(region, "region", "r_name")).unionByName(one(nation.where("n_regionkey = 1"), "nation", "n_name"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand || '.' END || CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_type || '(' || replace(p_name, ' ', ', ') || ')' END AS signature,
  p_brand || '#' || p_type || '(' || replace(p_name, ' ', ', ') || ')' AS executable, p_brand || '::' || p_type AS field FROM part""")
def signature_format(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "FIELD").otherwise("method")
    declaring = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_brand"))
    types = F.split("p_name", " ")
    return _t(spark, sf_dir, "part").select("p_partkey", text.qualified_signature(kind, declaring, F.col("p_type"), types).alias("signature"), text.describe_executable(F.col("p_brand"), F.col("p_type"), types).alias("executable"), text.describe_field(F.col("p_brand"), F.col("p_type")).alias("field"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'UNKNOWN' WHEN s_suppkey % 2 = 0 THEN n_name || ':' || s_name ELSE n_name || ':' || s_name || ':' || cast(s_suppkey AS VARCHAR) END AS coordinates,
  coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN n_name END, 'null') || ':' || s_name AS classifier, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN n_name END, 'null') || '-' || s_name AS descriptor FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def coordinates_format(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    group, some = F.when(F.col("s_acctbal") >= 0, F.col("n_name")), F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name"))
    version = F.when(F.col("s_suppkey") % 2 != 0, F.col("s_suppkey").cast("string"))
    return rows.select("s_suppkey", text.short_coordinates(F.lit("UNKNOWN"), group, F.col("s_name"), version).alias("coordinates"), text.classifier(some, F.col("s_name")).alias("classifier"), text.descriptor(some, F.col("s_name")).alias("descriptor"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'in_context' WHEN 'view' THEN 'anthropic_spoon_rules' WHEN 'purchase' THEN 'prompt_4' WHEN 'error' THEN 'final' END AS prompt, CASE event_type WHEN 'signup' THEN 'openrewrite' ELSE 'default' END AS reader FROM events""")
def token_synonyms(spark, sf_dir):
    kind = F.col("event_type")
    token = F.when(kind == "click", " In-Context ").when(kind == "view", "ANTHROPIC").when(kind == "purchase", "prompt4").when(kind == "signup", "Open-Rewrite").when(kind == "error", "Final-Spoon-Rules")
    return _t(spark, sf_dir, "events").select("event_id", text.prompt_kind(token).alias("prompt"), text.reply_reader(token).alias("reader"))


@query(r"SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(replace(url, '/', ' , '), '[,:]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM pages")
def path_list_parse(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(text.path_list(F.replace("url", F.lit("/"), F.lit(" , "))), "|").alias("parts"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS lang, CASE WHEN page_id % 2 = 0 THEN 'OpenRewriteRecipe' ELSE 'P' || CAST(page_id AS STRING) END AS class_name FROM pages""")
def regex_capture(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.nullif(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("")).alias("lang"), text.class_name(F.expr("html || CASE WHEN page_id % 2 = 0 THEN '' ELSE 'public  class P' || CAST(page_id AS STRING) || ' {' END")).alias("class_name"))


@query("""SELECT c_custkey, 'Customer ' || c_name || ' of ' || CASE WHEN c_custkey % 4 = 0 THEN 'nowhere' ELSE c_mktsegment END || '.' || CASE WHEN c_acctbal < 0 THEN '## Debt' || chr(10) || c_mktsegment || chr(10) ELSE '' END AS prompt FROM customer""")
def template_render(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    body = text.template("Customer {name} of {segment}.{debt}", {"name": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")), "debt": text.section("Debt", F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")))}, {"segment": "nowhere"})
    return rows.select("c_custkey", body.alias("prompt"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_extract(spark, sf_dir):
    parsed = F.from_json("props", "k INT, none STRING")
    return _t(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["none"].alias("missing"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS succeeded FROM lineitem GROUP BY l_orderkey")
def exists_predicate(spark, sf_dir):
    attempts = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_returnflag") == "R").alias("successful"))).alias("a"))
    return attempts.select("l_orderkey", state.succeeded(F.col("a")).alias("succeeded"))


@query("""SELECT p_partkey, p_brand, p_type, p_name FROM part WHERE lower(p_type) = 'economy' OR lower(p_brand) = 'economy' OR lower(p_name) = 'economy' OR contains(lower(p_brand || ':' || p_name || ':' || cast(p_size AS VARCHAR)), 'economy')""")
def or_filter(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("dependency", F.struct(F.col("p_type").alias("origin"), F.col("p_brand").alias("groupId"), F.col("p_name").alias("artifactId"), F.col("p_size").cast("string").alias("version")))
    return impact.filter_dependency(part, " Economy ").select("p_partkey", "p_brand", "p_type", "p_name")


@query()
def text_diff(spark, sf_dir):
    """Each document against its text without repeated lines."""
    from faultline.functions.python import unified_diff

    text_ = F.coalesce("text", F.lit(""))
    once = F.array_join(F.array_distinct(F.split(text_, "\n")), "\n")
    return _t(spark, sf_dir, "documents").select("doc_id", unified_diff(text_, once).alias("diff"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, sf_dir):
    """The events as a stream in batches of one file, merged by key into a versioned table."""
    from faultline.plans.storage import scratch
    from faultline.streaming.upserts import each_batch, upsert_into

    base = scratch(spark, "upsert")
    schema = _t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    table = upsert_into(_uri(f"{base}/table"), "user_id", "ts", "event_id", buckets=16)
    each_batch(stream, table, f"{base}/checkpoint", once=True).awaitTermination()
    return table.read(spark, schema).select("user_id", "event_id", "event_type", "value")


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


from faultline.plans import workflows  # noqa: E402, F401  registers its queries here
