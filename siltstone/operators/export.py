"""Reports: SARIF results and DOT graphs as rows or one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The format's version and schema, and the rules by level.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
RULES = (("interface-break", "error"), ("dependency-divergence", "warning"), ("structural-mutation", "note"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, result): one JSON object for each (path, rule, message); its level is the rule's."""
    level = F.create_map(*(F.lit(x) for pair in RULES for x in pair))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    body = F.struct(
        F.col("rule").alias("ruleId"),
        F.coalesce(F.try_element_at(level, F.col("rule")), F.lit("note")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        place.alias("locations"),
    )
    return findings.select("path", F.to_json(body).alias("result"))


def sarif_document(findings: DataFrame, tool: str = "siltstone") -> DataFrame:
    """One row: a whole document of the results in order; for reports of a size that one reader takes."""
    rules = F.array(*(F.struct(F.lit(r).alias("id")) for r, _ in RULES))
    driver = F.to_json(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")))
    results = sarif_results(findings).agg(F.array_join(F.array_sort(F.collect_list("result")), ",").alias("all"))
    head = F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":')
    return results.select(F.concat(head, driver, F.lit(',"results":['), "all", F.lit("]}]}")).alias("sarif"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line) of each (src, dst, label) for a digraph's body."""
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    label = F.replace(F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return edges.select(F.concat(F.lit("  "), name("src"), F.lit(" -> "), name("dst"), F.lit(' [label="'), label, F.lit('"];')).alias("line"))


#: Which rule a part of a program's diff breaks; the others are structural.
_RULE_OF = {"declaration": RULES[0][0], "dependency": RULES[1][0]}
_RULE_OF_SEVERITY = {"interface": RULES[0][0], "dependency": RULES[1][0]}


def _rule(name, known: dict[str, str]):
    rules = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(rules, name), F.lit(RULES[2][0]))


def diff_findings(told: DataFrame) -> DataFrame:
    """(path, rule, message) of a program_diff, for SARIF."""
    message = F.concat_ws(" ", F.translate("part", "_", " "), "target", F.translate("action", "_", " "))
    return told.select("path", _rule(F.col("part"), _RULE_OF).alias("rule"), message.alias("message"))


def impact_findings(slices: DataFrame) -> DataFrame:
    """(path, rule, message) of changed files (path, severity, callers, files, tests: how many a change reaches)."""
    reach = F.format_string("%s change: %d direct callers, %d files and %d tests affected", F.translate("severity", "_", " "), "callers", "files", "tests")
    quiet = F.concat(F.translate("severity", "_", " "), F.lit(" change: the interface is as it was"))
    loud = F.col("severity").isin(*_RULE_OF_SEVERITY)
    return slices.select("path", _rule(F.col("severity"), _RULE_OF_SEVERITY).alias("rule"), F.when(loud, reach).otherwise(quiet).alias("message"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(line) of each row as a JSON object, as test runners read an impact."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def function_dots(edges: DataFrame, src: str, dst: str, label: str) -> DataFrame:
    """(path, function, dot): a digraph's cluster for the control or data flow of each function, edges in order."""
    quoted = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    prefix = F.concat(F.lit('  "'), F.sha2(F.concat_ws(":", "path", "function"), 256).substr(1, 12), F.lit("_"))
    node = lambda c: F.concat(prefix, F.col(c).cast("string"), F.lit('"'))
    line = F.concat(node(src), F.lit(" -> "), F.ltrim(node(dst)), F.lit(' [label="'), quoted(F.col(label)), F.lit('"];'))
    made = edges.groupBy("path", "function").agg(F.array_sort(F.collect_list(F.struct(src, dst, label, line.alias("line")))).alias("all"))
    head = F.concat(F.lit('subgraph "cluster_'), quoted(F.concat_ws(":", "path", "function")), F.lit('" {\n'))
    return made.select("path", "function", F.concat(head, F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("dot"))
