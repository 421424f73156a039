"""Queries over a tree of source files made from the documents' ids, a file each, in four languages.

File d has 1 to 5 functions, each of which calls the first function of file d + 4, which is of the same language, under
another name, and its own file's first one. What this makes is stated in SQL from the ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.digest import path_hash
from siltstone.operators import code, export
from siltstone.plans.queries import _PATH_SQL, ORACLES, files_of, query
from siltstone.session import table
from siltstone.sources import manifest

#: (extension, first line, a function); a file has one line and seven for each function.
_LANGUAGES = (
    ("py", "from m@n import f@n_0 as h@n\n", "\n\ndef f@d_@j(a, b=1):\n    t = a + @j\n    if t > b:\n        return h@n(t, b)\n    return f@d_0(t, k=2)\n"),
    ("js", "import {f@n_0 as h@n} from './m@n';\n", "\n\nfunction f@d_@j(a, b) {\n  const t = a + @j;\n  if (t > b) { return h@n(t, b); }\n  return f@d_0(t);\n}\n"),
    ("go", "package m\n", "\n\nfunc f@d_@j(a int, b int) int {\n\tt := a + @j\n\tif t > b { return h@n(t, b) }\n\treturn f@d_0(t)\n}\n"),
    ("rs", "use crate::m@n::f@n_0 as h@n;\n", "\n\nfn f@d_@j(a: i32, b: i32) -> i32 {\n    let t = a + @j;\n    if t > b { return h@n(t, b); }\n    f@d_0(t)\n}\n"),
)


def _by_language(made) -> Column:
    which = F.col("doc_id") % 4
    out = F.when(which == 0, made(_LANGUAGES[0]))
    for i, language in enumerate(_LANGUAGES[1:], 1):
        out = out.when(which == i, made(language))
    return out


def _filled(text: Column, **values: Column) -> Column:
    for mark, value in values.items():
        text = F.replace(text, F.lit("@" + mark), value.cast("string"))
    return text


def source_tree(spark, d) -> DataFrame:
    """(doc_id, path, content)."""
    number = F.col("doc_id")
    functions = F.sequence(F.lit(0), F.floor(number / 4) % 5)
    body = _by_language(lambda x: F.array_join(F.transform(functions, lambda j: _filled(F.lit(x[2]), j=j)), ""))
    content = _filled(F.concat(_by_language(lambda x: F.lit(x[1])), body), d=number, n=number + 4)
    path = F.concat(F.lit("m"), number, F.lit("."), _by_language(lambda x: F.lit(x[0])))
    # Only ids are moved: a file is small where it is made and dear where it is parsed, so each core gets its share.
    ids = table(spark, d, "documents").select("doc_id").repartition(spark.sparkContext.defaultParallelism)
    return ids.select("doc_id", path.alias("path"), content.alias("content"))


def _changed_tree(spark, d) -> DataFrame:
    """The tree with arguments swapped in every third file and another default in the Python files after those."""
    third = F.col("doc_id") % 3
    swapped = F.replace("content", F.lit("(t, b)"), F.lit("(b, t)"))
    other = F.replace("content", F.lit("b=1)"), F.lit("b=3)"))
    return source_tree(spark, d).withColumn("content", F.when(third == 0, swapped).when(third == 1, other).otherwise(F.col("content")))


#: One row a function: file d, function j, language l, whether the file that it calls is there.
_FUNCTIONS_SQL = """(SELECT d, j, l, 'm' || d AS m, 'm' || d || '.' || ['py', 'js', 'go', 'rs'][l + 1] AS path, d + 4 AS n,
EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d + 4) AS there
FROM (SELECT doc_id AS d, CAST(doc_id % 4 AS INT) AS l, unnest(range(0, CAST(floor(doc_id / 4) AS BIGINT) % 5 + 1)) AS j FROM documents))"""
_OUTER_SQL = "m || ':f' || d || '_' || j AS src, 'm' || n || ':f' || n || '_0' AS dst"
_OWN_SQL = "m || ':f' || d || '_' || j AS src, m || ':f' || d || '_0' AS dst"


@query(f"SELECT path, 'function' AS kind, '' AS owner, 'f' || d || '_' || j AS name FROM {_FUNCTIONS_SQL}")
def tree_declarations(spark, d):
    return code.declarations(source_tree(spark, d)).select("path", "kind", "owner", "name")


@query(f"""SELECT path, CASE l WHEN 0 THEN '' WHEN 1 THEN './' ELSE 'crate::' END || 'm' || n AS module, 'f' || n || '_0' AS symbol, 'h' || n AS bound, 'call' AS usage
FROM {_FUNCTIONS_SQL} WHERE j = 0 AND l <> 2""")
def tree_imports(spark, d):
    return code.imports(source_tree(spark, d))


@query(f"""SELECT path, 'f' || d || '_' || j AS caller, unnest(['h' || n, 'f' || d || '_0']) AS callee, false AS is_async, CAST(1 AS BIGINT) AS times FROM {_FUNCTIONS_SQL}""")
def tree_calls(spark, d):
    return code.calls(source_tree(spark, d))


@query(f"""SELECT {_OUTER_SQL}, CAST(1 AS BIGINT) AS calls, true AS is_cross FROM {_FUNCTIONS_SQL} WHERE there AND l <> 2
UNION ALL SELECT {_OWN_SQL}, 1, false FROM {_FUNCTIONS_SQL}""")
def tree_call_graph(spark, d):
    return code.call_graph(source_tree(spark, d))


def _flow_sql(first: str = "'t'", second: str = "'b'") -> str:
    return f"""WITH outer_calls AS (SELECT {_OUTER_SQL}, {first} AS x, {second} AS y FROM {_FUNCTIONS_SQL} WHERE there AND l <> 2),
own_calls AS (SELECT {_OWN_SQL}, l FROM {_FUNCTIONS_SQL})
SELECT src, dst, CAST(0 AS BIGINT) AS place, x AS variable, false AS is_return FROM outer_calls UNION ALL SELECT src, dst, 1, y, false FROM outer_calls
UNION ALL SELECT dst, src, -1, '<return>', true FROM outer_calls UNION ALL SELECT src, dst, 0, 't', false FROM own_calls
UNION ALL SELECT src, dst, -2, 'k=<const>', false FROM own_calls WHERE l = 0 UNION ALL SELECT dst, src, -1, '<return>', true FROM own_calls"""


@query(_flow_sql())
def tree_flow_graph(spark, d):
    return code.flow_graph(source_tree(spark, d))


@query(_flow_sql("CASE WHEN d % 3 = 0 THEN 'b' ELSE 't' END", "CASE WHEN d % 3 = 0 THEN 't' ELSE 'b' END"))
def tree_flow_update(spark, d):
    old = code.flow_graph(source_tree(spark, d))
    changed = source_tree(spark, d).where("doc_id % 3 <> 2").select("path")
    return code.update_flow(old, _changed_tree(spark, d).select("path", "content"), changed)


@query(f"""SELECT path, 'structure' AS part, 'body_changed' AS action, 'f' || d || '_' || j AS target FROM {_FUNCTIONS_SQL} WHERE d % 3 = 0
UNION ALL SELECT path, 'declaration', 'changed', 'f' || d || '_' || j FROM {_FUNCTIONS_SQL} WHERE d % 3 = 1 AND l = 0""")
def tree_diff(spark, d):
    return code.program_diff(source_tree(spark, d), _changed_tree(spark, d))


@query(f"SELECT count(DISTINCT d) AS files, count(DISTINCT d) AS parsed, CAST(count(DISTINCT d) + 7 * count(*) AS BIGINT) AS lines FROM {_FUNCTIONS_SQL}")
def tree_bundles(spark, d):
    """All nine digests of every file: the parsing stage, measured in lines."""
    tree = source_tree(spark, d)
    parsed = code.bundles(tree).agg(F.count("*").alias("files"), F.count("composite").alias("parsed"))
    lines = tree.agg(F.sum(F.size(F.split("content", "\n")) - 1).alias("lines"))
    return parsed.crossJoin(lines)  # one row each


@query("""SELECT 'm' || doc_id || '.' || ['py', 'js', 'go', 'rs'][CAST(doc_id % 4 AS INT) + 1] AS path,
CASE WHEN doc_id % 3 = 2 THEN 'hit' ELSE 'miss' END AS found FROM documents""")
def manifest_lookup(spark, d):
    """Files found again: every third is as it was, one has grown, one is younger by a second and a half."""
    tree = source_tree(spark, d).select("doc_id", "path", F.length("content").cast("long").alias("length"))
    at = F.timestamp_millis(F.col("doc_id") * 1000 + 200)
    known = tree.select("path", "length", at.alias("modified"))
    grown = F.col("length") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    later = F.timestamp_millis(F.col("doc_id") * 1000 + F.when(F.col("doc_id") % 3 == 1, 1700).otherwise(900))
    hits, misses = manifest.look_up(tree.select("path", grown.alias("length"), later.alias("modified")), known)
    return hits.select("path", F.lit("hit").alias("found")).unionByName(misses.select("path", F.lit("miss").alias("found")))


def _digest_sql(edges: str, line: str) -> str:
    return f"""SELECT count(*) AS edges, sha256(string_agg(line || ':' || sha256(line) || ';', '' ORDER BY line)) AS digest
FROM (SELECT {line} AS line FROM ({edges}))"""


@query(_digest_sql(ORACLES["tree_call_graph"], """'{"calls":' || calls || ',"dst":"' || dst || '","is_cross":' || is_cross || ',"src":"' || src || '"}'"""))
def tree_call_digest(spark, d):
    return code.graph_digest(code.call_graph(source_tree(spark, d)))


@query(_digest_sql(ORACLES["tree_flow_graph"], """'{"dst":"' || dst || '","is_return":' || is_return || ',"place":' || place || ',"src":"' || src || '","variable":"' || variable || '"}'"""))
def tree_flow_digest(spark, d):
    return code.graph_digest(code.flow_graph(source_tree(spark, d)))


@query(f"""SELECT path, count(*) FILTER (part = 'declaration') AS errors, count(*) FILTER (part = 'dependency') AS warnings,
count(*) FILTER (part NOT IN ('declaration', 'dependency')) AS notes FROM ({ORACLES["tree_diff"]}) GROUP BY path""")
def tree_findings(spark, d):
    """The SARIF results of a diff by level."""
    told = export.sarif_results(export.diff_findings(tree_diff(spark, d)))
    level = F.get_json_object("result", "$.level")
    return told.groupBy("path").agg(*(F.count_if(level == x).alias(f"{x}s") for x in ("error", "warning", "note")))


@query(f"""SELECT path, lpad(lower(hex(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), [CAST('0x' || h AS UHUGEINT) FOR h IN regexp_extract_all(hex(encode(path)), '..')]),
lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616))), 16, '0') AS hash FROM (SELECT {_PATH_SQL} AS path FROM documents)""")
def path_hashes(spark, d):
    return files_of(table(spark, d, "documents")).select("path", path_hash(F.col("path")).alias("hash"))
