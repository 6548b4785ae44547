"""Queries of the code-shaped operators over a source tree that is written from the tables.

No table holds code, so customers become files (Python, TypeScript or JavaScript, in a folder for each
nation, some of them tests) and their orders functions: each has an import line and a body that calls what it
imports and the function before it. Some imports take the local name of the import before, some that of the function
before; a class at the end of each file has a method with the name of the file's first function; some files have a folder of
their name with an index file in it. The text goes through the real readers; the SQL works out from the keys
alone, without reading any text, what they have to find, in which order they compete and which of them wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..operators import clones, clusters, graph
from ..runtime import stored, table
from ..sources import files as tree
from ..sources import units as parsing
from .catalog import query

# The text of an order's import line and function, in the SQL that both engines share. Of order o: its file's
# language, the file t of another customer (in folder nt) whose first order is fo, the order before it (prev), the local name of its import.
ALIAS = "CASE WHEN o % 31 = 0 THEN concat('o', prev) WHEN o % 7 = 0 THEN concat('i', prev) ELSE concat('i', o) END"
IMPORT_LINE = """CASE
    WHEN o % 17 = 0 THEN CASE WHEN language = 'python' THEN concat('from os.path import join as ', alias) ELSE concat('import ', alias, ' from ''react'';') END
    WHEN o % 11 = 0 THEN CASE WHEN language = 'python' THEN concat('from ..n', nt, '.c', t, ' import *') ELSE concat('export * from ''../n', nt, '/c', t, ''';') END
    WHEN o % 13 = 0 THEN CASE WHEN language = 'python' THEN concat('import src.n', nt, '.c', t) ELSE concat('import * as i', o, ' from "../n', nt, '/c', t, '";') END
    WHEN o % 19 = 0 AND language <> 'python' THEN concat('import { x as ', alias, ' } from ''lodash/map'';')
    WHEN language = 'python' THEN concat('from ..n', nt, '.c', t, ' import o', fo, ' as ', alias)
    ELSE concat('import { o', fo, ' as ', alias, ' } from ''../n', nt, '/c', t, ''';') END"""
PYTHON_BODY = "concat('    b = i', o, '(a)', chr(10), repeat(concat('    b = b + 1', chr(10)), CAST(o % 3 AS INT)), '    c = o', prev, '(b) if b else print(a)', chr(10), '    return c')"
SCRIPT_BODY = "concat('{', chr(10), '  const b = i', o, '(a);', chr(10), repeat(concat('  // step', chr(10)), CAST(o % 3 AS INT)), '  return o', prev, '(b);', chr(10), '}')"
UNIT_TEXT = f"""CASE
    WHEN language = 'python' AND o % 5 = 0 THEN concat('def o', o, '(a):', chr(10), '    return i', o, '(a)')
    WHEN language = 'python' THEN concat('def o', o, '(a):', chr(10), {PYTHON_BODY})
    WHEN language = 'typescript' THEN concat('export const o', o, ' = (a: number): number => ', {SCRIPT_BODY}, ';')
    ELSE concat('function o', o, '(a) ', {SCRIPT_BODY}) END"""
# The class at the end of the file of customer k, whose first order is f: its first line, its method from the name or ``def`` on, its end.
CLASS_LINE = "concat('class K', k, CASE WHEN language = 'python' THEN ':' ELSE ' {' END)"
METHOD = "CASE WHEN language = 'python' THEN concat('def o', f, '(self, a):', chr(10), '        b = a', chr(10), '        return b') ELSE concat('o', f, '(a) {', chr(10), '    return a;', chr(10), '  }') END"
CLASS = f"concat({CLASS_LINE}, chr(10), CASE WHEN language = 'python' THEN '    ' ELSE '  ' END, {METHOD}, CASE WHEN language = 'python' THEN '' ELSE concat(chr(10), '}}') END)"
INDEX = "concat(root, '/n', n, '/c', k, CASE language WHEN 'python' THEN '/__init__.py' WHEN 'typescript' THEN '/index.ts' ELSE '/index.js' END)"
LANGUAGE = "CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'javascript' END"
ROOT = "CASE WHEN k % 29 = 5 THEN 'tests' ELSE 'src' END"
PATH = f"concat({ROOT}, '/n', n, '/c', k, CASE k % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.js' END)"


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey k", "c_nationkey n").selectExpr("k", "n", f"{LANGUAGE} language", f"{PATH} path")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, source, language: one file for each customer, and an empty index file beside every tenth."""
    customers = customer_files(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey o", "o_custkey k")
    firsts = orders.groupBy(F.col("k").alias("t")).agg(F.min("o").alias("fo"))
    rows = orders.withColumn("t", F.col("o") * 31 % max(1, customers.count())).withColumn("prev", F.coalesce(F.lag("o").over(Window.partitionBy("k").orderBy("o")), F.col("o")))
    rows = rows.join(customers, "k").join(customers.select(F.col("k").alias("t"), F.col("n").alias("nt")), "t", "left").join(firsts, "t", "left")
    rows = rows.withColumn("fo", F.coalesce("fo", F.lit(0))).withColumn("alias", F.expr(ALIAS)).select("k", "o", F.expr(IMPORT_LINE).alias("head"), F.expr(UNIT_TEXT).alias("unit"))
    per = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("o", "head", "unit"))).alias("orders"))
    text = F.concat(F.array_join("orders.head", "\n"), F.lit("\n\n"), F.array_join("orders.unit", "\n\n"), F.lit("\n\n"), F.expr(CLASS), F.lit("\n"))
    own = customers.join(per, "k", "left").withColumn("f", F.expr("orders[0].o")).select("path", F.coalesce(text, F.lit("")).alias("source"), "language")
    index = index_files(customers).select("path", F.lit("").alias("source"), "language")
    return own.unionByName(index)


def index_files(customers: DataFrame) -> DataFrame:
    return customers.where("k % 10 = 3").selectExpr("*", f"{ROOT} root").select(F.expr(INDEX).alias("path"), "language")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language of ``files``: their names need no text, so no order is read for them."""
    customers = customer_files(spark, sf_dir)
    return customers.select("path", "language").unionByName(index_files(customers))


def read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(names of all files; rows of every kind without the units' texts)"""
    rows = parsing.extracted(files(spark, sf_dir), texts=False)
    return paths(spark, sf_dir), parsing.kinds(stored(rows, "parsed"))


def symbol_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, graph.SymbolGraph]:
    of, rows = read(spark, sf_dir)
    return of, graph.build(of, **rows)


#: file, ord (with import line, first and last line), unit (of three lines or more), named imports with their target.
CODE = f"""
    cust AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
    own_file AS (SELECT k, n, {LANGUAGE} AS language, {ROOT} AS root, {PATH} AS path FROM cust),
    file AS (SELECT * FROM own_file UNION ALL SELECT -1 - k, n, language, root, {INDEX} FROM own_file WHERE k % 10 = 3),
    firsts AS (SELECT o_custkey AS t, min(o_orderkey) AS fo FROM orders GROUP BY 1),
    placed AS (SELECT o_orderkey AS o, o_custkey AS k, (o_orderkey * 31) % (SELECT count(*) FROM customer) AS t,
        coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey) AS prev,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders),
    sized AS (SELECT placed.*, {ALIAS} AS alias, file.language, file.root, file.path, coalesce(fo, 0) AS fo, tf.n AS nt, tf.language AS t_language, tf.root AS t_root, tf.path AS t_path,
        CASE WHEN file.language = 'python' AND o % 5 = 0 THEN 2 ELSE 4 + o % 3 END AS n_lines,
        CASE WHEN o % 17 = 0 THEN 'outside' WHEN o % 11 = 0 THEN 'star' WHEN o % 13 = 0 THEN 'space' WHEN o % 19 = 0 AND file.language <> 'python' THEN 'library' ELSE 'named' END AS kind
        FROM placed JOIN file USING (k) LEFT JOIN file tf ON tf.k = placed.t LEFT JOIN firsts ON firsts.t = placed.t),
    ord AS (SELECT *, CAST(n_orders + 2 + sum(n_lines + 1) OVER (PARTITION BY k ORDER BY o) - n_lines - 1 AS BIGINT) AS first_line FROM sized),
    unit AS (SELECT *, first_line + n_lines - 1 AS last_line FROM ord WHERE n_lines >= 3),
    closing AS (SELECT path, k, language, min(o) AS f, max(first_line + n_lines - 1) + 2 AS class_at FROM ord GROUP BY 1, 2, 3),
    every_unit AS (SELECT path, 'o' || o AS bare, 'o' || o AS name, first_line, last_line FROM unit UNION ALL SELECT path, 'o' || f, 'K' || k || '.o' || f, class_at + 1, class_at + 3 FROM closing),
    definition AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, bare ORDER BY first_line, last_line, name) AS nth FROM every_unit) WHERE nth = 1),
    spec AS (SELECT *, CASE kind WHEN 'outside' THEN CASE WHEN language = 'python' THEN 'os.path' ELSE 'react' END WHEN 'library' THEN 'lodash/map'
            ELSE CASE WHEN language <> 'python' THEN '../n' || nt || '/c' || t WHEN kind = 'space' THEN 'src.n' || nt || '.c' || t ELSE '..n' || nt || '.c' || t END END AS specifier,
        kind NOT IN ('outside', 'library') AND (language = 'python') = (t_language = 'python') AND CASE WHEN language = 'python' AND kind = 'space' THEN t_root = 'src' ELSE t_root = root END AS found FROM ord),
    solved AS (SELECT *, CASE WHEN found THEN t_path END AS target,
        CASE WHEN found THEN NULL WHEN kind = 'library' THEN 'external_package' WHEN kind = 'outside' THEN CASE WHEN language = 'python' THEN 'external_package' ELSE 'path_alias' END
             WHEN kind = 'space' AND language = 'python' THEN 'external_package' ELSE 'missing_target' END AS reason FROM spec),
    called AS (SELECT path, k, 'i' || o AS name, first_line + 1 AS line FROM ord
        UNION ALL SELECT path, k, 'o' || prev, first_line + n_lines - 2 FROM unit UNION ALL SELECT path, k, 'print', first_line + n_lines - 2 FROM unit WHERE language = 'python'),
    winner AS (SELECT * FROM (SELECT path, alias, target, 'o' || fo AS bare, row_number() OVER (PARTITION BY path, alias ORDER BY line) AS nth FROM solved WHERE kind = 'named' AND found) WHERE nth = 1),
    remote AS (SELECT winner.path, alias, target, winner.bare FROM winner JOIN definition d ON d.path = target AND d.bare = winner.bare),
    reference AS (SELECT CASE WHEN d.bare IS NULL THEN remote.bare ELSE called.name END AS name, CASE WHEN d.bare IS NULL THEN target ELSE called.path END AS target_path, called.path AS from_path, called.line
        FROM called LEFT JOIN definition d ON d.path = called.path AND d.bare = called.name LEFT JOIN remote ON remote.path = called.path AND alias = called.name
        WHERE CASE WHEN d.bare IS NULL THEN alias IS NOT NULL ELSE called.line NOT BETWEEN d.first_line AND d.last_line END),
    hole AS (SELECT path, CASE WHEN language = 'python' THEN 'wildcard_import' ELSE 'star_reexport' END AS reason FROM ord WHERE kind = 'star'
        UNION ALL SELECT path, CASE WHEN found THEN 'namespace_import' ELSE reason END FROM solved WHERE kind = 'space' AND (found OR reason <> 'external_package')
        UNION ALL SELECT path, reason FROM solved WHERE kind IN ('named', 'outside', 'library') AND NOT found)"""


@query(f"""WITH {CODE}, text AS (SELECT k, string_agg({IMPORT_LINE}, chr(10) ORDER BY o) || chr(10) || chr(10) || string_agg({UNIT_TEXT}, chr(10) || chr(10) ORDER BY o) AS source FROM ord GROUP BY k)
    SELECT file.path, file.language, sha256(coalesce((SELECT source || chr(10) || chr(10) || {CLASS} || chr(10) FROM text JOIN closing USING (k) WHERE text.k = file.k), '')) AS source_hash FROM file""")
def source_tree(spark, sf_dir):
    return files(spark, sf_dir).select("path", "language", F.sha2("source", 256).alias("source_hash"))


@query(f"""WITH {CODE} SELECT path, language, 'o' || o AS name, CAST(first_line AS INTEGER) AS start_line, CAST(last_line AS INTEGER) AS end_line,
    'sha256:' || sha256(CASE WHEN language = 'typescript' THEN concat('(a: number): number => ', {SCRIPT_BODY}) ELSE {UNIT_TEXT} END) AS content_hash FROM unit
    UNION ALL SELECT path, language, 'K' || k || '.o' || f, CAST(class_at + 1 AS INTEGER), CAST(class_at + 3 AS INTEGER), 'sha256:' || sha256({METHOD}) FROM closing""")
def extracted_units(spark, sf_dir):
    return read(spark, sf_dir)[1]["units"].drop("text")


@query(f"""WITH {CODE}
    SELECT path, 'import' AS kind, alias AS local_name, CASE kind WHEN 'named' THEN 'o' || fo WHEN 'library' THEN 'x' ELSE CASE WHEN language = 'python' THEN 'join' ELSE 'default' END END AS source_name,
        specifier, CAST(line AS INTEGER) AS line, NULL AS reason FROM spec WHERE kind IN ('named', 'outside', 'library')
    UNION ALL SELECT path, 'namespace', NULL, NULL, specifier, CAST(line AS INTEGER), NULL FROM spec WHERE kind = 'space'
    UNION ALL SELECT path, 'hole', NULL, NULL, specifier, CAST(line AS INTEGER), CASE WHEN language = 'python' THEN 'wildcard_import' ELSE 'star_reexport' END FROM spec WHERE kind = 'star'""")
def extracted_imports(spark, sf_dir):
    rows = parsing.extracted(files(spark, sf_dir), texts=False).where("kind in ('import', 'namespace', 'hole')")
    return rows.select("path", "kind", "local_name", "source_name", "specifier", "line", "reason")


@query(f"WITH {CODE} SELECT path, name, CAST(line AS INTEGER) AS line FROM called")
def extracted_calls(spark, sf_dir):
    return read(spark, sf_dir)[1]["calls"]


@query(f"""WITH {CODE} SELECT DISTINCT path, specifier, language, target, reason FROM solved WHERE kind <> 'star'""")
def specifier_resolution(spark, sf_dir):
    of, rows = read(spark, sf_dir)
    columns = ["path", "specifier", "language"]
    asked = rows["imports"].select(*columns).unionByName(rows["namespaces"].select(*columns)).distinct()
    return graph.resolve(asked, of).select(*columns, "target", "reason")


@query(f"""WITH {CODE} SELECT path, bare, name, CAST(first_line AS INTEGER) AS start_line, CAST(last_line AS INTEGER) AS end_line FROM definition""")
def first_definition(spark, sf_dir):
    return symbol_graph(spark, sf_dir)[1].definitions


@query(f"WITH {CODE} SELECT name, target_path, from_path, CAST(line AS INTEGER) AS line FROM reference")
def resolved_references(spark, sf_dir):
    return symbol_graph(spark, sf_dir)[1].references


@query(f"WITH {CODE} SELECT target_path, name, count(*) AS calls FROM reference GROUP BY 1, 2")
def call_site_counts(spark, sf_dir):
    return symbol_graph(spark, sf_dir)[1].call_site_counts()


@query(f"WITH {CODE} SELECT reason, count(*) AS n FROM hole GROUP BY 1")
def unresolved_by_reason(spark, sf_dir):
    return symbol_graph(spark, sf_dir)[1].by_reason()


@query(f"WITH {CODE} SELECT path FROM file WHERE path NOT IN (SELECT path FROM hole WHERE reason <> 'external_package')")
def fully_resolved_files(spark, sf_dir):
    of, g = symbol_graph(spark, sf_dir)
    return g.fully_resolved(of).select("path")


@query(f"""WITH {CODE} SELECT (SELECT count(*) FROM file) AS files_scanned, count(*) AS units_extracted, CAST(coalesce(sum(last_line - first_line + 1), 0) AS BIGINT) AS lines_in_units, 0::BIGINT AS candidate_pairs,
    CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS total_possible_pairs, false AS candidates_truncated,
    (SELECT count(*) FROM file WHERE path NOT IN (SELECT path FROM hole WHERE reason <> 'external_package')) AS files_fully_resolved FROM every_unit""")
def tree_coverage(spark, sf_dir):
    of, rows = read(spark, sf_dir)
    return clusters.coverage(rows["units"], of, graph.build(of, **rows).unresolved, 0)


@query(f"WITH {CODE} SELECT path, language FROM file WHERE root <> 'tests'")
def miner_tree(spark, sf_dir):
    return tree.miner_files(files(spark, sf_dir)).select("path", "language")


#: Chunks: the last function's goes on to the first line of the class in Python, where its method is the next start, else to the end.
SPAN = """span AS (SELECT *, lead(o) OVER (PARTITION BY k ORDER BY o) IS NULL AS is_last, min(o) OVER (PARTITION BY k) AS f,
    coalesce(lead(first_line) OVER (PARTITION BY k ORDER BY o) - 1, first_line + n_lines - 1 + CASE WHEN language = 'python' THEN 2 ELSE 6 END) AS until FROM ord)"""
CHUNK_TEXT = f"concat({UNIT_TEXT}, CASE WHEN NOT is_last THEN '' ELSE concat(chr(10), chr(10), CASE WHEN language = 'python' THEN {CLASS_LINE} ELSE {CLASS} END) END)"


@query(f"""WITH {CODE}, {SPAN}
    SELECT path, substr(string_split({UNIT_TEXT}, chr(10))[1], 1, 60) AS name, CAST(first_line AS INTEGER) AS start_line, CAST(until AS INTEGER) AS end_line FROM span WHERE root <> 'tests' AND until - first_line + 1 >= 5""")
def heuristic_chunks(spark, sf_dir):
    return tree.chunks(tree.miner_files(files(spark, sf_dir))).select("path", "name", "start_line", "end_line")


def mined_chunks(spark, sf_dir) -> DataFrame:
    """id (path:line) and shingles of every chunk that the miner reads."""
    rows = tree.chunks(tree.miner_files(files(spark, sf_dir)))
    shingles = clones.shingle_hashes(lexical.normalized(lexical.tokens(F.col("text"))), 3)
    return rows.select(F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("id"), shingles.alias("items"))
