"""Corpora that the driver's tables stand for, as (file_id, rel, content).

documents: a file for each document, with blank lines put after lines that end in "n.".
code: source files of up to a hundred parts in five languages, rendered from part: two
definitions and two calls for each part, and one import for each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Definition lines, by the remainder of the file's number: extension, before, after.
STYLES = (("rs", "fn ", "() {"), ("ts", "function ", "() {"), ("py", "def ", "():"), ("go", "func ", "() {"), ("java", "public void ", "() {"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.replace(F.coalesce("text", F.lit("")), F.lit("n.\n"), F.lit("n.\n\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("rel"), content.alias("content"))


DOCUMENTS_SQL = """
files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.txt' AS rel,
  replace(coalesce(text, ''), 'n.' || chr(10), 'n.' || chr(10) || chr(10)) AS content FROM documents),
each_line AS (SELECT file_id, rel, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM files),
islands AS (SELECT *, trim(l) = '' AS blank, sum((trim(l) = '')::INT) OVER (PARTITION BY file_id ORDER BY n) AS island FROM each_line),
chunks AS (SELECT *, (row_number() OVER (PARTITION BY file_id, island ORDER BY n) - 1) // 80 AS chunk FROM islands WHERE NOT blank),
runs AS (SELECT file_id, rel, min(n) AS line, count(*) AS n_lines, string_agg(l, chr(10) ORDER BY n) AS text FROM chunks GROUP BY file_id, rel, island, chunk),
blocks AS (SELECT file_id * 2097152 + row_number() OVER (PARTITION BY file_id ORDER BY line) - 1 AS block_id, file_id, rel, line, n_lines, text FROM runs)
"""


def _style(n, part: int):
    out = None
    for k, s in enumerate(STYLES):
        out = F.when(n % 5 == k, s[part]) if out is None else out.when(n % 5 == k, s[part])
    return out


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k, f = F.col("p_partkey"), F.floor(F.col("p_partkey") / 100)
    define = lambda name: F.concat(_style(f, 1), name, _style(f, 2))
    body = F.concat(
        define(F.concat(F.lit("f_"), k % 700)), F.lit("\n    f_"), (7 * k + 3) % 700, F.lit("(); h_"), k % 5, F.lit(" (1);\n}\n\n"),
        define(F.concat(F.lit("h_"), F.col("p_size") % 40)),
    )
    grouped = part.groupBy(f.cast("long").alias("file_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), body.alias("b")))), lambda s: s["b"]), "\n").alias("body"))
    n, g = F.col("file_id"), F.col("g")
    files = (part.agg(F.max("p_partkey")).first()[0] or 0) // 100 + 1
    target = grouped.withColumn("g", (7 * n + 2) % files)
    where = F.concat(F.lit("d"), g % 3, F.lit("/m"), g)
    dotted = F.concat(F.lit("d"), g % 3, F.lit(".m"), g)
    line = (
        F.when(n % 5 == 0, F.concat(F.lit("mod m"), g, F.lit(";")))
        .when(n % 5 == 1, F.concat(F.lit("import { x } from '../"), where, F.lit("'")))
        .when(n % 5 == 2, F.concat(F.lit("from "), dotted, F.lit(" import x")))
        .when(n % 5 == 3, F.concat(F.lit('import "example.com/r/'), where, F.lit('"')))
        .otherwise(F.concat(F.lit("import "), dotted, F.lit(";")))
    )
    rel = F.concat(F.lit("d"), n % 3, F.lit("/m"), n, F.lit("."), _style(n, 0))
    return target.select("file_id", rel.alias("rel"), F.concat(line, F.lit("\n\n"), F.col("body")).alias("content"))


#: What the rendered code defines and calls, straight from part: part number i of a file
#: begins at line 3 + 5 * i.
CODE_SQL = """
placed AS (SELECT p_partkey AS k, p_partkey // 100 AS file_id, p_size,
  3 + 5 * (row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1) AS line FROM part),
defs AS (SELECT file_id, line, 'f_' || (k % 700) AS name FROM placed UNION ALL SELECT file_id, line + 4, 'h_' || (p_size % 40) FROM placed),
ext AS (SELECT DISTINCT file_id, ['rs', 'ts', 'py', 'go', 'java'][file_id % 5 + 1] AS ext FROM placed),
symbols AS (SELECT file_id * 16777216 + line AS sym_id, name, CASE WHEN ext = 'java' THEN 'method' ELSE 'func' END AS kind, file_id, line,
  file_id * 2097152 + (CASE WHEN (line - 3) % 5 = 0 THEN (line - 3) // 5 + 1 ELSE (line - 7) // 5 + 2 END) AS block_id FROM defs JOIN ext USING (file_id)),
sites AS (SELECT DISTINCT file_id * 16777216 + line AS src, file_id, unnest(['f_' || (k % 700), 'f_' || ((7 * k + 3) % 700), 'h_' || (k % 5)]) AS name FROM placed
  UNION SELECT file_id * 16777216 + line + 4, file_id, 'h_' || (p_size % 40) FROM placed),
named AS (SELECT name, count(*) AS n FROM symbols GROUP BY name),
linked AS (SELECT s.src, s.file_id, d.sym_id AS dst, d.file_id AS df, n, max((d.file_id = s.file_id)::INT) OVER (PARTITION BY s.src, s.name) AS own
  FROM sites s JOIN symbols d USING (name) JOIN named USING (name)),
calls AS (SELECT DISTINCT src, dst FROM linked WHERE src <> dst AND (n = 1 OR df = file_id OR (own = 0 AND n <= 25)))
"""

#: The file that each file imports: links are spread over all files, whatever their number.
TARGETS_SQL = "targets AS (SELECT file_id, ext, (7 * file_id + 2) % (SELECT max(p_partkey) // 100 + 1 FROM part) AS g FROM ext)"

IMPORTS_SQL = (
    TARGETS_SQL
    + """,
imports AS (SELECT a.file_id AS from_id, b.file_id AS to_id FROM targets a JOIN ext b ON b.file_id = a.g
  WHERE a.file_id <> b.file_id AND (a.ext = 'rs' OR b.ext <> 'java'))
"""
)

#: Texts of the rendered code's blocks: a block is the second definition of the part before
#: and the first one of a part; the last block of a file has a second definition only.
CODE_BLOCKS_SQL = """
styled AS (SELECT *, file_id % 5 AS style, row_number() OVER (PARTITION BY file_id ORDER BY k) AS nth FROM placed),
rendered AS (SELECT file_id, nth, ['fn ', 'function ', 'def ', 'func ', 'public void '][style + 1] AS a, ['() {', '() {', '():', '() {', '() {'][style + 1] AS z,
  'f_' || (k % 700) AS f, chr(10) || '    f_' || ((7 * k + 3) % 700) || '(); h_' || (k % 5) || ' (1);' || chr(10) || '}' AS calls, 'h_' || (p_size % 40) AS h FROM styled),
code_blocks AS (SELECT file_id * 2097152 + nth AS block_id, coalesce(lag(a || h || z || chr(10)) OVER (PARTITION BY file_id ORDER BY nth), '') || a || f || z || calls AS text FROM rendered
  UNION ALL SELECT file_id * 2097152 + max(nth) + 1, arg_max(a || h || z, nth) FROM rendered GROUP BY file_id)
"""

#: A line for each rule: extension, text before and after a number, the kind it defines.
RULE_LINES = (
    ("rs", "pub fn f_", "(a: u8) {", "func"), ("rs", "pub struct S_", " {", "struct"), ("rs", "enum E_", " {", "enum"), ("rs", "trait R_", ": Sized {", "trait"),
    ("rs", "type T_", " = u8;", "type"), ("rs", "impl<T, U<V<W>>> I_", " for X {", "impl"), ("rs", "let x_", " = 1;", None), ("rs", "type N_", ";", None),
    ("ts", "export function f_", "(a) {", "func"), ("tsx", "class C_", " extends X {", "class"), ("js", "interface I_", " {", "interface"), ("mjs", "enum E_", " {", "enum"),
    ("ts", "type T_", " = string;", "type"), ("jsx", "export const c_", " = async () => {", "func"), ("cjs", "const d_", " = function () {", "func"), ("ts", "const n_", " = 3;", None),
    ("py", "    def m_", "(self):", "func"), ("py", "class C_", ":", "class"),
    ("go", "func F_", "() {", "func"), ("go", "func(r *T[(a)]) M_", "() {", "method"), ("go", "type S_", " struct {", "struct"), ("go", "type I_", " interface {", "interface"), ("go", "func (r T) N_", "() {", None),
    ("java", "public class C_", " {", "class"), ("cs", "interface I_", " {", "interface"), ("kt", "enum E_", " {", "enum"), ("scala", "private static final Map<K,V> m_", "(K k) {", "method"), ("java", "n_", "(args);", None),
    ("txt", "fn f_", "() {", None),
)

#: A line for each form of import: extension, text before and after a number, the module
#: that it names as (before, after), if any.
IMPORT_LINES = (
    ("ts", "import { x } from './b", "';", ("./b", "")), ("js", 'const y = require("../c', '")', ("../c", "")), ("ts", "import './side", "';", ("./side", "")), ("ts", "export * from `x/d", "`", ("x/d", "")), ("ts", "export default ", ";", None),
    ("rs", "use crate::net::h", "::{get, post};", ("net/h", "")), ("rs", "pub mod s", ";", ("s", "")), ("rs", "use std::io", ";", None), ("rs", "pub use crate::a", "::b;", ("a", "/b")),
    ("py", "from .m", " import x", (".m", "")), ("py", "import os", ", sys", ("os", "")), ("py", "x = ", "", None),
    ("go", '"github.com/o/r/p', '"', ("github.com/o/r/p", "")), ("go", 'import "a/p', '"', ("a/p", "")), ("go", "x := ", "", None),
    ("java", "import com.x.F", ";", ("com.x.F", "")), ("kt", "import a.b", "", ("a.b", "")), ("txt", "import a", "", None),
)


def lines_of(spark: SparkSession, sf_dir: str, shapes: tuple) -> DataFrame:
    """(file_id, rel, content): a file of one line for each part, by its number's shape."""
    k = F.col("p_partkey")
    pick = lambda i: F.get(F.array(*[F.lit(s[i]) for s in shapes]), (k % len(shapes)).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("file_id"), F.concat(F.lit("m"), k, F.lit("."), pick(0)).alias("rel"), F.concat(pick(1), k, pick(2)).alias("content"))


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"
