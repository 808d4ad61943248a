"""Registered queries over the driver's tables, with their SQL.

Names, columns and rounding of a query and its SQL agree; everything reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.shared import cut
from lodestone.operators import ask, chunk, graph, paths, search, symbols, vectors
from lodestone.plans import corpora
from lodestone.plans.corpora import CODE_BLOCKS_SQL, CODE_SQL, DOCUMENTS_SQL, IMPORT_LINES, IMPORTS_SQL, RULE_LINES, TARGETS_SQL, sql_list, table
from lodestone.sources import lake
from lodestone.sources.files import MOST_BYTES
from lodestone.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        REGISTRY[name or f.__name__.rstrip("_")] = (f, sql)
        return f

    return keep


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.blocks(corpora.documents(spark, sf_dir))


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source lines and symbols of the rendered code."""
    files = cut(corpora.code(spark, sf_dir))
    lines = symbols.source_lines(files)
    return lines, cut(graph.symbols(symbols.definitions(lines), chunk.blocks(files)))


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, syms = _code(spark, sf_dir)
    return syms, cut(graph.call_edges(symbols.call_tokens(lines), syms))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cut(corpora.code(spark, sf_dir))
    return graph.import_edges(graph.resolve(symbols.imports(symbols.source_lines(files)), files.select("file_id", "rel")))


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)


_HIT = "lower(text)"


def _occ(q: str) -> str:
    return f"((length({_HIT}) - length(replace({_HIT}, '{q}', ''))) / {len(q)})::BIGINT"


def _search_sql(q: str, limit: int) -> str:
    return _with(DOCUMENTS_SQL) + f" SELECT block_id, rel, line::INT AS line, {_occ(q)} AS occurrences FROM blocks WHERE contains({_HIT}, '{q}') ORDER BY occurrences DESC, strlen(text), block_id LIMIT {limit}"


@query(_with(DOCUMENTS_SQL) + " SELECT block_id, rel, line::INT AS line, n_lines::INT AS n_lines, md5(text) AS text_md5 FROM blocks")
def blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_id", "rel", "line", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT file_id, rel, len FROM (SELECT doc_id AS file_id, source || '/' || doc_id || '.txt' AS rel, strlen(text)::BIGINT AS len, text FROM documents) WHERE len <= 5242880 AND NOT contains(left(text, 8192), chr(0))")
def scan_filter(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    files = table(spark, sf_dir, "documents").filter((size <= MOST_BYTES) & ~F.contains(F.substring(F.col("text").cast("binary"), 1, 8192), F.lit(b"\x00")))
    return files.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("rel"), size.alias("len"))


_TRI = """
hexed AS (SELECT block_id, hex(encode(lower(text))) AS h FROM blocks),
tri AS (SELECT DISTINCT block_id, unnest(list_transform(range(0, length(h) // 2 - 2), lambda i: substr(h, 2 * i + 1, 6))) AS trigram FROM hexed WHERE length(h) >= 6)
"""


@query(_with(DOCUMENTS_SQL, _TRI) + " SELECT block_id, count(*)::BIGINT AS n, min(trigram) AS first, max(trigram) AS last FROM tri GROUP BY block_id")
def block_trigrams(spark, sf_dir):
    return chunk.postings(_blocks(spark, sf_dir)).groupBy("block_id").agg(F.count("*").alias("n"), F.min("trigram").alias("first"), F.max("trigram").alias("last"))


@query(_with(DOCUMENTS_SQL, _TRI) + " SELECT trigram, count(*)::BIGINT AS n FROM tri GROUP BY trigram")
def posting_lengths(spark, sf_dir):
    return chunk.postings(_blocks(spark, sf_dir)).groupBy("trigram").agg(F.count("*").alias("n"))


_FNV = "lower(printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::INT::UHUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)))"


@query(f"SELECT p_partkey, {_FNV.format(h='hex(encode(p_name))')} AS fnv FROM part")
def fnv64(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.fnv64(F.col("p_name")).alias("fnv"))


@query(_with(DOCUMENTS_SQL) + ", h AS (SELECT block_id, hex(encode(text)) AS h FROM blocks) SELECT block_id, " + _FNV.format(h="h") + " AS hash FROM h")
def block_hash(spark, sf_dir):
    return chunk.hashed(_blocks(spark, sf_dir)).select("block_id", "hash")


@query(_search_sql("the", 20), "search")
def search_(spark, sf_dir):
    return search.search(_blocks(spark, sf_dir), "the", 20).select("block_id", "rel", "line", "occurrences")


@query(_search_sql("ea", 50))
def search_short(spark, sf_dir):
    return search.search(_blocks(spark, sf_dir), "EA", 50).select("block_id", "rel", "line", "occurrences")


@query(_search_sql("thtion", 50))
def search_indexed(spark, sf_dir):
    found = _blocks(spark, sf_dir)
    return search.search(found, "thtion", 50, chunk.postings(found)).select("block_id", "rel", "line", "occurrences")


@query(_with(DOCUMENTS_SQL, _TRI) + " SELECT block_id, trigram FROM tri WHERE trigram IN ('746874', '687469', '74696F', '696F6E')")
def trigram_candidates(spark, sf_dir):
    return search.candidates(chunk.postings(_blocks(spark, sf_dir)), "thtion").select("block_id", "trigram")


@query(_with(DOCUMENTS_SQL, _TRI) + " SELECT block_id FROM tri WHERE trigram IN ('746874', '687469', '74696F', '696F6E') GROUP BY block_id HAVING count(*) = 4")
def trigram_intersect(spark, sf_dir):
    return search.intersect(chunk.postings(_blocks(spark, sf_dir)), "thtion")


@query(_with(DOCUMENTS_SQL) + f" SELECT block_id, {_occ('tion')} AS occurrences FROM blocks WHERE contains({_HIT}, 'tion')")
def occurrences(spark, sf_dir):
    return search.rank(_blocks(spark, sf_dir), "TION").select("block_id", "occurrences")


_MANY = ("the", "tion", "ière", "lich", "ment", "idiot", "erst", "ción")


@query(_with(DOCUMENTS_SQL) + ", q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _MANY) + f"]) AS query), h AS (SELECT query, block_id, text, ((length({_HIT}) - length(replace({_HIT}, query, ''))) / length(query))::BIGINT AS occurrences FROM blocks JOIN q ON contains({_HIT}, query)) SELECT query, block_id, occurrences, row_number() OVER (PARTITION BY query ORDER BY occurrences DESC, strlen(text), block_id)::INT AS rank FROM h QUALIFY rank <= 20")
def search_many(spark, sf_dir):
    return search.search_many(_blocks(spark, sf_dir), list(_MANY), 20).select("query", "block_id", "occurrences", "rank")


@query(_with(DOCUMENTS_SQL) + ", h AS (SELECT block_id, line, text FROM blocks WHERE contains(lower(text), 'ation') ORDER BY ((length(lower(text)) - length(replace(lower(text), 'ation', ''))) / 5) DESC, strlen(text), block_id LIMIT 50), l AS (SELECT block_id, unnest(string_split(text, chr(10))) AS matched, unnest(range(0, len(string_split(text, chr(10))))) + line AS line_no FROM h), m AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY block_id) AS n FROM l WHERE contains(lower(matched), 'ation')) SELECT block_id, line_no::INT AS line_no, matched, n > 6 AS more FROM m WHERE k <= 6")
def match_lines(spark, sf_dir):
    return search.matching_lines(search.search(_blocks(spark, sf_dir), "ation", 50), "ation", 6)


@query("SELECT page_id, CASE WHEN e IN ('html', '') THEN 'plain' WHEN e IN ('rs') THEN 'rust' WHEN e IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs') THEN 'tsjs' WHEN e = 'py' THEN 'python' WHEN e = 'go' THEN 'go' WHEN e IN ('java', 'cs', 'kt', 'scala') THEN 'javalike' ELSE 'plain' END AS lang FROM (SELECT page_id, ['rs', 'tsx', 'py', 'go', 'kt', 'md', 'html', 'CS'][page_id % 8 + 1].lower() AS e FROM pages)")
def lang_of(spark, sf_dir):
    exts = F.array(*[F.lit(x) for x in ("rs", "tsx", "py", "go", "kt", "md", "html", "CS")])
    path = F.concat(F.lit("a.b/x_"), F.col("page_id"), F.lit("."), F.get(exts, (F.col("page_id") % 8).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", symbols.language(path).alias("lang"))


@query(_with(CODE_SQL) + " SELECT file_id, line::INT AS line, name, kind FROM symbols")
def defs(spark, sf_dir):
    return symbols.definitions(symbols.source_lines(corpora.code(spark, sf_dir))).select("file_id", "line", "name", "kind")


_RULE = "p_partkey % " + str(len(RULE_LINES)) + " + 1"


@query(
    f"SELECT p_partkey AS file_id, regexp_extract({sql_list([s[1] for s in RULE_LINES])}[{_RULE}], '[A-Za-z]_$') || p_partkey AS name, {sql_list([s[3] for s in RULE_LINES])}[{_RULE}] AS kind FROM part WHERE kind IS NOT NULL"
)
def defs_of_rules(spark, sf_dir):
    return symbols.definitions(symbols.source_lines(corpora.lines_of(spark, sf_dir, RULE_LINES))).select("file_id", "name", "kind")


_FORM = "p_partkey % " + str(len(IMPORT_LINES)) + " + 1"


@query(
    f"SELECT p_partkey AS file_id, {sql_list([s[3] and s[3][0] for s in IMPORT_LINES])}[{_FORM}] || p_partkey || {sql_list([s[3] and s[3][1] for s in IMPORT_LINES])}[{_FORM}] AS spec FROM part WHERE spec IS NOT NULL"
)
def imports_of_forms(spark, sf_dir):
    return symbols.imports(symbols.source_lines(corpora.lines_of(spark, sf_dir, IMPORT_LINES))).select("file_id", "spec")


@query(_with(CODE_SQL) + " SELECT sym_id, name, kind, file_id, line::INT AS line, block_id FROM symbols", "symbols")
def symbols_(spark, sf_dir):
    return _code(spark, sf_dir)[1]


@query(_with(CODE_SQL) + " SELECT sym_id, block_id FROM symbols")
def def_block_asof(spark, sf_dir):
    return _code(spark, sf_dir)[1].select("sym_id", "block_id")


@query(_with(CODE_SQL) + ", t AS (SELECT file_id, line + d AS line, line AS def_line FROM placed, (SELECT unnest([0, 1, 2]) AS d) UNION ALL SELECT file_id, line + 4, line + 4 FROM placed) SELECT file_id, line::INT AS line, (file_id * 16777216 + def_line)::BIGINT AS enclosing FROM t")
def enclosing_def(spark, sf_dir):
    lines, syms = _code(spark, sf_dir)
    return graph.as_of(lines.select("file_id", "line"), syms, "file_id", "line", "sym_id", "enclosing").filter("enclosing IS NOT NULL").select("file_id", "line", "enclosing")


@query("SELECT page_id, count(*)::BIGINT AS n, count(DISTINCT name)::BIGINT AS names FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)[ \\t]*\\(', 1)) AS name FROM pages) WHERE length(name) >= 2 GROUP BY page_id")
def call_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit(1).alias("line"), F.col("html").alias("text"))
    return symbols.call_tokens(pages).groupBy(F.col("file_id").alias("page_id")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query(_with(CODE_SQL, TARGETS_SQL) + " SELECT file_id, CASE ext WHEN 'rs' THEN 'm' || g WHEN 'ts' THEN '../d' || (g % 3) || '/m' || g WHEN 'go' THEN 'example.com/r/d' || (g % 3) || '/m' || g ELSE 'd' || (g % 3) || '.m' || g END AS spec FROM targets")
def imports_raw(spark, sf_dir):
    return symbols.imports(symbols.source_lines(corpora.code(spark, sf_dir))).select("file_id", "spec")


@query(_with(CODE_SQL, IMPORTS_SQL) + " SELECT from_id, to_id FROM imports")
def import_edges(spark, sf_dir):
    return _imports(spark, sf_dir)


@query(_with(CODE_SQL, IMPORTS_SQL) + " SELECT from_id, CASE a.ext WHEN 'rs' THEN 'm' || to_id WHEN 'ts' THEN '../d' || (to_id % 3) || '/m' || to_id WHEN 'go' THEN 'example.com/r/d' || (to_id % 3) || '/m' || to_id ELSE 'd' || (to_id % 3) || '.m' || to_id END AS spec, to_id FROM (SELECT a.file_id AS from_id, b.file_id AS to_id FROM targets a JOIN ext b ON b.file_id = a.g WHERE a.ext = 'rs' OR b.ext <> 'java') JOIN ext a ON a.file_id = from_id")
def resolve_imports(spark, sf_dir):
    files = corpora.code(spark, sf_dir).select("file_id", "rel", "content")
    return graph.resolve(symbols.imports(symbols.source_lines(files)), files.select("file_id", "rel"))


@query(_with(CODE_SQL) + " SELECT a.file_id, b.file_id AS to_id FROM ext a JOIN ext b ON b.file_id = a.file_id + 1 WHERE b.ext <> 'java'")
def resolve_ext(spark, sf_dir):
    files = corpora.code(spark, sf_dir).select("file_id", "rel")
    following = F.col("file_id") + 1
    specs = files.select("file_id", "rel", F.concat(F.lit("../d"), following % 3, F.lit("/m"), following).alias("spec"))
    return graph.resolve(specs, files).select(F.col("from_id").alias("file_id"), "to_id")


@query("SELECT p_partkey, 'a' || (p_partkey % 7) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'x' ELSE '' END || CASE p_partkey % 3 WHEN 0 THEN '/' ELSE '' END || 'c.ts' AS path FROM part")
def normalize_path(spark, sf_dir):
    k = F.col("p_partkey")
    middle = F.when(k % 3 == 0, F.lit("x/./y/..")).when(k % 3 == 1, F.lit("./z/..")).otherwise(F.lit("q//../."))
    path = F.concat(F.lit("../"), F.lit("a"), k % 7, F.lit("/"), middle, F.lit("//c.ts"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize_path(path).alias("path"))


@query(_with(CODE_SQL) + " SELECT src, dst FROM calls")
def call_edges(spark, sf_dir):
    return _calls(spark, sf_dir)[1]


def _degree(by: str, other: str) -> str:
    return _with(CODE_SQL) + f" SELECT {by} AS node, count(*)::BIGINT AS degree, min({other}) AS first, max({other}) AS last FROM calls GROUP BY {by}"


@query(_degree("src", "dst"))
def out_degree(spark, sf_dir):
    return graph.degrees(_calls(spark, sf_dir)[1], "src")


@query(_degree("dst", "src"))
def in_degree(spark, sf_dir):
    return graph.degrees(_calls(spark, sf_dir)[1], "dst")


@query(_with(CODE_SQL) + " SELECT sym_id, name, kind, file_id, line::INT AS line, block_id FROM symbols WHERE name = 'h_7'")
def find_symbol(spark, sf_dir):
    return graph.find_symbol(_code(spark, sf_dir)[1], "h_7")


def _near(a: str, b: str) -> str:
    return _with(CODE_SQL) + f" SELECT s.sym_id, c.{b} AS other, o.name AS other_name FROM symbols s JOIN calls c ON c.{a} = s.sym_id JOIN symbols o ON o.sym_id = c.{b} WHERE s.name = 'f_10' QUALIFY row_number() OVER (PARTITION BY s.sym_id ORDER BY c.{b}) <= 50"


@query(_near("src", "dst"))
def callees(spark, sf_dir):
    return graph.neighbours(*_calls(spark, sf_dir), "f_10", True, 50)


@query(_near("dst", "src"))
def callers(spark, sf_dir):
    return graph.neighbours(*_calls(spark, sf_dir), "f_10", False, 50)


@query(_with(CODE_SQL, IMPORTS_SQL) + " SELECT sym_id, from_id FROM symbols JOIN imports ON to_id = file_id WHERE name = 'f_10' QUALIFY row_number() OVER (PARTITION BY sym_id ORDER BY from_id) <= 20")
def importers(spark, sf_dir):
    return graph.importers(_code(spark, sf_dir)[1], _imports(spark, sf_dir), "f_10")


@query(
    _with(CODE_SQL, IMPORTS_SQL)
    + """, s AS (SELECT * FROM symbols WHERE name = 'f_10'),
  o AS (SELECT sym_id, string_agg(x::VARCHAR, ',' ORDER BY x) AS l FROM (SELECT sym_id, dst AS x FROM s JOIN calls ON src = sym_id QUALIFY row_number() OVER (PARTITION BY sym_id ORDER BY dst) <= 50) GROUP BY 1),
  i AS (SELECT sym_id, string_agg(x::VARCHAR, ',' ORDER BY x) AS l FROM (SELECT sym_id, src AS x FROM s JOIN calls ON dst = sym_id QUALIFY row_number() OVER (PARTITION BY sym_id ORDER BY src) <= 50) GROUP BY 1),
  m AS (SELECT sym_id, string_agg(x::VARCHAR, ',' ORDER BY x) AS l FROM (SELECT sym_id, from_id AS x FROM s JOIN imports ON to_id = file_id QUALIFY row_number() OVER (PARTITION BY sym_id ORDER BY from_id) <= 20) GROUP BY 1)
  SELECT s.sym_id, name, kind, file_id, line::INT AS line, block_id, coalesce(o.l, '') AS calls, coalesce(i.l, '') AS called_by, coalesce(m.l, '') AS imported_by
  FROM s LEFT JOIN o USING (sym_id) LEFT JOIN i USING (sym_id) LEFT JOIN m USING (sym_id)"""
)
def graph_neighborhood(spark, sf_dir):
    syms, edges = _calls(spark, sf_dir)
    return graph.neighbourhood(syms, edges, _imports(spark, sf_dir), "f_10")


@query(_with(CODE_SQL) + " SELECT DISTINCT name FROM symbols WHERE contains(lower(name), 'h_1') ORDER BY name LIMIT 6")
def suggest(spark, sf_dir):
    return graph.suggest(_code(spark, sf_dir)[1], "H_1")


@query(
    _with(CODE_SQL, CODE_BLOCKS_SQL)
    + """, hits AS (SELECT block_id, ((length(text) - length(replace(text, 'f_10()', ''))) / 6)::BIGINT AS occurrences FROM code_blocks WHERE contains(text, 'f_10()')
    ORDER BY occurrences DESC, strlen(text), block_id LIMIT 15),
  near AS (SELECT src AS a, dst AS b, 'c' AS way FROM calls UNION ALL SELECT dst, src, 'b' FROM calls),
  few AS (SELECT a, way, o.name AS n, row_number() OVER (PARTITION BY a, way ORDER BY b) AS k FROM near JOIN symbols o ON o.sym_id = b QUALIFY k <= 6),
  l AS (SELECT a, way, string_agg(n, ',' ORDER BY k) AS names FROM few GROUP BY a, way)
  SELECT block_id, occurrences, sym_id, name, kind, coalesce(c.names, '') AS calls, coalesce(b.names, '') AS called_by
  FROM hits LEFT JOIN symbols USING (block_id) LEFT JOIN l c ON c.a = sym_id AND c.way = 'c' LEFT JOIN l b ON b.a = sym_id AND b.way = 'b'"""
)
def clues(spark, sf_dir):
    hits = search.search(chunk.blocks(corpora.code(spark, sf_dir)), "F_10()", search.CLUES_LIMIT)
    return graph.clues(hits, *_calls(spark, sf_dir))


def _generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(k.alias("src"), ((7 * k + 1) % 97).alias("dst")).union(part.select(k, (3 * k + 2) % 97)).distinct()


_PATHS = """WITH RECURSIVE e AS (SELECT p_partkey AS src, (7 * p_partkey + 1) % 97 AS dst FROM part UNION SELECT p_partkey, (3 * p_partkey + 2) % 97 FROM part),
w AS (SELECT [1::BIGINT] AS path, 1::BIGINT AS cur UNION ALL SELECT list_append(path, dst), dst FROM w JOIN e ON src = cur WHERE NOT list_contains(path, dst) AND len(path) < 8 AND (cur <> 57 OR len(path) = 1)),
f AS (SELECT path, len(path)::INT AS nodes FROM w WHERE cur = 57 AND len(path) > 1 ORDER BY path LIMIT 5)"""


@query(_PATHS + " SELECT array_to_string(path, '>') AS path, nodes FROM f")
def flow_paths(spark, sf_dir):
    one = lambda x: spark.createDataFrame([(x,)], "node long")
    found = paths.find_paths(_generic(spark, sf_dir), one(1), one(57))
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "nodes")


@query(_PATHS + " SELECT array_to_string(path, '>') AS path_text, unnest(range(0, len(path)))::INT AS hop, unnest(path) AS sym_id, p_name FROM f JOIN part ON true WHERE false UNION ALL SELECT path_text, hop, sym_id, p_name FROM (SELECT array_to_string(path, '>') AS path_text, unnest(range(0, len(path)))::INT AS hop, unnest(path) AS sym_id FROM f) JOIN part ON p_partkey = sym_id")
def flow_hops(spark, sf_dir):
    one = lambda x: spark.createDataFrame([(x,)], "node long")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sym_id"), F.col("p_name").alias("name"), F.lit(0).alias("file_id"), F.lit(0).alias("line"), F.lit(0).alias("block_id"))
    return paths.hops(paths.find_paths(_generic(spark, sf_dir), one(1), one(57)), nodes).select("path_text", "hop", "sym_id", F.col("name").alias("p_name"))


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {0})"


def _vector(spark: SparkSession, sf_dir: str, k: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == k).select("embedding").first()[0]


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q.format(0)}), 6) AS score FROM embeddings", "dot")
def dot_(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir, 0)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), q), 6).alias("score"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS l1 FROM embeddings")
def l2_normalize(spark, sf_dir):
    v = vectors.l2_normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q.format(0)}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def knn_topk(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 20)


@query("SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INT AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10")
def knn_many(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest_many(v, v.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), 10)


_LIST = "(SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS place FROM (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], " + _Q + "), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 200))"


@query(f"SELECT vec_id, round(sum(1 / (60.0::DOUBLE + place)), 6) AS score FROM ({_LIST.format(0)} UNION ALL {_LIST.format(1)}) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 20")
def rrf(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    lists = [vectors.ranked(vectors.nearest(v, _vector(spark, sf_dir, k), 200), [F.desc("score"), F.col("vec_id")]) for k in (0, 1)]
    return vectors.fuse(lists, "vec_id", 20)


@query("SELECT hash, min(text) AS text FROM (SELECT md5(text) AS hash, text FROM documents WHERE text IS NOT NULL) WHERE hash NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) GROUP BY hash")
def missing_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("hash", F.md5(F.col("text").cast("binary")))
    return vectors.missing(docs, docs.filter("doc_id % 2 = 0").select("hash").distinct())


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def vector_gc(spark, sf_dir):
    live = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("hash"))
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hash"))
    return vectors.collect_garbage(held, live).select(F.col("hash").alias("vec_id"))


@query("SELECT count(*)::BIGINT AS blocks, count(v.vec_id)::BIGINT AS covered, round(avg((v.vec_id IS NOT NULL)::INT), 6) AS coverage FROM documents LEFT JOIN embeddings v ON vec_id = doc_id")
def coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash"))
    return vectors.coverage(docs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hash")))


def _embed_sql(texts: str) -> str:
    """Hashed features of (id, low): words of two bytes or more and byte trigrams, each at
    its hash and, by half, at the hash's upper half; (id, i, v) of length one."""
    return f"""
t AS ({texts}),
grams AS (SELECT id, hex(encode(w)) AS h, 1.0::DOUBLE AS weight FROM (SELECT id, unnest(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+')) AS w FROM t) WHERE strlen(w) >= 2
  UNION ALL SELECT id, substr(x, 2 * i + 1, 6), 0.5 FROM (SELECT id, x, unnest(range(0, length(x) // 2 - 2)) AS i FROM (SELECT id, hex(encode(low)) AS x FROM t))),
counted AS (SELECT id, h, sum(weight) AS w FROM grams GROUP BY id, h),
fnv AS (SELECT h, ('0x' || {_FNV.format(h="h")})::UBIGINT AS v FROM (SELECT DISTINCT h FROM counted)),
placed_at AS (SELECT id, (v % 256)::INT AS i, w FROM counted JOIN fnv USING (h) UNION ALL SELECT id, ((v >> 32) % 256)::INT, w / 2 FROM counted JOIN fnv USING (h)),
summed AS (SELECT id, i, sum(w) AS w FROM placed_at GROUP BY id, i),
vec AS (SELECT id, i, (w / sqrt(sum(w * w) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM summed)
"""


@query(
    _with(_embed_sql("SELECT doc_id AS id, lower(coalesce(text, '')) AS low FROM documents"))
    + " SELECT doc_id, round(coalesce(sqrt(sum(v * v)), 0), 4) AS norm, round(coalesce(max(v), 0), 4) AS top FROM documents LEFT JOIN vec ON id = doc_id GROUP BY doc_id"
)
def hash_embed(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", vectors.hash_embed(F.col("text")).alias("v"))
    return found.select("doc_id", F.round(vectors.norm(F.col("v")), 4).alias("norm"), F.round(F.array_max("v").cast("double"), 4).alias("top"))


_QUESTION = "tion the"
_FUSED = f"""
near AS (SELECT b.id AS block_id, round(sum(b.v * q.v), 6) AS score FROM vec b JOIN vec q ON q.i = b.i AND q.id = -1 WHERE b.id <> -1 GROUP BY b.id),
one AS (SELECT block_id, row_number() OVER (ORDER BY score DESC, block_id) - 1 AS place FROM near QUALIFY place < 200),
two AS (SELECT block_id, row_number() OVER (ORDER BY {_occ(_QUESTION)} DESC, strlen(text), block_id) - 1 AS place FROM blocks WHERE contains({_HIT}, '{_QUESTION}') QUALIFY place < 200)
"""


@query(
    _with(DOCUMENTS_SQL, _embed_sql(f"SELECT block_id AS id, {_HIT} AS low FROM blocks UNION ALL SELECT -1, '{_QUESTION}'"), _FUSED)
    + " SELECT block_id, round(sum(1 / (60.0::DOUBLE + place)), 6) AS score, 'rrf' AS ranked_by FROM (FROM one UNION ALL FROM two) GROUP BY block_id ORDER BY score DESC, block_id LIMIT 20"
)
def ask_hybrid(spark, sf_dir):
    """Lexical and semantic lists over blocks, fused; vectors are made once for each content
    and read back from their table."""
    found = cut(chunk.hashed(_blocks(spark, sf_dir)))
    made = cut(vectors.missing(found, spark.createDataFrame([], "hash string")).select("hash", vectors.hash_embed(F.col("text")).alias("embedding")))
    return ask.fused(found, made, _QUESTION, vectors.embed([_QUESTION])[0].tolist(), 20).withColumn("ranked_by", F.lit("rrf"))


_POOL = "pool AS (SELECT row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS idx, vec_id, label FROM (SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], " + _Q.format(0) + "), 6) AS score FROM embeddings) QUALIFY idx < 80)"


@query(f"WITH {_POOL} SELECT idx::INT AS idx, pos::INT AS pos, vec_id, label FROM pool JOIN (SELECT (idx * 38) % 90 AS idx, min(idx) AS pos FROM pool WHERE idx < 20 GROUP BY 1) USING (idx)")
def rerank_apply(spark, sf_dir):
    """The first hits of a whole search in an order with repeated and unknown entries."""
    v = table(spark, sf_dir, "embeddings")
    near = vectors.nearest(v, _vector(spark, sf_dir, 0), vectors.pool_size(20))
    pool = vectors.ranked(near, [F.desc("score"), F.col("vec_id")]).join(v.select("vec_id", "label"), "vec_id")
    order = pool.select(((F.col("place") * 38) % 90).alias("idx"), F.col("place").alias("pos"))
    return vectors.apply_order(pool.withColumnRenamed("place", "idx"), order, 20).select("idx", "pos", "vec_id", "label")


@query("SELECT vec_id, greatest(vec_id, least(4 * vec_id, 100)) AS pool FROM embeddings")
def rerank_pool(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.pandas_udf(lambda n: n.map(vectors.pool_size), "long")("vec_id").alias("pool"))


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content hash of each document: the lower half of its MD5, as DuckDB reads it."""
    docs = table(spark, sf_dir, "documents")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    little = F.concat(*[F.substring(digest, 33 - 2 * k, 2) for k in range(1, 9)])
    return docs.select(little.alias("hash"))


@query("SELECT lower(printf('%016x', xor(bit_xor(h), count(*)::UBIGINT))) AS fingerprint, count(*)::BIGINT AS files FROM (SELECT md5_number_lower(text) AS h FROM documents)", "fingerprint")
def fingerprint(spark, sf_dir):
    return lake.fingerprint(_digests(spark, sf_dir))


@query(
    _with(DOCUMENTS_SQL.replace("blocks AS", "d_blocks AS"), CODE_SQL, IMPORTS_SQL)
    + " SELECT (SELECT count(*) FROM documents)::BIGINT AS files, (SELECT count(*) FROM d_blocks)::BIGINT AS blocks, (SELECT count(*) FROM symbols)::BIGINT AS symbols, (SELECT count(*) FROM calls)::BIGINT AS calls, (SELECT count(*) FROM imports)::BIGINT AS imports, (SELECT count(*) FROM embeddings)::BIGINT AS vectors, (SELECT max(len(embedding)) FROM embeddings)::INT AS dim"
)
def stats(spark, sf_dir):
    syms, edges = _calls(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    counts = [(corpora.documents(spark, sf_dir), "files"), (_blocks(spark, sf_dir), "blocks"), (syms, "symbols"), (edges, "calls"), (_imports(spark, sf_dir), "imports"), (v, "vectors")]
    rows = None
    for frame, name in counts:
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
        rows = one if rows is None else rows.union(one)
    rows = rows.union(v.agg(F.max(F.size("embedding")).cast("long").alias("n")).select(F.lit("dim"), "n"))
    names = [n for _, n in counts] + ["dim"]
    out = rows.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in names])
    return out.withColumn("dim", F.col("dim").cast("int"))


@query(
    _with(DOCUMENTS_SQL)
    + " SELECT 1 AS version, count(*)::BIGINT AS files, lower(printf('%016x', xor(bit_xor(md5_number_lower(coalesce(text, ''))), count(*)::UBIGINT))) AS fingerprint, (SELECT count(*) FROM blocks)::BIGINT AS blocks, (SELECT count(*) FROM embeddings)::BIGINT AS vectors, 'hash:256' AS provider, 256 AS dim FROM documents"
)
def manifest(spark, sf_dir):
    made = lake.manifest(_digests(spark, sf_dir), _blocks(spark, sf_dir), table(spark, sf_dir, "embeddings"), "hash:256", 256)
    return spark.createDataFrame([made], "version int, files long, fingerprint string, blocks long, vectors long, provider string, dim int")


_OLD = "(SELECT conv_id * 100 + turn AS rel, length(text) AS len, turn AS mtime_ns FROM conversations WHERE conv_id % 5 <> 0)"
_NOW = "(SELECT conv_id * 100 + turn AS rel, length(text) + (turn % 4 = 3)::INT AS len, turn AS mtime_ns FROM conversations WHERE conv_id % 7 <> 0)"


@query(f"SELECT coalesce(n.rel, o.rel) AS rel, CASE WHEN o.rel IS NULL THEN 'added' WHEN n.rel IS NULL THEN 'removed' WHEN n.len = o.len AND n.mtime_ns = o.mtime_ns THEN 'same' ELSE 'modified' END AS status FROM {_OLD} o FULL JOIN {_NOW} n ON o.rel = n.rel")
def refresh_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("rel"), F.char_length("text").alias("len"), F.col("turn").alias("mtime_ns"), "conv_id")
    now = c.filter("conv_id % 7 <> 0").withColumn("len", F.col("len") + F.when(F.col("mtime_ns") % 4 == 3, 1).otherwise(0))
    return lake.refresh_diff(c.filter("conv_id % 5 <> 0"), now)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 5")
def upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    changed = docs.filter("doc_id % 3 = 0 AND doc_id % 11 <> 5").withColumn("lang", F.lit("new"))
    return lake.upsert(docs, changed, docs.filter("doc_id % 11 = 5"), "doc_id")


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS \"end\", count(*)::BIGINT AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 MINUTE, true)::INT AS new FROM events)) GROUP BY user_id, s")
def debounce_sessions(spark, sf_dir):
    return watch.keyed_sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "5 minutes")
