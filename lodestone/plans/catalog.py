"""Queries over the synthetic tables and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text as T
from lodestone.functions.chunking import chunked
from lodestone.operators import dense, lexical, lookup
from lodestone.plans import library as L
from lodestone.plans import readers  # noqa: F401  it registers its queries
from lodestone.plans import search as S
from lodestone.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from lodestone.plans.syntax import parse
from lodestone.schema import Index
from lodestone.session import shared_folder
from lodestone.sources import routing, snapshots
from lodestone.streaming import watch

WORDS = "thanti ores enin"
TERMS = WORDS.split()
NOW = L.EPOCH + 900 * 3600.0
FLAGSHIP = "hybrid_search"


def _exact(df: DataFrame, *columns: str) -> DataFrame:
    """Sums depend on their order in the last digits; nine places don't."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


_TOK = ("lib", "tok")
_LEX = ("lib", "tok", "len", "stats", "corpus")

# -- text analysis and statistics ---------------------------------------------


@query("tokens", L.sql("SELECT doc_id, term FROM tok", *_TOK))
def tokens(spark, sf):
    return lexical.token_rows(L.index(spark, sf).chunks).select("doc_id", "term")


@query("postings", L.sql("SELECT term, doc_id, doc_id AS chunk_id, CAST(1 AS INTEGER) AS term_freq FROM tok", *_TOK))
def postings(spark, sf):
    return L.index(spark, sf).postings


@query("token_counts", L.sql("SELECT chunk_id, CAST(token_count AS INTEGER) AS token_count FROM len", *_TOK, "len"))
def token_counts(spark, sf):
    return L.index(spark, sf).chunks.select("chunk_id", "token_count")


@query("estimate_tokens", "SELECT doc_id, CAST(greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3)) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def estimate_tokens(spark, sf):
    return L.files(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("term_stats", L.sql("SELECT term, doc_freq FROM stats", *_TOK, "stats"))
def term_stats(spark, sf):
    return lexical.term_stats(L.index(spark, sf).postings)


@query("term_stats_refresh", L.sql("SELECT term, doc_freq FROM stats", *_TOK, "stats"))
def term_stats_refresh(spark, sf):
    """Statistics in which some terms are stale: counted anew, they are those of the whole."""
    i = L.index(spark, sf)
    stats = lexical.term_stats(i.postings)
    touched = i.postings.where(F.col("term").startswith("th")).select("term").distinct()
    stale = stats.withColumn("doc_freq", F.when(F.col("term").startswith("th"), F.lit(-1)).otherwise(F.col("doc_freq")))
    stale = stale.unionByName(lexical.term_frame(spark, ["th_gone"]).withColumn("doc_freq", F.lit(5)))
    return lexical.refreshed_stats(stale, i.postings, touched.union(lexical.term_frame(spark, ["th_gone"])))


@query("document_frequencies", L.sql("SELECT t.term, coalesce(s.doc_freq, 0) AS doc_freq FROM (VALUES ('thanti'), ('ores'), ('enin'), ('nowhere_found')) t(term) LEFT JOIN stats s USING (term)", *_TOK, "stats"))
def document_frequencies(spark, sf):
    return lexical.frequencies(lexical.term_stats(L.index(spark, sf).postings), lexical.term_frame(spark, [*TERMS, "nowhere_found"]))


@query("posting_lists", L.sql("SELECT term, CAST(len(list(doc_id)) AS INTEGER) AS n, list_min(list(doc_id)) AS first_chunk, list_max(list(doc_id)) AS last_chunk FROM tok WHERE term IN ('thanti', 'ores', 'enin') GROUP BY term", *_TOK))
def posting_lists(spark, sf):
    p = lexical.posting_lists(L.index(spark, sf).postings, TERMS)
    return p.select("term", F.size("postings").alias("n"), F.col("postings")[0]["chunk_id"].alias("first_chunk"), F.element_at("postings", -1)["chunk_id"].alias("last_chunk"))


@query("corpus_summary", L.sql("SELECT n_chunks, round(avg_tokens, 9) AS avg_tokens FROM corpus", *_TOK, "len", "corpus"))
def corpus_summary(spark, sf):
    return _exact(lexical.corpus_summary(L.index(spark, sf).chunks), "avg_tokens")


@query("index_stats", L.sql("SELECT (SELECT count(*) FROM lib) AS documents, (SELECT count(*) FROM lib) AS chunks, (SELECT count(*) FROM lib WHERE code_type IS NOT NULL AND symbol_name <> '') AS symbols, (SELECT count(*) FROM stats) AS terms, (SELECT CAST(sum(token_count) AS BIGINT) FROM len) AS tokens", *_TOK, "len", "stats"))
def index_stats(spark, sf):
    return lexical.index_stats(L.index(spark, sf))


@query("extension_facet", L.sql("SELECT extension, count(*) AS n FROM lib GROUP BY extension ORDER BY n DESC", "lib"))
def extension_facet(spark, sf):
    return L.index(spark, sf).documents.groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension")


# -- ranking -------------------------------------------------------------------


@query("bm25_topk", L.sql("SELECT chunk_id, round(bm25, 9) AS bm25 FROM b", *_LEX, more=L.bm25_sql("b", TERMS, 10)))
def bm25_topk(spark, sf):
    i = L.index(spark, sf)
    return _exact(lexical.bm25(i.postings, i.chunks, WORDS, 10), "bm25")


@query("bm25_all", L.sql("SELECT chunk_id, round(bm25, 9) AS bm25 FROM b", *_LEX, more=L.bm25_sql("b", TERMS, 10**9)))
def bm25_all(spark, sf):
    i = L.index(spark, sf)
    return _exact(lexical.bm25(i.postings, i.chunks, WORDS, None), "bm25")


_PREFIX = """p AS (SELECT term, doc_id AS chunk_id FROM tok WHERE starts_with(term, 'thantio') ORDER BY term, doc_id LIMIT 100),
b AS (SELECT chunk_id, sum(ln((c.n_chunks - s.doc_freq + 0.5) / (s.doc_freq + 0.5) + 1.0) * (1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * (len.token_count / c.avg_tokens))))) AS bm25
 FROM p JOIN stats s USING (term) JOIN len USING (chunk_id) CROSS JOIN corpus c WHERE NOT EXISTS (SELECT 1 FROM tok WHERE term = 'thantio') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"""


@query("bm25_prefix_fallback", L.sql("SELECT chunk_id, round(bm25, 9) AS bm25 FROM b UNION ALL SELECT chunk_id, round(bm25, 9) FROM e", *_LEX, more=_PREFIX + ",\n" + L.bm25_sql("e", ["thantio"], 20)))
def bm25_prefix_fallback(spark, sf):
    i = L.index(spark, sf)
    return _exact(lexical.bm25(i.postings, i.chunks, "thantio", 20), "bm25")


@query("prefix_postings", L.sql("SELECT term, doc_id, doc_id AS chunk_id, CAST(1 AS INTEGER) AS term_freq, prefix FROM (SELECT t.*, p.prefix, row_number() OVER (PARTITION BY prefix ORDER BY term, doc_id) AS n FROM tok t JOIN (VALUES ('than'), ('ere')) p(prefix) ON starts_with(t.term, p.prefix)) WHERE n <= 100", *_TOK))
def prefix_postings(spark, sf):
    return lexical.prefix_postings(L.index(spark, sf).postings, ["than", "ere", "x"])


@query("tfidf_topk", L.sql("SELECT chunk_id, round(dot / (dn * qn), 9) AS tfidf FROM (SELECT k.doc_id AS chunk_id, sum(d * q) AS dot, sqrt(sum(d * d)) AS dn FROM k JOIN w USING (term) GROUP BY 1) CROSS JOIN (SELECT sqrt(sum(q * q)) AS qn FROM w) ORDER BY 2 DESC, 1 LIMIT 50", *_LEX, more="w AS (SELECT t.term, ln((1 + c.n_chunks) / (1 + coalesce(s.doc_freq, 0))) + 1.0 AS idf, (ln((1 + c.n_chunks) / (1 + coalesce(s.doc_freq, 0))) + 1.0) / 3 AS q FROM (VALUES ('thanti'), ('ores'), ('enin')) t(term) LEFT JOIN stats s USING (term) CROSS JOIN corpus c),\nk AS (SELECT t.doc_id, t.term, w.idf / count(*) OVER (PARTITION BY t.doc_id) AS d FROM tok t JOIN w USING (term))"))
def tfidf_topk(spark, sf):
    i = L.index(spark, sf)
    return _exact(lexical.tfidf(i.postings, i.chunks, WORDS, 50), "tfidf")


_Q = "q AS (SELECT embedding AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "list_inner_product(e.embedding::DOUBLE[], q.v::DOUBLE[]) / q.n"


@query("vector_topk", f"WITH {_Q} SELECT vec_id AS chunk_id, round({_COS}, 9) AS cosine FROM embeddings e CROSS JOIN q ORDER BY {_COS} DESC, vec_id LIMIT 50")
def vector_topk(spark, sf):
    return _exact(dense.vector_top(L.index(spark, sf).vectors, L.first_vector(spark, sf), 50), "cosine")


@query("vector_topk_filtered", f"WITH {_Q}, {L.SQL['lib']} SELECT vec_id AS chunk_id, round({_COS}, 9) AS cosine FROM embeddings e CROSS JOIN q WHERE vec_id IN (SELECT doc_id FROM lib WHERE extension = '.py') ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, sf):
    i = L.index(spark, sf)
    return _exact(dense.vector_top(i.vectors, L.first_vector(spark, sf), 20, lookup.candidates(i, parse("ext:py"))), "cosine")


@query("semantic_scores", f"WITH {_Q} SELECT vec_id AS chunk_id, round(least(1.0, greatest(0.0, (c - 0.36) / (1.0 - 0.36))), 9) AS semantic FROM (SELECT vec_id, {_COS} AS c FROM embeddings e CROSS JOIN q ORDER BY c DESC, vec_id LIMIT 500) WHERE c >= 0.36")
def semantic_scores(spark, sf):
    return _exact(dense.semantic(L.index(spark, sf).vectors, L.first_vector(spark, sf), 500), "semantic")


@query("normalised_vectors", "SELECT vec_id AS chunk_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 5) AS length, round(u[1], 5) AS first_component FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(3.0 * x AS FLOAT)::DOUBLE / (3.0 * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS u FROM embeddings)")
def normalised_vectors(spark, sf):
    v = L.index(spark, sf).vectors.withColumn("embedding", F.transform("embedding", lambda x: (x * 3.0).cast("float")))
    u = dense.normalised(v)
    return u.select("chunk_id", F.round(dense.norm(F.col("embedding")), 5).alias("length"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first_component"))


@query("vector_upsert", "SELECT vec_id AS chunk_id, CASE WHEN label = 0 THEN 1.0 ELSE round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) END AS length FROM embeddings UNION ALL SELECT -1, 0.0")
def vector_upsert(spark, sf):
    """Vectors of one label replaced by ten times themselves, and a zero vector added."""
    e = L.table(spark, sf, "embeddings")
    new = e.where("label = 0").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x * F.lit(10).cast("float")).alias("embedding"))
    new = new.unionByName(spark.createDataFrame([(-1, [0.0, 0.0])], "chunk_id long, embedding array<float>"))
    u = dense.upsert_vectors(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), new)
    return u.select("chunk_id", F.round(dense.norm(F.col("embedding")), 4).alias("length"))


@query("vector_delete", "SELECT vec_id AS chunk_id FROM embeddings WHERE label <> 0 OR label IS NULL")
def vector_delete(spark, sf):
    e = L.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return dense.delete_vectors(e, e.where("label = 0").select("chunk_id")).select("chunk_id")


# -- filters and look-ups --------------------------------------------------------

FILTERS = {
    "filter_ext": ("ext:md,py", "extension IN ('.md', '.py')"),
    "filter_not_ext": ("-ext:.md", "extension NOT IN ('.md')"),
    "filter_path": ('path:"/SRC1/"', "contains(lower(path), 'src1')"),
    "filter_type_doc": ("type:belge", "extension IN ('.md', '.txt', '.pdf')"),
    "filter_type_code": ("kind:code", "code_type IS NOT NULL"),
    "filter_after": ("after:2023-11-20", "mtime >= 1700438400"),
    "filter_before": ("until:20.11.2023", "mtime <= 1700524799"),
    "filter_symbol": ("sym:EN", "contains(lower(symbol_name), 'en')"),
    "filter_all": ('ext:py -ext:md dir:lib since:2023-11-15 to:2026-01-01 symbol:e', "extension = '.py' AND contains(lower(path), 'lib') AND mtime >= 1700006400 AND mtime <= 1767311999 AND contains(lower(symbol_name), 'e')"),
}


def _filter_query(text: str):
    return lambda spark, sf: lookup.candidates(L.index(spark, sf), parse(text)).select("chunk_id", "doc_id", "mtime")


for _name, (_text, _where) in FILTERS.items():
    query(_name, L.sql(f"SELECT doc_id AS chunk_id, doc_id, mtime FROM lib WHERE {_where}", "lib"))(_filter_query(_text))


@query("candidates_latest", L.sql("SELECT doc_id AS chunk_id, doc_id, mtime FROM lib WHERE extension = '.md' ORDER BY mtime DESC, doc_id LIMIT 50", "lib"))
def candidates_latest(spark, sf):
    return lookup.candidates(L.index(spark, sf), parse("ext:md"), top=50).select("chunk_id", "doc_id", "mtime")


@query("filename_lookup", L.sql("SELECT doc_id AS chunk_id, CASE WHEN filename = 'doc_12.md' THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS weight FROM lib WHERE contains(lower(filename), 'oc_12') OR contains(lower(path), 'oc_12') ORDER BY filename = 'OC_12' DESC, length(filename), doc_id LIMIT 100", "lib").replace("filename = 'doc_12.md'", "lower(filename) = 'oc_12'"))
def filename_lookup(spark, sf):
    return lookup.by_filename(L.index(spark, sf), "OC_12")


@query("symbol_lookup", L.sql("SELECT doc_id AS chunk_id, symbol_name AS name, CASE WHEN lower(symbol_name) = 'en' THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS weight FROM lib WHERE contains(lower(symbol_name), 'en') AND code_type IS NOT NULL ORDER BY symbol_name = 'En' DESC, length(symbol_name), doc_id LIMIT 100", "lib"))
def symbol_lookup(spark, sf):
    return lookup.by_symbol(L.index(spark, sf), "En")


@query("find_symbols", L.sql("SELECT doc_id AS symbol_id, symbol_name AS name, 'function' AS kind, CAST(1 AS INTEGER) AS line_number, doc_id AS chunk_id, path, filename, substring(text, 1, 300) AS code_snippet, CAST(1 AS INTEGER) AS start_line, end_line FROM lib WHERE contains(lower(symbol_name), 'ti') AND code_type IS NOT NULL ORDER BY symbol_name = 'ti' DESC, length(symbol_name), doc_id LIMIT 20", "lib"))
def find_symbols(spark, sf):
    return S.search_symbol(L.index(spark, sf), "ti")


@query("derived_names", L.sql("SELECT doc_id, filename, extension FROM lib", "lib"))
def derived_names(spark, sf):
    return L.files(spark, sf).select("doc_id", T.filename(F.col("path")).alias("filename"), T.extension(F.col("path")).alias("extension"))


@query("like_is_literal", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_brand), 'brand#1') OR contains(p_name, '%') OR contains(p_name, '_')")
def like_is_literal(spark, sf):
    p = L.table(spark, sf, "part")
    return p.where(T.contains_ci(F.col("p_brand"), "BRAND#1") | T.contains_ci(F.col("p_name"), "%") | T.contains_ci(F.col("p_name"), "_")).select("p_partkey", "p_name")


# -- fusing and presenting --------------------------------------------------------

_SNIP_HIT = "least(" + ", ".join(f"CASE WHEN strpos(lower(text), '{w}') > 0 THEN strpos(lower(text), '{w}') END" for w in TERMS) + ")"


def _snippet_sql(source: str) -> str:
    """chunk columns with `snippet` for WORDS."""
    t = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
    return f"""(SELECT *, CASE WHEN length(text) <= 350 THEN {t.format('text')} WHEN hit IS NULL THEN {t.format('substring(text, 1, 350)')} || '...'
 ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || {t.format('substring(text, CAST(st AS INTEGER) + 1, 350)')} || CASE WHEN st + 350 < length(text) THEN '...' ELSE '' END END AS snippet
 FROM (SELECT *, greatest(0, hit - 101) AS st FROM (SELECT *, {_SNIP_HIT} AS hit FROM {source})))"""


@query("snippets", L.sql(f"SELECT doc_id, snippet FROM {_snippet_sql('lib')}", "lib"))
def snippets(spark, sf):
    return L.files(spark, sf).select("doc_id", T.snippet(F.col("text"), WORDS).alias("snippet"))


@query("highlights", "SELECT doc_id, sha256(regexp_replace(text, '(thanti|ores)', '<mark>\\1</mark>', 'gi')) AS marked FROM documents WHERE text IS NOT NULL")
def highlights(spark, sf):
    return L.files(spark, sf).select("doc_id", F.sha2(T.highlight(F.col("text"), "thanti a ores"), 256).alias("marked"))


def _scores(spark, sf):
    """Two score tables: lengths of parts and sizes of parts, by key."""
    p = L.table(spark, sf, "part").where("p_retailprice is not null")
    a = p.where("p_size <= 30").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_retailprice") / 100).alias("bm25"))
    b = p.where("p_size >= 20").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_size") / 50.0).alias("semantic"))
    return a, b


_FUSE = """a AS (SELECT p_partkey AS chunk_id, p_retailprice / 100 AS x FROM part WHERE p_retailprice IS NOT NULL AND p_size <= 30),
b AS (SELECT p_partkey AS chunk_id, p_size / 50.0 AS x FROM part WHERE p_retailprice IS NOT NULL AND p_size >= 20),
an AS (SELECT chunk_id, (x - (SELECT min(x) FROM a)) / ((SELECT max(x) FROM a) - (SELECT min(x) FROM a)) AS x FROM a),
bn AS (SELECT chunk_id, (x - (SELECT min(x) FROM b)) / ((SELECT max(x) FROM b) - (SELECT min(x) FROM b)) AS x FROM b),
f AS (SELECT chunk_id, coalesce(an.x, 0.0) AS bm25_score, coalesce(bn.x, 0.0) AS semantic_score, 0.3 * coalesce(an.x, 0.0) + (1.0 - 0.3) * coalesce(bn.x, 0.0) AS raw_score FROM an FULL JOIN bn USING (chunk_id))"""


@query("min_max", f"WITH {_FUSE} SELECT chunk_id, round(x, 9) AS bm25 FROM an")
def min_max(spark, sf):
    return _exact(S.normalised(_scores(spark, sf)[0], "bm25"), "bm25")


@query("fused_scores", f"WITH {_FUSE} SELECT chunk_id, round(raw_score, 9) AS raw_score, round(bm25_score, 9) AS bm25_score, round(semantic_score, 9) AS semantic_score FROM f WHERE raw_score > 0.005")
def fused_scores(spark, sf):
    return _exact(S.fused(*_scores(spark, sf), 0.3), "raw_score", "bm25_score", "semantic_score")


@query("metadata_scores", """WITH b AS (SELECT p_partkey AS chunk_id, p_retailprice / 100 AS x FROM part WHERE p_size <= 30), m AS (SELECT max(x) AS m FROM b),
h AS (SELECT p_partkey AS chunk_id, 0 AS kind, 0.85 AS w FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey, 1, 0.75 FROM part WHERE p_size % 2 = 0),
g AS (SELECT chunk_id, sum(w) AS al, arg_min(w, kind) AS fi FROM h GROUP BY 1)
SELECT chunk_id, round(CASE WHEN al IS NULL THEN x WHEN x IS NULL THEN (fi + (al - fi) * 0.5) * m ELSE x + al * m * 0.5 END, 9) AS bm25 FROM b FULL JOIN g USING (chunk_id) CROSS JOIN m""")
def metadata_scores(spark, sf):
    p = L.table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), "p_size", "p_retailprice")
    names = p.where("p_size <= 10").select("chunk_id", F.lit(0.85).alias("weight"))
    symbols = p.where("p_size % 2 = 0").select("chunk_id", F.lit(0.75).alias("weight"))
    return _exact(S.with_names(p.where("p_size <= 30").select("chunk_id", (F.col("p_retailprice") / 100).alias("bm25")), names, symbols), "bm25")


_RANKED = f"""r AS (SELECT doc_id AS chunk_id, doc_id, source, 0.1 + (mtime - {L.EPOCH}) / 1e9 AS raw_score, filename, section_title, symbol_name, text, mtime FROM lib),
s AS (SELECT *, least(1.0, raw_score + CASE WHEN symbol_name IS NULL OR symbol_name = '' THEN 0.0 WHEN lower(translate(symbol_name, 'İI', 'iı')) = 'en' THEN 0.35 WHEN contains(lower(translate(symbol_name, 'İI', 'iı')), 'en') THEN 0.15 ELSE 0.0 END
 + CASE WHEN contains(lower(translate(section_title, 'İI', 'iı')), 'en') THEN 0.20 ELSE 0.0 END
 + CASE WHEN contains(lower(translate(text, 'İI', 'iı')), 'en') THEN 0.10 ELSE 0.0 END) AS score FROM r)"""


def _ranked(spark, sf):
    f = L.files(spark, sf).select(F.col("doc_id").alias("chunk_id"), "doc_id", "source", (F.lit(0.1) + (F.col("mtime") - L.EPOCH) / 1e9).alias("raw_score"), "filename", F.col("section_title").alias("section"), "symbol_name", F.col("text").alias("snippet"))
    return S.reranked(f, "En ")


@query("reranked_scores", L.sql("SELECT chunk_id, round(score, 9) AS score FROM s", "lib", more=_RANKED))
def reranked_scores(spark, sf):
    return _exact(S.reranked(_ranked(spark, sf), "En").select("chunk_id", "score"), "score")


@query("diverse_top2", L.sql("SELECT chunk_id, source, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, raw_score DESC, chunk_id) AS n FROM s) WHERE n <= 2", "lib", more=_RANKED))
def diverse_top2(spark, sf):
    by_source = _ranked(spark, sf).withColumn("doc_id", F.col("source"))
    return _exact(S.diverse(by_source).select("chunk_id", "source", "score"), "score")


@query("paged", L.sql("SELECT chunk_id, round(score, 9) AS score FROM s ORDER BY s.score DESC, raw_score DESC, chunk_id LIMIT 15 OFFSET 30", "lib", more=_RANKED))
def paged(spark, sf):
    return _exact(S.page_of(_ranked(spark, sf), 3, 15).select("chunk_id", "score"), "score")


@query("recency_boosts", L.sql(f"SELECT doc_id, CASE WHEN {NOW} - mtime <= 604800 THEN 0.08::DOUBLE WHEN {NOW} - mtime <= 2592000 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM lib", "lib"))
def recency_boosts(spark, sf):
    return L.files(spark, sf).select("doc_id", T.recency(F.col("mtime"), NOW).alias("boost"))


_REC = f"CASE WHEN {NOW} - mtime <= 604800 THEN 0.08::DOUBLE WHEN {NOW} - mtime <= 2592000 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END"


@query("filter_only_search", L.sql(f"SELECT doc_id AS chunk_id, filename, round(least(1.0::DOUBLE, 0.70::DOUBLE + {_REC}), 9) AS score, mtime FROM (SELECT * FROM lib WHERE extension = '.md' ORDER BY mtime DESC, doc_id LIMIT 1000) ORDER BY 3 DESC, mtime DESC, doc_id LIMIT 20 OFFSET 20", "lib"))
def filter_only_search(spark, sf):
    return _exact(S.search(L.index(spark, sf), "ext:md", NOW, 2, 20).select("chunk_id", "filename", "score", "mtime"), "score")


def _hybrid_sql(where: str | None, limit: int, semantic: bool = True) -> str:
    """The whole of a search for WORDS, none of which is in a name or symbol."""
    keep = f"chunk_id IN (SELECT doc_id FROM lib WHERE {where})" if where else "TRUE"
    low = lambda c: f"lower(translate({c}, 'İI', 'iı'))"
    more = f"""{L.bm25_sql('b0', TERMS, 500)},
b AS (SELECT * FROM b0 WHERE {keep}), {_Q},
v AS (SELECT vec_id AS chunk_id, {_COS} AS c FROM embeddings e CROSS JOIN q WHERE {keep.replace('chunk_id', 'vec_id')} ORDER BY c DESC, vec_id LIMIT 500),
s AS (SELECT chunk_id, least(1.0, greatest(0.0, (c - 0.36) / (1.0 - 0.36))) AS x FROM v WHERE c >= 0.36 AND {semantic}),
bn AS (SELECT chunk_id, CASE WHEN (SELECT max(bm25) FROM b) = (SELECT min(bm25) FROM b) THEN greatest(0.0, least(1.0, bm25)) ELSE (bm25 - (SELECT min(bm25) FROM b)) / ((SELECT max(bm25) FROM b) - (SELECT min(bm25) FROM b)) END AS x FROM b),
sn AS (SELECT chunk_id, CASE WHEN (SELECT max(x) FROM s) <= 0 THEN 0.0 WHEN (SELECT max(x) FROM s) = (SELECT min(x) FROM s) THEN x ELSE (x - (SELECT min(x) FROM s)) / ((SELECT max(x) FROM s) - (SELECT min(x) FROM s)) END AS x FROM s),
f AS (SELECT chunk_id, coalesce(bn.x, 0.0) AS bm25_score, coalesce(sn.x, 0.0) AS semantic_score, 0.5 * coalesce(bn.x, 0.0) + 0.5 * coalesce(sn.x, 0.0) AS raw_score FROM bn FULL JOIN sn USING (chunk_id)),
top AS (SELECT * FROM f WHERE raw_score > 0.005 ORDER BY raw_score DESC, chunk_id LIMIT 500),
d AS (SELECT top.*, lib.* FROM top JOIN lib ON lib.doc_id = top.chunk_id),
r AS (SELECT *, least(1.0, raw_score + CASE WHEN contains({low('section_title')}, '{WORDS}') THEN 0.20 ELSE 0.0 END + CASE WHEN contains({low('snippet')}, '{WORDS}') THEN 0.10 ELSE 0.0 END) AS score FROM {_snippet_sql('d')})"""
    return L.sql(
        f"SELECT chunk_id, filename, path, round(score, 9) AS score, round(bm25_score, 9) AS bm25_score, round(semantic_score, 9) AS semantic_score, {_REC} AS recency_boost, snippet, code_type FROM r ORDER BY r.score DESC, raw_score DESC, chunk_id LIMIT {limit}",
        *_LEX,
        more=more,
    )


_SHOWN = ("chunk_id", "filename", "path", "score", "bm25_score", "semantic_score", "recency_boost", "snippet", "code_type")


def _shown(df: DataFrame) -> DataFrame:
    return _exact(df.select(*_SHOWN), "score", "bm25_score", "semantic_score")


@query("hybrid_search", _hybrid_sql(None, 10))
def hybrid_search(spark, sf):
    return _shown(S.search(L.index(spark, sf), WORDS, NOW, query_vector=L.first_vector(spark, sf)))


@query("hybrid_search_filtered", _hybrid_sql("extension IN ('.md', '.py') AND contains(lower(path), 'src1')", 25))
def hybrid_search_filtered(spark, sf):
    return _shown(S.search(L.index(spark, sf), f"{WORDS} ext:md,py path:src1", NOW, limit=25, query_vector=L.first_vector(spark, sf)))


@query("lexical_search", _hybrid_sql(None, 30, semantic=False))
def lexical_search(spark, sf):
    return _shown(S.search(L.index(spark, sf), WORDS, NOW, limit=30))


@query("code_search", _hybrid_sql("code_type IS NOT NULL", 10))
def code_search(spark, sf):
    return _shown(S.search_code(L.index(spark, sf), WORDS, NOW, query_vector=L.first_vector(spark, sf)))


@query("search_total", _hybrid_sql(None, 10**9).replace("SELECT chunk_id, filename, path,", "SELECT count(*) AS total FROM (SELECT chunk_id, filename, path,") + ")")
def search_total(spark, sf):
    return S.search_paginated(L.index(spark, sf), WORDS, NOW, query_vector=L.first_vector(spark, sf))[1]


# -- events --------------------------------------------------------------------------


@query("latest_event", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event(spark, sf):
    e = L.table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_type", "e.event_id")


@query("first_per_group", L.sql("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mtime DESC, doc_id) AS n FROM lib) WHERE n = 1", "lib"))
def first_per_group(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("mtime"), "doc_id")
    return L.files(spark, sf).withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "source")


@query("sha256_documents", "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def sha256_documents(spark, sf):
    return L.files(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("safe_files", """SELECT c_custkey, s AS safe FROM (SELECT c_custkey, NOT (m IN ('BUILDING', 'MACHINERY')) AND c_custkey * 10000 <= 52428800 AS s FROM (SELECT c_custkey, c_mktsegment AS m FROM customer))""")
def safe_files(spark, sf):
    c = L.table(spark, sf, "customer")
    folder = F.when(F.col("c_mktsegment") == "BUILDING", "build").when(F.col("c_mktsegment") == "MACHINERY", ".hidden").otherwise(F.lower("c_mktsegment"))
    path = F.concat(F.lit("/home/"), folder, F.lit("/"), "c_name", F.lit(".txt"))
    return c.select("c_custkey", lookup.safe_path(path, F.col("c_custkey") * 10000).alias("safe"))


@query("human_sizes", "SELECT o_orderkey, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN printf('%.1f KB', v / 1024.0) ELSE printf('%.1f MB', v / 1048576.0) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS BIGINT) AS v FROM orders)")
def human_sizes(spark, sf):
    return L.table(spark, sf, "orders").select("o_orderkey", T.human_size(F.col("o_orderkey") * F.col("o_orderkey")).alias("size"))


# -- reading files ---------------------------------------------------------------------


_SEEN = "CAST(greatest(1, floor(len(regexp_extract_all({0}, '\\S+')) * 1.3::DOUBLE)) AS INTEGER)"
_MOST, _AGAIN = config.CHUNK_TOKENS, config.CHUNK_OVERLAP
#: Packs of paragraphs, and of sentences where a paragraph is too long, by one recursion each.
_CHUNKS = f"""WITH RECURSIVE pars AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
par AS (SELECT doc_id, p, t, {_SEEN.format('t')} AS n FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM pars)),
lists AS (SELECT doc_id, p, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM par WHERE n > {_MOST}),
sen AS (SELECT doc_id, p, s, t, {_SEEN.format('t')} AS n, s = len(l) AS ends FROM (SELECT doc_id, p, l, unnest(l) AS t, generate_subscripts(l, 1) AS s FROM lists)),
bys AS (SELECT doc_id, p, s, ends, NULL::VARCHAR[] AS given, [t] AS pack, [n] AS held FROM sen WHERE s = 1 UNION ALL
 SELECT b.doc_id, b.p, x.s, x.ends, CASE WHEN f THEN b.pack END, list_append(CASE WHEN f THEN b.pack[-2:] ELSE b.pack END, x.t), list_append(CASE WHEN f THEN b.held[-2:] ELSE b.held END, x.n)
 FROM (SELECT b.*, list_sum(b.held) + x.n > {_MOST} AS f FROM bys b JOIN sen x ON x.doc_id = b.doc_id AND x.p = b.p AND x.s = b.s + 1) b JOIN sen x ON x.doc_id = b.doc_id AND x.p = b.p AND x.s = b.s + 1),
byp AS (SELECT doc_id, 0::BIGINT AS p, NULL::VARCHAR[] AS given, []::VARCHAR[] AS pack, []::INTEGER[] AS held FROM pars UNION ALL
 SELECT doc_id, p + 1, CASE WHEN f THEN pack END, CASE WHEN n > {_MOST} THEN [] ELSE list_append(CASE WHEN NOT f THEN pack WHEN a THEN pack[-1:] ELSE [] END, t) END,
 CASE WHEN n > {_MOST} THEN [] ELSE list_append(CASE WHEN NOT f THEN held WHEN a THEN held[-1:] ELSE [] END, n) END
 FROM (SELECT b.*, x.n, x.t, len(pack) > 0 AND (x.n > {_MOST} OR list_sum(held) + x.n > {_MOST}) AS f, x.n <= {_MOST} AND len(pack) > 1 AND held[-1] <= {_AGAIN} AS a FROM byp b JOIN par x ON x.doc_id = b.doc_id AND x.p = b.p + 1)),
packs AS (SELECT doc_id, p, 0 AS s, array_to_string(given, chr(10) || chr(10)) AS text FROM byp WHERE given IS NOT NULL
 UNION ALL SELECT doc_id, p, s, array_to_string(given, ' ') FROM bys WHERE given IS NOT NULL
 UNION ALL SELECT doc_id, p, s + 1, array_to_string(pack, ' ') FROM bys WHERE ends
 UNION ALL SELECT doc_id, p + 1, 0, array_to_string(pack, chr(10) || chr(10)) FROM byp JOIN (SELECT doc_id, len(l) AS p FROM pars) USING (doc_id, p) WHERE len(pack) > 0),
counted AS (SELECT *, row_number() OVER w AS i, len(string_split(text, chr(10))) AS lines, sum(len(string_split(text, chr(10)))) OVER w AS upto FROM packs WINDOW w AS (PARTITION BY doc_id ORDER BY p, s))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, text, CAST(upto - lines + 1 AS INTEGER) AS start_line, CAST(upto AS INTEGER) AS end_line FROM counted"""


@query("chunks", _CHUNKS)
def chunks(spark, sf):
    """Documents cut along paragraphs and sentences (sequential within a text, so by an Arrow function)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, n, *c) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for n, c in enumerate(chunked(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "start_line", "end_line"])

    return L.files(spark, sf).select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index int, text string, start_line int, end_line int")


def _page_files(spark, sf):
    p = L.table(spark, sf, "pages").where("html is not null")
    path = F.concat(F.lit("/web/page_"), F.col("page_id").cast("string"), F.lit(".html"))
    return p.select("page_id", path.alias("path"), F.encode("html", "UTF-8").alias("content"), F.octet_length("html").cast("long").alias("size_bytes"), F.lit(L.EPOCH).alias("mtime"))


@query("html_chunks")
def html_chunks(spark, sf):
    """Pages as .html files through the readers."""
    return routing.read_files(_page_files(spark, sf)).select("doc_id", "chunk_index", "section_title", "text", "start_line", "end_line")


_FAMILY = " ".join(f"WHEN e IN ({', '.join(repr(s) for s in sorted(suffixes))}) THEN '{name}'" for name, (suffixes, _) in routing.FAMILIES.items())
_KNOWN = ", ".join(f"('{s}')" for s in sorted({*config.SUPPORTED_EXTENSIONS, ".blend", ".unknown"}))


@query("parser_routes", f"SELECT e AS extension, CASE {_FAMILY} ELSE 'other' END AS family FROM (VALUES {_KNOWN}) t(e)")
def parser_routes(spark, sf):
    e = spark.createDataFrame([(s,) for s in sorted({*config.SUPPORTED_EXTENSIONS, ".blend", ".unknown"})], "extension string")
    return e.withColumn("family", routing.family(F.col("extension")))


@query("companion_subtitles", L.sql("SELECT v.path, list_sort(list(s.filename)) AS companions FROM v JOIN s ON v.source = s.source AND v.lang = s.lang AND starts_with('doc_' || s.doc_id, 'doc_' || v.doc_id) GROUP BY 1", "lib", more="v AS (SELECT doc_id, source, lang, '/lib/' || source || '/' || lang || '/doc_' || doc_id || '.mp4' AS path FROM lib WHERE length(text) >= 1500),\ns AS (SELECT doc_id, source, lang, 'doc_' || doc_id || '.srt' AS filename FROM lib WHERE length(text) < 1500)").replace("list_sort(list(s.filename)) AS companions", "array_to_string(list_sort(list(s.filename)), ',') AS companions"))
def companion_subtitles(spark, sf):
    f = L.files(spark, sf)
    path = F.regexp_replace("path", r"\.[^.]*$", F.when(F.length("text") >= 1500, ".mp4").otherwise(".srt"))
    files = f.select(path.alias("path"), F.lit(b"").alias("content"))
    found = routing.with_companions(files).where("companions is not null")
    return found.select("path", F.array_join("companions.name", ",").alias("companions"))


@query("path_keywords", L.sql("SELECT doc_id, 'lib,' || source || ',' || lang || ',doc' || CASE WHEN length(doc_id::VARCHAR) > 1 THEN ',' || doc_id ELSE '' END AS keywords FROM lib", "lib"))
def path_keywords(spark, sf):
    return L.files(spark, sf).select("doc_id", F.array_join(T.path_keywords(F.col("path"), 3), ",").alias("keywords"))


@query("rtf_text", "SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus AS text FROM orders")
def rtf_text(spark, sf):
    o = L.table(spark, sf, "orders")
    rtf = F.concat(F.lit("{\\rtf1\\ansi \\b "), "o_orderpriority", F.lit("\\b0\\par "), "o_orderstatus", F.lit("}"))
    words = F.regexp_replace(rtf, r"\\[a-zA-Z]+(-?\d+)? ?", " ")
    return o.select("o_orderkey", T.strip(F.regexp_replace(F.regexp_replace(words, r"[{}\\]", ""), r"(?U)\s+", " ")).alias("text"))


@query("date_filters", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 23:59:59'")
def date_filters(spark, sf):
    q = parse("since:10.01.2024 until:2024/01/20")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return L.table(spark, sf, "events").where((t >= q.after) & (t <= q.before)).select("event_id")


# -- keeping an index --------------------------------------------------------------------


def _versions(spark, sf):
    """Documents as indexed before and files as they are now: without Spanish, German ones changed, French ones new, some unreadable."""
    f = L.files(spark, sf)
    before = f.where("lang <> 'fr'").select("doc_id", "path", F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = f.where("lang <> 'es'").select("path", F.when(F.length("text") < 80, F.lit(None)).otherwise(F.sha2(text, 256)).alias("sha256"))
    return before, now


_STATUS = "SELECT path, CASE WHEN lang = 'es' THEN 'deleted' WHEN length(text) < 80 THEN 'failed' WHEN lang = 'fr' THEN 'new' WHEN lang = 'de' THEN 'changed' ELSE 'unchanged' END AS status FROM lib"


@query("file_changes", L.sql(_STATUS, "lib"))
def file_changes(spark, sf):
    return snapshots.changes(*_versions(spark, sf), under="/lib/")


@query("crawl_counters", L.sql(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status", "lib"))
def crawl_counters(spark, sf):
    return file_changes(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("deleted_paths", L.sql("SELECT path FROM lib WHERE lang = 'es'", "lib"))
def deleted_paths(spark, sf):
    before, now = _versions(spark, sf)
    return before.select("path").join(now, "path", "left_anti")


@query("upserted_documents", L.sql("SELECT doc_id, path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS sha256 FROM lib WHERE lang <> 'fr'", "lib"))
def upserted_documents(spark, sf):
    before, now = _versions(spark, sf)
    f = L.files(spark, sf).where("lang = 'de'").select("doc_id", "path", F.sha2(F.concat("text", F.lit("!")), 256).alias("sha256"))
    return snapshots.latest(before, f)


def _changed_index(spark, sf) -> tuple[Index, Index]:
    i = L.index(spark, sf)
    new = i.having(
        documents=i.documents.where("extension = '.pdf'"),
        chunks=i.chunks.join(i.documents.where("extension = '.pdf'"), "doc_id", "left_semi").withColumn("token_count", F.lit(-1)),
        symbols=i.symbols.limit(0),
        postings=i.postings.limit(0),
        vectors=i.vectors.limit(0),
    )
    return i, new


@query("cascade_delete", L.sql("SELECT 'chunks' AS name, count(*) AS n FROM lib WHERE extension <> '.py' UNION ALL SELECT 'documents', count(*) FROM lib WHERE extension <> '.py' UNION ALL SELECT 'symbols', 0 UNION ALL SELECT 'postings', count(*) FROM tok JOIN lib USING (doc_id) WHERE extension <> '.py' UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM lib WHERE extension = '.py')", *_TOK))
def cascade_delete(spark, sf):
    i = L.index(spark, sf)
    left = snapshots.without(i, i.documents.where("extension = '.py'"))
    sizes = [getattr(left, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("documents", "chunks", "symbols", "postings", "vectors")]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


@query("atomic_upsert", L.sql("SELECT extension, count(*) AS chunks, count(*) FILTER (WHERE extension = '.pdf') AS replaced FROM lib GROUP BY extension", "lib"))
def atomic_upsert(spark, sf):
    u = snapshots.upserted(*_changed_index(spark, sf))
    both = u.chunks.join(u.documents.select("doc_id", "extension"), "doc_id")
    return both.groupBy("extension").agg(F.count("*").alias("chunks"), F.count_if(F.col("token_count") == -1).alias("replaced"))


@query("posting_upsert", L.sql("SELECT CAST(CASE WHEN starts_with(term, 'th') THEN 7 ELSE 1 END AS INTEGER) AS term_freq, count(*) AS n FROM tok GROUP BY 1", *_TOK))
def posting_upsert(spark, sf):
    p = L.index(spark, sf).postings
    again = p.where(F.col("term").startswith("th")).withColumn("term_freq", F.lit(7))
    return snapshots.appended_postings(p, again).groupBy("term_freq").agg(F.count("*").alias("n"))


@query("candidate_union", L.sql("SELECT DISTINCT doc_id AS chunk_id FROM (SELECT doc_id FROM tok WHERE term IN ('thanti', 'ores', 'enin') UNION ALL SELECT doc_id FROM lib WHERE contains(filename, '_12') UNION ALL SELECT doc_id FROM lib WHERE contains(lower(symbol_name), 'en'))", *_TOK))
def candidate_union(spark, sf):
    i = L.index(spark, sf)
    ids = [lexical.bm25(i.postings, i.chunks, WORDS, None), lookup.by_filename(i, "_12", 10**6), lookup.by_symbol(i, "en", 10**6)]
    return ids[0].select("chunk_id").union(ids[1].select("chunk_id")).union(ids[2].select("chunk_id")).distinct()


# -- event streams ---------------------------------------------------------------------------


@query("event_sessions", """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT user_id, min(ts) AS started, count(*) AS events, arg_max(event_type, (ts, event_id)) AS event_type FROM s GROUP BY user_id, n""")
def event_sessions(spark, sf):
    e = L.table(spark, sf, "events").withColumn("k", F.struct("event_id", "event_type"))
    w = F.session_window("ts", "30 minutes")
    s = e.groupBy("user_id", w).agg(F.min("ts").alias("started"), F.count("*").alias("events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return s.select("user_id", "started", "events", "event_type")


_QUIET = "10 minutes"


@query("debounced_events", f"""WITH e AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '{_QUIET}' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id AS path, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event, count(*) AS events FROM s GROUP BY user_id, run
HAVING max(ts) + INTERVAL '{_QUIET}' <= (SELECT max(ts) FROM events)""")
def debounced_events(spark, sf):
    """The events as a stream: a key's last event is emitted once the key was quiet long enough by the watermark; what is not yet due waits in the state."""
    e = L.table(spark, sf, "events")
    src = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    due = watch.sessions(src.withWatermark("ts", "0 seconds"), "user_id", _QUIET, "event_id", "event_type", "ts")
    at = shared_folder(spark, "events")
    out = due.select(F.col("user_id").alias("path"), "ts", F.col("event_type").alias("event"), "events")
    out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("covered_paths", L.sql("SELECT path, '/lib/' || source AS root FROM lib WHERE source IN ('src1', 'src2')", "lib"))
def covered_paths(spark, sf):
    paths = L.files(spark, sf).select("path")
    roots = spark.createDataFrame([("/lib/src1",), ("/lib/src2/",)], "root string")
    return watch.covered(paths, roots).select("path", F.regexp_replace("root", "/$", "").alias("root"))


@query("presented_results", _hybrid_sql(None, 10).replace("SELECT chunk_id, filename, path, round(score, 9) AS score, round(bm25_score, 9) AS bm25_score, round(semantic_score, 9) AS semantic_score,", "SELECT chunk_id, filename, round(score, 4) AS score, round(bm25_score, 4) AS bm25_score, round(semantic_score, 4) AS semantic_score,").replace(", snippet, code_type FROM r", " FROM r"))
def presented_results(spark, sf):
    return S.presented(S.search(L.index(spark, sf), WORDS, NOW, query_vector=L.first_vector(spark, sf))).select("chunk_id", "filename", "score", "bm25_score", "semantic_score", "recency_boost")


@query("embedded_chunks")
def embedded_chunks(spark, sf):
    """Hashed-word vectors of the documents: the nearest to a text's own words."""
    i = L.index(spark, sf)
    v = dense.embed_chunks(i.chunks)
    return _exact(dense.vector_top(v, dense.embed_query(WORDS), 20), "cosine")
