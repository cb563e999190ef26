"""A document library over the synthetic tables: every document is a file of one chunk.

Its suffix follows the language, its folder the source; French documents stand
for code, named by their first word. `embeddings` holds the vectors of the
documents with the same id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import STOP_WORDS
from lodestone.operators import lexical
from lodestone.schema import Index

EPOCH = 1_700_000_000.0
SUFFIXES = {"en": ".md", "de": ".txt", "fr": ".py", "es": ".pdf"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with all that documents, chunks and symbols need."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    suffix = F.lit(".bin")
    for lang, s in SUFFIXES.items():
        suffix = F.when(F.col("lang") == lang, s).otherwise(suffix)
    code = F.col("lang") == "fr"
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), suffix)
    return d.select(
        "doc_id", "text", "source", "lang", suffix.alias("extension"), name.alias("filename"),
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"),
        (F.lit(EPOCH) + F.col("doc_id") * 3600.0).alias("mtime"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.when(code, "python").alias("code_type"),
        F.when(code, F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("symbol_name"),
        F.substring("text", 1, 40).alias("section_title"),
    )


def index(spark: SparkSession, sf_dir: str) -> Index:
    f = files(spark, sf_dir)
    chunks = f.select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("int").alias("page_number"), "section_title", "code_type", "symbol_name",
        F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"),
    )
    symbols = f.where("code_type is not null and symbol_name <> ''").select(F.col("doc_id").alias("symbol_id"), "doc_id", F.col("doc_id").alias("chunk_id"), F.col("symbol_name").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_number"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return Index(f.select("doc_id", "path", "filename", "extension", "size_bytes", "mtime"), lexical.token_counts(chunks), symbols, lexical.postings(chunks), vectors)


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the least id, which stands for a query's."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]]


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_U, _L = "A-ZĞÜŞİÖÇ", "a-zğüşıöç"
_GOOD = f"length(t) >= 2 AND regexp_matches(t, '[a-z0-9ğüşıöç]') AND t NOT IN ({_STOP})"
_FOLD = "lower(translate({0}, 'İI', 'iı'))"

#: The same in SQL, as common table expressions that may follow one another.
SQL = {
    "lib": f"""lib AS (SELECT doc_id, text, source, lang, e AS extension, 'doc_' || doc_id || e AS filename, '/lib/' || source || '/' || lang || '/doc_' || doc_id || e AS path,
 CAST({EPOCH} + doc_id * 3600.0 AS DOUBLE) AS mtime, CAST(strlen(text) AS BIGINT) AS size_bytes, CASE WHEN lang = 'fr' THEN 'python' END AS code_type,
 CASE WHEN lang = 'fr' THEN regexp_extract(text, '([A-Za-z]+)', 1) END AS symbol_name, substring(text, 1, 40) AS section_title, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line
 FROM (SELECT *, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIXES.items())} ELSE '.bin' END AS e FROM documents WHERE text IS NOT NULL))""",
    "tok": f"""raw0 AS (SELECT doc_id, trim(unnest(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9_ğüşıöç]+')), '_') AS t FROM lib),
raw AS (SELECT DISTINCT doc_id, t FROM raw0 WHERE t <> ''),
camel AS (SELECT doc_id, {_FOLD.format('w')} AS t FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '[{_U}]?[{_L}0-9]+'), regexp_extract_all(text, '([{_U}]+)[{_U}][{_L}]', 1), regexp_extract_all(text, '([{_U}]+)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1))) AS w FROM lib)),
good AS (SELECT doc_id, t FROM camel WHERE {_GOOD} UNION SELECT doc_id, t FROM raw WHERE contains(t, '_') OR ({_GOOD}) UNION SELECT doc_id, t FROM (SELECT doc_id, unnest(string_split(t, '_')) AS t FROM raw WHERE contains(t, '_')) WHERE {_GOOD}),
tok AS (SELECT doc_id, t AS term FROM good UNION SELECT doc_id, t FROM raw WHERE regexp_matches(t, '[a-z0-9ğüşıöç]') AND doc_id NOT IN (SELECT doc_id FROM good))""",
    "len": "len AS (SELECT l.doc_id AS chunk_id, greatest(1, count(k.term)) AS token_count FROM lib l LEFT JOIN tok k USING (doc_id) GROUP BY 1)",
    "stats": "stats AS (SELECT term, count(*) AS doc_freq FROM tok GROUP BY term)",
    "corpus": "corpus AS (SELECT count(*) AS n_chunks, coalesce(avg(token_count), 0.0) AS avg_tokens FROM len)",
}


def sql(body: str, *names: str, more: str = "") -> str:
    return "WITH " + ",\n".join([*(SQL[n] for n in names), *([more] if more else [])]) + "\n" + body


def bm25_sql(name: str, terms: list[str], top: int) -> str:
    """A table expression `name` (chunk_id, bm25)."""
    inside = ", ".join(f"'{t}'" for t in terms)
    idf = "greatest(0.0, ln((c.n_chunks - s.doc_freq + 0.5) / (s.doc_freq + 0.5) + 1.0))"
    return f"""{name} AS (SELECT k.doc_id AS chunk_id, sum({idf} * (1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * (len.token_count / c.avg_tokens))))) AS bm25
 FROM tok k JOIN stats s USING (term) JOIN len ON len.chunk_id = k.doc_id CROSS JOIN corpus c WHERE k.term IN ({inside}) AND {idf} > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {top})"""
