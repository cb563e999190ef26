"""Removal of lines that many sites share.

Each line's hash gathers a HyperLogLog sketch of the sites that hold it; the
sketches merge by aggregation. A line whose estimate lies near the threshold
gets an exact distinct count; one clearly above it is boilerplate. Such a line
is taken out of every document but the one with the least doc_id that holds
it, so that what was copied whole still exists once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Sites that make a line boilerplate.
MIN_SITES = 5
#: Sites that make a line boilerplate if it has fewer than MIN_WORDS words: prose shares such lines sooner.
SHORT_SITES = 50
MIN_WORDS = 3
#: log2 of a sketch's registers, and its standard error.
LOG_K = 10
ERROR = 1.04 / 2 ** (LOG_K / 2)
#: Standard errors round the threshold within which lines are counted exactly.
NEAR = 6

_SPACE = " \t\v\f\r"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text_key, pos, line_a, line_b (128 bits of hash) of lines that hold a word, whether they are short, and more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("text_key"), *more, F.posexplode(F.split(_text(), "\n")).alias("pos", "raw"))
    rows = rows.withColumn("line", F.btrim("raw", F.lit(_SPACE))).where("line <> ''")
    short = ~F.col("line").rlike(rf"^(?:[^{_SPACE}]+[{_SPACE}]+){{{MIN_WORDS - 1}}}[^{_SPACE}]")
    return rows.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("line_a"), F.xxhash64(F.lit(1), "line").alias("line_b"), short.alias("short"), *[c for c in rows.columns if c == "site"])


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES) -> DataFrame:
    """line_a, line_b, first_doc of the lines on at least that many sites (a null site counts as one site)."""
    lines = _lines(docs, F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"))
    spread = lines.groupBy("line_a", "line_b").agg(
        F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"),
        F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first_doc"),
        F.when(F.bool_or("short"), short_sites).otherwise(min_sites).alias("least"),
    )
    spread = materialize(spread.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("sites") >= F.floor(F.col("least") * (1 - NEAR * ERROR))), "lines")
    near = F.col("sites") <= F.ceil(F.col("least") * (1 + NEAR * ERROR))
    exact = lines.join(spread.where(near).select("line_a", "line_b"), ["line_a", "line_b"], "left_semi")
    exact = exact.select("line_a", "line_b", "site").distinct().groupBy("line_a", "line_b").agg(F.count("*").alias("n"))
    sure = spread.where(~near).select("line_a", "line_b", "first_doc")
    counted = spread.where(near).join(exact, ["line_a", "line_b"]).where(F.col("n") >= F.col("least")).select("line_a", "line_b", "first_doc")
    return materialize(sure.unionByName(counted), "boilerplate")


def remove(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns of docs, boilerplate lines taken out of text; and _lines, _removed.

    A null text stays null and has no lines; an empty one has one. Lines are
    compared without white space at their ends. Rows with one doc_id and
    text fare alike. n_chars, if docs has it, follows a changed text.
    """
    bad = boilerplate(docs, site, min_sites)
    hits = _lines(docs).join(bad, ["line_a", "line_b"]).where(F.coalesce("doc_id", F.lit(2**63 - 1)) != F.col("first_doc"))
    gone = hits.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("_gone")).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_gone")
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(_text()) == F.col("_key"))
    out = docs.join(gone.hint("shuffle_hash"), key, "left").drop("_doc", "_key")
    lines = F.split(_text(), "\n")
    text = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    changed = F.col("_gone").isNotNull()
    names = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        names["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    picked = [names[c].alias(c) if c in names else F.col(c) for c in docs.columns]
    return out.select(*picked, F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_removed"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and sha256 of the text that remains (null: empty)."""
    r = remove(docs.select("doc_id", "text", "source"))
    return r.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.length(_text()).cast("long").alias("n_chars"), F.sha2(_text(), 256).alias("text_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the columns of docs."""
    return remove(docs).select(*docs.columns)


_ORACLE_LINES = f"""
l AS (SELECT doc_id, coalesce(source, '') AS site, generate_subscripts(a, 1) AS pos, unnest(a) AS raw FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, site, pos, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
w AS (SELECT *, regexp_matches(line, '^(?:[^ \\t\\x0b\\x0c\\r]+[ \\t\\x0b\\x0c\\r]+){{{MIN_WORDS - 1}}}[^ \\t\\x0b\\x0c\\r]') AS long FROM t),
b AS (SELECT line, min(doc_id) AS first_doc FROM w WHERE long GROUP BY line HAVING line <> '' AND count(DISTINCT site) >= CASE WHEN bool_or(long) THEN {MIN_SITES} ELSE {SHORT_SITES} END),
f AS (SELECT w.*, (b.line IS NOT NULL AND w.doc_id <> b.first_doc) AS gone FROM w LEFT JOIN b USING (line))
"""

ORACLE = f"""WITH {_ORACLE_LINES}
SELECT d.doc_id, coalesce(s.n, 0) AS n_lines, coalesce(s.g, 0) AS n_removed, length(coalesce(s.x, '')) AS n_chars, sha256(coalesce(s.x, '')) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS x FROM f GROUP BY doc_id) s USING (doc_id)"""
