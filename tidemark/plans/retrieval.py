"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import text_index as I
from .registry import frame, read

_TOKENS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _bm25_sql(terms: list[str], where: str = "TRUE", source: str = "documents", limit: str = "") -> str:
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (WHERE f{i} > 0) AS DOUBLE) AS d{i}" for i in range(len(terms)))
    parts = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""SELECT doc_id, round(score, 6) AS score FROM (
WITH w AS (SELECT doc_id, source, lang, {_TOKENS} AS t FROM {source}), c AS (SELECT doc_id, source, lang, CAST(len(t) AS DOUBLE) AS l, {tf} FROM w),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS a, {df} FROM c)
SELECT doc_id, {parts} AS score FROM c, s WHERE ({hit}) AND {where} ORDER BY score DESC, doc_id {limit})"""


def _query_vector(spark, d) -> list[float]:
    """A query's vector: that of row 0."""
    return [float(x) for x in read(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


_indexes: dict[tuple[str, ...], str] = {}


def text_index(spark, d, *columns: str) -> str:
    """The index of these columns of documents: built at the first query of a session, read by all that follow."""
    at = (spark.sparkContext.applicationId, d, *columns)
    if at not in _indexes or not I.exists(spark, _indexes[at]):
        _indexes[at] = _folder(spark, "text-index")
        I.build(read(spark, d, "documents"), columns, "doc_id", _indexes[at])
    return _indexes[at]


def _folder(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def words(spark, d, query: str, k: int | None = None, only=None, columns: tuple[str, ...] = ("text",)):
    return I.search(spark, text_index(spark, d, *columns), query, k, key="doc_id", only=only)


def _rounded(df, *keys):
    return df.select(*keys, F.round("score", 6).alias("score"))


@frame("r1_vector_score", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20")
def r1(spark, d):
    return _rounded(R.vector_top_k(read(spark, d, "embeddings"), "embedding", _query_vector(spark, d), "vec_id", 20), "vec_id")


@frame("r2_bm25_score", _bm25_sql(["the", "idiot", "que"]))
def r2(spark, d):
    return _rounded(words(spark, d, "The idiot que"), "doc_id")


@frame("r3_tokenizer", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS distinct_n FROM documents")
def r3(spark, d):
    t = R.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_n"))


@frame("r4_multi_column_bm25", _bm25_sql(["src3", "the"], source="(SELECT doc_id, source, lang, source || ' ' || text AS text FROM documents)"))
def r4(spark, d):
    return _rounded(words(spark, d, "src3 the", columns=("source", "text")), "doc_id")


_FUSE = f"""WITH b AS (SELECT doc_id AS k, score FROM ({_bm25_sql(["the", "of"]).replace("round(score, 6) AS score", "score")}) ORDER BY score DESC, k LIMIT 40),
v AS (SELECT vec_id AS k, {_COS} AS score FROM embeddings ORDER BY score DESC, k LIMIT 40),
r AS (SELECT k, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, k)) AS p FROM b UNION ALL SELECT k, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, k)) FROM v)
SELECT k AS doc_id, round(sum(p), 9) AS score FROM r GROUP BY k ORDER BY sum(p) DESC, k LIMIT 40"""


@frame("r5_hybrid_fusion", _FUSE)
def r5(spark, d):
    found = words(spark, d, "the of", 40)
    near = R.vector_top_k(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "embedding", _query_vector(spark, d), "doc_id", 40).select("doc_id", "score")
    return R.fuse("doc_id", 40, found, near).select("doc_id", F.round("score", 9).alias("score"))


@frame("r6_tie_break", "SELECT vec_id, 0.0 AS score FROM embeddings ORDER BY vec_id LIMIT 10")
def r6(spark, d):
    return R.vector_top_k(read(spark, d, "embeddings"), "embedding", [0.0] * 64, "vec_id", 10).select("vec_id", "score")


@frame("r7_filtered_vector", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def r7(spark, d):
    return _rounded(R.vector_top_k(read(spark, d, "embeddings"), "embedding", _query_vector(spark, d), "vec_id", 10, F.col("label") == 3), "vec_id")


@frame("r7_filtered_bm25", _bm25_sql(["the", "and"], "lang = 'en' AND source = 'src1'"))
def r7b(spark, d):
    only = read(spark, d, "documents").filter((F.col("lang") == "en") & (F.col("source") == "src1")).select("doc_id")
    return _rounded(words(spark, d, "the and", only=only), "doc_id")


@frame("r2_unindexed", _bm25_sql(["idiot", "moron"]))
def r2_unindexed(spark, d):
    """The same ranking of any DataFrame, without an index."""
    return _rounded(R.bm25(read(spark, d, "documents"), "text", "idiot Moron", "doc_id"), "doc_id")


@frame("r8_retrieval_join", f"SELECT t.doc_id, t.score, l.toxic FROM ({_bm25_sql(['the', 'idiot'], limit='LIMIT 40')}) t JOIN labels l ON l.doc_id = t.doc_id")
def r8(spark, d):
    top = _rounded(words(spark, d, "the idiot", 40), "doc_id")
    return top.join(read(spark, d, "labels").select(F.col("doc_id").alias("l"), "toxic"), F.col("doc_id") == F.col("l")).select("doc_id", "score", "toxic")


_Q8 = "WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127 AS s FROM embeddings)"


@frame("r9_int8_quantised", f"{_Q8} SELECT vec_id, round(s, 9) AS scale, CAST(list_sum(list_transform(e, lambda x: CAST(round(x / s) AS BIGINT))) AS BIGINT) AS code_sum, round(list_dot_product(list_transform(e, lambda x: CAST(round(x / s) AS DOUBLE)), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) * s, 6) AS score FROM q")
def r9(spark, d):
    q = read(spark, d, "embeddings").select("vec_id", R.quantised("embedding").alias("q"))
    total = F.aggregate("q.codes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), total.alias("code_sum"), F.round(R.quantised_score(F.col("q"), _query_vector(spark, d)), 6).alias("score"))


@frame("r10_paged_index", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def r10(spark, d):
    """The pages that can hold a neighbour of the query, ranked as R1 ranks all rows."""
    at = (spark.sparkContext.applicationId, d, "pages of embeddings")
    if at not in _pages:
        e = read(spark, d, "embeddings")
        centres = R.trained_centres(e, "embedding", "vec_id", 8)
        to = _folder(spark, "vector-pages")
        R.paged(e, "embedding", centres, to)
        _pages[at] = (to, centres)
    to, centres = _pages[at]
    return _rounded(R.probed(spark.read.parquet(to), "embedding", _query_vector(spark, d), centres, "vec_id", 10, 4), "vec_id")


_pages: dict[tuple[str, ...], tuple[str, list]] = {}


@frame("r11_hashed_embedding", None)
def r11(spark, d):
    return read(spark, d, "nation").select("n_nationkey", R.hashed_embedding("n_name", 32).alias("embedding"))


_BOTH = "(SELECT d.* FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"


@frame(
    "r12_hybrid_search",
    _FUSE.replace("FROM documents)", f"FROM {_BOTH})").replace("FROM embeddings ORDER BY", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY").removesuffix("LIMIT 40") + "LIMIT 10",
)
def r12(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return R.hybrid(both, "doc_id", "text", "the of", "embedding", _query_vector(spark, d), 10).select("doc_id", F.round("score", 9).alias("score"))


_ASKED = (11, 23, 37, 53, 71)


@frame(
    "r13_recall",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS q, e AS qe FROM e WHERE vec_id IN {_ASKED}),
c AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS s FROM e),
p AS (SELECT q, vec_id, list_cosine_similarity(e, qe) AS exact, list_dot_product(list_transform(e, lambda x: CAST(round(x / s) AS DOUBLE)), qe) * s AS coded FROM c, q),
r AS (SELECT row_number() OVER (PARTITION BY q ORDER BY exact DESC, vec_id) AS a, row_number() OVER (PARTITION BY q ORDER BY coded DESC, vec_id) AS b FROM p)
SELECT count(*) FILTER (WHERE a <= 10 AND b <= 10) / count(*) FILTER (WHERE a <= 10) AS recall FROM r""",
)
def r13(spark, d):
    """Eight-bit codes against the exact lists, over five queries."""
    e = read(spark, d, "embeddings")
    asked = {r["vec_id"]: list(map(float, r["embedding"])) for r in e.filter(F.col("vec_id").isin(*_ASKED)).collect()}
    coded = e.select("vec_id", R.quantised("embedding").alias("q"))
    best = lambda df: df.orderBy(F.desc("score"), "vec_id").limit(10)
    found = {i: best(coded.select("vec_id", R.quantised_score(F.col("q"), v).alias("score"))) for i, v in asked.items()}
    exact = {i: R.vector_top_k(e, "embedding", v, "vec_id", 10) for i, v in asked.items()}
    return R.recall(R.listed(found, "vec_id"), R.listed(exact, "vec_id"), "pair")


@frame("r14_normalised", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x / list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS one FROM embeddings")
def r14(spark, d):
    n = read(spark, d, "embeddings").select("vec_id", R.normalised("embedding").alias("e"))
    return n.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x), 6).alias("one"))
