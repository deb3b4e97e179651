"""The registered queries, over the test tables, and their DuckDB statements.

Searches take every vector whose id is divisible by 20 as a query, against all vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.functions import text as tx
from shelfmatch.functions import vectors as vec
from shelfmatch.functions.codes import normalize_code
from shelfmatch.operators import classify, evaluate, lookup, products, report, search, textsearch
from shelfmatch.operators.runtime import cross_blocks
from shelfmatch.sources import xlsx
from shelfmatch.sources.store import absent_rows, metadata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- vectors ---------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_COS = "coalesce(list_cosine_similarity(a.v, b.v), 0)"
_P = f"{_E}, p AS (SELECT a.vec_id AS qid, b.vec_id AS vid, a.label AS ql, b.label AS vl, {_COS} AS sim FROM e a, e b WHERE a.vec_id % 20 = 0)"
_NEAR = f"{_P}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vid) AS rk FROM p QUALIFY rk <= 30)"
_BI = "sim AS forward_similarity, sim AS backward_similarity, (sim + sim) / 2 AS bi_directional_similarity"


def _vectors(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), "label", F.col("embedding").alias("vector"))


def _queries(spark, sf) -> DataFrame:
    return _vectors(spark, sf).filter("vid % 20 = 0").select(F.col("vid").alias("qid"), "vector")


def _near(spark, sf, k: int = search.INITIAL) -> DataFrame:
    return search.knn(_queries(spark, sf), _vectors(spark, sf), k)


def _six(c: str):
    return F.round(c, 6).alias(c)


@query(f"WITH {_E} SELECT a.vec_id AS qid, b.vec_id AS vid, round({_COS}, 6) AS sim FROM e a, e b WHERE a.vec_id % 20 = 0")
def cosine_pairs(spark, sf):
    """Queries, a checked twentieth of the ids, against all vectors; the query side is broadcast if Spark finds it small."""
    q = _queries(spark, sf).select("qid", F.col("vector").alias("qv"))
    return _vectors(spark, sf).crossJoin(q).select("qid", "vid", F.round(vec.cosine("qv", "vector"), 6).alias("sim"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", F.round(vec.norm("embedding"), 6).alias("norm"))


@query(f"WITH {_NEAR} SELECT qid, vid, rk, round(sim, 6) AS sim, round(1 - sim, 6) AS distance FROM near")
def knn_forward_topk(spark, sf):
    return _near(spark, sf).select("qid", "vid", "rk", _six("sim"), F.round(1 - F.col("sim"), 6).alias("distance"))


@query(SQL["knn_forward_topk"])
def knn_vectorized(spark, sf):
    """The search as expressions, without Python workers."""
    near = search.knn_columns(_queries(spark, sf), _vectors(spark, sf), search.INITIAL)
    return near.select("qid", "vid", "rk", _six("sim"), F.round(1 - F.col("sim"), 6).alias("distance"))


def _rounded(df):
    return df.select("qid", "vid", "rk", _six("forward_similarity"), _six("backward_similarity"), _six("bi_directional_similarity"))


_ROUNDED = "round(forward_similarity, 6) AS forward_similarity, round(backward_similarity, 6) AS backward_similarity, round(bi_directional_similarity, 6) AS bi_directional_similarity"


@query(f"WITH {_NEAR} SELECT qid, vid, rk, {_ROUNDED} FROM (SELECT qid, vid, rk, {_BI} FROM near) WHERE rk <= 5")
def bidirectional_topk(spark, sf):
    return _rounded(search.bidirectional(_near(spark, sf)))


@query(f"WITH {_NEAR} SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY round(bi_directional_similarity, 9) DESC, vid) AS rk, {_ROUNDED} FROM (SELECT qid, vid, {_BI} FROM near) WHERE bi_directional_similarity >= 0.25 QUALIFY rk <= 5")
def bidirectional_topk_threshold(spark, sf):
    return _rounded(search.bidirectional(_near(spark, sf), search.FORWARD))


@query(f"WITH {_P} SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vid) AS rk, round(sim, 6) AS sim FROM p WHERE vl IN (1, 3, 5) OR (vl >= 7 AND vid <> 0) QUALIFY rk <= 5")
def filtered_topk(spark, sf):
    rows = _vectors(spark, sf).filter(search.where({"$or": [{"label": {"$in": [1, 3, 5]}}, {"$and": [{"label": {"$gte": 7}}, {"vid": {"$ne": 0}}]}]}))
    return search.knn(_queries(spark, sf), rows, 5).select("qid", "vid", "rk", _six("sim"))


@query("SELECT vec_id, label, len(embedding)::INTEGER AS dimensions FROM embeddings")
def vector_scan(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("dimensions"))


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id IN (0, 7, 42, 100000000)")
def vector_get_by_id(spark, sf):
    return _t(spark, sf, "embeddings").filter(F.col("vec_id").isin(0, 7, 42, 100000000)).select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT count(*) AS n FROM embeddings")
def vector_count(spark, sf):
    return _t(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))


_MUTUAL = f"{_NEAR}, m AS (SELECT qid, vid, ql, vl, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vid) AS place FROM near WHERE qid <> vid AND sim >= 0.25 AND sim >= 0.2 QUALIFY place <= 5)"


def _mutual(spark, sf):
    return search.mutual_search(_near(spark, sf))


@query(f"WITH {_MUTUAL} SELECT qid, vid, place AS rk, {_ROUNDED} FROM (SELECT qid, vid, place, {_BI} FROM m)")
def mutual_search(spark, sf):
    return _rounded(_mutual(spark, sf))


_SCORES = "SELECT *, coalesce({tp} / nullif({p}, 0)::DOUBLE, 0) AS precision, coalesce({tp} / nullif({a}, 0)::DOUBLE, 0) AS recall FROM {t}"
_F1 = "SELECT *, coalesce(2.0::DOUBLE * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ({s})"


def _scored(t: str, tp: str, p: str, a: str) -> str:
    return _F1.format(s=_SCORES.format(t=t, tp=tp, p=p, a=a))


def _sixes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _sql_sixes(s: str) -> str:
    return f"SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1) FROM ({s})"


@query(f"WITH {_MUTUAL}, q AS (SELECT vec_id AS qid, label AS ql FROM embeddings WHERE vec_id % 20 = 0 AND label IS NOT NULL), one AS (SELECT count(DISTINCT q.qid) AS queries, count(m.vid) AS returned, count(*) FILTER (m.vl = q.ql) AS correct FROM q LEFT JOIN m ON q.qid = m.qid) " + _sql_sixes(_scored("one", "correct", "returned", "queries")))
def mutual_search_eval(spark, sf):
    return _sixes(evaluate.evaluate_mutual_search(_queries(spark, sf), _mutual(spark, sf), _vectors(spark, sf)))


@query(f"WITH {_E}, s AS (SELECT a.vec_id AS qid, b.vec_id AS vid, {_COS} AS sim FROM e a, e b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vid) AS rk FROM s QUALIFY rk <= 11) SELECT x.qid, x.vid, x.rk, round(x.sim, 6) AS sim, y.rk AS back_rk FROM r x LEFT JOIN r y ON x.qid = y.vid AND x.vid = y.qid WHERE x.qid % 20 = 0 AND x.qid <> x.vid")
def reciprocal_neighbors(spark, sf):
    return search.reciprocal(_queries(spark, sf), _vectors(spark, sf), 10).select("qid", "vid", "rk", _six("sim"), "back_rk")


# ---- text and products -----------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS cleaned FROM documents")
def clean_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.clean_text("text").alias("cleaned"))


def _short(spark, sf):
    keys = list(tx.ABBREVIATIONS)
    pick = lambda shift: F.get(F.lit(keys), ((F.col("p_partkey") + shift) % len(keys)).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", F.concat_ws(" ", pick(0), "p_name", pick(7), F.concat(pick(19), F.lit("x")), F.concat(pick(23), F.lit(","))).alias("description"))


_KEYS = "[" + ", ".join("'" + k + "'" for k in tx.ABBREVIATIONS) + "]"
_SHORT = "SELECT p_partkey, concat_ws(' ', k[(p_partkey % n + 1)::INT], p_name, k[((p_partkey + 7) % n + 1)::INT], k[((p_partkey + 19) % n + 1)::INT] || 'x', k[((p_partkey + 23) % n + 1)::INT] || ',') AS description FROM part, (SELECT " + f"{_KEYS} AS k, {len(tx.ABBREVIATIONS)} AS n)"


def _expanded(c: str, option: str) -> str:
    for k in sorted(tx.ABBREVIATIONS, key=len, reverse=True):
        c = f"regexp_replace({c}, '\\b{k}\\b', '{tx.ABBREVIATIONS[k]}', '{option}')"
    return c


@query(f"SELECT p_partkey, {_expanded('description', 'g')} AS expanded, {_expanded('lower(description)', 'g')} AS cleaned_first, {_expanded('lower(description)', 'gi')} AS any_case FROM ({_SHORT})")
def expand_abbreviations(spark, sf):
    return _short(spark, sf).select("p_partkey", tx.expand_abbreviations("description").alias("expanded"), tx.clean_and_expand("description").alias("cleaned_first"), tx.clean_and_expand("description", False).alias("any_case"))


def _sql_code(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({c}, '-\d+$', '')), '^\d(\d+)$', '\1')"


_MAPPING = """mapping AS (SELECT p_partkey AS ord, '5' || p_partkey || '-' || p_size AS "Fulton_code", p_partkey::VARCHAR AS "Pritzlaff_code", 'AB-' || p_size AS "Queen_code",
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey || '-1' END AS "Moesle_code", NULL::VARCHAR AS "Anmar_code", CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_type END AS "USDA_Code" FROM part)"""
_CELLS = 'cells AS (SELECT ord, "USDA_Code" AS target, unnest(["Fulton_code", "Pritzlaff_code", "Queen_code", "Moesle_code", "Anmar_code"]) AS code, unnest([0, 1, 2, 3, 4]) AS col FROM mapping WHERE "USDA_Code" IS NOT NULL)'


def _mapping(spark, sf) -> DataFrame:
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return _t(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("5"), k, F.lit("-"), size).alias("Fulton_code"),
        k.alias("Pritzlaff_code"),
        F.concat(F.lit("AB-"), size).alias("Queen_code"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(k, F.lit("-1"))).alias("Moesle_code"),
        F.lit(None).cast("string").alias("Anmar_code"),
        F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).alias("USDA_Code"),
    )


@query(f"WITH {_MAPPING} SELECT ord, {_sql_code(chr(34) + 'Fulton_code' + chr(34))} AS fulton, {_sql_code(chr(34) + 'Pritzlaff_code' + chr(34))} AS pritzlaff, {_sql_code(chr(34) + 'Queen_code' + chr(34))} AS queen, {_sql_code(chr(34) + 'Moesle_code' + chr(34))} AS moesle FROM mapping")
def normalize_code_columns(spark, sf):
    return _mapping(spark, sf).select("ord", *[normalize_code(f"{c.capitalize()}_code").alias(c) for c in ("fulton", "pritzlaff", "queen", "moesle")])


QUERIES["normalize_code"] = QUERIES.pop("normalize_code_columns")
SQL["normalize_code"] = SQL.pop("normalize_code_columns")


@query("SELECT p_brand, trim(unnest(string_split(string_agg(p_name, ' ; ' ORDER BY p_partkey), ';'))) AS variant FROM part GROUP BY p_brand")
def explode_variants(spark, sf):
    lists = _t(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ; ").alias("all"))
    return lists.select("p_brand", F.explode(tx.variants("all")).alias("variant"))


def _transactions(spark, sf) -> DataFrame:
    """Lines with their part's name, under headers as a spreadsheet has them."""
    p = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" ")).alias("Product Description"))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("string").alias("Price"), F.col("l_quantity").alias("Quantity"))
    return rows.join(p, F.col("l_partkey") == F.col("p_partkey"))


_TRANS = "t AS (SELECT l_orderkey, l_linenumber, lower(p_name) AS product_description, l_extendedprice AS price, l_quantity::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_TRANS} SELECT * FROM t")
def clean_transactions(spark, sf):
    return products.clean_transactions(_transactions(spark, sf)).select("l_orderkey", "l_linenumber", "product_description", "price", "quantity")


@query("SELECT l_orderkey, l_linenumber, chr(9) || ' ' || upper(p_name) || ' ' AS description, l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey")
def scan_transactions(spark, sf):
    return _transactions(spark, sf).select("l_orderkey", "l_linenumber", F.col("Product Description").alias("description"), F.col("Quantity").alias("quantity"))


@query("SELECT s_suppkey::VARCHAR AS code, s_name AS description, chr(9) || s_nationkey || ' <&> \"x\"' AS note FROM supplier")
def excel_scan(spark, sf):
    """The suppliers as workbooks of a hundred rows, read back; two columns by their headers, one with marks that XML escapes."""
    rows = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("ProductCode"), F.col("s_name").alias("ProductDescription"), F.concat(F.lit("\t"), F.col("s_nationkey").cast("string"), F.lit(' <&> "x"')).alias("Note"))
    books = xlsx.workbooks(rows, 100)
    return xlsx.parse(books, rows.columns, "Sheet1").select(F.col("ProductCode").alias("code"), F.col("ProductDescription").alias("description"), F.col("Note").alias("note"))


_METRICS = "m AS (SELECT product_description, count(*) AS transaction_count, sum(price::DECIMAL(18,2))::DOUBLE / count(price) AS avg_price, sum(quantity::DECIMAL(18,2))::DOUBLE / count(quantity) AS avg_quantity, min(price) AS min_price, max(price) AS max_price, sum(quantity::DECIMAL(18,2))::DOUBLE AS total_quantity FROM t GROUP BY 1)"


def _metrics(spark, sf):
    return products.build_product_metrics(_transactions(spark, sf))


@query(f"WITH {_TRANS}, {_METRICS} SELECT * FROM m")
def product_metrics(spark, sf):
    return _metrics(spark, sf)


_FIXED = "round({c}::DECIMAL(28,10), {n})::DECIMAL(28,{n})::VARCHAR"


@query(f"WITH {_TRANS}, {_METRICS} SELECT product_description, product_description || ', average price: $' || {_FIXED.format(c='avg_price', n=2)} || ', average quantity: ' || {_FIXED.format(c='avg_quantity', n=1)} AS enhanced FROM m")
def enhanced_description(spark, sf):
    return textsearch.described(_metrics(spark, sf)).select("product_description", "enhanced")


def _profile_sql() -> str:
    cols = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]}
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM {t}" for t, cs in cols.items() for c in cs)


@query(_profile_sql())
def null_profile(spark, sf):
    return products.null_profile(_t(spark, sf, "customer"))


_BUCKETS = "(SELECT p_name AS d, list_transform(list_filter(string_split(lower(p_name), ' '), lambda t: t <> ''), lambda t: (('0x' || substr(md5(t), 1, 8))::UBIGINT % 64)::INT) AS b FROM (SELECT DISTINCT p_name FROM part))"
_DENSE = f"dense AS (SELECT d, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM {_BUCKETS})"


@query(f"WITH {_DENSE}, u AS (SELECT d, unnest(range(64))::INT AS bucket, unnest(v) AS x, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM dense) SELECT d AS text, bucket, round(x / n, 6) AS weight FROM u WHERE x > 0")
def hash_embedding(spark, sf):
    v = _names(spark, sf).select(F.col("vid").alias("text"), F.posexplode("vector").alias("bucket", "weight"))
    return v.filter("weight > 0").select("text", "bucket", _six("weight"))


def _names(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_name").alias("vid")).distinct().withColumn("vector", vec.hash_embedding("vid"))


_RAW = "SELECT p_partkey::VARCHAR AS code, concat_ws(' ', p_name, p_brand, p_type) AS d, p_partkey AS o FROM part"
_UNIQUE = rf"u AS (SELECT product_description, arg_min(code, o) AS product_code FROM (SELECT *, regexp_replace(trim(lower(d)), '\s+', ' ', 'g') AS product_description FROM ({_RAW}) WHERE code IS NOT NULL AND d IS NOT NULL) WHERE product_description <> '' GROUP BY 1)"


def _raw_products(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("ProductCode"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("ProductDescription"), F.col("p_partkey").alias("ord"))


def _unique(spark, sf) -> DataFrame:
    return products.build_unique_products(_raw_products(spark, sf), "ProductCode", "ProductDescription", "ord")


@query(f"WITH {_UNIQUE} SELECT * FROM u")
def unique_products_first(spark, sf):
    return _unique(spark, sf)


@query(f"SELECT DISTINCT code AS \"ProductCode\", d AS \"ProductDescription\" FROM ({_RAW})")
def distinct_products(spark, sf):
    return products.distinct_products(_raw_products(spark, sf), "ProductCode", "ProductDescription")


@query(f'WITH {_MAPPING} SELECT "USDA_Code", min(ord) AS first_seen FROM mapping WHERE "USDA_Code" IS NOT NULL GROUP BY 1')
def distinct_categories(spark, sf):
    return lookup.distinct_categories(_mapping(spark, sf), "ord")


@query(f"WITH {_UNIQUE} SELECT product_description, product_code, 'item_' || (row_number() OVER (ORDER BY product_description) - 1) AS id FROM u")
def surrogate_ids(spark, sf):
    return products.surrogate_ids(_unique(spark, sf), "product_description")


@query(f"SELECT o AS ord, 'N/A' AS usda_code, code AS product_code, d AS product_description FROM ({_RAW})")
def vector_metadata(spark, sf):
    rows = _raw_products(spark, sf).select((F.col("ord") - F.lit(0)).alias("ord"), F.col("ProductCode").alias("product_code"), F.col("ProductDescription").alias("product_description"), F.lit(None).cast("string").alias("usda_code"))
    return rows.select("ord", metadata(rows).alias("m")).select("ord", "m.*")


@query("WITH old AS (SELECT vec_id FROM embeddings WHERE label < 5), new AS (SELECT vec_id, label FROM embeddings) SELECT vec_id, label FROM new WHERE vec_id NOT IN (SELECT vec_id FROM old)")
def vector_add_if_absent(spark, sf):
    e = _t(spark, sf, "embeddings")
    return absent_rows(e.filter("label < 5"), e.select("vec_id", "label"), "vec_id")


# ---- lookups ---------------------------------------------------------------------------------

_LOOKUP = f"{_MAPPING}, {_CELLS}, look AS (SELECT code, arg_max(target, ord * 5 + col) AS target FROM (SELECT {_sql_code('code')} AS code, target, ord, col FROM cells WHERE code IS NOT NULL) WHERE code <> '' GROUP BY 1)"


def _lookup(spark, sf):
    return lookup.build_code_lookup(_mapping(spark, sf), "ord")


@query(f"WITH {_LOOKUP} SELECT * FROM look")
def build_usda_lookup(spark, sf):
    return _lookup(spark, sf)


@query(f"WITH {_LOOKUP}, {_UNIQUE} SELECT product_code, product_description, coalesce(target, 'NOT_FOUND') AS usda_code FROM u LEFT JOIN look ON {_sql_code('product_code')} = look.code")
def usda_lookup_left_join(spark, sf):
    return lookup.attach_category(_unique(spark, sf), _lookup(spark, sf), "product_code")


_SEEN = 'seen AS (SELECT "USDA_Code" AS target, min(ord) AS first_seen FROM mapping WHERE "USDA_Code" IS NOT NULL GROUP BY 1)'


@query(f"WITH {_MAPPING}, {_CELLS}, {_SEEN} SELECT trim(code) AS code, arg_max(target, first_seen::HUGEINT * 1000000000000 + ord * 5 + col) AS target FROM cells JOIN seen USING (target) WHERE trim(code) IN (SELECT p_partkey::VARCHAR FROM part) GROUP BY 1")
def known_category(spark, sf):
    return lookup.known_categories(_mapping(spark, sf), _raw_products(spark, sf), "ProductCode", "ord")


@query(f"WITH {_MAPPING}, {_CELLS} SELECT DISTINCT target, trim(code) AS code FROM cells WHERE trim(code) IN (SELECT p_partkey::VARCHAR FROM part)")
def ground_truth_pairs(spark, sf):
    return lookup.ground_truth_pairs(_mapping(spark, sf), _raw_products(spark, sf), "ProductCode", "ord")


@query(f"WITH {_LOOKUP} SELECT * FROM look")
def excel_lookup(spark, sf):
    """The lookup from a mapping that went through workbooks, where every cell is a text or absent."""
    mapping = _mapping(spark, sf)
    read = xlsx.parse(xlsx.workbooks(mapping, 5000), mapping.columns)
    return lookup.build_code_lookup(read.withColumn("ord", F.col("ord").cast("long")), "ord")


# ---- best category and reports ----------------------------------------------------------------

_PROTO = f"{_E}, proto AS (SELECT label, arg_min(v, vec_id) AS v, min(vec_id) AS first_seen FROM e WHERE label IS NOT NULL GROUP BY label)"
_BEST = f"{_PROTO}, best AS (SELECT a.vec_id AS vid, b.label AS best, {_COS} AS similarity FROM e a, proto b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.first_seen) = 1)"
_JUDGED = f"{_BEST}, j AS (SELECT vid, best, similarity, known, best = known AS is_correct FROM best LEFT JOIN (SELECT vec_id AS vid, CASE WHEN vec_id % 7 <> 0 THEN label END AS known FROM embeddings) USING (vid))"


def _best(spark, sf):
    v = _vectors(spark, sf)
    return classify.classify_best(v, classify.prototypes(v))


def _judged(spark, sf):
    known = _vectors(spark, sf).select("vid", F.when(F.col("vid") % 7 != 0, F.col("label")).alias("known"))
    return report.judged(_best(spark, sf), known)


@query(f"WITH {_BEST} SELECT vid, best, round(similarity, 6) AS similarity FROM best")
def best_category_match(spark, sf):
    return _best(spark, sf).select("vid", "best", _six("similarity"))


@query(f"WITH {_JUDGED}, one AS (SELECT count(*) AS total, count(known) AS known, count(*) FILTER (known IS NULL) AS unknown, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS incorrect FROM j) SELECT *, coalesce(known / nullif(total, 0)::DOUBLE, 0) AS known_share, coalesce(correct / nullif(known, 0)::DOUBLE, 0) AS accuracy FROM one")
def match_accuracy(spark, sf):
    return report.match_accuracy(_judged(spark, sf))


_STATS = "round(avg(similarity), 6) AS mean, round(median(similarity), 6) AS median, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max, round(stddev_samp(similarity), 6) AS std"
_CONTRAST = "round(avg(similarity) FILTER (is_correct), 6) AS correct_avg, round(avg(similarity) FILTER (NOT is_correct), 6) AS incorrect_avg, round(avg(similarity) FILTER (is_correct) - avg(similarity) FILTER (NOT is_correct), 6) AS difference"


@query(f"WITH {_JUDGED} SELECT {_STATS} FROM j")
def similarity_stats(spark, sf):
    return report.similarity_stats(_judged(spark, sf))


@query(f"WITH {_JUDGED} SELECT {_CONTRAST} FROM j")
def correct_vs_incorrect(spark, sf):
    return report.correct_vs_incorrect(_judged(spark, sf))


@query(f"WITH {_JUDGED} SELECT known, count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_correct) / count(*)::DOUBLE AS accuracy FROM j WHERE known IS NOT NULL GROUP BY 1")
def category_performance(spark, sf):
    return report.category_performance(_judged(spark, sf))


@query(f"WITH {_JUDGED} SELECT known, best, count(*) AS n FROM j WHERE NOT is_correct GROUP BY ALL ORDER BY n DESC, known, best LIMIT 10")
def common_mismatches(spark, sf):
    return report.common_mismatches(_judged(spark, sf)).orderBy(F.desc("n"), "known", "best").limit(10)


@query(f"WITH {_JUDGED}, g AS (SELECT 0.1::DOUBLE + i * 0.05::DOUBLE AS threshold FROM range(18) t(i)) SELECT threshold, coalesce(count(*) FILTER (is_correct) / nullif(count(vid), 0)::DOUBLE, 0) AS accuracy, count(vid) AS remaining_samples FROM g LEFT JOIN (SELECT * FROM j WHERE known IS NOT NULL) ON similarity >= threshold GROUP BY 1")
def accuracy_by_threshold(spark, sf):
    return report.accuracy_by_threshold(_judged(spark, sf))


@query(f"WITH {_JUDGED}, r AS (SELECT vid, best, similarity, row_number() OVER (ORDER BY round(similarity, 9) DESC, vid) AS hi, row_number() OVER (ORDER BY round(similarity, 9), vid) AS lo FROM j) SELECT vid, best, round(similarity, 6) AS similarity, 'top' AS part FROM r WHERE hi <= 10 UNION ALL SELECT vid, best, round(similarity, 6), 'bottom' FROM r WHERE lo <= 10")
def top_bottom_matches(spark, sf):
    return report.top_bottom(_judged(spark, sf), "similarity", "vid", 10).select("vid", "best", _six("similarity"), "part")


@query(f"WITH {_JUDGED} SELECT count(*) AS total, count(known) AS known, count(*) FILTER (is_correct) AS correct, {_STATS}, {_CONTRAST} FROM j")
def report_summary(spark, sf):
    """One pass for the whole report."""
    j = _judged(spark, sf)
    s, ok = F.col("similarity"), F.col("is_correct")
    yes, no = F.avg(F.when(ok, s)), F.avg(F.when(~ok, s))
    six = lambda c, n: F.round(c, 6).alias(n)
    return j.agg(
        F.count(F.lit(1)).alias("total"), F.count("known").alias("known"), F.count_if(ok).alias("correct"),
        six(F.avg(s), "mean"), six(F.median(s), "median"), six(F.min(s), "min"), six(F.max(s), "max"), six(F.stddev_samp(s), "std"),
        six(yes, "correct_avg"), six(no, "incorrect_avg"), six(yes - no, "difference"),
    )


@query(f"WITH {_JUDGED} SELECT vid, best, round(similarity, 6) AS similarity, known, is_correct FROM j ORDER BY md5(vid || ':42'), vid LIMIT 10")
def sample_matches(spark, sf):
    return report.sample_rows(_judged(spark, sf), "vid", 10).select("vid", "best", _six("similarity"), "known", "is_correct")


# ---- threshold classification -----------------------------------------------------------------

_CLASSES = f"{_PROTO}, cl AS (SELECT label, vid, sim FROM (SELECT b.label, a.vec_id AS vid, {_COS} AS sim, row_number() OVER (PARTITION BY b.label ORDER BY round({_COS}, 9) DESC, a.vec_id) AS rk FROM e a, proto b QUALIFY rk <= 100) WHERE sim >= 0.2)"
_CM = f"{_CLASSES}, truth AS (SELECT label, vec_id AS vid FROM embeddings WHERE label IS NOT NULL), cm0 AS (SELECT label, count(t) AS n_true_products, count(p) AS n_predicted, count(*) FILTER (t = 1 AND p = 1) AS true_positives FROM (SELECT label, vid, 1 AS p FROM cl) FULL JOIN (SELECT label, vid, 1 AS t FROM truth) USING (label, vid) GROUP BY 1), cm AS (SELECT *, n_predicted - true_positives AS false_positives, n_true_products - true_positives AS false_negatives FROM cm0)"


def _classes(spark, sf):
    v = _vectors(spark, sf)
    return classify.classify_threshold(classify.prototypes(v), v, search.BACKWARD)


def _class_metrics(spark, sf):
    return evaluate.classification_metrics(_classes(spark, sf), _vectors(spark, sf).filter("label is not null"))


@query(f"WITH {_CLASSES} SELECT label, vid, round(sim, 6) AS sim FROM cl")
def classify_by_threshold(spark, sf):
    return _classes(spark, sf).select("label", "vid", _six("sim"))


_CMS = _sql_sixes(_scored("cm", "true_positives", "n_predicted", "n_true_products"))


@query(f"WITH {_CM} {_CMS}")
def classification_metrics(spark, sf):
    return _sixes(_class_metrics(spark, sf))


@query(f"WITH {_CM}, one AS (SELECT count(*) AS categories, sum(n_true_products)::BIGINT AS n_true_products, sum(n_predicted)::BIGINT AS n_predicted, sum(true_positives)::BIGINT AS true_positives, sum(n_true_products) / count(*)::DOUBLE AS avg_products FROM cm) " + _sql_sixes(_scored("one", "true_positives", "n_predicted", "n_true_products")))
def classification_overall(spark, sf):
    return _sixes(evaluate.classification_overall(_class_metrics(spark, sf)))


@query(f"WITH {_CM}, s AS ({_scored('cm', 'true_positives', 'n_predicted', 'n_true_products')}), r AS (SELECT label, f1, row_number() OVER (ORDER BY round(f1, 9) DESC, label) AS hi, row_number() OVER (ORDER BY round(f1, 9), label) AS lo FROM s) SELECT label, round(f1, 6) AS f1, 'top' AS part FROM r WHERE hi <= 5 UNION ALL SELECT label, round(f1, 6), 'bottom' FROM r WHERE lo <= 5")
def top_bottom_categories(spark, sf):
    return report.top_bottom(_class_metrics(spark, sf), "f1", "label", 5).select("label", _six("f1"), "part")


# ---- clusters by text --------------------------------------------------------------------------
# A cluster is the first word of a part's name; its variants are the names that begin with it.

_CLUSTER = f"{_DENSE}, name AS (SELECT d, v, split_part(d, ' ', 1) AS cluster FROM dense), cq AS (SELECT cluster, list_transform(range(64), lambda i: CASE WHEN (('0x' || substr(md5(lower(cluster)), 1, 8))::UBIGINT % 64) = i THEN 1.0::DOUBLE ELSE 0 END) AS v FROM (SELECT DISTINCT cluster FROM name))"
_CFOUND = f"{_CLUSTER}, cs AS (SELECT a.cluster, b.d, {_COS} AS sim, row_number() OVER (PARTITION BY a.cluster ORDER BY round({_COS}, 9) DESC, b.d) AS rk FROM cq a, name b QUALIFY rk <= 20)"


def _clusters(spark, sf) -> DataFrame:
    return _names(spark, sf).select(F.substring_index("vid", " ", 1).alias("cluster"), F.col("vid").alias("description"))


def _found(spark, sf) -> DataFrame:
    names = _names(spark, sf)
    q = _clusters(spark, sf).select(F.col("cluster").alias("qid")).distinct().withColumn("vector", vec.hash_embedding("qid"))
    return search.knn(q, names, 20).select(F.col("qid").alias("cluster"), F.col("vid").alias("description"), "sim")


@query(f"WITH {_CFOUND} SELECT name.cluster, count(*) AS variants, count(cs.d) AS found, count(cs.d) / count(*)::DOUBLE AS recall FROM name LEFT JOIN cs ON name.cluster = cs.cluster AND name.d = cs.d AND cs.sim >= 0.25 GROUP BY 1")
def cluster_recall(spark, sf):
    return evaluate.cluster_recall(_found(spark, sf).filter("sim >= 0.25"), _clusters(spark, sf))


_SWEEP = [0.2, 0.25, 0.3, 0.35, 0.4]


@query(f"WITH {_CFOUND}, g AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4])::DOUBLE AS threshold) SELECT threshold, name.cluster, count(*) AS variants, count(cs.d) AS found, count(cs.d) / count(*)::DOUBLE AS recall FROM g CROSS JOIN name LEFT JOIN cs ON name.cluster = cs.cluster AND name.d = cs.d AND cs.sim >= threshold GROUP BY ALL")
def recall_by_threshold(spark, sf):
    return evaluate.recall_sweep(_found(spark, sf), _clusters(spark, sf), _SWEEP)


@query(f"WITH {_CFOUND} SELECT name.cluster, name.d AS variant FROM name WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.cluster = name.cluster AND cs.d = name.d AND cs.sim >= 0.75)")
def missing_variants(spark, sf):
    found = _found(spark, sf).filter("sim >= 0.75").select("cluster", "description")
    return _clusters(spark, sf).join(found, ["cluster", "description"], "left_anti").select("cluster", F.col("description").alias("variant"))


_RX = r"'\b' || regexp_replace(lower({}), '([\\\[\](){{}}.*+?^$|#&~\-])', '\\\1', 'g') || '\b'"


@query(f"SELECT b.p_name AS description, a.term FROM (SELECT DISTINCT p_name FROM part) b, (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part UNION SELECT DISTINCT p_name || ' x' FROM part) a WHERE regexp_matches(lower(b.p_name), {_RX.format('a.term')}) OR regexp_matches(lower(a.term), {_RX.format('b.p_name')})")
def word_boundary_match(spark, sf):
    """Distinct names are few whatever the number of parts; a pair is tested by one pattern each way."""
    names = _t(spark, sf, "part").select("p_name").distinct()
    terms = names.select(F.substring_index("p_name", " ", 1).alias("term")).unionAll(names.select(F.concat("p_name", F.lit(" x")).alias("term"))).distinct()
    return cross_blocks(names, terms, "term", 10_000).filter(tx.word_boundary_match("term", "p_name")).select(F.col("p_name").alias("description"), "term")


_RETRIEVE = f"{_CLUSTER}, rq AS (SELECT a.d AS q, a.cluster, b.d AS hit, row_number() OVER (PARTITION BY a.d ORDER BY round({_COS}, 9) DESC, b.d) AS rk FROM name a, name b QUALIFY rk <= 10), ex AS (SELECT a.d AS q, count(*) AS expected FROM name a JOIN name b ON a.cluster = b.cluster AND a.d <> b.d GROUP BY 1), ok AS (SELECT rq.q, rq.hit, bool_or(coalesce(c.d IS NOT NULL, false)) AS good FROM rq JOIN ex USING (q) LEFT JOIN name c ON c.cluster = rq.cluster AND c.d <> rq.q AND (regexp_matches(rq.hit, {_RX.format('c.d')}) OR regexp_matches(c.d, {_RX.format('rq.hit')})) GROUP BY ALL), per AS (SELECT q, count(*) AS matched, count(*) FILTER (good) AS correct FROM ok GROUP BY 1), one AS (SELECT count(*) AS total_queries, sum(correct)::BIGINT AS correct_matches, sum(matched - correct)::BIGINT AS false_positives, sum(expected - correct)::BIGINT AS false_negatives, sum(matched)::BIGINT AS returned, sum(expected)::BIGINT AS expected FROM per JOIN ex USING (q))"


@query(f"WITH {_RETRIEVE}, s AS ({_sql_sixes(_scored('one', 'correct_matches', 'returned', 'expected'))}) SELECT *, CASE WHEN f1 >= 0.8 THEN 'excellent' WHEN f1 >= 0.6 THEN 'good' WHEN f1 >= 0.4 THEN 'moderate' ELSE 'poor' END AS rating FROM s")
def retrieval_eval(spark, sf):
    """Each name queries for the others of its cluster; a hit counts if it matches one of them at word boundaries."""
    return _sixes(evaluate.evaluate_retrieval(_names(spark, sf), _clusters(spark, sf))).withColumn("rating", evaluate.rating("f1"))


_RECALLS = f"{_CFOUND}, rec AS (SELECT name.cluster, count(*) AS variants, count(cs.d) AS found, count(cs.d) / count(*)::DOUBLE AS recall FROM name LEFT JOIN cs ON name.cluster = cs.cluster AND name.d = cs.d AND cs.sim >= 0.25 GROUP BY 1)"


@query(f"WITH {_RECALLS} SELECT count(*) AS clusters, round(coalesce(avg(recall), 0), 6) AS mean_recall, round(coalesce(sum(found) / nullif(sum(variants), 0)::DOUBLE, 0), 6) AS overall_recall, count(*) FILTER (found = variants) AS perfect, count(*) FILTER (found = 0) AS \"none\" FROM rec")
def cluster_recall_summary(spark, sf):
    return evaluate.cluster_summary(cluster_recall(spark, sf)).select("clusters", _six("mean_recall"), _six("overall_recall"), "perfect", "none")


@query(f"WITH {_RECALLS} SELECT * FROM rec ORDER BY recall, cluster LIMIT 3")
def worst_clusters(spark, sf):
    return evaluate.worst_clusters(cluster_recall(spark, sf))


# ---- counters of the lookup ---------------------------------------------------------------------


@query(f"WITH {_MAPPING}, {_CELLS}, c AS (SELECT code, {_sql_code('code')} AS norm FROM cells WHERE code IS NOT NULL) SELECT (SELECT count(*) FROM mapping) AS total_rows, (SELECT count(*) FROM mapping WHERE \"USDA_Code\" IS NULL) AS skipped_rows, (SELECT count(*) FROM mapping WHERE \"USDA_Code\" IS NOT NULL) AS processed_rows, (SELECT count(*) FROM c) AS codes, (SELECT count(*) FROM c WHERE norm = '') AS empty_codes")
def lookup_counters(spark, sf):
    return lookup.lookup_counters(_mapping(spark, sf))


@query(f"WITH {_LOOKUP}, {_UNIQUE} SELECT count(*) AS products, count(*) FILTER (target IS NULL) AS unmapped FROM u LEFT JOIN look ON {_sql_code('product_code')} = look.code")
def unmapped_count(spark, sf):
    return lookup.unmapped_count(usda_lookup_left_join(spark, sf))


@query(f"SELECT p_partkey, {_expanded('p_name', 'g')} AS p_name, {_expanded('p_type', 'g')} AS p_type FROM (SELECT p_partkey, 'Bnls ' || p_name AS p_name, p_type || ' Stk' AS p_type FROM part)")
def expand_columns(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("Bnls "), "p_name").alias("p_name"), F.concat("p_type", F.lit(" Stk")).alias("p_type"))
    return tx.expand_columns(rows, ["p_name", "p_type", "absent"])


# ---- search by text -----------------------------------------------------------------------------


def _hashed(name: str, source: str) -> str:
    """A common table ``name(d, v)`` of the texts ``d`` that ``source`` selects, with their lexical embeddings."""
    buckets = f"(SELECT d, list_transform(list_filter(string_split(lower(d), ' '), lambda t: t <> ''), lambda t: (('0x' || substr(md5(t), 1, 8))::UBIGINT % 64)::INT) AS b FROM ({source}))"
    return f"{name} AS (SELECT d, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM {buckets})"


_ASKED = "SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 1) AS d FROM part"
_TEXTS = f"{_hashed('asked', _ASKED)}, {_hashed('names', 'SELECT DISTINCT p_name AS d FROM part')}, hit AS (SELECT a.d AS query, b.d AS id, {_COS} AS sim, row_number() OVER (PARTITION BY a.d ORDER BY round({_COS}, 9) DESC, b.d) AS rk FROM asked a, names b QUALIFY rk <= 30)"


@query(f"WITH {_TEXTS} SELECT query, rk, id AS product_description, 'N/A' AS usda_code, round(sim, 6) AS similarity, contains(lower(id), lower(split_part(query, ' ', -1))) AS expected FROM hit WHERE rk <= 5 AND sim >= 0.25")
def search_text(spark, sf):
    """Texts of a part's type and a word against the names; a column that the table lacks is padded, a hit that holds the word is marked."""
    parts = _t(spark, sf, "part")
    asked = parts.select(F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1)).alias("query"))
    table = _names(spark, sf).select(F.col("vid").alias("id"), "vector", F.col("vid").alias("product_description"))
    found = textsearch.search_text(asked, table, textsearch.HashEmbedder(), 5, 0.25, expected=["product_description", "usda_code"])
    holds = F.contains(F.lower("product_description"), F.lower(F.substring_index("query", " ", -1)))
    return found.select("query", "rk", "product_description", "usda_code", F.round("bi_directional_similarity", 6).alias("similarity"), holds.alias("expected"))


_BRANDED = "SELECT p_partkey AS id, p_name || ' ' || p_brand AS text FROM part"
_OTHERS = f"{_hashed('branded', f'SELECT DISTINCT text AS d FROM ({_BRANDED})')}, e AS (SELECT id, text, v FROM ({_BRANDED}) x JOIN branded ON d = text), hit AS (SELECT a.id AS qid, b.id AS vid, a.text AS asked, b.text AS product_description, {_COS} AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS}, 9) DESC, b.id) AS place FROM e a, e b WHERE a.id % 20 = 0 QUALIFY place <= 30)"


@query(f"WITH {_OTHERS} SELECT qid, vid, product_description, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vid) AS rk, round(sim, 6) AS similarity FROM hit WHERE lower(trim(asked)) <> lower(trim(product_description)) AND sim >= 0.25 QUALIFY rk <= 5")
def mutual_search_text(spark, sf):
    """Rows that repeat the query's own text are no hits."""
    text = _t(spark, sf, "part").select(F.col("p_partkey").alias("vid"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    vectors = text.join(text.select("text").distinct().withColumn("vector", vec.hash_embedding("text")), "text")
    found = textsearch.mutual_search_text(vectors.filter("vid % 20 = 0").withColumnRenamed("vid", "qid"), vectors)
    return found.select("qid", "vid", "product_description", "rk", F.round("bi_directional_similarity", 6).alias("similarity"))
