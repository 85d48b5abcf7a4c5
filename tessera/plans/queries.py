"""The engine's operators on the test tables. Arrays are joined to strings and scores rounded for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunks, graph, search, sync
from ..sources.tables import table
from .catalogue import register


def _query_vector(points: DataFrame) -> list[float]:
    return list(points.where("vec_id = 0").select("embedding").first()[0])


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    points = table(spark, d, "embeddings")
    return points.where("vec_id != 0"), _query_vector(points)


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORED = f"SELECT e.vec_id, e.label, q.label AS q_label, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0"


@register(f"SELECT vec_id, round(score, 6) AS score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    return search.top_k(points, q, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@register(f"SELECT vec_id, label, round(score, 6) AS score FROM ({_SCORED}) WHERE label = 5 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    return search.top_k(points, q, 10, "vec_id", where=F.col("label") == 5).select("vec_id", "label", F.round("score", 6).alias("score"))


@register(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 50) WHERE score >= 0.1")
def vector_postfilter(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    return search.valid(search.top_k(points, q, 50, "vec_id"), 0.1).select("vec_id", F.round("score", 6).alias("score"))


@register(
    f"""WITH hits AS (SELECT * FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 20),
     adj AS (SELECT vec_id, score, least(1.0, score + CASE WHEN vec_id % 2 = 0 THEN 0.05 ELSE 0 END + CASE WHEN label = q_label THEN 0.04 ELSE 0 END) AS a FROM hits WHERE score BETWEEN 0 AND 1)
SELECT row_number() OVER (ORDER BY a DESC, score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score, round(a, 6) AS adjusted_score FROM adj"""
)
def search_rerank(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    label = table(spark, d, "embeddings").where("vec_id = 0").first()["label"]
    hits = search.rerank(search.valid(search.top_k(points, q, 20, "vec_id")), "vec_id", F.col("vec_id") % 2 == 0, F.lit(False), F.col("label") == label)
    rank = F.row_number().over(Window.orderBy(F.desc("adjusted_score"), F.desc("score"), "vec_id"))  # of the 20 hits
    return hits.select(rank.cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"), F.round("adjusted_score", 6).alias("adjusted_score"))


@register("SELECT count(*) AS points, min(len(embedding)) AS dimension, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS min_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS max_norm FROM embeddings")
def vector_info(spark: SparkSession, d: str) -> DataFrame:
    norm = F.sqrt(S.dot("embedding", "embedding"))
    return table(spark, d, "embeddings").agg(F.count("*").alias("points"), F.min(F.size("embedding")).cast("long").alias("dimension"), F.round(F.min(norm), 5).alias("min_norm"), F.round(F.max(norm), 5).alias("max_norm"))


_LINES = "CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"


@register(
    f"""WITH c AS (SELECT doc_id, array_to_string(({_LINES})[1:50], chr(10)) AS body FROM documents), t AS (SELECT doc_id, CASE WHEN length(body) > 2000 THEN left(body, 2000) || '...' ELSE body END AS text, length(body) > 2000 AS truncated FROM c WHERE body <> '')
SELECT doc_id, text, truncated, CAST(length(text) AS INT) AS text_length, contains(text, '/**') OR contains(text, '\"\"\"') AS has_docstring, CAST(len(string_split(text, chr(10))) AS INT) AS line_count FROM t"""
)
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    rows = docs.select(F.col("path").alias("file"), F.lit("d").alias("name"), F.lit(1).alias("line"), F.lit(True).alias("exported"))
    found = chunks.payload(chunks.of_relation(rows, docs, "function"))
    return found.select(F.col("file").cast("long").alias("doc_id"), "text", "truncated", "text_length", "has_docstring", "line_count")


@register(
    """SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3], lambda x: CASE WHEN length(x) > 120 THEN left(x, 120) || '...' ELSE x END), chr(10)) AS preview FROM documents"""
)
def preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.preview("text").alias("preview"))


@register(
    """SELECT id, doc_id, good FROM (SELECT sha256(text) AS id, d.doc_id, coalesce(l.quality, 0) = 1 AS good,
 row_number() OVER (PARTITION BY sha256(text) ORDER BY coalesce(l.quality, 0) = 1 DESC, d.doc_id) AS r FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE r = 1"""
)
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("id"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("exported", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return chunks.dedup(rows, ("doc_id",)).select("id", "doc_id", F.col("exported").alias("good"))


@register("SELECT min(event_id) AS event_id, ts, user_id, event_type, value, props FROM events GROUP BY ALL")
def entry_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sync.distinct_entries(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"), "event_id")


@register("WITH s AS (SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS dependencies FROM documents GROUP BY lang) SELECT doc_id, coalesce(dependencies, '') AS dependencies FROM documents LEFT JOIN s USING (lang)")
def enrich_dependencies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return chunks.with_dependencies(docs.select("doc_id", "lang"), docs, "lang").select("doc_id", F.array_join("dependencies", ",").alias("dependencies"))


@register(
    f"""WITH hits AS (SELECT s.vec_id, s.score, d.text FROM ({_SCORED}) s JOIN documents d ON d.doc_id = s.vec_id ORDER BY s.score DESC, s.vec_id LIMIT 20),
 run AS (SELECT vec_id, length(text) AS size, sum(length(text)) OVER (ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING) AS running FROM hits)
SELECT vec_id, CAST(size AS BIGINT) AS size, CAST(running AS BIGINT) AS running FROM run WHERE running <= 8000"""
)
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    hits = search.top_k(points.join(docs, "vec_id"), q, 20, "vec_id").withColumn("size", F.length("text").cast("long"))
    return search.context(hits, [F.desc("score"), F.col("vec_id")], F.col("size")).select("vec_id", "size", "running")


@register("SELECT (r - 1) // 32 AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) GROUP BY 1")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return graph.numbered(table(spark, d, "documents").select("doc_id"), 32, "doc_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@register("SELECT page_id, url FROM pages WHERE url GLOB 'https://*/en/*'")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(S.glob_match("url", "https://*/en/*")).select("page_id", "url")


@register(
    r"""SELECT page_id, coalesce(nullif(regexp_extract(p, '(?:^|/)features/([^/]+)/', 1), ''), nullif(regexp_extract(p, '(?:^|/)routes/([^/]+)/', 1), ''), nullif(regexp_extract(p, '(?:^|/)components/([^/]+)/', 1), ''),
 nullif(regexp_extract(p, '(?:^|/)app/([^/]+)/', 1), ''), nullif(regexp_extract(p, '(?:^|/)pages/([^/]+)/', 1), '')) AS feature
 FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'src/app/' WHEN 1 THEN 'src/routes/' ELSE 'lib/' END || regexp_extract(url, '://(.*)', 1) || '/x.ts' AS p FROM pages)"""
)
def feature_infer(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("page_id") % 3 == 0, "src/app/").when(F.col("page_id") % 3 == 1, "src/routes/").otherwise("lib/")
    path = F.concat(lead, F.regexp_extract("url", "://(.*)", 1), F.lit("/x.ts"))
    return table(spark, d, "pages").select("page_id", S.infer_feature(path).alias("feature"))


_HREFS = """SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


_SOURCES = "SELECT [\'./\', \'../\', \'@\', \'~/\', \'\', \'.\'][CAST(c_custkey % 6 AS INT) + 1] || c_mktsegment AS source FROM customer"


@register(f"SELECT CASE WHEN source LIKE './%' OR source LIKE '../%' THEN 'relative' WHEN source LIKE '@%' OR source LIKE '~%' THEN 'alias' ELSE 'external' END AS kind, count(*) AS n FROM ({_SOURCES}) GROUP BY 1")
def classify_links(spark: SparkSession, d: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("./", "../", "@", "~/", "", "."))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").groupBy(S.import_kind(F.concat(lead, "c_mktsegment")).alias("kind")).agg(F.count("*").alias("n"))


@register(
    """SELECT category, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names, count(*) AS n FROM
 (SELECT p_type, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'A' WHEN p_type LIKE 'PROMO%' THEN 'B' WHEN p_type LIKE 'S%' THEN 'C' ELSE 'OTHER' END AS category FROM part) GROUP BY category"""
)
def category_case(spark: SparkSession, d: str) -> DataFrame:
    out = F.when(F.col("p_type").startswith("ECONOMY"), "A").when(F.col("p_type").startswith("PROMO"), "B").when(F.col("p_type").startswith("S"), "C").otherwise("OTHER")
    return table(spark, d, "part").groupBy(out.alias("category")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("names"), F.count("*").alias("n"))


@register("SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1")
def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.substring_index("p_name", " ", 1).alias("prefix")).agg(F.count("*").alias("n"))


@register(
    """WITH cat(category, entry) AS (VALUES ('ui', 'Brand#1/'), ('db', 'Brand#21'), ('db', 'Brand#22'), ('auth', 'Brand#3/'))
SELECT category, string_agg(DISTINCT rtrim(entry, '/'), ',' ORDER BY rtrim(entry, '/')) AS labels, count(DISTINCT p_brand) AS brands FROM part JOIN cat ON p_brand = entry OR (entry LIKE '%/' AND starts_with(p_brand, rtrim(entry, '/'))) GROUP BY category"""
)
def catalog_match(spark: SparkSession, d: str) -> DataFrame:
    entries = spark.createDataFrame([("ui", "Brand#1/"), ("db", "Brand#21"), ("db", "Brand#22"), ("auth", "Brand#3/")], "category string, entry string")
    label = F.rtrim("entry", F.lit("/"))
    brands = table(spark, d, "part").select("p_brand").distinct()  # the theta join meets each brand once
    hit = brands.join(F.broadcast(entries), (F.col("p_brand") == F.col("entry")) | (F.col("entry").endswith("/") & F.col("p_brand").startswith(label)))
    return hit.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.count_distinct("p_brand").alias("brands"))


@register("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END, CASE WHEN c_nationkey < 5 THEN 'near' END, 'none') AS pick FROM customer")
def priority_pick(spark: SparkSession, d: str) -> DataFrame:
    pick = F.coalesce(F.when(F.col("c_acctbal") > 5000, "rich"), F.when(F.col("c_mktsegment") == "BUILDING", "builder"), F.when(F.col("c_nationkey") < 5, "near"), F.lit("none"))
    return table(spark, d, "customer").select("c_custkey", pick.alias("pick"))


_FLAGS = (("licence", "[Ll]icen[sc]e"), ("mail", "[a-z]+@[a-z]+"), ("number", "[0-9]{3}"), ("table", " [|] "))


@register("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _FLAGS) + ") AS flags FROM documents")
def capability_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", *[F.when(F.col("text").rlike(p), n) for n, p in _FLAGS]).alias("flags"))


@register("""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages), u AS (SELECT page_id, unnest(a) AS href, generate_subscripts(a, 1) AS i FROM h), f AS (SELECT page_id, href, min(i) AS i FROM u GROUP BY 1, 2)
SELECT h.page_id, coalesce(string_agg(href, '|' ORDER BY i), '') AS links FROM h LEFT JOIN f USING (page_id) GROUP BY h.page_id""")
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.coalesce(F.array_join(found, "|"), F.lit("")).alias("links"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@register(r"""SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/'), lambda x: x NOT IN ('', 'en', 'de', 'fr', 'es')), '/') AS route FROM pages""")
def route_fold(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/")
    fold = F.aggregate(parts, F.lit(""), lambda s, x: F.when(x.isin("", "en", "de", "fr", "es"), s).otherwise(F.concat(s, F.lit("/"), x)), lambda s: F.when(s == "", "/").otherwise(s))
    return table(spark, d, "pages").select("page_id", fold.alias("route"))


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("caller"), F.col("turn").alias("line"), F.col("text").alias("callee"), F.lit("call").alias("kind"))


@register("SELECT conv_id AS file, role AS caller, turn AS line, text AS callee FROM conversations")
def call_graph_nested(spark: SparkSession, d: str) -> DataFrame:
    return graph.flat_calls(graph.nested_calls(_talk(spark, d))).select("file", "caller", "line", "callee")


@register("SELECT count_if(event_type = 'signup')::BIGINT AS signups, count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'click')::BIGINT AS clicks, count(*) AS events FROM events")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda x: F.count_if(F.col("event_type") == x)
    return table(spark, d, "events").agg(n("signup").alias("signups"), n("error").alias("errors"), n("click").alias("clicks"), F.count("*").alias("events"))


_COUNTED = ("customer", "supplier", "part", "orders", "lineitem", "documents", "pages")


@register("SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in _COUNTED) + ", (SELECT sum(len(regexp_extract_all(html, 'href=\"'))) FROM pages)::BIGINT AS links")
def repo_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = None
    for t in _COUNTED:
        one = table(spark, d, t).select(F.lit(t).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.union(one)
    links = table(spark, d, "pages").select(F.lit("links").alias("t"), F.regexp_count("html", F.lit('href="')).cast("long").alias("n")).groupBy("t").agg(F.sum("n").alias("n"))
    return counts.union(links).groupBy().agg(*[F.coalesce(F.max(F.when(F.col("t") == t, F.col("n"))), F.lit(0)).alias(t) for t in (*_COUNTED, "links")])


@register("SELECT e.event_id, s.event_id AS signup_id FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts WHERE e.event_type = 'error' QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY s.ts DESC, s.event_id DESC) = 1")
def asof_caller(spark: SparkSession, d: str) -> DataFrame:
    # a place is time and number in one; an error comes after all signups of its time
    place = lambda last: (F.unix_micros("ts").cast("decimal(38,0)") * 1_000_000_000 + last).cast("decimal(38,0)")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_timestamp("ts").alias("ts"))
    functions = rows.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("file"), F.lit("f").alias("name"), place(F.col("event_id")).alias("line"))
    calls = rows.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("file"), F.lit("f").alias("caller"), place(F.lit(999_999_999)).alias("line"), "event_id")
    found = graph.resolve_caller(calls, functions)
    return found.select("event_id", (F.substring_index("caller_id", "::", -1).cast("decimal(38,0)") % 1_000_000_000).cast("long").alias("signup_id"))


@register(
    """WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), own AS (SELECT s_nationkey, min(s_suppkey) AS id FROM s GROUP BY 1)
SELECT c_custkey, coalesce(own.id, (SELECT min(s_suppkey) FROM s)) AS supplier FROM customer LEFT JOIN own ON own.s_nationkey = c_nationkey AND c_custkey % 2 = 0"""
)
def callee_priority(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("line"), F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0")).alias("file"), F.lit("g").alias("name"))
    any_file = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))).otherwise("none")
    c = table(spark, d, "customer").select("c_custkey", any_file.alias("file"), F.lit("g").alias("callee"))
    lowest = s.agg(F.min("line").alias("least"))
    first = s.join(F.broadcast(lowest), F.col("line") == F.col("least")).select(F.lit("").alias("file"), "name", "line")
    out = graph.resolve_callee(c, s.unionByName(first))
    return out.select("c_custkey", F.element_at(F.split("callee_id", "::"), -1).cast("long").alias("supplier"))


@register(
    """SELECT o_orderkey, coalesce('c' || c.c_custkey, 's' || s.s_suppkey) AS owner, CASE WHEN c.c_custkey IS NOT NULL THEN 'Function' ELSE 'Component' END AS side
FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal > 0 LEFT JOIN supplier s ON s.s_suppkey = o_custkey WHERE coalesce(c.c_custkey, s.s_suppkey) IS NOT NULL"""
)
def coalesce_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    s = table(spark, d, "supplier").select("s_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(s, F.col("o_custkey") == F.col("s_suppkey"), "left")
    own = F.coalesce(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return o.where("coalesce(c_custkey, s_suppkey) is not null").select("o_orderkey", own.alias("owner"), F.when(F.col("c_custkey").isNotNull(), "Function").otherwise("Component").alias("side"))


def _page_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_hrefs(spark, d), "IMPORTS", "File", F.col("url"), "Module", F.col("href"))


@register(f"SELECT DISTINCT 'IMPORTS' AS rel, url AS src, href AS dst FROM ({_HREFS})")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _page_edges(spark, d).select("rel", "src", "dst")


@register(f"SELECT href AS module, count(DISTINCT url) AS n FROM ({_HREFS}) GROUP BY 1 ORDER BY n DESC, module LIMIT 10")
def module_usage(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(_page_edges(spark, d), "dst").select(F.col("node").alias("module"), "n").orderBy(F.desc("n"), "module").limit(10)


@register(f"SELECT 'File' AS label, count(DISTINCT url) AS n FROM pages UNION ALL SELECT 'Module', count(DISTINCT href) FROM ({_HREFS}) UNION ALL SELECT 'Function', count(*) FROM customer")
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "pages").select(F.lit("File").alias("label"), F.col("url").alias("key")).union(_hrefs(spark, d).select(F.lit("Module"), "href")).union(table(spark, d, "customer").select(F.lit("Function"), F.col("c_custkey").cast("string")))
    return nodes.distinct().groupBy("label").agg(F.count("*").alias("n"))


@register("SELECT l_partkey AS node, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, node LIMIT 10")
def high_degree(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst")).distinct()
    return graph.degree(pairs, "dst", 5).orderBy(F.desc("n"), "node").limit(10)


@register("SELECT event_type AS hook, count(DISTINCT user_id) AS users, CAST(sum(user_id) AS BIGINT) AS user_sum FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def hook_usage(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "events").select("event_type", "user_id").distinct()
    return used.groupBy(F.col("event_type").alias("hook")).agg(F.count("*").alias("users"), F.sum("user_id").alias("user_sum"))


@register("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS hooks FROM events GROUP BY 1")
def hooks_per_component(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("hooks"))


_ERRORS = "SELECT DISTINCT user_id AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS dst FROM events WHERE event_type = 'error'"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst")).distinct()


@register(
    f"""WITH e AS ({_ERRORS}), p1 AS (SELECT src AS a, dst AS b FROM e WHERE src = 7), p2 AS (SELECT a, b, dst AS c FROM p1 JOIN e ON src = b WHERE NOT (src = a AND dst = b)),
 p3 AS (SELECT a, b, c, dst AS x FROM p2 JOIN e ON src = c WHERE NOT (src = a AND dst = b) AND NOT (src = b AND dst = c))
SELECT a || '>' || b AS path, 1 AS length FROM p1 UNION ALL SELECT a || '>' || b || '>' || c, 2 FROM p2 UNION ALL SELECT a || '>' || b || '>' || c || '>' || x, 3 FROM p3"""
)
def khop(spark: SparkSession, d: str) -> DataFrame:
    found = graph.paths(_errors(spark, d), F.col("src") == 7, 3)
    return found.select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"), "length")


# edges by number; in a path no number comes twice
_STEP = "SELECT p.*, e.dst AS n{0}, e.i AS i{0} FROM p{1} p JOIN e ON e.src = p.n{1} WHERE e.i NOT IN ({2})"
_CYCLES = "".join(f", p{k} AS ({_STEP.format(k, k - 1, ', '.join(f'p.i{j}' for j in range(1, k)))})" for k in range(2, 6))


@register(
    f"""WITH d AS ({_ERRORS}), e AS (SELECT src, dst, row_number() OVER () AS i FROM d WHERE dst IN (SELECT src FROM d) AND src IN (SELECT dst FROM d)), p1 AS (SELECT src AS n0, dst AS n1, i AS i1 FROM e){_CYCLES}
"""
    + " UNION ALL ".join("SELECT " + " || '>' || ".join(f"n{j}" for j in range(k + 1)) + f" AS cycle, {k} AS length FROM p{k} WHERE n{k} = n0" for k in range(2, 6))
)
def cycles(spark: SparkSession, d: str) -> DataFrame:
    found = graph.cycles(_errors(spark, d), 2, 5)
    return found.select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("cycle"), "length")


@register("SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.orphans(table(spark, d, "part").select(F.col("p_partkey").alias("key")), links)


@register("SELECT s_suppkey, count(DISTINCT o_custkey) AS customers FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) > 10")
def handlers_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    pairs = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s_suppkey"), "o_custkey").distinct()
    return pairs.groupBy("s_suppkey").agg(F.count("*").alias("customers")).where("customers > 10")


@register(
    """WITH changed AS (SELECT 'c' || c_custkey AS path FROM customer WHERE c_acctbal < -900), imp AS (SELECT DISTINCT 'o' || o_orderkey AS path FROM orders WHERE 'c' || o_custkey IN (SELECT path FROM changed)),
 calls AS (SELECT DISTINCT 's' || s_suppkey AS path FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal < -900)
SELECT path FROM changed UNION SELECT path FROM imp UNION SELECT path FROM calls"""
)
def affected_files(spark: SparkSession, d: str) -> DataFrame:
    at = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c = table(spark, d, "customer")
    changed = c.where("c_acctbal < -900").select(at("c", "c_custkey").alias("path"))
    imports = table(spark, d, "orders").select(at("o", "o_orderkey").alias("file"), at("c", "o_custkey").alias("target"))
    functions = c.select(at("c", "c_custkey").alias("file"), F.col("c_nationkey").alias("name"))
    calls = table(spark, d, "supplier").select(at("s", "s_suppkey").alias("file"), F.col("s_nationkey").alias("callee"))
    return sync.affected(changed, imports, calls, functions)


@register(
    """WITH now AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), was AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(now.path, was.path) AS path, CASE WHEN now.h IS NULL THEN 'deleted' ELSE 'changed' END AS op FROM now FULL JOIN was USING (path) WHERE now.h IS DISTINCT FROM was.h"""
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    # the earlier state is made up from the table: some files absent, some new, some of other content
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.col("doc_id") % 10 == 1, F.col("doc_id") % 10 == 2, F.col("doc_id") % 7 == 0).toDF("path", "content", "gone", "new", "edited")
    now = sync.snapshot(docs.where("not gone"))
    was = sync.snapshot(docs.where("not new").withColumn("content", F.when(F.col("edited"), F.concat("content", F.lit("x"))).otherwise(F.col("content"))))
    return sync.diff(now, was)


@register("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'new' ELSE 'old' END AS state FROM orders")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    changed = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("path"))
    return sync.merge(orders.withColumn("state", F.lit("old")), orders.withColumn("state", F.lit("new")), changed, "o_custkey")


@register("SELECT changed, total, CASE WHEN changed * 1.0 / total > 0.2 THEN 'full' ELSE 'incremental' END AS mode FROM (SELECT count_if(c_acctbal < 0)::BIGINT AS changed, count(*) AS total FROM customer)")
def sync_mode(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("changed"), F.count("*").alias("total"))
    r = n.first()
    return n.withColumn("mode", F.lit(sync.mode(r["changed"], r["total"])))


@register(
    f"""WITH l AS ({_HREFS}), left_ AS (SELECT DISTINCT url, href FROM l WHERE url NOT LIKE '%/de/%')
SELECT 'File' AS label, count(DISTINCT url) AS n FROM pages WHERE url NOT LIKE '%/de/%' UNION ALL SELECT 'Module', count(DISTINCT href) FROM left_ UNION ALL SELECT 'edge', count(*) FROM left_"""
)
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    e = _page_edges(spark, d)
    files = table(spark, d, "pages").select(F.col("url").alias("path")).distinct()
    nodes = files.select(F.lit("File").alias("label"), F.col("path").alias("key")).union(e.select("dst_label", "dst").distinct())
    nodes, left = graph.delete_files(nodes, e, files.where(F.col("path").contains("/de/")))
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(left.select(F.lit("edge").alias("label")).groupBy("label").agg(F.count("*").alias("n")))
