"""The library's operators over the driver's tables, each with DuckDB SQL for the same rows.

The star model is read from the order tables: orders are papers, suppliers authors, brands categories. Documents
and their labels, embeddings, events, pages and the benchmark serve the text, vector and incremental operators.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, text, vectors
from .operators import bm25, concepts, dense, evaluation, fusion, sampling, stats, upsert
from .plans import indexing, questions, retrieval
from .schemas import duplicate_keys, orphans
from .sources.tables import Versions, kept, scratch
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STAR_SQL = """WITH papers AS (SELECT o_orderkey AS arxiv_id, o_orderdate AS published_date FROM orders),
brands AS (SELECT l_orderkey AS paper_id, p_brand AS category_code, min(l_linenumber) AS line FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
paper_categories AS (SELECT paper_id, category_code, row_number() OVER (PARTITION BY paper_id ORDER BY line, category_code) = 1 AS is_primary FROM brands),
paper_authors AS (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2)
"""
WORDS_SQL = """tokens AS (SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text), '[a-z0-9]+') IF NOT list_contains([{stop}], w)] AS ts FROM documents),
lengths AS (SELECT doc_id, len(ts) AS n FROM tokens), corpus AS (SELECT count(*) AS n_docs, avg(n) AS avg_length FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tokens) GROUP BY 1, 2),
raw AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r FROM postings, corpus GROUP BY 1),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)""".format(stop=", ".join(f"'{w}'" for w in text.STOPWORDS))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Star:
    """The star model over the order tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        t = lambda name: table(spark, sf_dir, name)
        self.papers = t("orders").select(F.col("o_orderkey").alias("arxiv_id"), F.col("o_orderdate").cast("timestamp").alias("published_date"))
        self.authors = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
        self.categories = t("part").select(F.col("p_brand").alias("code"), F.col("p_brand").alias("display_name")).distinct()
        lines = t("lineitem")
        self.paper_authors = lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).agg((F.min("l_linenumber")).alias("position"))
        brands = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("category_code")).agg(F.min("l_linenumber").alias("line"))
        self.brands = brands
        self.links = brands.select("paper_id", "category_code")
        first = brands.groupBy("paper_id").agg(F.min(F.struct("line", "category_code")).alias("f"))
        self.paper_categories = brands.join(first, "paper_id").select("paper_id", "category_code", (F.col("category_code") == F.col("f.category_code")).alias("is_primary"))


@query(STAR_SQL + "SELECT (SELECT count(*) FROM papers) AS total_papers, (SELECT count(*) FROM supplier) AS total_authors, (SELECT count(DISTINCT p_brand) FROM part) AS total_categories, (SELECT strftime(min(published_date), '%Y-%m-%d') FROM papers) AS date_from, (SELECT strftime(max(published_date), '%Y-%m-%d') FROM papers) AS date_to, (SELECT string_agg(category_code || ':' || n, ',' ORDER BY n DESC, category_code) FROM (SELECT category_code, count(*) AS n FROM paper_categories JOIN papers ON paper_id = arxiv_id GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)) AS top_categories")
def summary(spark, sf_dir):
    s = Star(spark, sf_dir)
    one = stats.summary(s.papers, s.authors, s.categories, s.links)
    shown = F.array_join(F.transform("top_categories", lambda c: F.concat_ws(":", c["code"], c["paper_count"].cast("string"))), ",")
    return one.select("total_papers", "total_authors", "total_categories", F.col("date_range.from").alias("date_from"), F.col("date_range.to").alias("date_to"), shown.alias("top_categories"))


@query(STAR_SQL + "SELECT category_code AS code, count(*) AS paper_count FROM paper_categories JOIN papers ON paper_id = arxiv_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_categories(spark, sf_dir):
    s = Star(spark, sf_dir)
    return stats.top_categories(s.papers, s.categories, s.links).select("code", "paper_count")


@query(STAR_SQL + "SELECT category_code AS code, count(*) AS paper_count FROM paper_categories JOIN papers ON paper_id = arxiv_id WHERE published_date >= DATE '1996-01-01' AND published_date < DATE '1997-06-30' + INTERVAL 1 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_categories_ranged(spark, sf_dir):
    s = Star(spark, sf_dir)
    return stats.top_categories(s.papers, s.categories, s.links, first="1996-01-01", last="1997-06-30").select("code", "paper_count")


@query(STAR_SQL + "SELECT count(DISTINCT category_code) AS total FROM paper_categories JOIN papers ON paper_id = arxiv_id WHERE published_date >= DATE '1996-01-01'")
def category_total_distinct(spark, sf_dir):
    s = Star(spark, sf_dir)
    return stats.category_total(s.papers, s.categories, s.links, first="1996-01-01")


def _over_time(granularity: str, label: str, category: str | None = None):
    where = f" WHERE category_code = '{category}'" if category else ""
    sql = STAR_SQL + f"SELECT {label} AS period, category_code, count(*) AS paper_count FROM paper_categories JOIN papers ON paper_id = arxiv_id{where} GROUP BY 1, 2"

    def run(spark, sf_dir):
        s = Star(spark, sf_dir)
        return stats.categories_over_time(s.papers, s.links, granularity, category)

    run.__name__ = f"categories_over_time_{granularity}" + ("_one" if category else "")
    query(sql)(run)


_over_time("month", "strftime(published_date, '%Y-%m')")
_over_time("year", "strftime(published_date, '%Y')")
_over_time("week", "strftime(published_date, '%G-W%V')")
_over_time("month", "strftime(published_date, '%Y-%m')", "Brand#2")


@query(STAR_SQL + "SELECT author_id, s_name AS author, count(*) AS paper_count FROM paper_authors JOIN papers ON paper_id = arxiv_id JOIN supplier ON author_id = s_suppkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20")
def top_authors(spark, sf_dir):
    s = Star(spark, sf_dir)
    return stats.top_authors(s.papers, s.authors, s.paper_authors)


@query(STAR_SQL + "SELECT strftime(published_date, '%G-W%V') AS period, count(*) AS paper_count FROM papers GROUP BY 1")
def velocity_week(spark, sf_dir):
    return stats.velocity(Star(spark, sf_dir).papers)


@query(STAR_SQL + "SELECT strftime(published_date, '%Y-%m') AS period, count(*) AS paper_count FROM papers WHERE published_date >= DATE '1996-01-01' GROUP BY 1")
def velocity_month(spark, sf_dir):
    return stats.velocity(Star(spark, sf_dir).papers, "month", first="1996-01-01")


@query(STAR_SQL + "SELECT a.category_code AS a, b.category_code AS b, count(*) AS together FROM paper_categories a JOIN paper_categories b ON a.paper_id = b.paper_id AND a.category_code < b.category_code GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def category_cooccurrence(spark, sf_dir):
    return stats.cooccurrence(Star(spark, sf_dir).links)


@query("SELECT count(*) AS total, count(CASE WHEN label < 5 THEN embedding END) AS embedded, greatest(1, round_even(sqrt(count(CASE WHEN label < 5 THEN embedding END)), 0))::BIGINT AS lists FROM embeddings")
def readiness_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("label") < 5, F.col("embedding")))
    return stats.readiness(rows).withColumn("lists", vectors.index_lists(F.col("embedded")))


@query("WITH r AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders) SELECT d::DATE AS win_start, least(d::DATE + 6, b) AS win_end FROM (SELECT unnest(generate_series(a, b, INTERVAL 7 DAY)) AS d, b FROM r)")
def weekly_windows(spark, sf_dir):
    span = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("date_from"), F.to_date(F.max("o_orderdate")).alias("date_to"))
    return dates.windows(span).select("win_start", "win_end")


@query("SELECT o_orderkey, o_orderpriority, year, rank FROM (SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year, row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 29")
def quota_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return sampling.even_sample(rows, ["year", "o_orderpriority"], ["o_orderdate", "o_orderkey"], sampling.quota(1000, 7, 5)).select("o_orderkey", "o_orderpriority", "year", "rank")


UPSERT_SQL = """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, part ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_returnflag = 'N' AS part FROM lineitem)) WHERE r = 1),
t AS (SELECT * FROM latest WHERE NOT part), s AS (SELECT * FROM latest WHERE part),
merged AS (SELECT coalesce(t.l_orderkey, s.l_orderkey) AS l_orderkey, coalesce(t.l_linenumber, s.l_linenumber) AS l_linenumber,
CASE WHEN t.l_shipdate IS NULL THEN 'insert' WHEN s.l_shipdate > t.l_shipdate THEN 'update' ELSE 'unchanged' END AS action, t.l_shipdate AS t_ship, s.l_shipdate AS s_ship, t.l_partkey AS t_part, s.l_partkey AS s_part, t.l_suppkey AS t_supp, s.l_suppkey AS s_supp
FROM t FULL JOIN s ON t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber)
"""


def _upserted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    keys, ties = ["l_orderkey", "l_linenumber"], ("l_partkey", "l_suppkey", "l_extendedprice")
    old = upsert.latest(lines.where("l_returnflag <> 'N'").drop("l_returnflag"), keys, "l_shipdate", *ties)
    return upsert.upsert(old, lines.where("l_returnflag = 'N'").drop("l_returnflag"), keys, "l_shipdate", ("l_suppkey",), ties)


@query(UPSERT_SQL + "SELECT l_orderkey, l_linenumber, action, CASE action WHEN 'unchanged' THEN t_part ELSE s_part END AS l_partkey, CASE action WHEN 'insert' THEN s_supp ELSE t_supp END AS l_suppkey FROM merged")
def upsert_conditional(spark, sf_dir):
    return _upserted(spark, sf_dir).select("l_orderkey", "l_linenumber", "action", "l_partkey", "l_suppkey")


@query(UPSERT_SQL + "SELECT action, count(*) AS n_rows FROM merged GROUP BY 1")
def upsert_actions(spark, sf_dir):
    return upsert.actions(_upserted(spark, sf_dir))


@query(UPSERT_SQL + "SELECT l_orderkey, l_linenumber, CASE action WHEN 'unchanged' THEN t_part ELSE s_part END AS l_partkey, CASE action WHEN 'insert' THEN s_supp ELSE t_supp END AS l_suppkey FROM merged")
def upsert_buckets(spark, sf_dir):
    """The same upsert into a stored table in hash buckets: first the old rows, then the new ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    keys, ties = ["l_orderkey", "l_linenumber"], ("l_partkey", "l_suppkey", "l_extendedprice")
    with scratch(spark, "buckets") as root:
        store = Versions(spark, root)
        for old in (True, False):
            with store.begin() as draft:
                if old:
                    draft.create("lines", lines.drop("l_returnflag").schema.simpleString()[7:-1].replace(":", " "), keys)
                draft.merge("lines", lines.where(f"l_returnflag {'<>' if old else '='} 'N'").drop("l_returnflag"), lambda held, batch: upsert.upsert(held, batch, keys, "l_shipdate", ("l_suppkey",), ties))
                draft.publish(keep=1)
        return kept(store.read()["lines"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts::TIMESTAMP END AS v, event_type FROM events WHERE event_id % 2 = 0 OR event_id % 5 = 0),
s AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN ts::TIMESTAMP + INTERVAL 1 DAY END AS v, 'new' AS event_type FROM events WHERE event_id % 2 = 1 OR event_id % 7 = 0)
SELECT coalesce(t.event_id, s.event_id) AS event_id, CASE WHEN t.event_id IS NULL THEN 'insert' WHEN t.v < s.v THEN 'update' ELSE 'unchanged' END AS action,
CASE WHEN t.event_id IS NULL OR t.v < s.v THEN s.event_type ELSE t.event_type END AS event_type FROM t FULL JOIN s ON t.event_id = s.event_id""")
def upsert_null_version(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("v"), "event_type")
    old = rows.where("event_id % 2 = 0 or event_id % 5 = 0").withColumn("v", F.when(F.col("event_id") % 3 > 0, F.col("v")))
    new = rows.where("event_id % 2 = 1 or event_id % 7 = 0").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("v") + F.expr("interval 1 day")).alias("v"), F.lit("new").alias("event_type"))
    return upsert.upsert(old, new, ["event_id"], "v").select("event_id", "action", "event_type")


@query("SELECT lower(c_mktsegment) AS key, arg_min(c_mktsegment, c_custkey) AS name FROM customer GROUP BY 1 UNION ALL SELECT 'books', 'Books'")
def insert_ignore_names(spark, sf_dir):
    there = spark.createDataFrame([("books", "Books")], "key string, name string")
    rows = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("key"), F.col("c_mktsegment").alias("name"), "c_custkey")
    return upsert.insert_ignore(there, rows, ["key"], ["c_custkey"])


@query("WITH first AS (SELECT lower(c_name) AS name_normalized, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY 1) SELECT count(*) AS n_rows, count(DISTINCT name_normalized) AS n_names, min(7) AS first_id, 7 + count(*) - 1 AS last_id FROM first")
def surrogate_ids(spark, sf_dir):
    there = spark.createDataFrame([(6, "Someone", "someone")], "id long, name string, name_normalized string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lower("c_name").alias("name_normalized"), "c_custkey")
    new = upsert.with_ids(there, rows, "name_normalized", "name", ["c_custkey"]).where("id > 6")
    return new.agg(F.count("*").alias("n_rows"), F.count_distinct("name_normalized").alias("n_names"), F.min("id").cast("int").alias("first_id"), F.max("id").alias("last_id"))


def _lists(spark, sf_dir):
    """Papers with their authors and categories as lists, in line order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    listed = lines.groupBy(F.col("l_orderkey").alias("arxiv_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_brand", "s_name"))).alias("x"))
    return listed.select("arxiv_id", F.col("x.s_name").alias("authors"), F.col("x.p_brand").alias("categories"), F.lit("").alias("primary_category"))


LISTS_SQL = "WITH lines AS (SELECT l_orderkey, s_suppkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_brand, s_name) - 1 AS position FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"


@query(LISTS_SQL + " SELECT l_orderkey AS paper_id, s_suppkey AS author_id, min(position)::SMALLINT AS position FROM lines GROUP BY 1, 2")
def link_authors_position(spark, sf_dir):
    authors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.normalize_author(F.col("s_name")).alias("name_normalized"))
    return upsert.author_links(_lists(spark, sf_dir), authors, text.normalize_author)


@query(LISTS_SQL + " SELECT DISTINCT l_orderkey AS paper_id, p_brand AS category_code, p_brand = first(p_brand) OVER (PARTITION BY l_orderkey ORDER BY position) AS is_primary FROM lines")
def link_categories_primary(spark, sf_dir):
    return upsert.category_links(_lists(spark, sf_dir))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_linenumber = 1 AND l_suppkey % 3 > 0)")
def orphan_check(spark, sf_dir):
    heavy = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49 and l_linenumber = 1 and l_suppkey % 3 > 0")
    return orphans(table(spark, sf_dir, "supplier"), heavy, "s_suppkey", "l_suppkey").select("s_suppkey", "s_name")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key_check(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT doc_id, lang FROM documents d WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT vec_id FROM embeddings WHERE label = 0 OR (CASE WHEN label = 1 THEN NULL WHEN label < 5 THEN 'small' ELSE 'other' END) IS DISTINCT FROM 'small' OR vec_id % 7 < label % 7")
def pending_stale_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") != 0, F.col("embedding")).alias("embedding"), F.when(F.col("label") == 1, None).when(F.col("label") < 5, "small").otherwise("other").alias("embedding_model"), (F.col("vec_id") % 7).alias("embedding_updated_at"), (F.col("label") % 7).alias("updated_at"))
    return upsert.pending(rows, "small").select("vec_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf_dir):
    return upsert.keyset_page(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, 50)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def latest_run_max_by(spark, sf_dir):
    return upsert.latest_run(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_path_read(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(nfc_normalize('  ' || s_name || '  X')), '\\s+', ' ', 'g')) AS name_normalized FROM supplier")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.normalize_author(F.concat(F.lit("  "), "s_name", F.lit("  X"))).alias("name_normalized"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\\\[a-zA-Z]+\\{([^}]*)\\}', '\\1', 'g'), '\\$[^$]+\\$', '[MATH]', 'g'), '\\\\\\([^)]+\\\\\\)', '[MATH]', 'g'), '\\\\\\[[^\\]]+\\\\\\]', '[MATH]', 'g'), '\\\\[a-zA-Z]+', '', 'g')) AS cleaned FROM documents")
def latex_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_latex(F.col("text"))).alias("cleaned"))


@query()
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, 'arxiv\\.org/abs/\\S+') THEN regexp_replace(regexp_extract(u, 'arxiv\\.org/abs/(\\S+)', 1), 'v\\d+$', '') ELSE u END AS identifier FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'http://arxiv.org/abs/2401.' || (10000 + page_id) || 'v2' END AS u FROM pages)")
def strip_version(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("http://arxiv.org/abs/2401."), (10000 + F.col("page_id")).cast("string"), F.lit("v2"))).alias("u"))
    return pages.select("page_id", text.strip_version(F.col("u")).alias("identifier"))


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(text || ' arXiv: 2401.' || (10000 + turn) || ' and ARXIV:2402.' || (20000 + conv_id % 1000), '(?i)arXiv:\\s*(\\d{4}\\.\\d{4,5})', 1), ',') AS cited FROM conversations")
def citation_extract(spark, sf_dir):
    said = F.concat("text", F.lit(" arXiv: 2401."), (10000 + F.col("turn")).cast("string"), F.lit(" and ARXIV:2402."), (20000 + F.col("conv_id") % 1000).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.citations(said), ",").alias("cited"))


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2000-01-01' WHEN o_orderkey % 5 = 1 THEN o_orderdate + INTERVAL 150 MINUTE ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders")
def iso_parse_fallback(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("o_orderkey") % 5 == 0, "soon").when(F.col("o_orderkey") % 5 == 1, F.concat(day, F.lit("-02:30"))).otherwise(F.concat(day, F.lit("Z")))
    parsed = dates.parse(said, F.lit("2000-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("WITH " + WORDS_SQL + " SELECT doc_id, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens FROM tokens")
def bm25_tokenize(spark, sf_dir):
    tokens = text.bm25_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens"))


@query("WITH " + WORDS_SQL + " SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, sf_dir):
    with _stored(spark, table(spark, sf_dir, "documents")) as index:
        return kept(index.terms.select("term", "df", F.round("idf", 6).alias("idf")))


SEARCH_SQL = """, asked AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest([w FOR w IN regexp_extract_all(lower(text), '[a-z0-9]+') IF NOT list_contains([{stop}], w)]) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT qid, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_length))) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), corpus GROUP BY 1, 2),
sparse AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 20)""".format(stop=", ".join(f"'{w}'" for w in text.STOPWORDS))


@contextmanager
def _stored(spark, docs):
    """An index of ``docs`` in the shared folder, for a while."""
    with scratch(spark, "bm25") as root:
        yield bm25.store(docs, root)


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query("WITH " + WORDS_SQL + SEARCH_SQL + " SELECT qid, doc_id, round(score, 6) AS score FROM sparse WHERE score > 0")
def bm25_search(spark, sf_dir):
    with _stored(spark, table(spark, sf_dir, "documents")) as index:
        found = bm25.search(index, _asked(spark, sf_dir))
        return kept(found.select("qid", "doc_id", F.round("score", 6).alias("score")))


@query("WITH " + WORDS_SQL + SEARCH_SQL + " SELECT g AS qid, doc_id, round(best, 6) AS score FROM (SELECT qid % 10 AS g, doc_id, max(score) AS best, row_number() OVER (PARTITION BY qid % 10 ORDER BY round(max(score), 9) DESC, doc_id) AS r FROM sparse WHERE score > 0 GROUP BY 1, 2) WHERE r <= 20")
def bm25_multi_query(spark, sf_dir):
    with _stored(spark, table(spark, sf_dir, "documents")) as index:
        found = bm25.search(index, _asked(spark, sf_dir))
        best = bm25.best_of_variants(found.select((F.col("qid") % 10).alias("qid"), "doc_id", "score"))
        return kept(best.select("qid", "doc_id", F.round("score", 6).alias("score")))


DENSE_SQL = """dense AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20)"""


def _near(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return dense.search(rows, asked, doc_id="vec_id")


@query("WITH " + DENSE_SQL + " SELECT qid, doc_id, round(score, 6) AS score FROM dense")
def dense_topk(spark, sf_dir):
    return _near(spark, sf_dir).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query("WITH " + DENSE_SQL + " SELECT g AS qid, doc_id, round(best, 6) AS score FROM (SELECT (qid // 20) % 5 AS g, doc_id, max(score) AS best, row_number() OVER (PARTITION BY (qid // 20) % 5 ORDER BY round(max(score), 9) DESC, doc_id) AS r FROM dense GROUP BY 1, 2) WHERE r <= 20")
def dense_multi_vector(spark, sf_dir):
    found = _near(spark, sf_dir).select(F.expr("(qid div 20) % 5").alias("qid"), "doc_id", "score")
    return bm25.best_of_variants(found).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query()
def ann_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    index, centroids = dense.coarse_index(rows, max(1, round(n**0.5)), doc_id="vec_id")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return dense.probe(index, centroids, asked).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query()
def ann_quantised(spark, sf_dir):
    """From codes of all lists, with the vectors of a tenth of the rows at sf0.1."""
    rows = table(spark, sf_dir, "embeddings")
    index, centroids = dense.coarse_index(rows, max(1, round(rows.count() ** 0.5)), doc_id="vec_id")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    with scratch(spark, "codes") as root:
        codes = dense.quantise(index, centroids)
        Versions(spark, root).write(rows=codes.rows)
        stored = dense.Codes(Versions(spark, root).read()["rows"], codes.books, codes.centroids)
        return kept(dense.search_codes(stored, asked).select("qid", "doc_id", F.round("score", 6).alias("score")))


FUSED_SQL = "WITH " + WORDS_SQL + SEARCH_SQL + ", " + DENSE_SQL + """, legs AS (SELECT qid, 'sparse' AS leg, 1 AS leg_order, doc_id, rank FROM sparse WHERE score > 0 UNION ALL SELECT qid, 'dense', 0, doc_id, rank FROM dense),
fused AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(leg, rank * 10 + leg_order) AS source FROM legs GROUP BY 1, 2)"""


def _fused(spark, sf_dir):
    leg = lambda found, name, order: found.select(F.col("qid").cast("long").alias("qid"), F.lit(name).alias("leg"), F.lit(order).alias("leg_order"), "doc_id", "rank")
    with _stored(spark, table(spark, sf_dir, "documents")) as index:
        sparse = bm25.search(index, _asked(spark, sf_dir))
        return kept(fusion.rrf(leg(sparse, "sparse", 1).unionByName(leg(_near(spark, sf_dir), "dense", 0))))


@query(FUSED_SQL + " SELECT qid, doc_id, round(rrf, 6) AS rrf, source FROM fused QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) <= 20")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("qid", "doc_id", F.round("rrf", 6).alias("rrf"), "source")


@query("WITH " + DENSE_SQL + " SELECT qid, doc_id, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.45 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'none' END AS band FROM dense")
def confidence_bands(spark, sf_dir):
    return _near(spark, sf_dir).select("qid", "doc_id", fusion.confidence(F.col("score")).alias("band"))


@query("WITH " + DENSE_SQL + " SELECT qid, count(*) AS kept, round(max(score), 6) AS best FROM dense WHERE score >= 0.45 GROUP BY 1")
def similarity_gate(spark, sf_dir):
    return fusion.gate(_near(spark, sf_dir), 0.45, "score").groupBy("qid").agg(F.count("*").alias("kept"), F.round(F.max("score"), 6).alias("best"))


CONCEPT_SQL = "WITH rows_ AS (SELECT DISTINCT l_orderkey AS paper_id, p_name || ' ' || p_type AS name, lower(p_name || ' ' || p_type) AS key FROM lineitem JOIN part ON l_partkey = p_partkey), "


def _concepts(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("paper_id"), F.xxhash64("p_name", "p_type").alias("concept_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.lit("other").alias("concept_type"))


@query(CONCEPT_SQL[:-2] + " SELECT key, min(name) AS name, 'other' AS concept_type, count(DISTINCT paper_id) AS n_papers FROM rows_ GROUP BY 1")
def concept_nodes(spark, sf_dir):
    return concepts.nodes(_concepts(spark, sf_dir)).select("key", "name", "concept_type", "n_papers")


@query(CONCEPT_SQL[:-2] + " SELECT a.key AS src, b.key AS dst, count(*) AS weight FROM (SELECT DISTINCT paper_id, key FROM rows_) a JOIN (SELECT DISTINCT paper_id, key FROM rows_) b ON a.paper_id = b.paper_id AND a.key < b.key GROUP BY 1, 2")
def concept_edges(spark, sf_dir):
    return concepts.edges(_concepts(spark, sf_dir))


@query(
    CONCEPT_SQL
    + """asked AS (SELECT p_partkey AS qid, lower(p_name || ' ' || p_type) AS key FROM part WHERE p_partkey % 20 = 0),
edges AS (SELECT a.key AS src, b.key AS dst, count(*) AS weight FROM (SELECT DISTINCT paper_id, key FROM rows_) a JOIN (SELECT DISTINCT paper_id, key FROM rows_) b ON a.paper_id = b.paper_id AND a.key <> b.key GROUP BY 1, 2),
near AS (SELECT qid, dst AS key FROM (SELECT qid, dst, row_number() OVER (PARTITION BY qid, key ORDER BY weight DESC, dst) AS n FROM asked JOIN edges ON key = src) WHERE n <= 3),
expanded AS (SELECT qid, key, max(own) AS own FROM (SELECT qid, key, 1 AS own FROM asked UNION ALL SELECT qid, key, 0 FROM near) GROUP BY 1, 2),
counted AS (SELECT qid, paper_id, count(*) AS total, sum(own)::BIGINT AS direct FROM expanded JOIN (SELECT DISTINCT key, paper_id FROM rows_) USING (key) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT qid, paper_id, total, direct FROM counted QUALIFY row_number() OVER (PARTITION BY qid ORDER BY direct DESC, total DESC, paper_id) <= 10"""
)
def concept_traverse(spark, sf_dir):
    rows = _concepts(spark, sf_dir)
    asked = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    with scratch(spark, "graph") as root:
        held = concepts.store(rows, root)
        return kept(concepts.traverse(held.links, held.edges, asked).select("qid", "paper_id", "total", "direct"))


GRAPH_SQL = """, held AS (SELECT DISTINCT doc_id, unnest(ts) AS term FROM tokens), band AS (SELECT term FROM held GROUP BY 1 HAVING count(*) BETWEEN 5 AND 8),
linked AS MATERIALIZED (SELECT doc_id, term FROM held SEMI JOIN band USING (term)),
edges AS MATERIALIZED (SELECT a.term AS src, b.term AS dst, count(*) AS weight FROM linked a JOIN linked b ON a.doc_id = b.doc_id AND a.term <> b.term GROUP BY 1, 2),
direct AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) SEMI JOIN band USING (term) WHERE length(term) >= 2),
near AS (SELECT qid, dst AS term FROM (SELECT qid, dst, row_number() OVER (PARTITION BY qid, term ORDER BY weight DESC, dst) AS n FROM direct JOIN edges ON term = src) WHERE n <= 3),
expanded AS (SELECT qid, term, max(own) AS own FROM (SELECT qid, term, 1 AS own FROM direct UNION ALL SELECT qid, term, 0 FROM near) GROUP BY 1, 2),
graph AS (SELECT qid, doc_id, count(*) AS overlap, row_number() OVER (PARTITION BY qid ORDER BY sum(own) DESC, count(*) DESC, doc_id) AS rank FROM expanded JOIN linked USING (term) GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY rank <= 10)"""
HYBRID_SQL = (
    FUSED_SQL.replace(", legs AS", GRAPH_SQL + ", legs AS").replace("FROM dense)", "FROM dense UNION ALL SELECT qid, 'graph', 2, doc_id, rank FROM graph)")
    .replace("FROM benchmark", "FROM (SELECT * FROM benchmark WHERE item_id % 20 = 0)")
    .replace("FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0", "FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)")
    + """, best AS (SELECT qid, doc_id, rrf, source, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id::VARCHAR) AS rank FROM fused QUALIFY rank <= 20),
full_ AS (SELECT b.qid::VARCHAR AS qid, b.doc_id::VARCHAR AS doc_id, round(rrf, 6) AS rrf, source, b.rank, round(coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0), 6) AS sim, overlap
FROM best b LEFT JOIN embeddings e ON e.vec_id = b.doc_id LEFT JOIN embeddings q ON q.vec_id = b.qid LEFT JOIN graph g ON g.qid = b.qid AND g.doc_id = b.doc_id)"""
)


@contextmanager
def _corpus(spark, sf_dir):
    """The corpus with frequent terms as concepts, and the queries: every twentieth benchmark item."""
    docs, rows = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = _asked(spark, sf_dir).where("qid % 20 = 0")
    near = asked.join(rows.withColumnRenamed("doc_id", "qid"), "qid").select("qid", "embedding")
    terms = indexing.frequent_terms(docs, 5, 8).select("paper_id", F.xxhash64("term").alias("concept_id"), F.col("term").alias("name"), F.lit("other").alias("concept_type"))
    with scratch(spark, "graph") as root, _stored(spark, docs) as index:
        yield retrieval.Corpus(docs, rows, index, concepts.store(terms, root)), asked, near


@query(HYBRID_SQL + " SELECT qid, doc_id, rrf, source, sim, overlap FROM full_")
def hybrid_search(spark, sf_dir):
    with _corpus(spark, sf_dir) as corpus:
        return kept(retrieval.hybrid(*corpus).select("qid", "doc_id", F.round("rrf", 6).alias("rrf"), "source", F.round("sim", 6).alias("sim"), "overlap"))


@query(HYBRID_SQL + " SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY full_.rank) AS rank, source, lang, n_chars FROM full_ JOIN documents d ON d.doc_id::VARCHAR = full_.doc_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY full_.rank) <= 10".replace("SELECT qid, doc_id", "SELECT qid, full_.doc_id AS doc_id").replace("source, lang", "full_.source AS source, lang"))
def search(spark, sf_dir):
    with _corpus(spark, sf_dir) as corpus:
        return kept(retrieval.search(*corpus).select("qid", "doc_id", "rank", "source", "lang", "n_chars"))


ASKED_SQL = """WITH sims AS (SELECT q.vec_id AS q, e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id SEMI JOIN documents d ON d.doc_id = e.vec_id WHERE q.vec_id % 20 < 2),
found AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, doc_id) AS rank FROM sims QUALIFY rank <= 20), best AS (SELECT q, max(sim) AS best FROM found GROUP BY 1),
asked AS (SELECT v.vec_id AS qid, CASE WHEN coalesce(a.best, -1) < 0.4 AND v.vec_id + 1 IN (SELECT vec_id FROM embeddings) THEN v.vec_id + 1 ELSE v.vec_id END AS q, CASE WHEN coalesce(a.best, -1) < 0.4 THEN 2 ELSE 1 END AS iterations FROM embeddings v LEFT JOIN best a ON a.q = v.vec_id WHERE v.vec_id % 20 = 0),
near AS (SELECT qid, doc_id, sim, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM asked JOIN found USING (q) WHERE sim >= 0.4 QUALIFY n <= 5),
told AS (SELECT qid, max(sim) AS top, string_agg(substr(text, 1, 20), '|' ORDER BY n) AS answer, string_agg(near.doc_id::VARCHAR, ',' ORDER BY n) AS cited FROM near JOIN documents d ON d.doc_id = near.doc_id GROUP BY 1)
"""


def _quoted(prompt: str) -> list[str]:
    """The texts of a prompt's blocks, whose titles are empty: they are numbered from 1, and a text may hold brackets and lines."""
    said, k = [], 1
    rest = prompt
    while rest.startswith(head := f"[{k}] \n"):
        text_, _, after = rest[len(head) :].partition(f"\n\n[{k + 1}] \n")
        said.append(text_)
        rest, k = f"[{k + 1}] \n{after}" if _ else "", k + 1
    return said


@query(ASKED_SQL + "SELECT qid::VARCHAR AS qid, iterations, CASE WHEN top >= 0.6 THEN 'high' WHEN top >= 0.45 THEN 'medium' WHEN top IS NOT NULL THEN 'low' ELSE 'none' END AS confidence, coalesce(trim(answer), '" + retrieval.NO_MATCH + "') AS answer, coalesce(cited, '') AS cited FROM asked LEFT JOIN told USING (qid)")
def ask_batch(spark, sf_dir):
    """Every twentieth vector as a question, by its number; where nothing is near, the next number is asked for. The stand-in for a
    model quotes what it reads, the first characters of texts; no more of them goes from step to step."""
    read = 20
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.lit("").alias("title"), F.substring("text", 1, read).alias("text"))
    own = rows.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")

    def search(asked):
        queries_ = asked.select("qid", F.col("query").cast("long").alias("vec_id")).join(rows, "vec_id")
        near = dense.search(own, queries_, questions.FOUND + 1, doc_id="vec_id").join(queries_.select("qid", "vec_id"), "qid").where("doc_id <> vec_id")
        ranked = bm25.rank(near, questions.FOUND)
        return ranked.join(docs, "doc_id").select("qid", "doc_id", F.col("score").alias("sim"), "rank", "title", "text")

    def quote(pairs):
        return ["|".join(_quoted(p)) for _, p in pairs]

    held = questions.ask_batch(
        rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("vec_id").cast("string").alias("question")),
        [questions.retrieve(search), questions.rewrite(lambda pairs: [str(int(q) + 1) for q, _ in pairs], search, 0.4), questions.gate(0.4), questions.shorten(read), questions.generate(quote, trim=" ")],
    )
    return held.select("qid", "iterations", "confidence", "answer", F.array_join(F.transform("docs", lambda d: d["doc_id"]), ",").alias("cited"))


PAIRS_SQL = """WITH pairs AS (SELECT u.conv_id * 1000 + u.turn AS qid, a.text AS predicted, u.text AS gold FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
words AS (SELECT qid, predicted, gold, regexp_extract_all(lower(predicted), '[\\p{L}\\p{N}_]+') AS pt, regexp_extract_all(lower(gold), '[\\p{L}\\p{N}_]+') AS gt FROM pairs),
common AS (SELECT qid, sum(least(p, g)) AS n FROM (SELECT qid, token, sum(p) AS p, sum(g) AS g FROM (SELECT qid, unnest(pt) AS token, 1 AS p, 0 AS g FROM words UNION ALL SELECT qid, unnest(gt), 0, 1 FROM words) GROUP BY 1, 2) GROUP BY 1),
scored AS (SELECT qid, CASE WHEN len(pt) = 0 AND len(gt) = 0 THEN 1.0 WHEN len(pt) = 0 OR len(gt) = 0 OR coalesce(n, 0) = 0 THEN 0.0 ELSE 2 * (n / len(pt)::DOUBLE) * (n / len(gt)::DOUBLE) / (n / len(pt)::DOUBLE + n / len(gt)::DOUBLE) END AS f1, array_to_string(pt, ' ') = array_to_string(gt, ' ') AS em FROM words LEFT JOIN common USING (qid))
"""


def _pairs(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    user = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    answer = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("predicted"))
    return user.join(answer, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "predicted", "gold")


@query(PAIRS_SQL + "SELECT qid, round(f1, 6) AS f1 FROM scored")
def token_f1(spark, sf_dir):
    return evaluation.token_f1(_pairs(spark, sf_dir)).select("qid", F.round("f1", 6).alias("f1"))


@query(PAIRS_SQL + "SELECT qid, em FROM scored")
def exact_match(spark, sf_dir):
    return evaluation.exact_match(_pairs(spark, sf_dir)).select("qid", "em")


def _samples(spark, sf_dir):
    cited = F.concat(F.lit("arXiv:2401."), (10000 + F.col("qid") % 7).cast("string"))
    gold = F.transform(F.sequence(F.lit(0), (F.col("qid") % 3).cast("int")), lambda k: F.concat(F.lit("2401."), (10000 + (F.col("qid") % 5) + k).cast("string")))
    return _pairs(spark, sf_dir).select("qid", F.concat("predicted", F.lit(" "), cited).alias("predicted"), F.array("gold").alias("golds"), F.when(F.col("qid") % 4 != 0, gold).alias("gold_citations"))


RECALL_SQL = "CASE WHEN qid % 4 <> 0 THEN CASE WHEN qid % 7 BETWEEN qid % 5 AND qid % 5 + qid % 3 THEN 1.0::DOUBLE / (qid % 3 + 1) ELSE 0.0::DOUBLE END END"


@query(PAIRS_SQL + f"SELECT qid, round({RECALL_SQL}, 6) AS citation_recall FROM pairs")
def citation_recall(spark, sf_dir):
    return evaluation.citation_recall(_samples(spark, sf_dir)).select("qid", F.round("citation_recall", 6).alias("citation_recall"))


@query(PAIRS_SQL.replace("a.text AS predicted", "a.text || ' arXiv:2401.' || (10000 + (u.conv_id * 1000 + u.turn) % 7) AS predicted") + f"SELECT count(*) AS total, count_if(em)::BIGINT AS exact_match, count_if(em) / count(*)::DOUBLE AS exact_match_rate, round(avg(f1), 6) AS avg_f1, round(avg({RECALL_SQL}), 6) AS citation_recall_avg FROM scored")
def eval_summary(spark, sf_dir):
    one = evaluation.summary(evaluation.evaluate(_samples(spark, sf_dir)))
    return one.select("total", "exact_match", "exact_match_rate", F.round("avg_f1", 6).alias("avg_f1"), F.round("citation_recall_avg", 6).alias("citation_recall_avg"))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2")
def events_tumbling_week(spark, sf_dir):
    weeks = incremental.tumbling(table(spark, sf_dir, "events"), "ts", "7 days", incremental.MONDAY, None, "event_type")
    return weeks.select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), "event_type", "n_rows")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def events_latest_version(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return incremental.latest_version(rows, "user_id", "ts").select("user_id", "event_id", "event_type", "value")


@query("WITH cells AS (SELECT DISTINCT event_type AS category, strftime(date_trunc('week', ts), '%Y-%m-%d') AS win_start FROM events) SELECT * FROM cells WHERE NOT (category = 'click' AND win_start < '2024-01-15')")
def windows_todo(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("win_start")).distinct()
    return incremental.todo(cells, cells.where("category = 'click' and win_start < '2024-01-15'"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


@query("SELECT doc_id, [len(string_split(text, c)) - 1 FOR c IN " + str(list(LETTERS)) + "]::VARCHAR AS vector FROM documents WHERE regexp_matches(text, '[^\\s]')")
def embed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("abstract_clean"))
    made = indexing.embed_pending(docs, _letters, "letters", len(LETTERS), key="doc_id")
    return made.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ", "), F.lit("]")).alias("vector"))


#: Names that the stand-in for a model finds, more than the eight that a paper keeps.
NAMES = ("the", "und", "les", "que", "estion", "license", "ein", "con", "er", "ma", "in", "so")


def _named(rows: list[tuple[str, str]]) -> str:
    return json.dumps({"papers": [{"arxiv_id": i, "concepts": [n for n in NAMES if n in t.lower()]} for i, t in rows]})


@query("""WITH d AS (SELECT doc_id, text FROM documents d WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
pieces AS (SELECT doc_id, s // 1000 AS piece, lower(substr(text, s + 1, 1200)) AS t FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 201, 0), 1000)) AS s FROM d)),
met AS (SELECT doc_id, n, w, min(piece) AS piece FROM pieces JOIN (SELECT unnest(range(""" + str(len(NAMES)) + ")) AS n, unnest(" + str(list(NAMES)) + """) AS w) ON contains(t, w) GROUP BY 1, 2, 3),
first AS (SELECT doc_id, string_agg(w, ',' ORDER BY w) AS names FROM (SELECT doc_id, w FROM met QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY piece, n) <= 8) GROUP BY 1)
SELECT doc_id::VARCHAR AS paper_id, coalesce(names, '') AS names FROM d LEFT JOIN first USING (doc_id)""")
def concept_extraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("abstract"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"))
    found = indexing.extract_concepts(docs, done, _named)
    return found.select("paper_id", F.array_join(F.array_sort(F.transform("concepts", lambda c: c["name"])), ",").alias("names"))


@query("SELECT count(*) AS n_links, count(DISTINCT term) AS n_terms FROM (SELECT doc_id, term, count(*) OVER (PARTITION BY term) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS term FROM (SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text), '[a-z0-9]+') IF NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "], w)] AS ts FROM documents))) WHERE df BETWEEN 5 AND 20")
def frequent_terms(spark, sf_dir):
    return indexing.frequent_terms(table(spark, sf_dir, "documents"), 5, 20).agg(F.count("*").alias("n_links"), F.count_distinct("term").alias("n_terms"))


@query("SELECT 'tok' AS kind, count(*) AS n_rows FROM (SELECT DISTINCT doc_id FROM documents) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_totalprice > 0 AND o_orderdate >= DATE '1996-01-01'")
def union_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").distinct().agg(F.count("*").alias("n_rows")).select(F.lit("tok").alias("kind"), "n_rows")
    orders = dates.between_days(table(spark, sf_dir, "orders").where("o_totalprice > 0"), "o_orderdate", "1996-01-01", None)
    return docs.unionByName(orders.agg(F.count("*").alias("n_rows")).select(F.lit("orders").alias("kind"), "n_rows"))
