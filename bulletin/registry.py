"""Every query of the library by name, and SQL for each that SQL can express.

The synthetic tables stand in for notices: an order is a notice, its customer's nation the
college, the region the campus, its lines the announcing sources; an event is a visit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import dates as D, lecture_time as L, predicates as P, text as T
from .operators import counters, cube, dedup, links, maintain, resolve, serve, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices with college and campus."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("college"), F.col("r_name").alias("campus"))
    who = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "college", "campus")
    return t("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ord"), "college", "campus", F.col("o_orderdate").alias("start"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"))


NOTICES = """n AS (
  SELECT o_orderkey AS ord, n_name AS college, r_name AS campus, o_orderdate AS start, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS status, o_orderpriority AS title
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {NOTICES} SELECT college, year, CAST(count(*) AS BIGINT) AS n, CAST(grouping(college, year) AS INTEGER) AS level FROM n GROUP BY CUBE (college, year)")
def cube_count(spark, sf_dir):
    """A1, A2, A8."""
    return cube.college_year_cube(notices(spark, sf_dir))


@query(f"WITH {NOTICES} SELECT DISTINCT year FROM n")
def year_list(spark, sf_dir):
    """A4, O5."""
    return cube.years(notices(spark, sf_dir))


@query(f"WITH {NOTICES} SELECT college, arg_min(campus, ord) AS campus FROM n GROUP BY college")
def campus_map(spark, sf_dir):
    """A6."""
    return cube.first_seen(notices(spark, sf_dir), "college", "campus", "ord")


@query(f"WITH {NOTICES} SELECT college, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY college")
def college_frequency(spark, sf_dir):
    """A5."""
    return cube.frequency(notices(spark, sf_dir), "college", "ord")


@query("""WITH s AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1),
r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN NULL ELSE 3 END AS c, coalesce(k, 0) AS k FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT CAST(count(*) AS BIGINT) AS "lectureCount", CAST(sum(coalesce(c, nullif(k, 0), 1)) AS BIGINT) AS "sourceNoticeCount" FROM r""")
def source_notice_sum(spark, sf_dir):
    """A3: the sources are an order's lines; a count of 0 is kept."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey")).alias("sources"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("sourceCount", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") != "O", 3))
    return cube.notice_count(rows)


@query(f"""WITH {NOTICES}, c AS (SELECT user_id AS url, count(*) AS visits, count(*) FILTER (WHERE event_type = 'purchase') AS likes FROM events GROUP BY 1)
SELECT college, year, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(visits, 0)) AS BIGINT) AS visits, CAST(sum(coalesce(likes, 0)) AS BIGINT) AS likes, CAST(grouping(college, year) AS INTEGER) AS level
FROM n LEFT JOIN c ON url = ord GROUP BY CUBE (college, year)""")
def stats_overlay(spark, sf_dir):
    """J4, A7, A8."""
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("url")).agg(F.count("*").alias("visits"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("likes"))
    return cube.measures(cube.with_counters(notices(spark, sf_dir), c, "ord"))


@query(f"""WITH {NOTICES} SELECT college, year, CAST(count(*) AS BIGINT) AS n FROM n
WHERE college IN (SELECT college FROM n WHERE campus = (SELECT min(campus) FROM n)) AND contains(lower(college), 'a') GROUP BY 1, 2""")
def campus_facet(spark, sf_dir):
    """J5, F13."""
    n = notices(spark, sf_dir)
    return cube.of_campus(n, n.join(n.agg(F.min("campus").alias("campus")), "campus", "left_semi").select("college", "campus"), None, " A ").groupBy("college", "year").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(year(day) AS INTEGER) AS year, {', '.join(f"CAST(coalesce(sum(n) FILTER (WHERE month(day) = {m}), 0) AS BIGINT) AS m{m:02d}" for m in range(1, 13))} FROM d GROUP BY 1""")
def year_month_matrix(spark, sf_dir):
    """A9."""
    return cube.year_month_matrix(table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n")))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS day_sum, CAST(count(*) AS BIGINT) AS n_days, min(day) AS first_day, max(day) AS last_day, CAST(greatest(1, max(n)) AS BIGINT) AS max_cell, CAST(greatest(0, 20000 - sum(n)) AS BIGINT) AS legacy FROM d""")
def visit_summary(spark, sf_dir):
    """A10."""
    return cube.visit_summary(table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n")), 20000)


def documents_as_notices(spark, sf_dir):
    """Documents as notices: language as college, source as campus."""
    d = table(spark, sf_dir, "documents")
    start = F.when(F.col("doc_id") % 7 != 0, F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd"), F.lit(" 09:00:00")))
    return d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("https://x.test/"), F.col("doc_id").cast("string")).alias("sourceUrl"), F.col("lang").alias("college"), F.col("source").alias("campus"), F.col("text").alias("title"), F.col("text").alias("abstract"), start.alias("lectureStart"))


DOCS = """d AS (SELECT doc_id AS ord, 'https://x.test/' || doc_id AS "sourceUrl", lang AS college, source AS campus, text AS title, text AS abstract,
  CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') || ' 09:00:00' END AS "lectureStart" FROM documents)"""


@query(f"""WITH {DOCS} SELECT ord, college, campus FROM d WHERE college = 'en' AND campus = 'src3' AND contains(lower(concat_ws(' ', title, college)), 'the')""")
def facet_search(spark, sf_dir):
    """F10, F11."""
    return serve.search(documents_as_notices(spark, sf_dir), campus="src3", college="en", query=" THE ").select("ord", "college", "campus")


@query(f"""WITH {DOCS} SELECT ord, college, campus FROM d WHERE college = 'en' AND campus = 'src3' AND contains(lower(concat_ws(' ', abstract, college)), 'the')""")
def facet_search_text(spark, sf_dir):
    """F10, F11 with the whole text as the field that is searched."""
    d = documents_as_notices(spark, sf_dir).withColumn("title", F.col("abstract"))
    return serve.search(d, campus="src3", college="en", query=" THE ").select("ord", "college", "campus")


@query(f"""WITH {DOCS}, r AS (SELECT ord, row_number() OVER (ORDER BY "lectureStart" DESC NULLS LAST, ord) AS k FROM d WHERE college = 'en') SELECT ord FROM r WHERE k BETWEEN 51 AND 75""")
def page_slice(spark, sf_dir):
    """O1, W8."""
    rows = serve.search(documents_as_notices(spark, sf_dir), college="en")
    return serve.page(rows, 3, serve.newest_first()).select("ord")


@query(f"""WITH {DOCS} SELECT ord, "lectureStart", substring(abstract, 1, 220) AS abstract FROM d ORDER BY "lectureStart" DESC NULLS FIRST, ord LIMIT 50""")
def latest_previews(spark, sf_dir):
    """O2, P2."""
    return serve.latest(documents_as_notices(spark, sf_dir)).select("ord", "lectureStart", "abstract")


@query(f"""WITH {DOCS} SELECT coalesce(substring("lectureStart", 1, 10), '-') AS date, ord, CAST(row_number() OVER (PARTITION BY substring("lectureStart", 1, 10) ORDER BY "lectureStart" DESC NULLS LAST, ord) AS INTEGER) AS place FROM d""")
def day_groups(spark, sf_dir):
    """A17, O3, O6."""
    rows = serve.by_day(documents_as_notices(spark, sf_dir).withColumn("title", F.lit("")))
    return rows.select(F.coalesce(F.substring("lectureStart", 1, 10), F.lit("-")).alias("date"), "ord", "place")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE 1 END DESC, doc_id) AS k FROM documents) SELECT doc_id FROM r WHERE k = 1""")
def dedup_best(spark, sf_dir):
    """Of documents alike the one with the better score, the first of equals."""
    d = table(spark, sf_dir, "documents")
    return dedup.keep_best(d, [F.col("lang"), F.col("text")], F.when(F.col("source").isin("src1", "src2"), 0).otherwise(1), "doc_id").select("doc_id")


@query("""WITH l AS (SELECT c_nationkey AS g, c_custkey AS o, c_name AS t, substring(c_name, 10, 9) AS k FROM customer),
b AS (SELECT g, o, k, list_distinct(list_concat(list_transform(range(1, length(k)), lambda i: substring(k, i, 2)), [k])) AS s FROM l),
p AS (SELECT a.o AS a, b.o AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS x, len(b.s) AS y FROM b a JOIN b ON a.g = b.g AND a.o < b.o)
SELECT a, b, round(CAST(i AS DOUBLE) / (x + y - i), 6) AS similarity FROM p WHERE CAST(i AS DOUBLE) / (x + y - i) >= 0.6""")
def near_dup_pairs(spark, sf_dir):
    """Customers of one nation whose numbers share most pairs of digits."""
    k = F.substring("c_name", 10, 9)
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("sourceUrl"), k.alias("title"), F.lit(None).cast("string").alias("topic"))
    return resolve.similar_pairs(rows, 0.6, ("g",)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH RECURSIVE e AS (SELECT l_partkey AS p, l_suppkey AS s, l_quantity AS q, min(l_orderkey) AS b FROM lineitem GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT l_orderkey AS a, b FROM lineitem JOIN e ON l_partkey = p AND l_suppkey = s AND l_quantity = q WHERE l_orderkey <> b),
s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(n, m) AS (SELECT a, a FROM s UNION SELECT r.n, s.b FROM r JOIN s ON r.m = s.a)
SELECT n AS node, min(m) AS cluster FROM r GROUP BY n""")
def clusters(spark, sf_dir):
    """Orders linked by a part that both bought of one supplier in one quantity."""
    x, same = table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_quantity"]
    first = x.groupBy(*same).agg(F.min("l_orderkey").alias("b"))
    return resolve.close(x.join(first, same).select(F.col("l_orderkey").alias("a"), "b").filter("a <> b"))


@query()
def merged_notices(spark, sf_dir):
    """Events as announcements of one speaker on a day by several colleges."""
    e = table(spark, sf_dir, "events")
    c = lambda x: F.col(x).cast("string")
    none = F.lit(None).cast("string")
    rows = e.select(F.col("event_id").alias("ord"), F.concat(F.lit("u"), c("event_id")).alias("sourceUrl"), F.col("event_type").alias("college"), none.alias("campus"), F.concat(F.lit("讲座 "), c("user_id")).alias("title"), none.alias("topic"), F.concat(F.lit("王"), F.translate(c("user_id"), "0123456789", "甲乙丙丁戊己庚辛壬癸")).alias("speaker"), F.date_format("ts", "yyyy-MM-dd 00:00:00").alias("lectureStart"), F.when(F.col("value") > 50, "hall").alias("location"), *(none.alias(x) for x in ("speakerTitle", "speakerAffiliation", "speakerBio", "organizer")), F.lit(None).cast("array<struct<sourceUrl:string,college:string,campus:string,title:string>>").alias("sources"), F.lit(None).cast("boolean").alias("merged"), F.lit(None).cast("int").alias("sourceCount"))
    return resolve.resolve(rows).select("ord", "college", "location", "merged", "sourceCount", F.array_join(F.transform("sources", lambda s: s["college"]), ",").alias("others"))


@query()
def link_extract(spark, sf_dir):
    """P5: every link of every page, by an HTML parser."""
    return links.extract(table(spark, sf_dir, "pages"))


@query("""SELECT CAST(count(*) AS BIGINT) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)""")
def incremental_anti(spark, sf_dir):
    """Documents that are neither labelled nor excluded."""
    url = lambda c: F.concat(F.lit("https://x.test/"), F.col(c).cast("string"), F.lit("/")).alias("url")
    d = table(spark, sf_dir, "documents").select(url("doc_id"), F.lit("s").alias("source"))
    return maintain.unseen(d, table(spark, sf_dir, "labels").select(url("doc_id")), table(spark, sf_dir, "benchmark").select(url("item_id"))).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(s_suppkey, c_custkey) AS k, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS v FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""")
def upsert_rows(spark, sf_dir):
    """Suppliers win over customers of their number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return maintain.upsert(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "k", "k")


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS v FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def upsert_all(spark, sf_dir):
    """Labels win over documents, both whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v"))
    return maintain.upsert(d, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("v")), "doc_id", "doc_id")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)),
h AS (SELECT l_partkey AS k, min(l_orderkey) AS owner FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1)
SELECT m.k, owner, CASE WHEN owner IS NULL THEN 'orphan' ELSE 'swallowed' END AS state FROM m LEFT JOIN h USING (k)""")
def diff_audit(spark, sf_dir):
    """Ordering customers whose number no supplier has, and the first order whose parts hold it."""
    missing = maintain.difference(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_orderkey").alias("ord"), F.array(F.struct(F.col("l_partkey").alias("sourceUrl"))).alias("sources"))
    return maintain.audit_missing(missing.withColumnRenamed("k", "sourceUrl"), held.withColumnRenamed("k", "sourceUrl")).withColumnRenamed("sourceUrl", "k")


@query("""SELECT s_suppkey AS k, coalesce(n_name, s_name) AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey WHERE s_suppkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT -r_regionkey - 1, r_name FROM region""")
def overlay_patch(spark, sf_dir):
    """Suppliers patched by nations of their number, those of regions' numbers excluded, regions added."""
    t = lambda name, k, n: table(spark, sf_dir, name).select(F.col(k).cast("bigint").alias("k"), F.col(n).alias("name"))
    region = t("region", "r_regionkey", "r_name")
    return maintain.overlay(t("supplier", "s_suppkey", "s_name"), t("nation", "n_nationkey", "n_name"), region, region.withColumn("k", -F.col("k") - 1), "k", ["name"])


@query("""SELECT coalesce(s_suppkey, c_custkey) AS k, CASE WHEN s_suppkey IS NULL THEN c_acctbal END AS v FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""")
def map_merge(spark, sf_dir):
    """Whole rows of the right table win, nulls included."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return maintain.right_wins(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(None).cast("double").alias("v")), "k")


@query("""SELECT coalesce(p_partkey, s_suppkey) AS k, CASE WHEN p_partkey IS NULL THEN s_acctbal ELSE p_retailprice END AS v FROM supplier FULL JOIN part ON p_partkey = s_suppkey""")
def map_merge_all(spark, sf_dir):
    """Every part over every supplier of its number."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return maintain.right_wins(s, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), "k")


@query("""SELECT s_suppkey AS k, greatest(0, s_acctbal, coalesce(p_retailprice, 0)) AS v FROM supplier LEFT JOIN part ON p_partkey = s_suppkey""")
def greatest_merge(spark, sf_dir):
    """J11."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.greatest(F.lit(0), F.col("s_acctbal")).alias("v"))
    return maintain.greatest_merge(s, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), "k", "v")


ACCEPTED = """RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
a(user_id, k, last, hit) AS (
  SELECT user_id, k, ts, true FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, CASE WHEN e.ts - a.last >= INTERVAL 6 HOUR THEN e.ts ELSE a.last END, e.ts - a.last >= INTERVAL 6 HOUR FROM a JOIN e ON e.user_id = a.user_id AND e.k = a.k + 1)"""


@query(f"WITH {ACCEPTED} SELECT user_id, last AS ts FROM a WHERE hit")
def throttle_visits(spark, sf_dir):
    """Six hours, at which the last accepted visit matters."""
    return counters.accepted(table(spark, sf_dir, "events"), ["user_id"], seconds=6 * 3600)


@query(f"WITH {ACCEPTED} SELECT CAST(last AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM a WHERE hit GROUP BY 1")
def day_counter(spark, sf_dir):
    """A14."""
    return counters.per_day(counters.accepted(table(spark, sf_dir, "events"), ["user_id"], seconds=6 * 3600))


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')),
a(user_id, k, n) AS (SELECT user_id, k, greatest(0, d) FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, greatest(0, a.n + e.d) FROM a JOIN e ON e.user_id = a.user_id AND e.k = a.k + 1)
SELECT user_id, CAST(arg_max(n, k) AS BIGINT) AS likes FROM a GROUP BY 1""")
def like_floor(spark, sf_dir):
    """A15."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error")).withColumn("d", F.when(F.col("event_type") == "purchase", 1).otherwise(-1))
    return counters.likes(e, "user_id", "d", ["ts", "event_id"])


@query("""SELECT v.event_id, p.event_id AS next_value FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON v.user_id = p.user_id AND v.ts <= p.ts""")
def next_event_asof(spark, sf_dir):
    """Each view's next purchase by its user."""
    e = table(spark, sf_dir, "events")
    return sessions.next_value(e, "user_id", "ts", "event_type", "view", "purchase", "event_id").select("event_id", "next_value")


@query("""SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 99) AS "end" FROM conversations""")
def block_bounds(spark, sf_dir):
    """W2."""
    return sessions.block_ends(table(spark, sf_dir, "conversations").withColumn("len", F.lit(99).cast("bigint")), "conv_id", "turn", "len").select("conv_id", "turn", "end")


@query("""SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS role FROM conversations""")
def turn_inherit(spark, sf_dir):
    """W4."""
    c = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, F.col("role")))
    return sessions.inherit(c, "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, CAST(row_number() OVER w + 4 AS INTEGER) AS "lectureIndex", CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS "lectureCount", CASE WHEN row_number() OVER w = 1 THEN 1 ELSE 0 END AS "sourceCount" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def numbering(spark, sf_dir):
    """W5."""
    return sessions.number(table(spark, sf_dir, "conversations"), "conv_id", "turn", 5).select("conv_id", "turn", "lectureIndex", "lectureCount", "sourceCount")


@query("""WITH s AS (SELECT l_orderkey AS k, l_returnflag AS f, arg_max(l_partkey, l_linenumber * 10000000 + l_partkey) AS v, min(l_linenumber * 10000000 + l_partkey) AS slot FROM lineitem GROUP BY 1, 2) SELECT * FROM s""")
def last_in_first_slot(spark, sf_dir):
    """W3."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("v"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"))
    return sessions.last_in_first_slot(rows, "k", "f", "pos", "v")


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS pos, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) AS slot, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) SELECT k, pos, slot FROM r WHERE n = 1""")
def session_dedup(spark, sf_dir):
    """W6."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("topic"), F.col("l_linestatus").alias("start"), F.col("l_quantity").alias("rich"))
    return sessions.dedup_sessions(rows, "k", "topic", "start", "rich", "pos").select("k", "pos", "slot")


# Texts of notices made of the tables' values, as one expression for Spark and for the SQL
# beside it; the functions under test are Spark's only, and the SQL computes them anew.
_DATE = "CAST(o_orderdate + INTERVAL 30 YEAR AS DATE)"
_DAY = f"CAST({_DATE} AS STRING)"
_Y, _M, _D = (f"substring({_DAY}, {at}, {n})" for at, n in ((1, 4), (6, 2), (9, 2)))
_BARE_M, _BARE_D = (f"CAST(CAST({x} AS INT) AS STRING)" for x in (_M, _D))

TITLE = f"concat(CASE o_orderkey % 3 WHEN 0 THEN '学术 报告' WHEN 1 THEN '讲座' ELSE '' END, o_orderpriority, CASE o_orderkey % 5 WHEN 0 THEN '（石牌）' WHEN 1 THEN '(a b)' WHEN 2 THEN ' 2026-06-25（x）' ELSE '' END, CASE o_orderkey % 4 WHEN 0 THEN {_DAY} WHEN 1 THEN replace({_DAY}, '-', '') WHEN 2 THEN replace({_DAY}, '-', '/') ELSE '' END)"
SPEAKER = "concat(CASE c_custkey % 4 WHEN 0 THEN ' ' ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN '' ELSE c_name END, CASE c_custkey % 7 WHEN 0 THEN '教授' WHEN 1 THEN '副教授' WHEN 2 THEN '博士教授' WHEN 3 THEN ' 讲师' WHEN 4 THEN '博士后研究员' WHEN 5 THEN '博士生导师' ELSE '' END)"
URL = f"concat('https://x.test', CASE o_orderkey % 6 WHEN 0 THEN concat('/a/', {_Y}, {_M}, {_D}, '/x.html') WHEN 1 THEN concat('/a/', {_Y}, '/', {_M}, {_D}, '/') WHEN 2 THEN concat('/n/', {_Y}, '/', {_M}, {_D}, '/x.htm') WHEN 3 THEN concat('/n/', {_Y}, '/', {_BARE_M}, '/', {_BARE_D}, '/x.html') WHEN 4 THEN concat('/a/', {_Y}, {_D}, {_M}, '/') ELSE '/about.html' END)"
LIST_URL = "concat('/xs/', CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_orderkey AS STRING), '.html') WHEN 1 THEN '' WHEN 2 THEN 'index.html' ELSE concat(o_orderstatus, '//') END)"
STARTED = f"CASE WHEN o_orderkey % 4 = 0 THEN concat({_DAY}, ' 15:00:00') END"
PUBLISHED = f"CASE o_orderkey % 3 WHEN 0 THEN concat(' ', {_DAY}) WHEN 1 THEN 'soon' END"
YEAR_TITLE = f"CASE o_orderkey % 5 WHEN 0 THEN concat('研讨', {_Y}, '年') WHEN 1 THEN '研讨' END"
HELD = f"concat({_DAY}, CASE o_orderkey % 2 WHEN 0 THEN ' 00:00:00' ELSE ' 15:00:00' END)"
TOLD = f"concat(CAST({_DATE} + CAST(o_custkey % 5 - 2 AS INT) AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' 20:00:00' WHEN 1 THEN ' 09:00:00' ELSE '' END)"
TOLD_BY = "CASE WHEN o_orderkey % 7 = 0 THEN 'url_proxy' END"
NAME = "concat(substring('张王李赵', CAST(o_orderkey % 5 AS INT) + 1, 2), CASE o_custkey % 6 WHEN 0 THEN '通知' WHEN 1 THEN ' ,12' WHEN 2 THEN o_orderpriority WHEN 3 THEN '敬请' WHEN 4 THEN '三' ELSE CAST(o_custkey AS STRING) END)"
NEWS_TITLE = "CASE doc_id % 8 WHEN 0 THEN '我院举办学术讲座' WHEN 1 THEN '关于举办学术讲座的通知' WHEN 2 THEN '讲座回顾：诗歌' WHEN 3 THEN '回顾与展望' WHEN 4 THEN '论坛圆满落幕' WHEN 5 THEN '我院师生参加会议' ELSE coalesce(source, '') END"
NEWS_BODY = "concat(coalesce(text, ''), CASE doc_id % 9 WHEN 0 THEN '初审：甲 复审：乙 终审：丙' WHEN 1 THEN '讲座圆满结束。' WHEN 2 THEN '2025年5月3日，报告会在礼堂顺利举办' WHEN 3 THEN '时间：2025年5月3日 报告会在礼堂顺利举办' WHEN 4 THEN '会议成功召开' ELSE '' END)"
SEGMENT = f"CASE o_orderkey % 6 WHEN 0 THEN concat({_Y}, '年', {_BARE_M}, '月', {_BARE_D}, '日 下午', CAST(o_custkey % 12 + 1 AS STRING), '点半') WHEN 1 THEN concat('时间：', {_DAY}, ' 14:30-16:00') WHEN 2 THEN concat({_BARE_M}, '月', {_BARE_D}, '日 上午9：', {_D}) WHEN 3 THEN concat({_M}, '/', {_D}) WHEN 4 THEN concat({_Y}, '年', {_BARE_M}, '月3', CAST(o_custkey % 3 AS STRING), '日 晚上7:05') ELSE o_orderpriority END"


def _ymd(text: str, pattern: str, year: str | None = None) -> str:
    """SQL for the date that a pattern's groups make, or null."""
    part = lambda k: f"regexp_extract({text}, '{pattern}', {k})"
    y, m, d = (part(1), part(2), part(3)) if year is None else (f"'{year}'", part(1), part(2))
    return f"try_cast(concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) AS DATE)"


def _has_any(text: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


@query()
def document_titles(spark, sf_dir):
    """C1, F6-F8, F14 over every document."""
    t, none = F.col("text"), F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_title(t).alias("bare"), T.normalize_speaker(t).alias("speaker"), P.is_speaker(t).alias("ok"), P.news_rule(t, t, none).alias("rule"))


@query()
def page_dates(spark, sf_dir):
    """D11, D19 over the address of every page."""
    return table(spark, sf_dir, "pages").select("page_id", D.date_in_url(F.col("url")).cast("string").alias("day"), D.next_page(F.col("url")).alias("following"))


@query()
def document_times(spark, sf_dir):
    """D1-D3, D17 over the text of every document."""
    seg, none = D.segment_time(F.col("text"), F.lit(2024), F.lit(None).cast("date")), F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", D.year_of(none, none, F.col("text")).alias("year"), seg["start"].cast("string").alias("s"), seg["end"].cast("string").alias("e"))


@query()
def late_events(spark, sf_dir):
    """F5 over every event: held at its time, published on the next day."""
    return table(spark, sf_dir, "events").select("event_id", P.is_late(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format(F.date_add("ts", 1), "yyyy-MM-dd 00:00:00"), F.lit(None).cast("string")).alias("late"))


@query(rf"""WITH t AS (SELECT o_orderkey, {TITLE} AS title FROM orders)
SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(title, '\s+', '', 'g'), '[（(][^）)]*[）)]$', ''), '(20[0-9]{{2}}[-/]?[0-9]{{2}}[-/]?[0-9]{{2}}|20[0-9]{{6}})$', '') AS bare FROM t""")
def normalised_titles(spark, sf_dir):
    """Titles with brackets and dates, one an order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_title(F.expr(TITLE)).alias("bare"))


@query(f"SELECT c_custkey, trim({reduce(lambda c, t: rf"regexp_replace({c}, '^(.+){t}$', '\1')", T.TITLES, f'trim({SPEAKER})')}) AS bare FROM customer")
def normalised_speakers(spark, sf_dir):
    """Names with titles, one a customer."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize_speaker(F.expr(SPEAKER)).alias("bare"))


_URL_FORMS = (r"/a/(20[0-9]{2})([0-9]{2})([0-9]{2})/", r"/a/(20[0-9]{2})/([0-9]{2})([0-9]{2})/", r"/(20[0-9]{2})/([0-9]{2})([0-9]{2})/[^/]+\.html?$", r"/(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})/[^/]+\.html?$")


@query(f"""WITH t AS (SELECT o_orderkey, {URL} AS url FROM orders) SELECT o_orderkey, CAST(coalesce({', '.join(_ymd('url', p) for p in _URL_FORMS)}) AS VARCHAR) AS day FROM t""")
def url_dates(spark, sf_dir):
    """Addresses of four forms, some with impossible days, one an order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", D.date_in_url(F.expr(URL)).cast("string").alias("day"))


@query(rf"""WITH t AS (SELECT o_orderkey, {LIST_URL} AS url FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(url, '/[0-9]+\.html$') THEN concat('/xs/', CAST(regexp_extract(url, '([0-9]+)\.html$', 1) AS BIGINT) + 1, '.html') WHEN ends_with(url, '/') THEN concat(rtrim(url, '/'), '/2.html') END AS following FROM t""")
def next_pages(spark, sf_dir):
    """Addresses of lists, one an order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", D.next_page(F.expr(LIST_URL)).alias("following"))


@query(f"""WITH t AS (SELECT o_orderkey, {STARTED} AS s, {PUBLISHED} AS p, {YEAR_TITLE} AS t FROM orders)
SELECT o_orderkey, coalesce(substring(s, 1, 4), CASE WHEN regexp_matches(substring(trim(p), 1, 4), '^[0-9]+$') THEN substring(trim(p), 1, 4) END, nullif(regexp_extract(t, '[0-9]{{4}}'), ''), '其他') AS year FROM t""")
def notice_years(spark, sf_dir):
    """Years from start, publishing or title, one an order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", D.year_of(F.expr(STARTED), F.expr(PUBLISHED), F.expr(YEAR_TITLE)).alias("year"))


@query(f"""WITH t AS (SELECT o_orderkey, CAST({HELD} AS TIMESTAMP) AS s, CASE WHEN length({TOLD}) = 19 THEN CAST({TOLD} AS TIMESTAMP) END AS p, coalesce({TOLD_BY}, '') AS told_by FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN told_by = 'url_proxy' THEN date_diff('day', s, p) > 1 WHEN strftime(s, '%H:%M:%S') <> '00:00:00' THEN p > s ELSE date_diff('day', s, p) > 0 END, false) AS late FROM t""")
def late_notices(spark, sf_dir):
    """notices told of up to two days before and after they are held, one an order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", P.is_late(F.expr(HELD), F.expr(TOLD), F.expr(TOLD_BY)).alias("late"))


@query(rf"""WITH t AS (SELECT o_orderkey, {NAME} AS n FROM orders) SELECT o_orderkey, length(n) BETWEEN 2 AND 15 AND NOT {_has_any('n', P.NO_NAME)} AND regexp_matches(n, '[\pL\pM]') AS ok FROM t""")
def speaker_names(spark, sf_dir):
    """names, words of forms, numbers, one an order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", P.is_speaker(F.expr(NAME)).alias("ok"))


@query(f"""WITH t AS (SELECT doc_id, {NEWS_TITLE} AS t, {NEWS_BODY} AS b FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(b, '{P.RETRO_STRONG}') THEN 'retro-summary'
  WHEN NOT regexp_matches(t, '通知|预告|公示|启事|将|拟|定于') AND regexp_matches(t, '举办|开展|举行') AND regexp_matches(t, '讲座|报告会|学术报告') THEN 'title-conduct'
  WHEN regexp_matches(t, '回顾([^与及·、—－和]|$)') AND NOT regexp_matches(t, '{P.TITLE_AHEAD}') THEN 'title-retro'
  WHEN regexp_matches(t, '{P.TITLE_DONE}') THEN 'title-done'
  WHEN regexp_matches(b, '终审[:：]') THEN 'signature-block'
  WHEN regexp_matches(b, '20[0-9]{{2}}年[0-9]{{1,2}}月[0-9]{{1,2}}日.{{0,50}}{P.DONE}') THEN 'narrative-completion'
  WHEN regexp_matches(t, '^我院.{{0,14}}参加') THEN 'title-participate'
  WHEN length(b) >= 30 AND NOT regexp_matches(b, '(时间|地点|主讲|主办|承办)[\\s:：．·0-9一-龥]')
    AND {' + '.join(f"CAST(contains(b, '{m}') AS INT)" for m in P.MARKERS)} >= CASE WHEN length(b) > 200 THEN 1 ELSE 2 END THEN 'narrative-process' END AS rule FROM t""")
def news_rules(spark, sf_dir):
    """The whole text of every document with a title and an ending of reports."""
    return table(spark, sf_dir, "documents").select("doc_id", P.news_rule(F.expr(NEWS_TITLE), F.expr(NEWS_BODY), F.lit(None).cast("string")).alias("rule"))


@query(f"""WITH g AS (SELECT o_orderkey, replace({SEGMENT}, ' ', '') AS g FROM orders),
h AS (SELECT *, CASE WHEN regexp_matches(g, '[0-9]{{4}}年') THEN {_ymd('g', '([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})[日号]')} WHEN regexp_matches(g, '[0-9]-[0-9]{{2}}-[0-9]') THEN {_ymd('g', '([0-9]{4})-([0-9]{2})-([0-9]{2})')} WHEN contains(g, '月') THEN {_ymd('g', '([0-9]{1,2})月([0-9]{1,2})', '2024')} ELSE {_ymd('g', '([0-9]{1,2})/([0-9]{1,2})', '2024')} END AS d,
  regexp_extract_all(g, '([0-9]{{1,2}})[:：]([0-9]{{2}})', 1) AS hs, regexp_extract_all(g, '([0-9]{{1,2}})[:：]([0-9]{{2}})', 2) AS ms, regexp_extract(g, '([0-9]{{1,2}})点', 1) AS said, CASE WHEN regexp_matches(g, '下午|晚上') THEN 12 ELSE 0 END AS more FROM g),
c AS (SELECT *, CASE WHEN len(hs) = 0 AND said <> '' THEN [said] ELSE hs END AS hh, CASE WHEN len(hs) = 0 AND contains(g, '半') THEN ['30'] ELSE ms END AS mm FROM h),
k AS (SELECT *, [CASE WHEN CAST(x AS INT) < 12 THEN CAST(x AS INT) + more ELSE CAST(x AS INT) END for x in hh] AS h24 FROM c)
SELECT o_orderkey, concat_ws(' ', CAST(d AS VARCHAR), CASE WHEN d IS NULL THEN NULL WHEN len(h24) = 0 THEN '00:00:00' ELSE concat(lpad(CAST(h24[1] AS VARCHAR), 2, '0'), ':', mm[1], ':00') END) AS s,
  CASE WHEN d IS NOT NULL AND len(h24) > 1 THEN concat(CAST(d AS VARCHAR), ' ', lpad(CAST(h24[2] AS VARCHAR), 2, '0'), ':', mm[2], ':00') END AS e FROM k""")
def segment_times(spark, sf_dir):
    """Times as notices write them, some on impossible days, one an order; no start is
    an empty text."""
    t = D.segment_time(F.expr(SEGMENT), F.lit(2024), F.lit(None).cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(t["start"].cast("string"), F.lit("")).alias("s"), t["end"].cast("string").alias("e"))


BODY = f"concat('报名时间：2020年1月1日', chr(10), CASE o_orderkey % 4 WHEN 0 THEN concat('讲座时间：', {_DAY}, ' 14:30-16:00') WHEN 1 THEN concat('举办讲座的时间：', {_BARE_M}, '月', {_BARE_D}, '日 上午9:05') WHEN 2 THEN concat('地点：石牌 ', {_DAY}) ELSE concat('讲座时间：', {_BARE_M}, '月', {_BARE_D}, '日') END)"
BODY_TOLD = f"CASE WHEN o_orderkey % 3 = 0 THEN concat({_Y}, '-01-05') END"


@query(f"""WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS form, {_DATE} AS d, {BODY_TOLD} AS told FROM orders),
f AS (SELECT *, CASE WHEN form = 0 AND CAST(d AS VARCHAR) = told THEN DATE '2020-01-01' WHEN form IN (0, 2) THEN d ELSE try_cast(concat(CASE WHEN told IS NULL THEN '2024' ELSE substring(told, 1, 4) END, substring(CAST(d AS VARCHAR), 5)) AS DATE) END AS own FROM t)
SELECT o_orderkey, CASE form WHEN 2 THEN '2020-01-01 00:00:00' ELSE concat(CAST(own AS VARCHAR), CASE form WHEN 0 THEN ' 14:30:00' WHEN 1 THEN ' 09:05:00' ELSE ' 00:00:00' END) END AS s, CASE WHEN form = 0 THEN concat(CAST(own AS VARCHAR), ' 16:00:00') END AS e,
  CASE WHEN form = 0 AND year(own) > 2020 THEN 'authoritative-label' WHEN form IN (0, 2) THEN 'general-body-full' WHEN told IS NULL THEN 'monthday-nopublish' WHEN CAST(own AS VARCHAR) = told THEN 'same-day-normal' ELSE 'same-year' END AS note FROM f""")
def lecture_times(spark, sf_dir):
    """Bodies with labels of several strengths, dates with and without a year, one an order.
    A date that is the time of publishing doesn't count, so the day of entry is left there."""
    none = F.lit(None).cast("int")
    t = L.lecture_time(F.expr(BODY), F.lit("x"), none, none, F.expr(BODY_TOLD), F.lit(2024))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", F.col("t.start").cast("string").alias("s"), F.col("t.end").cast("string").alias("e"), F.col("t.note").alias("note"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'copyright') THEN 'a' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'b' WHEN starts_with(text, 'The') THEN 'c' END AS rule FROM documents""")
def classify_first_rule(spark, sf_dir):
    """F6's shape over all documents: the first rule that holds."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.lower(t).contains("copyright"), "a").when(t.rlike("[0-9]{3}-[0-9]{4}"), "b").when(t.startswith("The"), "c").alias("rule"))
