"""Scans, joins, aggregates, sorts and changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins, mutate
from ..sources.tables import last_rows
from .registry import query

ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice AS price FROM lineitem")
def scan_projection(t):
    return t.lineitem.drop("l_tax", "l_discount").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(t):
    return t.customer.filter("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def index_equality(t):
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount > 0")
def index_range(t):
    return t.lineitem.filter("l_discount > 0").select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT p_partkey, p_name, (SELECT greatest(count(*) - 10, 0) FROM part)::BIGINT AS more FROM part ORDER BY p_partkey LIMIT 10")
def limit_prefix(t):
    more = t.part.agg(F.greatest(F.count("*") - 10, F.lit(0)).cast("long").alias("more"))
    return t.part.orderBy("p_partkey").limit(10).select("p_partkey", "p_name").crossJoin(F.broadcast(more))


@query("SELECT 'orders' AS tbl, count(*) AS n, count(*) = 0 AS is_empty FROM orders UNION ALL SELECT 'none', count(*), count(*) = 0 FROM orders WHERE o_orderkey < 0")
def global_counts(t):
    def one(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n", (F.col("n") == 0).alias("is_empty"))

    return one(t.orders, "orders").union(one(t.orders.filter("o_orderkey < 0"), "none"))


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS chats FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def chat_count_badge(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("chats"))


@query("""SELECT c_custkey, coalesce(opened, added) AS sort_key FROM (SELECT c_custkey, c_custkey * 100000000 AS added, max(epoch_ms(o_orderdate)) AS opened
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1) ORDER BY sort_key DESC, c_custkey DESC""")
def recent_or_added(t):
    opened = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(ms("o_orderdate")).alias("opened"))
    key = F.coalesce("opened", F.col("c_custkey") * 100000000)
    return t.customer.join(opened, "c_custkey", "left").select("c_custkey", key.alias("sort_key")).orderBy(F.desc("sort_key"), F.desc("c_custkey"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::BIGINT AS place FROM orders")
def recent_conversations(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT state, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM (SELECT c_custkey, CASE WHEN coalesce(CASE WHEN c_acctbal < 0 THEN c_custkey WHEN c_acctbal < 1000 THEN 0 END, 0) = 0 THEN 'active' ELSE 'archived' END AS state FROM customer) GROUP BY 1")
def active_archived_split(t):
    archived_at = F.when(F.col("c_acctbal") < 0, F.col("c_custkey")).when(F.col("c_acctbal") < 1000, 0)
    rows = t.customer.withColumn("at", F.coalesce(archived_at, F.lit(0)))
    return rows.groupBy(F.when(F.col("at") == 0, "active").otherwise("archived").alias("state")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("""SELECT l_orderkey, l_linenumber, c_name, n_name, s_acctbal FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def context_gather(t):
    some = t.supplier.filter("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.join(some, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "c_name", "n_name", "s_acctbal")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1")
def first_match(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.first_match(t.customer.select("c_custkey"), orders, "c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_children(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, p_name, n_marks FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT l_partkey AS pk, count(DISTINCT l_suppkey) AS n_marks FROM lineitem GROUP BY 1) ON pk = l_partkey WHERE p_type LIKE '%BRASS%' OR p_size > 40")
def spine_join(t):
    items = t.part.filter("p_type LIKE '%BRASS%' OR p_size > 40").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    marks = t.lineitem.groupBy("l_partkey").agg(F.size(F.collect_set("l_suppkey")).cast("long").alias("n_marks"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(items, "l_partkey").join(marks, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_name", "n_marks")


@query("""WITH u AS (SELECT o_custkey AS k, 0 AS src, o_orderkey AS v FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders)
SELECT k, src, v FROM (SELECT *, min(src) OVER (PARTITION BY k) AS best FROM u) WHERE src = best""")
def source_fallback(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderstatus", F.col("o_orderkey").alias("v"))
    # a row belongs to each source it qualifies for; one scan instead of three
    sources = F.explode(F.when(F.col("o_orderstatus") == "P", F.array(F.lit(0), F.lit(2))).when(F.col("o_orderstatus") == "O", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    u = o.select("k", sources.alias("src"), "v")
    return u.withColumn("best", F.min("src").over(Window.partitionBy("k"))).filter("src = best").select("k", "src", "v")


@query("SELECT o_custkey, (array_agg(o_totalprice ORDER BY o_orderkey) FILTER (WHERE o_totalprice > 200000))[1] AS first_large, coalesce(max(o_orderpriority) FILTER (WHERE o_orderstatus = 'P'), 'none') AS priority FROM orders GROUP BY 1")
def first_non_null(t):
    large = F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))
    return t.orders.groupBy("o_custkey").agg(
        F.min_by("o_totalprice", F.when(large.isNotNull(), F.col("o_orderkey"))).alias("first_large"),
        F.coalesce(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))), F.lit("none")).alias("priority"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)), lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS tbl, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost)""")
def cascade_delete(t):
    lines = t.lineitem.select("l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("line"))
    kept = mutate.cascade_delete(t.customer.select("c_custkey"), t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey"), "c_custkey",
                                 (t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"), (lines, "l_orderkey", "line"))
    count = lambda df, name, key: df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"), F.sum(key).alias("keys"))
    return count(kept[0], "customer", "c_custkey").union(count(kept[1], "orders", "o_orderkey")).union(count(kept[2], "lineitem", "l_orderkey"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 40 AS k, s_name AS name FROM supplier WHERE s_suppkey * 40 NOT IN (SELECT c_custkey FROM customer)")
def insert_if_absent(t):
    return mutate.insert_if_absent(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t.supplier.select((F.col("s_suppkey") * 40).alias("k"), F.col("s_name").alias("name")), "k")


@query("""SELECT k, v, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY new DESC, ver DESC) AS n FROM (
SELECT c_custkey AS k, 0 AS ver, c_acctbal AS v, 'old' AS src, 0 AS new FROM customer UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 'new', 1 FROM orders WHERE o_orderstatus = 'P')) WHERE n = 1""")
def upsert_latest(t):
    have = t.customer.select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("ver"), F.col("c_acctbal").alias("v"), F.lit("old").alias("src"))
    rows = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ver"), F.col("o_totalprice").alias("v"), F.lit("new").alias("src"))
    return mutate.upsert_latest(have, rows, "k", "ver").select("k", "v", "src")


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL AND s_acctbal > 5000 THEN NULL ELSE c_name END AS c_name, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS c_acctbal
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def patch_update(t):
    p = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), (F.col("s_acctbal") > 5000).alias("has_c_name"), F.col("s_acctbal").alias("c_acctbal"), F.lit(True).alias("has_c_acctbal"))
    return mutate.patch(t.customer.select("c_custkey", "c_name", "c_acctbal"), p, "c_custkey")


@query("""WITH b AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS tm FROM documents),
f AS (SELECT h, min_by(doc_id, tm) AS r FROM b WHERE tm > 0 GROUP BY h) SELECT b.doc_id, f.r AS restored_id, f.r IS NULL AS added FROM b LEFT JOIN f USING (h) WHERE b.tm IS NULL""")
def archive_restore(t):
    b = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("at"))
    return mutate.restore_match(b, b.filter("at is null"), "h", "doc_id", "at").select("doc_id", "restored_id", F.col("restored_id").isNull().alias("added"))


@query("""SELECT c_custkey, CASE WHEN ok THEN o_orderpriority ELSE c_mktsegment END AS val, ok AS applied FROM (SELECT c_custkey, c_mktsegment, o_orderpriority, coalesce(o_custkey IS NOT NULL AND (CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END) IS NOT DISTINCT FROM expected AND o_orderpriority <> '', false) AS ok
FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN min(o_orderkey) % 2 = 1 THEN 1 END AS expected, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1) ON o_custkey = c_custkey)""")
def optimistic_merge(t):
    have = t.customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 4).alias("version"))
    u = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.min("o_orderkey") % 2 == 1, 1).alias("expected"), F.min("o_orderpriority").alias("p"))
    out = mutate.compare_and_set(have, u, "c_custkey", "version", F.col("p"))
    return out.select("c_custkey", F.when(F.col("applied"), F.col("proposed")).otherwise(F.col("c_mktsegment")).alias("val"), "applied")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(t):
    return last_rows(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT c_mktsegment, bool_and(c_acctbal > 0) AS all_positive, bool_or(c_acctbal < -900) AS any_low, count(DISTINCT c_custkey) = count(*) AS keys_unique FROM customer GROUP BY 1")
def bool_aggregates(t):
    return t.customer.groupBy("c_mktsegment").agg(F.bool_and(F.col("c_acctbal") > 0).alias("all_positive"), F.bool_or(F.col("c_acctbal") < -900).alias("any_low"), (F.count_distinct("c_custkey") == F.count("*")).alias("keys_unique"))


@query("SELECT p_brand, list_aggregate(list_sort(list(DISTINCT p_size::VARCHAR)), 'string_agg', ',') AS sizes FROM part GROUP BY 1")
def distinct_sets(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"))


@query("SELECT l_orderkey, l_returnflag, min(l_linenumber)::BIGINT AS first_at FROM lineitem GROUP BY 1, 2")
def first_position(t):
    return t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").cast("long").alias("first_at"))


@query("SELECT 'doc' AS src, doc_id AS id, length(text)::BIGINT AS n FROM documents UNION ALL SELECT 'bench', item_id, length(text)::BIGINT FROM benchmark")
def union_all_parts(t):
    n = F.length("text").cast("long").alias("n")
    return t.documents.select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), n).union(t.benchmark.select(F.lit("bench"), "item_id", n))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'part#1')")
def title_contains(t):
    name = F.lower("p_name")
    return t.part.filter(F.contains(name, F.lit("red")) | F.contains(name, F.lit("part#1"))).select("p_partkey", "p_name")


@query("SELECT event_id, list_contains(['click', 'view', 'signup'], event_type) AS allowed FROM events")
def membership_filter(t):
    allowed = F.transform(F.split(F.lit(" click , view,signup "), ","), lambda x: F.trim(x))
    return t.events.select("event_id", F.array_contains(allowed, F.col("event_type")).alias("allowed"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS id, p_partkey // 7 AS up, p_name AS label FROM part), r AS (SELECT id, 0 AS depth, id::VARCHAR AS path FROM e WHERE up = 0 UNION ALL SELECT e.id, r.depth + 1, r.path || '/' || e.id FROM e JOIN r ON e.up = r.id AND e.up > 0)
SELECT id, depth::BIGINT AS depth, path FROM r""")
def flatten_toc(t):
    e = t.part.select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 7").alias("up"))
    return joins.flattened(e, "id", "up", F.col("up") == 0)


@query("""WITH b AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS file, CASE WHEN c_custkey % 2 = 0 THEN 'h' || (c_custkey % 40) END AS hash, CASE WHEN c_custkey % 10 = 7 THEN c_custkey END AS archived_at FROM customer)
SELECT id, title, CASE WHEN id % 5 > 0 THEN file END AS file, CASE WHEN id % 5 = 0 THEN coalesce(hash, sha256(file)) ELSE hash END AS hash, CASE WHEN id % 5 = 0 THEN 99 ELSE archived_at END::BIGINT AS archived_at FROM b""")
def archive_step(t):
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("file"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h"), (F.col("c_custkey") % 40).cast("string"))).alias("hash"),
                          F.when(F.col("c_custkey") % 10 == 7, F.col("c_custkey")).alias("archived_at"))
    return mutate.archived(b, b.filter("id % 5 = 0"), "id", "file", "hash", "archived_at", F.lit(99).cast("long"))


@query("""WITH b AS (SELECT c_custkey AS id, c_name AS title, 'h' || c_custkey AS hash, c_custkey * 2 AS added_at, c_acctbal AS position, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS archived_at FROM customer),
i AS (SELECT s_suppkey + 1000000 AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS title, 'h' || s_suppkey AS hash, 5::BIGINT AS added_at FROM supplier)
SELECT b.id, CASE WHEN b.archived_at IS NOT NULL AND i.id IS NOT NULL THEN coalesce(i.title, b.title) ELSE b.title END AS title, b.hash, b.added_at, b.position, CASE WHEN i.id IS NULL THEN b.archived_at END AS archived_at FROM b LEFT JOIN i ON i.hash = b.hash AND b.archived_at > 0
UNION ALL SELECT i.id, i.title, i.hash, i.added_at, NULL, NULL FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.hash = i.hash AND b.archived_at > 0)""")
def restore_overlay(t):
    k = F.col("c_custkey")
    b = t.customer.select(k.alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("h"), k.cast("string")).alias("hash"), (k * 2).alias("added_at"), F.col("c_acctbal").alias("position"), F.when(k % 2 == 0, k).alias("archived_at"))
    s = F.col("s_suppkey")
    new = t.supplier.select((s + 1000000).alias("id"), F.when(s % 3 > 0, F.col("s_name")).alias("title"), F.concat(F.lit("h"), s.cast("string")).alias("hash"), F.lit(5).cast("long").alias("added_at"))
    return mutate.restored(b, new, "hash", "id", "archived_at", "added_at")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'left' END AS a, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS b, 'left' AS c FROM nation")
def map_merge(t):
    """Two maps as one; of a key in both the right value counts."""
    left = F.create_map(F.lit("a"), F.lit("left"), F.lit("c"), F.lit("left"))
    right = F.create_map(F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b"), F.col("n_name"))
    both = F.map_zip_with(left, right, lambda k, x, y: F.coalesce(y, x))
    return t.nation.select("n_nationkey", both["a"].alias("a"), both["b"].alias("b"), both["c"].alias("c"))
