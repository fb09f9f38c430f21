"""Registered queries of the path language and its operators, with the SQL that gives the same rows.

Each works on whole tables. Columns are cast to plain types, so that both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.catalog_functions import FUNCTIONS
from sylvan.operators import axes, grouping, joins, ordering, rules, validation
from sylvan.plans.query import Query, compile_row
from sylvan.plans.tree import Tree
from sylvan.sources import nodes as trees
from sylvan.streaming import records

FLAGSHIP = "group_by_customer"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Order columns of the tables as documents.
ORDER = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"]}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables(Mapping):
    """The tables of a folder as documents, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> tuple[DataFrame, list[str]]:
        return table(self.spark, self.sf_dir, name), ORDER[name]

    def __iter__(self) -> Iterator[str]:
        return iter(ORDER)

    def __len__(self) -> int:
        return len(ORDER)

    def __contains__(self, name: object) -> bool:
        return name in ORDER


def path(name: str, text: str, sql: str, columns: str | None = None) -> None:
    """A query in the path language over all tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Query(Tables(spark, sf_dir)).run(text)
        return out.selectExpr(*columns.split("; ")) if columns else out

    query(name, sql)(run)


def row(name: str, source: str, columns: dict[str, tuple[str, str | None]], sql: str | None, where: str | None = None) -> None:
    """Expressions over each row of a table: column name to (expression, Spark type to cast to)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if where:
            df = df.where(compile_row(where, df.schema))
        made = {c: compile_row(text, df.schema) for c, (text, _) in columns.items()}
        return df.select(*((made[c].cast(t) if t else made[c]).alias(c) for c, (_, t) in columns.items()))

    query(name, sql)(run)


def money(x: str) -> Column:
    """Exact sums: cents."""
    return F.col(x).cast("decimal(18,2)")


# --- grouping


@query(FLAGSHIP, "SELECT o_custkey AS key, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS dearest, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def group_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.group_by(table(spark, sf_dir, "orders"), [F.col("o_custkey")], [F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"), grouping.max_of(F.col("o_totalprice")).alias("dearest")], "o_orderkey")
    return groups.select("key", "n", "total", "dearest", F.col("first_at.o_orderkey").alias("first_order"))


@query("group_first_item", "SELECT o_custkey AS key, arg_min(o_orderpriority, o_orderkey) AS first_priority, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey")
def group_first_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [grouping.first_of(F.col("o_orderpriority"), "o_orderkey").alias("first_priority"), grouping.last_of(F.col("o_orderstatus"), "o_orderkey").alias("last_status")]
    return grouping.group_by(table(spark, sf_dir, "orders"), [F.col("o_custkey")], made, "o_orderkey").drop("first_at")


@query("group_json", "SELECT o_custkey AS key, '{\"n\":' || count(*) || ',\"first\":' || min(o_orderkey) || '}' AS json FROM orders GROUP BY o_custkey")
def group_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.group_by(table(spark, sf_dir, "orders"), [F.col("o_custkey")], [F.count("*").alias("n")], "o_orderkey")
    return groups.select("key", F.to_json(F.struct("n", F.col("first_at.o_orderkey").alias("first"))).alias("json"))


@query("group_composite", "SELECT l_returnflag AS key_1, l_linestatus AS key_2, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY ALL")
def group_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggregates = [F.count("*").alias("n"), F.sum(money("l_quantity")).cast("double").alias("quantity"), F.sum(money("l_extendedprice")).cast("double").alias("price")]
    return grouping.group_by(table(spark, sf_dir, "lineitem"), [F.col("l_returnflag"), F.col("l_linestatus")], aggregates, "l_orderkey", composite=True).drop("first_at")


@query("group_multi_valued", r"SELECT key, count(*) AS n, min(p_partkey) AS first_part FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS key FROM part) GROUP BY key")
def group_multi_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.group_by(table(spark, sf_dir, "part"), [F.split("p_type", " ")], [F.count("*").alias("n")], "p_partkey")
    return groups.select("key", "n", F.col("first_at.p_partkey").alias("first_part"))


@query("group_numbered", "SELECT row_number() OVER (ORDER BY first) AS group_no, key, n FROM (SELECT o_orderpriority AS key, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1)")
def group_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.numbered(grouping.group_by(table(spark, sf_dir, "orders"), [F.col("o_orderpriority")], [F.count("*").alias("n")], "o_orderkey")).select("group_no", "key", "n")


_GROUPED = "SELECT conv_id, group_no, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM ({}) GROUP BY conv_id, group_no"


def _conversation_groups(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = make(table(spark, sf_dir, "conversations"))
        return rows.groupBy("conv_id", F.col("group_no").cast("long").alias("group_no")).agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))

    return run


query("group_adjacent", _GROUPED.format("SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS group_no FROM (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"))(_conversation_groups(lambda df: grouping.adjacent(df, F.col("role"), "turn", ["conv_id"])))
query("group_starting_with", _GROUPED.format("SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS group_no FROM (SELECT *, CASE WHEN role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS s FROM conversations)"))(_conversation_groups(lambda df: grouping.starting_with(df, F.col("role") == "user", "turn", ["conv_id"])))
query("group_ending_with", _GROUPED.format("SELECT *, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS group_no FROM conversations"))(_conversation_groups(lambda df: grouping.ending_with(df, F.col("role") == "assistant", "turn", ["conv_id"])))


@query("current_group", "SELECT o_custkey AS key, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1")
def current_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.group_by(table(spark, sf_dir, "orders"), [F.col("o_custkey")], [grouping.members("o_orderkey", F.col("o_orderkey")).alias("m")], "o_orderkey")
    return groups.select("key", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("distinct_first", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.distinct(table(spark, sf_dir, "events"), F.col("event_type"), "event_id").select("event_type", "event_id")


@query("aggregates", "SELECT c_mktsegment AS key, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, min(c_acctbal) AS low, max(c_acctbal) AS high, CAST(round(avg(c_nationkey), 6) AS DOUBLE) AS mean FROM customer GROUP BY 1")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [F.count("*").alias("n"), grouping.sum_of(money("c_acctbal")).cast("double").alias("total"), grouping.min_of(F.col("c_acctbal")).alias("low"), grouping.max_of(F.col("c_acctbal")).alias("high"), F.round(grouping.avg_of(F.col("c_nationkey"), exact=True).cast("double"), 6).alias("mean")]
    return grouping.group_by(table(spark, sf_dir, "customer"), [F.col("c_mktsegment")], made, "c_custkey").drop("first_at")


@query("accumulator", "SELECT event_id, user_id, CAST(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS acc_before, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS acc_after FROM (SELECT *, CAST(value AS DECIMAL(18,4)) AS v FROM events)")
def accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouping.accumulate(table(spark, sf_dir, "events"), F.col("value").cast("decimal(18,4)"), "event_id", ["user_id"])
    return rows.select("event_id", "user_id", F.col("acc_before").cast("double").alias("acc_before"), F.col("acc_after").cast("double").alias("acc_after"))


@query("running_aggregates", "SELECT event_id, max(value) OVER w AS high, count(*) OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    makes = {"high": lambda w: F.max("value").over(w), "seen": lambda w: F.count("*").over(w)}
    return grouping.running(table(spark, sf_dir, "events"), makes, "event_id", ["user_id"]).select("event_id", "high", "seen")


@query("iterate", "SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(run, event_id) AS total FROM (SELECT *, CAST(sum(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS run FROM events) WHERE run > 100 GROUP BY user_id")
def iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's running total first passes 100: a fold that stops."""
    import math

    def step(state: dict, item: dict) -> tuple[dict, dict | None, bool]:
        total = state["total"] + math.floor(item["value"])
        stop = total > 100
        return {"total": total}, {"event_id": item["event_id"], "total": float(total)} if stop else None, stop

    return grouping.iterate(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], {"total": 0}, step, "user_id long, event_id long, total double")


@query("fork", "SELECT 1 AS branch, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 2, o_orderpriority, count(*) FROM orders GROUP BY ALL")
def fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = [lambda df, c=c: df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")) for c in ("o_orderstatus", "o_orderpriority")]
    return grouping.fork(table(spark, sf_dir, "orders"), *branches, columns=["key", "n"])


# --- paths, predicates, joins

path("path_sum", "sum(/orders/row[o_totalprice > 500]/o_totalprice)", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_totalprice > 500", "round(value, 2) as value")
path("path_count", "count(/lineitem/row[l_quantity gt 10 and l_returnflag = ('A', 'R')])", "SELECT count(*) AS value FROM lineitem WHERE l_quantity > 10 AND l_returnflag IN ('A', 'R')")
path("path_avg", "avg(/part/row[starts-with(p_type, 'S')]/p_size)", "SELECT CAST(round(avg(p_size), 6) AS DOUBLE) AS value FROM part WHERE p_type LIKE 'S%'", "round(cast(value as double), 6) as value")
path("path_min_max", "max(/orders/row[o_orderstatus eq 'F']/o_totalprice)", "SELECT max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F'")
path("path_exists", "exists(/customer/row[c_acctbal < -99999])", "SELECT count(*) > 0 AS value FROM customer WHERE c_acctbal < -99999")
path("path_project", "/customer/row[c_mktsegment = 'BUILDING' or c_acctbal > 9000]/c_name", "SELECT c_name AS value FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000")
path("path_first", "/orders/row[1]", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1")
path("path_nth", "/orders/row[17]/o_orderkey", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 16")
path("path_last", "/orders/row[last()]/o_custkey", "SELECT o_custkey AS value FROM orders ORDER BY o_orderkey DESC LIMIT 1")
path("path_page", "/orders/row[position() > 10][o_orderstatus = 'O']/o_orderkey", "SELECT o_orderkey AS value FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n > 10 AND o_orderstatus = 'O'")
path("path_top", "/orders/row[position() <= 20]/o_orderkey", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey LIMIT 20")
path("path_distinct", "distinct-values(/orders/row/o_orderpriority)", "SELECT DISTINCT o_orderpriority AS value FROM orders")
path("path_string_join", "string-join(/nation/row[n_regionkey = 1]/n_name, '|')", "SELECT string_agg(n_name, '|' ORDER BY n_nationkey) AS value FROM nation WHERE n_regionkey = 1")
path("semi_join", "/customer/row[c_custkey = /orders/row[o_totalprice > 300000]/o_custkey]/c_name", "SELECT c_name AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
path("anti_join", "/customer/row[not(c_custkey = /orders/row/o_custkey)]/c_custkey", "SELECT c_custkey AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
path("theta_semi_join", "count(/supplier/row[s_acctbal > /customer/row[c_nationkey = 3]/c_acctbal])", "SELECT count(*) AS value FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 3 AND s_acctbal > c_acctbal)")
path("union_paths", "/customer/row[c_nationkey = 1] | /customer/row[c_acctbal > 5000]", "SELECT * FROM customer WHERE c_nationkey = 1 OR c_acctbal > 5000")
path("intersect_paths", "/customer/row[c_nationkey = 1] intersect /customer/row[c_acctbal > 5000]", "SELECT * FROM customer WHERE c_nationkey = 1 AND c_acctbal > 5000")
path("except_paths", "/customer/row[c_nationkey = 1] except /customer/row[c_acctbal > 5000]", "SELECT * FROM customer WHERE c_nationkey = 1 AND NOT c_acctbal > 5000")
path("for_join", "for $c in /customer/row, $o in /orders/row[o_custkey = $c/c_custkey][o_totalprice > 200000] return map{'name': $c/c_name, 'order': $o/o_orderkey, 'price': $o/o_totalprice}", "SELECT c_name AS name, o_orderkey AS \"order\", o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000")
path("for_let", "for $p in /part/row[p_size < 10] return let $tax := $p/p_retailprice * 0.1e0 return map{'part': $p/p_partkey, 'tax': round($tax, 2)}", "SELECT p_partkey AS part, floor(p_retailprice * 0.1 * 100.0 + 0.5) / 100.0 AS tax FROM part WHERE p_size < 10")
path("for_three", "for $r in /region/row, $n in /nation/row[n_regionkey = $r/r_regionkey], $s in /supplier/row[s_nationkey = $n/n_nationkey] return map{'region': $r/r_name, 'supplier': $s/s_name}", "SELECT r_name AS region, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
path("quantified_some", "some $c in /customer/row satisfies $c/c_acctbal > 9990", "SELECT coalesce(bool_or(c_acctbal > 9990), false) AS value FROM customer")
path("quantified_every", "every $o in /orders/row satisfies $o/o_totalprice > 0", "SELECT coalesce(bool_and(o_totalprice > 0), true) AS value FROM orders")


@query("key_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 250000")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = joins.key_index(table(spark, sf_dir, "customer"), F.col("c_custkey"))
    return joins.key_lookup(table(spark, sf_dir, "orders").where("o_totalprice > 250000"), F.col("o_custkey"), index).select("o_orderkey", "c_name")


@query("merge", "SELECT coalesce(o_custkey, c_custkey) AS custkey, CAST(coalesce(n, 0) AS BIGINT) AS orders, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) FULL JOIN customer ON o_custkey = c_custkey")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {"o": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "c": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))}
    counts = [F.sum(F.when(F.col("source") == s, 1).otherwise(0)).alias(name) for s, name in (("o", "orders"), ("c", "customers"))]
    return joins.merge(sources, ["custkey"], counts).select("custkey", F.col("orders").cast("long").alias("orders"), F.col("customers").cast("int").alias("customers"))


@query("merge_unsorted", "SELECT count(*) AS n FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before > value")
def merge_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unsorted(table(spark, sf_dir, "events"), ["value"], ["event_id"], ["user_id"]).agg(F.count("*").alias("n"))


@query("zip_rows", "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) USING (n)")
def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.zip_rows(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey"), ["c_custkey"], ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("as_of", "SELECT event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.event_id <= e.event_id) AS seen FROM events e WHERE event_type = 'purchase'")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "event_id", F.col("event_id").alias("seen"))
    return joins.as_of(events.where("event_type = 'purchase'").select("user_id", "event_id"), views, "event_id", ["user_id"], ["seen"]).select("event_id", F.col("asof_seen").alias("seen"))


@query("range_join", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size BETWEEN n_nationkey AND n_nationkey + 2")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 2).alias("end"))
    return joins.range_join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), spans, "p_size", "n_nationkey", "end", 5).select("p_partkey", "n_nationkey")


# --- order


@query("sort_top", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_orderkey, o_totalprice FROM orders QUALIFY pos <= 50")
def sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ordering.top(table(spark, sf_dir, "orders"), [(F.col("o_totalprice"), "double")], ["o_orderkey"], 50, descending=True)
    return first.select(F.row_number().over(_whole("o_totalprice", "o_orderkey")).cast("long").alias("pos"), "o_orderkey", "o_totalprice")


def _whole(value: str, key: str):
    from pyspark.sql import Window

    return Window.orderBy(F.col(value).desc(), F.col(key))  # over the k rows that are left


@query("ordinal", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM orders")
def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.ordinal(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("pos").cast("long").alias("pos"))


@query("positions", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, count(*) OVER (PARTITION BY o_custkey) AS last FROM orders")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.positions(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", F.col("position").cast("long").alias("position"), "last")


@query("nth_and_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 2 UNION ALL SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY 1")
def nth_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return ordering.nth(orders, ["o_custkey"], ["o_orderkey"], 2).unionByName(ordering.nth(orders, ["o_custkey"], ["o_orderkey"], 1, from_end=True))


@query("subsequence", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) BETWEEN 2 AND 3")
def subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.subsequence(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 1.5, 2).select("conv_id", "turn")


@query("siblings", "SELECT event_id, lag(event_type) OVER w AS prev_event_type, lead(event_type) OVER w AS next_event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.siblings(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type"]).select("event_id", "prev_event_type", "next_event_type")


@query("number_single", "SELECT event_id, CASE WHEN event_type = 'click' THEN sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS number FROM events")
def number_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.number_single(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "click").select("event_id", "number")


@query("number_any", "SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id, era ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS number FROM (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS c, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS era FROM events)")
def number_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.number_any(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase").select("event_id", "number")


@query("number_multiple", "SELECT n_name, dense_rank() OVER (ORDER BY n_regionkey) || '.' || dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS number FROM nation")
def number_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.number_multiple(table(spark, sf_dir, "nation"), [([], ["n_regionkey"]), (["n_regionkey"], ["n_nationkey"])]).select("n_name", "number")


# --- expressions

row("strings", "customer", {"c_custkey": ("c_custkey", None), "a": ("upper-case(substring(c_name, 1, 8))", None), "b": ("substring-after(c_name, '#')", None), "c": ("concat(c_mktsegment, '-', c_nationkey)", None), "d": ("string-length(c_name)", "long"), "e": ("translate(c_name, 'Cust', 'cUS')", None), "f": ("contains(c_mktsegment, 'BUILD')", None), "g": ("lower-case(c_mktsegment) || '!'", None), "h": ("normalize-space(concat('  ', c_mktsegment, '   x '))", None)}, "SELECT c_custkey, upper(substring(c_name, 1, 8)) AS a, CASE WHEN instr(c_name, '#') > 0 THEN substring(c_name, instr(c_name, '#') + 1) ELSE '' END AS b, c_mktsegment || '-' || c_nationkey AS c, length(c_name) AS d, replace(translate(c_name, 'Cus', 'cUS'), 't', '') AS e, contains(c_mktsegment, 'BUILD') AS f, lower(c_mktsegment) || '!' AS g, c_mktsegment || ' x' AS h FROM customer")
row("regex", "documents", {"doc_id": ("doc_id", None), "a": ("matches(text, '^[A-Z][a-z]+')", None), "b": ("replace(text, '[aeiou]+', '_')", None), "c": ("count(tokenize(text, '\\s+'))", "long"), "d": ("count(tokenize(text))", "long")}, r"SELECT doc_id, regexp_matches(text, '^[A-Z][a-z]+') AS a, regexp_replace(text, '[aeiou]+', '_', 'g') AS b, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '[ \t\r\n]+')) END AS c, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS d FROM documents")
row("arithmetic", "part", {"p_partkey": ("p_partkey", None), "a": ("p_size idiv 7", "long"), "b": ("p_size mod 7", "long"), "c": ("p_size div 4", "double"), "d": ("-p_size + 3", "long"), "e": ("floor(p_retailprice)", "double"), "f": ("ceiling(p_retailprice)", "double"), "g": ("round(p_retailprice div 10e0)", "double"), "h": ("abs(p_size - 25)", "long"), "i": ("if (p_size > 25) then 'big' else 'small'", None)}, "SELECT p_partkey, p_size // 7 AS a, p_size % 7 AS b, p_size / 4.0::DOUBLE AS c, 3 - p_size AS d, floor(p_retailprice) AS e, ceil(p_retailprice) AS f, floor(p_retailprice / 10 + 0.5) AS g, abs(p_size - 25) AS h, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS i FROM (SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part)")
row("math", "part", {"p_partkey": ("p_partkey", None), "a": ("round(math:sqrt(p_retailprice), 6)", None), "b": ("round(math:log(p_retailprice), 6)", None), "c": ("round(math:sin(xs:double(p_size)), 6)", None), "d": ("round(math:pow(xs:double(p_size), 2), 2)", None), "e": ("round(math:atan2(xs:double(p_size), 3e0), 6)", None)}, "SELECT p_partkey, floor(sqrt(p_retailprice) * 1e6 + 0.5) / 1e6 AS a, floor(ln(p_retailprice) * 1e6 + 0.5) / 1e6 AS b, floor(sin(p_size) * 1e6 + 0.5) / 1e6 AS c, floor(pow(p_size, 2) * 100 + 0.5) / 100 AS d, floor(atan2(p_size, 3) * 1e6 + 0.5) / 1e6 AS e FROM part")
row("dates", "orders", {"o_orderkey": ("o_orderkey", None), "a": ("year-from-dateTime(o_orderdate)", "long"), "b": ("month-from-dateTime(o_orderdate)", "long"), "c": ("day-from-dateTime(o_orderdate)", "long"), "d": ("hours-from-dateTime(o_orderdate)", "long"), "e": ("format-dateTime(o_orderdate, '[Y0001]/[M01]/[D01]')", None), "f": ("o_orderdate < xs:dateTime('1996-01-01T00:00:00')", None)}, "SELECT o_orderkey, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, hour(o_orderdate) AS d, strftime(o_orderdate, '%Y/%m/%d') AS e, o_orderdate < TIMESTAMP '1996-01-01' AS f FROM orders")
row("sequences", "part", {"p_partkey": ("p_partkey", None), "a": ("sum(1 to p_size)", "long"), "b": ("string-join(reverse(tokenize(p_type)), ' ')", None), "c": ("count((1 to p_size)[. mod 3 = 0])", "long"), "d": ("head(tokenize(p_type))", None), "e": ("string-join(tokenize(p_type)[last()], '')", None), "f": ("some $t in tokenize(p_type) satisfies starts-with($t, 'S')", None), "g": ("sum(for $i in 1 to p_size return $i * $i)", "long"), "h": ("string-join(sort(tokenize(p_type)), ',')", None)}, "SELECT p_partkey, p_size * (p_size + 1) // 2 AS a, array_to_string(list_reverse(string_split(p_type, ' ')), ' ') AS b, p_size // 3 AS c, string_split(p_type, ' ')[1] AS d, string_split(p_type, ' ')[-1] AS e, regexp_matches(p_type, '(^| )S') AS f, p_size * (p_size + 1) * (2 * p_size + 1) // 6 AS g, array_to_string(list_sort(string_split(p_type, ' ')), ',') AS h FROM (SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part)")
row("higher_order", "part", {"p_partkey": ("p_partkey", None), "a": ("fold-left(1 to 5, 0, function($s, $x) { $s + $x * p_size })", "long"), "b": ("string-join(for-each(tokenize(p_type), upper-case#1), '+')", None), "c": ("count(filter(1 to p_size, function($x) { $x > 10 }))", "long"), "d": ("sum(for-each-pair((1, 2, 3), (p_size, p_size), function($a, $b) { $a * $b }))", "long"), "e": ("let $f := concat(?, '/', p_brand) return $f('b')", None), "f": ("(p_size, 3) => max()", "long")}, "SELECT p_partkey, 15 * p_size AS a, upper(replace(p_type, ' ', '+')) AS b, greatest(p_size - 10, 0) AS c, 3 * p_size AS d, 'b/' || p_brand AS e, greatest(p_size, 3) AS f FROM (SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part)")
row("maps_arrays", "part", {"p_partkey": ("p_partkey", None), "a": ("map{'size': p_size, 'two': 2}?size", "long"), "b": ("map:size(map:put(map{'a': 1}, p_brand, 2))", "long"), "c": ("array:get([p_size, 7], 2)", "long"), "d": ("sum(array:flatten(array:append([1, 2], p_size)))", "long"), "e": ("map:merge((map{'a': 1}, map{'a': p_size, 'b': 3}))?a", "long"), "f": ("array:size(array:subarray([1, 2, 3], 2))", "long")}, "SELECT p_partkey, p_size AS a, 2::BIGINT AS b, 7::BIGINT AS c, 3 + p_size AS d, 1::BIGINT AS e, 2::BIGINT AS f FROM (SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part)")
row("casts", "events", {"event_id": ("event_id", None), "a": ("xs:string(event_id)", None), "b": ("xs:integer(value)", "long"), "c": ("event_type castable as xs:integer", None), "d": ("number(event_type) = 1e0", None), "e": ("event_id instance of xs:integer", None), "f": ("boolean(event_type) and not(value < 0)", None)}, "SELECT event_id, CAST(event_id AS VARCHAR) AS a, CAST(trunc(value) AS BIGINT) AS b, false AS c, false AS d, true AS e, event_type <> '' AND NOT value < 0 AS f FROM events")
row("general_comparison", "customer", {"c_custkey": ("c_custkey", None), "a": ("c_nationkey = (1, 2, 3)", None), "b": ("c_nationkey != (1, 1)", None), "c": ("(1, 10) < c_nationkey", None), "d": ("c_mktsegment = ('BUILDING', 'MACHINERY')", None), "e": ("c_acctbal gt 0e0", None)}, "SELECT c_custkey, c_nationkey IN (1, 2, 3) AS a, c_nationkey <> 1 AS b, 1 < c_nationkey AS c, c_mktsegment IN ('BUILDING', 'MACHINERY') AS d, c_acctbal > 0 AS e FROM customer")
row("formats", "orders", {"o_orderkey": ("o_orderkey", None), "a": ("format-integer(o_orderkey, '#,##0')", None), "b": ("format-number(o_totalprice, '#,##0.00')", None), "c": ("format-integer(o_custkey mod 30 + 1, 'i')", None)}, "SELECT o_orderkey, format('{:,}', o_orderkey) AS a, format('{:,.2f}', o_totalprice) AS b, ['', 'x', 'xx', 'xxx'][(o_custkey % 30 + 1) // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(o_custkey % 30 + 1) % 10 + 1] AS c FROM orders")


def _functions(name: str, source: str, key: str, columns: list[tuple[str, str | None, str]]) -> None:
    """The expressions as columns c1, c2, ... beside the key; SQL sees the tables' whole numbers as wide as the language has them."""
    wide = {"part": ["p_size"], "customer": ["c_nationkey"], "nation": ["n_nationkey"]}.get(source, [])
    rows = f"(SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in wide)}) FROM {source})" if wide else source
    made = {key: (key, "long")} | {f"c{k + 1}": (text, to) for k, (text, to, _) in enumerate(columns)}
    row(name, source, made, f"SELECT {key}, " + ", ".join(f"{q} AS c{k + 1}" for k, (*_, q) in enumerate(columns)) + f" FROM {rows}")


for _name, _spec in FUNCTIONS.items():
    _functions(_name, *_spec)


@query("json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.functions.collections import json_get

    return table(spark, sf_dir, "events").select("event_id", json_get(F.col("props"), "$.k", "long").alias("k"))


@query("analyze_string", "SELECT p_partkey, i - 1 AS n, i % 2 = 1 AS is_match, CASE WHEN i % 2 = 1 THEN w[(i + 1) // 2] ELSE ' ' END AS text, CASE WHEN i % 2 = 1 THEN w[(i + 1) // 2][1] || ',' || w[(i + 1) // 2][2:] ELSE '' END AS groups FROM (SELECT p_partkey, string_split(p_type, ' ') AS w, unnest(range(1, 2 * len(string_split(p_type, ' ')))) AS i FROM part)")
def analyze_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.functions.strings import analyze_string as analyze

    parts = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(analyze(F.col("p_type"), "([A-Z])([A-Z]*)")).alias("n", "part"))
    return parts.select("p_partkey", "n", "part.is_match", "part.text", F.array_join("part.groups", ",").alias("groups"))


# --- rules, errors


@query("template_rules", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big:' || o_orderpriority WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'part' END AS result FROM orders WHERE o_totalprice > 300000 OR o_orderstatus IN ('F', 'P')")
def template_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = rules.Mode(rules.Rule(F.col("o_orderstatus") == "F", F.lit("done"), 0), rules.Rule(F.col("o_orderstatus") == "P", F.lit("part"), 0), rules.Rule(F.col("o_totalprice") > 300000, F.concat(F.lit("big:"), "o_orderpriority"), 1))
    return mode.apply(table(spark, sf_dir, "orders")).select("o_orderkey", "result")


@query("next_match", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 'big,done' WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS made FROM orders")
def next_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = rules.Mode(rules.Rule(F.col("o_orderstatus") == "F", F.lit("done"), 0), rules.Rule(F.col("o_totalprice") > 300000, F.lit("big"), 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(mode.next_match(), ",").alias("made"))


@query("try_catch", "SELECT event_id, coalesce(TRY_CAST(event_type AS BIGINT), -1) AS a, coalesce(value / nullif(event_id % 2, 0), 0) AS b FROM events")
def try_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rules.try_catch(F.col("event_type").try_cast("long"), F.lit(-1)).alias("a"), rules.try_catch(F.try_divide("value", F.col("event_id") % 2), F.lit(0.0)).alias("b"))


# --- validation


@query("validate_facets", "SELECT CAST(c_custkey AS VARCHAR) AS doc, 'c_acctbal' AS path, 'cvc-minInclusive-valid' AS code FROM customer WHERE c_acctbal < 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_mktsegment', 'cvc-enumeration-valid' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT CAST(c_custkey AS VARCHAR), '', 'cvc-assertion' FROM customer WHERE NOT (c_nationkey < 20 OR c_acctbal > 0)")
def validate_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = validation.RecordType({"c_acctbal": validation.Simple("xs:double", min_inclusive=0.0), "c_mktsegment": validation.Simple(enumeration=("BUILDING", "MACHINERY")), "c_name": validation.Simple(pattern="Customer#[0-9]+|.*", max_length=40)}, required=("c_custkey",), assertions=("c_nationkey < 20 or c_acctbal > 0",))
    return validation.validate_records(table(spark, sf_dir, "customer"), record, ["c_custkey"]).select("doc", "path", "code")


@query("validate_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def validate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.not_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("validate_keyref", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def validate_keyref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dangling(table(spark, sf_dir, "orders"), ["o_custkey"], table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_custkey"]).select("o_orderkey")


@query("schema_view", "SELECT * FROM (VALUES ('/vec_id', 'bigint', true), ('/embedding', 'array<float>', true), ('/label', 'int', true)) AS t(path, type, nullable)")
def schema_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.schema_view(table(spark, sf_dir, "embeddings"))


# --- trees


def _page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.shred(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"), html=True)


def _order_trees(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """An XML document of each customer's orders; written, unless the query reads it only ``once``."""
    order = F.concat(F.lit('<order id="'), F.col("o_orderkey").cast("string"), F.lit('"><status>'), "o_orderstatus", F.lit("</status><priority>"), "o_orderpriority", F.lit("</priority></order>"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", order.alias("x")))), lambda s: s["x"]), "").alias("x"))
    nodes = trees.shred(docs, F.col("o_custkey"), F.concat(F.lit("<orders>"), "x", F.lit("</orders>")))
    return nodes if once else trees.written(nodes)


@query("tree_path", "SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'F'")
def tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/orders/order[status = 'F']/@id"""
    nodes = _order_trees(spark, sf_dir)
    done = nodes.where("kind = 'text' and value = 'F'")
    status = axes.step(done, nodes, "parent", axes.node_test("status"))
    found = axes.distinct_nodes(axes.step(axes.distinct_nodes(status), nodes, "parent", axes.node_test("order")))
    return found.select("doc_id", F.element_at("attrs", "id").alias("id"))


@query("tree_last_child", "SELECT o_custkey::VARCHAR AS doc_id, max(o_orderkey)::VARCHAR AS id FROM orders GROUP BY 1")
def tree_last_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _order_trees(spark, sf_dir)
    last = axes.positional(axes.step(axes.path(nodes, ("child", axes.node_test("orders"))), nodes, "child", axes.node_test("order")), "child", None)
    return last.select("doc_id", F.element_at("attrs", "id").alias("id"))


@query("tree_descendants", "SELECT o_custkey::VARCHAR AS doc_id, 3 * count(*) AS n FROM orders GROUP BY 1")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _order_trees(spark, sf_dir)
    found = axes.step(nodes.where("local = 'orders'"), nodes, "descendant", axes.node_test())
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("tree_serialize", "SELECT o_custkey::VARCHAR AS doc_id, '<orders>' || string_agg('<order id=\"' || o_orderkey || '\"><status>' || o_orderstatus || '</status><priority>' || o_orderpriority || '</priority></order>', '' ORDER BY o_orderkey) || '</orders>' AS text FROM orders GROUP BY 1")
def tree_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.serialize(_order_trees(spark, sf_dir, once=True))


@query("tree_content_model", "SELECT o_custkey::VARCHAR AS doc, count(*) AS children, 'cvc-complex-type.2.4' AS code FROM orders GROUP BY 1 HAVING count(*) > 12")
def tree_content_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents with more orders than the model allows."""
    order = validation.Particle(kind="sequence", parts=(validation.Particle("status"), validation.Particle("priority", least=0)))
    broken = validation.validate_content(_order_trees(spark, sf_dir), {"order": order, "orders": validation.Particle("order", most=12)})
    return broken.select("doc", F.size(F.split("message", ",")).cast("long").alias("children"), "code")


@query("html_outline", None)
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each name pages have, and how deep they lie."""
    return _page_nodes(spark, sf_dir).where("kind = 'element'").groupBy("local").agg(F.count("*").alias("n"), F.max("level").alias("deepest"))


@query("html_links", None)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _page_nodes(spark, sf_dir).where("local = 'a'")
    return links.select("doc_id", "node_id", F.try_element_at("attrs", F.lit("href")).alias("href"))


@query("tree_transform", "SELECT o_custkey::VARCHAR AS doc_id, '<orders>' || string_agg(CASE WHEN o_orderstatus = 'F' THEN '<done id=\"' || o_orderkey || '\">' || o_orderstatus || '</done>' ELSE '<order id=\"' || o_orderkey || '\">' || o_orderstatus || '</order>' END, '' ORDER BY o_orderkey) || '</orders>' AS text FROM orders GROUP BY 1")
def tree_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over a tree: priorities go, the status element is unwrapped, finished orders are renamed."""
    nodes = _order_trees(spark, sf_dir)
    done = axes.step(axes.step(nodes.where("kind = 'text' and value = 'F'"), nodes, "parent", axes.node_test("status")), nodes, "parent").select("doc_id", "node_id", F.lit("done").alias("_name"))
    marked = axes.joined(nodes, done.distinct(), ["doc_id", "node_id"], "left")
    return trees.serialize(axes.transform_tree(marked, F.col("local") == "priority", F.col("local") == "status", F.col("_name")).drop("_name"))


@query("tree_accumulator", "SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::VARCHAR AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, 100 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
def tree_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders count 1 when entered and 100 when left."""
    nodes = _order_trees(spark, sf_dir)
    is_order = F.col("local") == "order"
    rows = axes.accumulate_tree(nodes, F.when(is_order, 1), F.when(is_order, 100)).where(is_order)
    hundreds = F.floor((F.col("accumulator_before") - 1) / 101) * 100
    return rows.select("doc_id", F.element_at("attrs", "id").alias("id"), (F.col("accumulator_before") - hundreds).cast("long").alias("before"), F.col("accumulator_after").cast("long").alias("after"))


_TREE = "SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::VARCHAR AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


@query("tree_paths", f"SELECT DISTINCT doc_id, 1 AS node_id, '/orders[1]' AS path FROM ({_TREE}) UNION ALL SELECT doc_id, 5 * r - 3 + step AS node_id, '/orders[1]/order[' || r || ']' || rest AS path FROM ({_TREE}), (VALUES (0, ''), (1, '/status[1]'), (3, '/priority[1]')) AS s(step, rest)")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.paths(_order_trees(spark, sf_dir))


def _axis(axis: str, n: str) -> None:
    """How many elements (or attributes, namespaces) each order has on an axis, for orders that have any."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _order_trees(spark, sf_dir)
        orders = nodes.where("local = 'order'")
        test = None if axis in ("attribute", "namespace") else axes.node_test()
        counts = axes.step(orders, nodes, axis, test).groupBy("doc_id", "ctx_id").agg(F.count("*").alias("n"))
        named = orders.select("doc_id", F.col("node_id").alias("ctx_id"), F.element_at("attrs", "id").alias("id"))
        return axes.joined(named, counts, ["doc_id", "ctx_id"]).select("doc_id", "id", "n")

    query(f"tree_axis_{axis.replace('-', '_')}", f"SELECT doc_id, id, {n} AS n FROM ({_TREE}) WHERE {n} > 0")(run)


for _name, _n in {"self": "1", "child": "2", "descendant": "2", "descendant-or-self": "3", "parent": "1", "ancestor": "1", "ancestor-or-self": "2", "attribute": "1", "namespace": "1", "following-sibling": "n - r", "preceding-sibling": "r - 1", "following": "3 * (n - r)", "preceding": "3 * (r - 1)"}.items():
    _axis(_name, _n)


_ORDERS = f"SELECT *, 5 * r - 3 AS node_id FROM (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey, o_orderkey::VARCHAR AS id, o_orderstatus AS status, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def _tree_path(name: str, path: str, sql: str) -> None:
    """An expression over the order trees; ``sql`` says the same of the rows that they were made of."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Tree(_order_trees(spark, sf_dir)).run(path)

    query(name, sql.replace("ORDERS", f"({_ORDERS})"))(run)


_ID = "SELECT doc_id, node_id, 'id' AS name, id AS text FROM ORDERS"
_tree_path("tree_expr_compare", "//order[status = 'F']/priority", "SELECT doc_id, node_id + 3 AS node_id, 'priority' AS name, priority AS text FROM ORDERS WHERE status = 'F'")
_tree_path("tree_expr_not", "//order[not(status = 'F') and @id > 1000]/@id", f"{_ID} WHERE status <> 'F' AND o_orderkey > 1000")
_tree_path("tree_expr_or", "//order[status = ('O', 'P') or starts-with(priority, '1')]/@id", f"{_ID} WHERE status IN ('O', 'P') OR priority LIKE '1%'")
_tree_path("tree_expr_last", "/orders/order[last()]/@id", f"{_ID} WHERE r = n")
_tree_path("tree_expr_position", "/orders/order[position() mod 3 = 0]/@id", f"{_ID} WHERE r % 3 = 0")
_tree_path("tree_expr_siblings", "//order[status = 'O']/following-sibling::order[1]/@id", f"{_ID} QUALIFY lag(status) OVER (PARTITION BY doc_id ORDER BY r) = 'O'")
_tree_path("tree_expr_up", "//status[. = 'P']/ancestor::orders/order[1]/@id", f"{_ID} WHERE r = 1 AND doc_id IN (SELECT doc_id FROM ORDERS WHERE status = 'P')")
_tree_path("tree_expr_filtered", "(//order[status = 'F'])[2]/@id", f"{_ID} WHERE status = 'F' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r) = 2")
_tree_path("tree_expr_except", "//order except //order[@id = 7 or priority = '5-LOW']", "SELECT doc_id, node_id, 'order' AS name, status || priority AS text FROM ORDERS WHERE o_orderkey <> 7 AND priority <> '5-LOW'")
_tree_path("tree_expr_count", "count(//order[starts-with(priority, '1')]) * 10 + count(//order)", "SELECT doc_id, 10 * count(*) FILTER (WHERE priority LIKE '1%') + count(*) AS value FROM ORDERS GROUP BY 1")
_tree_path("tree_expr_join", "string-join(//order[status = 'P']/@id, ',')", "SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY r) FILTER (WHERE status = 'P'), '') AS value FROM ORDERS GROUP BY 1")


@query("tree_pattern", "SELECT o_custkey::VARCHAR AS doc_id, count(*) AS n FROM orders GROUP BY 1")
def tree_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that match the pattern orders/order/status."""
    return axes.match_pattern(_order_trees(spark, sf_dir), "orders", "order", "status").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("tree_string_values", "SELECT o_custkey::VARCHAR AS doc_id, string_agg(o_orderstatus || o_orderpriority, '' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1")
def tree_string_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _order_trees(spark, sf_dir)
    return axes.string_values(nodes.where("local = 'orders'"), nodes).select("doc_id", "text")


@query("tree_snapshot", "SELECT o_custkey::VARCHAR AS doc_id, count(*) AS n, 'orders' AS top FROM orders GROUP BY 1")
def tree_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _order_trees(spark, sf_dir)
    rows = axes.snapshot(nodes.where("local = 'status'"), nodes)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("ancestors")[0]["local"]).alias("top"))


@query("tree_ids", "SELECT DISTINCT l_orderkey::VARCHAR AS id FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey")
def tree_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id(): the orders with the ids that line items name."""
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("value"))
    return axes.by_id(wanted, _order_trees(spark, sf_dir, once=True)).select(F.element_at("attrs", "id").alias("id"))


@query("json_to_xml", "SELECT event_id, '<map xmlns=\"http://www.w3.org/2005/xpath-functions\"><number key=\"k\">' || CAST(json_extract(props, '$.k') AS VARCHAR) || '</number></map>' AS xml, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS back FROM events")
def json_to_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.functions import collections as C

    xml = C.json_to_xml(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", xml.alias("xml")).withColumn("back", C.xml_to_json(F.col("xml")))


@query("serialize_items", "SELECT p_partkey, '[\"' || replace(p_type, ' ', '\",\"') || '\"]' AS text FROM part")
def serialize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("words"))
    return trees.serialize_items(parts, "words", "adaptive").select("p_partkey", "text")


@query("user_function", "SELECT p_partkey, p_size * p_size + 1 AS value FROM (SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part)")
def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.plans.library import define_function

    define_function("my:square-plus", ["x", "y"], "$x * $x + $y")
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", compile_row("my:square-plus(p_size, 1)", parts.schema).alias("value"))


row("uris_and_unicode", "customer", {"c_custkey": ("c_custkey", None), "a": ("encode-for-uri(c_name)", None), "b": ("codepoints-to-string(string-to-codepoints(c_mktsegment))", None), "c": ("normalize-unicode(c_name)", None), "d": ("compare(c_mktsegment, 'furniture', 'http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive')", "long"), "e": ("resolve-uri(c_mktsegment, 'http://x.example/a/')", None), "f": ("starts-with(iri-to-uri(c_name), 'Customer')", None)}, "SELECT c_custkey, replace(c_name, '#', '%23') AS a, c_mktsegment AS b, c_name AS c, CASE WHEN lower(c_mktsegment) < 'furniture' THEN -1 WHEN lower(c_mktsegment) > 'furniture' THEN 1 ELSE 0 END::BIGINT AS d, 'http://x.example/a/' || c_mktsegment AS e, starts_with(c_name, 'Customer') AS f FROM customer")


# --- event time and streams


@query("stream_accumulator", _SQL["accumulator"].replace("acc_before", "before").replace("acc_after", "after"))
def stream_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accumulator over events as a stream: one state a user."""
    import tempfile
    import uuid

    batch = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("decimal(18,4)").cast("double").alias("value"))
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sylvan-stream-")
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    batch.write.parquet(f"{folder}/in")
    stream = records.read_records(spark, f"{folder}/in", batch.schema)
    out = records.run_once(records.accumulate(stream, "user_id", "event_id", "value", "event_id"), folder)
    return out.select("event_id", "user_id", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")]).select("window_start", "event_type", "n")


@query("session_windows", "SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")]).select("user_id", "window_start", "n")
