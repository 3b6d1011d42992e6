"""Queries of the sources: nested records made from orders and their lines."""

from pyspark.sql import functions as F

from wayline.plans.registry import query, table
from wayline.sources import records as S
from wayline.sources import sinks

SPEC = S.Record(
    "orders",
    "id",
    (S.Field("price", "double"), S.Field("urgent", "boolean"), S.Field("customer_name", path="customer.name"), S.Field("customer_key", "bigint", "customer.key")),
    (
        S.Child("line", "lines", (S.Field("number", "bigint"), S.Field("quantity", "double")), (S.Child("flag", "flags", (S.Field("code"), S.Field("rank", "bigint"))),)),
        S.Child("tag", "tags"),
    ),
)


def raw(spark, d):
    """JSON lines: every order with its lines; numbers as text with separators; every 50th line cut or not an object."""
    li = table(spark, d, "lineitem")
    flags = F.array(F.struct(F.col("l_returnflag").alias("code"), F.lit(0).alias("rank")), F.struct(F.col("l_linestatus").alias("code"), F.lit(1).alias("rank")))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"), flags.alias("flags")))).alias("lines"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.format_number("o_totalprice", 2)).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    rec = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), price.alias("price"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.struct(F.col("c_name").alias("name"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("true")).otherwise(F.col("c_custkey").cast("string")).alias("key")).alias("customer"),
        "lines", F.array("o_orderstatus", "o_orderpriority").alias("tags"),
    )
    text = F.to_json(rec)
    bad = F.when(F.col("o_orderkey") % 50 == 1, F.left(text, F.lit(20))).when(F.col("o_orderkey") % 50 == 2, F.lit("[1, 2]")).when(F.col("o_orderkey") % 50 == 3, F.lit("  ")).otherwise(text)
    return o.select(bad.alias("value"))


def parsed(spark, d):
    return S.parse(raw(spark, d), "value", SPEC)


_GOOD = "o_orderkey % 50 NOT IN (1, 2, 3)"


@query(
    "flatten_parent",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, o_orderpriority = '1-URGENT' AS urgent, c_name AS customer_name, CASE WHEN o_orderkey % 11 <> 0 THEN c_custkey END AS customer_key FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_GOOD}",
)
def flatten_parent(spark, d):
    return S.parent_table(parsed(spark, d), SPEC)


@query("flatten_child", f"SELECT CAST(l_orderkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS line_idx, CAST(l_linenumber AS BIGINT) AS number, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_GOOD}")
def flatten_child(spark, d):
    return S.child_table(parsed(spark, d), SPEC, "line")


@query(
    "flatten_grandchild",
    f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) - 1 AS line_idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_GOOD}) SELECT CAST(l_orderkey AS VARCHAR) AS id, line_idx, 0 AS flag_idx, l_returnflag AS code, 0 AS rank FROM l UNION ALL SELECT CAST(l_orderkey AS VARCHAR), line_idx, 1, l_linestatus, 1 FROM l",
)
def flatten_grandchild(spark, d):
    return S.child_table(parsed(spark, d), SPEC, "line", "flag")


@query("flatten_scalar_list", f"SELECT CAST(o_orderkey AS VARCHAR) AS id, 0 AS tag_idx, o_orderstatus AS value FROM orders WHERE {_GOOD} UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, o_orderpriority FROM orders WHERE {_GOOD}")
def flatten_scalar_list(spark, d):
    return S.child_table(parsed(spark, d), SPEC, "tag")


@query("coerce_or_null", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'view' THEN TRUE WHEN event_type = 'click' THEN FALSE END AS flag FROM events")
def coerce_or_null(spark, d):
    e = table(spark, d, "events")
    flag = F.when(F.col("event_type") == "view", " True").when(F.col("event_type") == "click", "FALSE").otherwise(F.col("event_type"))
    return e.select("event_id", S.coerce(F.get_json_object("props", "$.k"), "bigint").alias("k"), S.coerce(flag, "boolean").alias("flag"))


@query("corrupt_row_count", "SELECT count(*) FILTER (o_orderkey % 50 IN (1, 2)) AS bad_lines, count(*) FILTER (o_orderkey % 50 NOT IN (1, 2, 3)) AS good_lines FROM orders")
def corrupt_row_count(spark, d):
    return parsed(spark, d).agg(F.count_if("bad").alias("bad_lines"), F.count_if(~F.col("bad")).alias("good_lines"))


@query("nested_conversations", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def nested_conversations(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"))


@query("latest_per_key", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, d):
    return S.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("optional_input", "SELECT p_partkey, CAST(NULL AS VARCHAR) AS override FROM part")
def optional_input(spark, d):
    overrides = S.optional(spark, f"{d}/no_such_mapping.parquet", "p_partkey bigint, override string")
    return table(spark, d, "part").select("p_partkey").join(overrides, "p_partkey", "left")


@query("nested_report", "SELECT c_mktsegment, count(DISTINCT o_orderpriority) AS panels, count(*) AS cells FROM (SELECT DISTINCT c_mktsegment, o_orderpriority, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def nested_report(spark, d):
    from wayline.plans.aggregates import order_customer

    cells = order_customer(spark, d).groupBy("c_mktsegment", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    report = sinks.nested_report(cells, "c_mktsegment", "o_orderpriority", ["o_orderstatus", "n"], [F.col("n").alias("wl_n")])
    panels = F.from_json("payload", "array<struct<o_orderpriority:string,rows:array<struct<o_orderstatus:string,n:bigint>>>>")
    return report.select("c_mktsegment", panels.alias("p")).select("c_mktsegment", F.size("p").cast("long").alias("panels"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.size(x["rows"])).alias("cells"))
