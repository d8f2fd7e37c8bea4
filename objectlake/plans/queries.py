"""A query for each operator over the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objectlake.functions import names, render
from objectlake.functions.predicates import json_fields, parse_filters, typed_fields
from objectlake.operators import catalog, changelog, ids, query
from objectlake.sources import documents
from objectlake.sources.files import shared_folder
from objectlake.sources.generations import Generations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_of(sql: str | None = None):
    """Registers a function of ``t``, which reads a table by name, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: _table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def listed(name: str, table: str, key: str, params: dict, sql: str) -> None:
    """Registers a filtered list."""
    QUERIES[name] = lambda spark, sf_dir: query.find(_table(spark, sf_dir, table), params, key)
    ORACLES[name] = sql


# -- scans, lookups, pages ---------------------------------------------------------------


@query_of("SELECT * FROM nation ORDER BY n_nationkey")
def scan_class(t):
    return query.page(t("nation"), 0, 0, "n_nationkey")


@query_of("SELECT * FROM orders WHERE o_orderkey = 7")
def point_get(t):
    return query.get(t("orders"), 7, "o_orderkey")


@query_of("SELECT * FROM orders WHERE o_orderkey = -7")
def point_get_missing(t):
    return query.get(t("orders"), -7, "o_orderkey")


listed("list_default_page", "orders", "o_orderkey", {}, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
listed("list_offset_page", "orders", "o_orderkey", {"limit": "3", "offset": "2"}, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 2")
listed("list_unlimited", "supplier", "s_suppkey", {"limit": "0"}, "SELECT * FROM supplier ORDER BY s_suppkey")
listed("list_offset_past_end", "supplier", "s_suppkey", {"offset": "10000000"}, "SELECT * FROM supplier WHERE false")
listed("list_negative_offset", "supplier", "s_suppkey", {"offset": "-3", "limit": "5"}, "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5")
listed("list_bad_numbers", "supplier", "s_suppkey", {"offset": "x", "limit": "1.5"}, "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 100")

# -- predicates ------------------------------------------------------------------------

ALL = {"limit": "0"}
listed("eq_ci_default", "orders", "o_orderkey", {"eq.o_orderpriority": "1-urgent", **ALL}, "SELECT * FROM orders WHERE lower(o_orderpriority) = '1-urgent'")
listed("eq_case_sensitive", "orders", "o_orderkey", {"eq.o_orderpriority": "1-URGENT", "ci": "false", **ALL}, "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
listed("eq_case_sensitive_miss", "orders", "o_orderkey", {"eq.o_orderpriority": "1-urgent", "ci": "false", **ALL}, "SELECT * FROM orders WHERE o_orderpriority = '1-urgent'")
listed("eq_missing_field", "orders", "o_orderkey", {"eq.nothing": "1"}, "SELECT * FROM orders WHERE false")
listed("eq_reserved_id", "orders", "o_orderkey", {"eq.id": "1", "eq.o_orderkey": "1"}, "SELECT * FROM orders WHERE false")
listed("like_prefix", "customer", "c_custkey", {"like.c_name": "customer#00000_%", **ALL}, "SELECT * FROM customer WHERE regexp_full_match(c_name, 'customer#00000..*', 'is')")
listed("like_ordered_contains", "part", "p_partkey", {"like.p_name": "%a%e%", **ALL}, "SELECT * FROM part WHERE regexp_full_match(p_name, '.*a.*e.*', 'is')")
listed("like_underscore", "nation", "n_nationkey", {"like.n_name": "_ation__", **ALL}, "SELECT * FROM nation WHERE regexp_full_match(n_name, '.ation..', 'is')")
listed("like_suffix", "customer", "c_custkey", {"like.c_name": "%7", **ALL}, "SELECT * FROM customer WHERE regexp_full_match(c_name, '.*7', 'is')")
listed("like_ci", "part", "p_partkey", {"like.p_type": "%Conom%", **ALL}, "SELECT * FROM part WHERE regexp_full_match(p_type, '.*conom.*', 'is')")
listed("like_cs", "part", "p_partkey", {"like.p_type": "ECON%", "ci": "0", **ALL}, "SELECT * FROM part WHERE p_type LIKE 'ECON%'")
listed("like_cs_miss", "part", "p_partkey", {"like.p_type": "econ%", "ci": "0", **ALL}, "SELECT * FROM part WHERE p_type LIKE 'econ%'")
listed("filter_and", "part", "p_partkey", {"eq.p_size": "7", "like.p_brand": "brand#1%", **ALL}, "SELECT * FROM part WHERE p_size = 7 AND regexp_full_match(p_brand, 'brand#1.*', 'is')")
listed("filter_then_page", "orders", "o_orderkey", {"eq.o_orderstatus": "o", "limit": "10", "offset": "5"}, "SELECT * FROM orders WHERE lower(o_orderstatus) = 'o' ORDER BY o_orderkey LIMIT 10 OFFSET 5")


@query_of("SELECT page_id, url FROM pages WHERE regexp_full_match(url, '.*\\.example\\.com.*\\?page=.*', 'is')")
def like_regex_meta_literal(t):
    return query.find(t("pages").select("page_id", "url"), {"like.url": "%.example.com%?page=%", **ALL}, "page_id")


@query_of("SELECT doc_id, lang, source FROM documents WHERE text LIKE '%' || chr(10) || '%'")
def like_newline(t):
    found = query.find(t("documents"), {"like.text": "%\n%", **ALL}, "doc_id")
    return found.select("doc_id", "lang", "source")


@query_of("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity = 17 AND l_discount = 0.05")
def eq_number_as_string(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return df.where(parse_filters({"eq.l_quantity": "17", "eq.l_discount": "0.05"}, typed_fields(df)))


_TEXT = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query_of(f"SELECT o_orderkey, {_TEXT.format('o_totalprice')} AS price_text FROM orders")
def render_numbers(t):
    df = t("orders")
    return df.select("o_orderkey", render.render_double(df.o_totalprice).alias("price_text"))


@query_of("SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 69")
def json_field_eq(t):
    return t("events").select("event_id", "props").where(parse_filters({"eq.k": "69"}, json_fields("props")))


@query_of("SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS VARCHAR) LIKE '%7%'")
def json_field_like(t):
    return t("events").select("event_id", "props").where(parse_filters({"like.k": "%7%"}, json_fields("props")))


@query_of("SELECT conv_id, turn FROM conversations WHERE turn = 1 AND role = 'user'")
def json_nested_eq(t):
    """Lists and objects are compared on their text."""
    doc = F.to_json(F.struct(F.struct(F.array(F.col("turn").cast("string"), "role").alias("b"), F.col("turn").alias("a")).alias("o")))
    return t("conversations").select("conv_id", "turn", doc.alias("doc")).where(parse_filters({"eq.o": "map[a:1 b:[1 user]]"}, json_fields("doc"))).select("conv_id", "turn")


@query_of("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn FROM conversations")
def json_array_source(t):
    """The items of arrays, in order."""
    items = F.array_sort(F.collect_list(F.struct("turn")))
    lists = t("conversations").groupBy("conv_id").agg(F.to_json(items).alias("list"))
    read = documents.read_arrays(lists, "list", "conv_id")
    return read.select("conv_id", F.col("pos").cast("long").alias("pos"), F.try_variant_get("doc", "$.turn", "long").alias("turn"))


@query_of("SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AS is_object FROM events")
def json_source(t):
    return documents.read_json(t("events"), "props", "event_id").select("event_id", F.col("doc").isNotNull().alias("is_object"))


@query_of("SELECT event_id, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def json_sink(t):
    docs = documents.read_json(t("events"), "props", F.col("event_id").alias("id"))
    return documents.write_json(docs).withColumnRenamed("id", "event_id")


# -- catalog, ids, names -------------------------------------------------------------------


@query_of("SELECT DISTINCT p_brand AS project FROM part ORDER BY 1")
def list_projects(t):
    return catalog.projects(t("part").select(F.col("p_brand").alias("project")))


@query_of("SELECT DISTINCT p_type AS class FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY 1")
def list_classes(t):
    part = t("part").select(F.col("p_brand").alias("project"), F.col("p_type").alias("class"))
    first = part.agg(F.min("project")).first()[0]
    return catalog.classes(part, first or "")


@query_of("SELECT o_orderstatus, max(o_orderkey) AS max_id FROM orders GROUP BY 1")
def max_id_per_scope(t):
    return ids.max_ids(t("orders"), ["o_orderstatus"], "o_orderkey")


@query_of("SELECT o_orderkey, o_orderstatus, 1000 + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS id FROM orders")
def assign_bulk_ids(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    last = rows.select("o_orderstatus").distinct().withColumn("max_id", F.lit(1000).cast("long"))
    return ids.assign(rows, ["o_orderstatus"], ["o_orderkey"], last)


@query_of("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
def drop_guard(t):
    used = t("lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return catalog.droppable(t("part").select("p_partkey"), used, ["p_partkey"])


@query_of("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def must_exist(t):
    wanted = t("orders").select("o_custkey").distinct()
    return changelog.must_exist(wanted, t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query_of("SELECT p_partkey, regexp_full_match(p_type, '[A-Za-z0-9_.-]{1,128}') AS type_ok, regexp_full_match(p_brand, '[A-Za-z0-9_.-]{1,128}') AS brand_ok FROM part")
def valid_names(t):
    return t("part").select("p_partkey", names.valid_name(F.col("p_type")).alias("type_ok"), names.valid_name(F.col("p_brand")).alias("brand_ok"))


@query_of("SELECT o_orderkey, upper('02' || hex(encode(o_orderstatus)) || '00' || hex(encode(o_orderpriority)) || '00' || lpad(to_hex(o_orderkey), 16, '0')) AS object_key FROM orders")
def object_keys(t):
    return t("orders").select("o_orderkey", F.hex(names.object_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey"))).alias("object_key"))


# -- change log --------------------------------------------------------------------------


@query_of("SELECT conv_id AS tx_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, turn AS id, role AS data FROM conversations")
def flatten_batches(t):
    part = F.struct(F.lit("put").alias("op"), F.lit("").alias("project"), F.lit("c").alias("class"), F.col("turn").alias("id"), F.col("role").alias("data"), F.lit(0).cast("long").alias("ts"))
    log = t("conversations").groupBy(F.col("conv_id").alias("tx_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("_t"), part.alias("m")))).alias("_s"))
    log = log.withColumn("sub", F.transform("_s", lambda s: s["m"])).withColumn("op", F.lit("batch"))
    for name, kind in (("project", "string"), ("class", "string"), ("id", "long"), ("data", "string"), ("ts", "long")):
        log = log.withColumn(name, F.lit(None).cast(kind))
    return changelog.flatten(log).select("tx_id", "seq", "id", "data")


def _net(events: DataFrame) -> DataFrame:
    return changelog.net_delta(events, ["user_id"], ("event_id",), F.col("event_type") == "error", ("event_type", "value"))


_NET = "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(event_type, event_id) = 'error' AS deleted FROM events {0} GROUP BY user_id"


@query_of(_NET.format(""))
def net_delta(t):
    return _net(t("events"))


@query_of(_NET.format("WHERE event_id <= 500"))
def snapshot_as_of(t):
    return _net(changelog.as_of(t("events"), 500, "event_id"))


@query_of("SELECT event_id, user_id FROM events WHERE event_id > 700")
def replay_after_watermark(t):
    return changelog.after(t("events"), 700, "event_id").select("event_id", "user_id")


_MERGED = f"WITH d AS ({_NET.format('')}) SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM d) UNION ALL SELECT user_id, value FROM d WHERE NOT deleted"


def _merged(t) -> DataFrame:
    delta = _net(t("events")).select(F.col("user_id").alias("id"), "value", "deleted")
    return changelog.merge(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), delta, ["id"])


@query_of(_MERGED)
def overlay_merge(t):
    return _merged(t)


@query_of(f"SELECT id, value, true AS packed FROM ({_MERGED})")
def compaction(t):
    """Writes the merge as a generation and reads it again; ``packed`` says whether its files hold separate ranges of ids."""
    merged = _merged(t)
    lake = Generations(merged.sparkSession, shared_folder(merged.sparkSession), merged.schema, ["id"])
    lake.publish(merged, 1)
    rows = lake.read().withColumn("_file", F.input_file_name())
    files = rows.groupBy("_file").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    before = F.lag("high").over(Window.orderBy("low"))
    packed = files.select((F.coalesce(before, F.col("low") - 1) < F.col("low")).alias("ok")).agg(F.min("ok").alias("packed"))
    return rows.drop("_file").join(F.broadcast(packed))


@query_of("SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS project, c_mktsegment AS class, c_acctbal AS value FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def scope_scan(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("project"), F.col("c_mktsegment").alias("class"), F.col("c_acctbal").alias("value"))
    return query.scope(rows, "3", "BUILDING")


@query_of("SELECT o_orderstatus AS class, 1 + max(o_orderkey) AS next_id FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def folded_catalog(t):
    """The next id of each class, from a log."""
    puts = t("orders").where("o_orderpriority <> '5-LOW'")
    log = puts.select(F.col("o_orderkey").alias("tx_id"), F.lit(0).alias("seq"), F.lit("put").alias("op"), F.lit("").alias("project"), F.col("o_orderstatus").alias("class"), F.col("o_orderkey").alias("id"))
    return changelog.catalog_delta(log).select("class", F.col("next_id"))


@query_of("SELECT min(event_id) - 1 AS last FROM (SELECT event_id FROM events WHERE event_type <> 'error' UNION ALL SELECT -1) l RIGHT JOIN (SELECT event_id + 1 AS event_id FROM events WHERE event_type <> 'error' UNION ALL SELECT 0) n USING (event_id) WHERE l.event_id IS NULL")
def gapless_prefix(t):
    """The last transaction before the first one that is missing."""
    return changelog.gapless(t("events").where("event_type <> 'error'").select(F.col("event_id").alias("tx_id")), -1)


@query_of("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) > 0 AS is_id FROM events")
def valid_ids(t):
    return t("events").select("event_id", names.valid_id(F.get_json_object("props", "$.k")).alias("is_id"))


@query_of("SELECT event_id FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE value > 499)")
def durable_prefix(t):
    return changelog.durable_prefix(t("events"), "event_id", F.col("value") <= 499).select("event_id")


@query_of("SELECT user_id, event_id FROM (SELECT user_id, event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS bad FROM events) WHERE bad IS NULL OR event_id < bad")
def durable_prefix_of_segments(t):
    return changelog.durable_prefix(t("events"), "event_id", F.col("event_type") != "error", "user_id").select("user_id", "event_id")


@query_of("SELECT (SELECT max(event_id) FROM events) AS last_tx_id, (SELECT count(*) FROM events) AS log_records, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type FROM part)) AS num_classes")
def store_stats(t):
    return catalog.stats(t("events").select(F.col("event_id").alias("tx_id")), t("part").select(F.col("p_brand").alias("project"), F.col("p_type").alias("class")))


@query_of("SELECT event_id // 256 AS batch, count(*) AS n FROM events GROUP BY 1")
def group_commit_batches(t):
    return changelog.commit_groups(t("events"), 256, "event_id")


FLAGSHIP = {"eq.o_orderstatus": "f", "like.o_orderpriority": "%-HIGH"}
listed("flagship", "orders", "o_orderkey", FLAGSHIP, "SELECT * FROM orders WHERE lower(o_orderstatus) = 'f' AND regexp_full_match(o_orderpriority, '.*-high', 'is') ORDER BY o_orderkey LIMIT 100")
