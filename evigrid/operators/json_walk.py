"""Nested JSON of any depth: every value of a body with its path, and what is read from them.

A body is one cell of a row, so it is walked where it is read: nothing is shuffled or written for it. What is asked of its values is said in columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from evigrid.plans.registry import query
from evigrid.sources.tables import table

_FIELDS = ("path", "key", "kind", "value")
_VALUES = ArrayType(StructType([StructField(f, StringType()) for f in _FIELDS]))
#: Values that are handed back at once, a whole body at least.
_AT_ONCE = 50_000


class _Number(str):
    """A number as the body spells it."""


def _walk(body: str, out: list[tuple[str, str | None, str | None, str | None]]) -> None:
    """Adds a body's values to out: a container before its members, keys sorted."""
    stack = [("$", None, json.loads(body, parse_int=_Number, parse_float=_Number))]
    while stack:
        path, key, x = stack.pop()
        if isinstance(x, dict):
            out.append((path, key, "object", None if x else ""))
            stack.extend([(f"{path}.{k}", k, x[k]) for k in sorted(x, reverse=True)])
        elif isinstance(x, list):
            out.append((path, key, "array", None if x else ""))
            stack.extend([(f"{path}[{i}]", None, x[i]) for i in range(len(x) - 1, -1, -1)])
        elif isinstance(x, _Number):
            out.append((path, key, "number", x))
        elif isinstance(x, str):
            out.append((path, key, "string", x))
        else:
            out.append((path, key, None, "") if x is None else (path, key, "boolean", "true" if x else "false"))


def values(bodies: DataFrame) -> DataFrame:
    """(id, values) of bodies (id, body variant): a row for each body, with a struct (path, key, kind, value) for each value in it, the whole one included.

    They come in the order in which they are read with sorted keys. path: as text, $.key[0]. key: the member's own key, null for others. kind: object, array,
    string, number or boolean; null for a JSON null. value: a leaf as text; empty for a null or an empty container, null for a container with members.
    What JSON has no type for (dates, binaries) is walked as to_json writes it. A null body has no row.
    """
    kind = pa.struct([(f, pa.string()) for f in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, found, ends = 0, [], [0]
            for i, body in enumerate(batch.column(1).to_pylist()):
                _walk(body, found)
                ends.append(len(found))
                if len(found) >= _AT_ONCE or i + 1 == batch.num_rows:
                    columns = zip(*found, strict=True)
                    each = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(kind))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends) - 1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["id", "values"])
                    first, found, ends = i + 1, [], [0]

    rows = bodies.where("body IS NOT NULL").select("id", F.to_json("body").alias("body"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("values", _VALUES)]))


def named_values(walked: DataFrame, key: str) -> DataFrame:
    """(id, value): the distinct strings that a key has anywhere in each body."""
    named = F.filter("values", lambda v: (v["key"] == key) & (v["kind"] == "string"))
    return walked.select("id", F.explode(F.array_distinct(F.transform(named, lambda v: v["value"]))).alias("value")).distinct()


def public_texts(walked: DataFrame) -> DataFrame:
    """(id, text): all keys and leaves of each body, a line each, keys sorted at every level; a null or an empty container is an empty line."""
    own = F.transform("values", lambda v: F.array(v["key"], F.when(v["kind"] == "boolean", F.initcap(v["value"])).otherwise(v["value"])))
    return walked.select("id", F.array_join(F.flatten(own), "\n").alias("text"))  # nulls are passed over: no key, or a container with members


def rounded(walked: DataFrame, places: int) -> DataFrame:
    """(id, path, value): every number of each body, rounded."""
    each = walked.select("id", F.inline(F.filter("values", lambda v: v["kind"] == "number")))
    return each.select("id", "path", F.round(F.col("value").cast("double"), places).alias("value"))


def order_bodies(spark: SparkSession, sf_dir: str, amounts: Callable[[Column], tuple[Column, ...]]) -> DataFrame:
    """(id, body): an order as a response of a hub: its customer, its lines, each with its part and amounts, an empty list and a null."""

    def line(x: Column) -> Column:
        return F.struct(
            F.concat(F.lit("line-"), x["l_orderkey"], F.lit("-"), x["l_linenumber"]).alias("artifact_id"),
            F.struct(F.concat(F.lit("part-"), x["l_partkey"]).alias("artifact_id"), (x["l_quantity"] > 25).alias("bulk")).alias("part"),
            F.array(*amounts(x)).alias("amounts"),
        )

    # only what differs from line to line is shuffled; texts are made where a body is
    own = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(own)).alias("ls"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    customer = F.struct(F.concat(F.lit("cust-"), "c_custkey").alias("artifact_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    body = F.struct(F.concat(F.lit("order-"), "o_orderkey").alias("artifact_id"), customer.alias("customer"), F.transform("ls", line).alias("lines"), F.array().cast("array<string>").alias("none"), F.lit(None).cast("string").alias("note"))
    return orders.select(F.col("o_orderkey").alias("id"), F.parse_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("body"))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_bodies(spark, sf_dir, lambda x: (F.array(x["l_extendedprice"] / 7), F.array(x["l_discount"], x["l_tax"])))


_BODIES = """b AS MATERIALIZED (SELECT o_orderkey AS id, json_object('artifact_id', 'order-' || o_orderkey, 'customer', json_object('artifact_id', 'cust-' || c_custkey, 'name', c_name, 'nation', c_nationkey), 'lines', ls, 'none', json_array(), 'note', NULL) AS body
  FROM orders JOIN (SELECT l_orderkey, json_group_array(x) AS ls FROM (SELECT l_orderkey, json_object('artifact_id', 'line-' || l_orderkey || '-' || l_linenumber, 'part', json_object('artifact_id', 'part-' || l_partkey, 'bulk', l_quantity > 25), 'amounts', json_array(json_array(l_extendedprice / 7), json_array(l_discount, l_tax))) AS x FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) GROUP BY l_orderkey) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
t AS (SELECT b.id, j.key, j.type, j.atom, j.fullkey FROM b, json_tree(b.body) j)"""


@query(f"WITH {_BODIES} SELECT DISTINCT id, atom->>'$' AS value FROM t WHERE key = 'artifact_id' AND type = 'VARCHAR'")
def json_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact_id anywhere in a body."""
    return named_values(values(_priced(spark, sf_dir)), "artifact_id")


@query(f"WITH {_BODIES} SELECT id, fullkey AS path, round(CAST(atom AS DOUBLE), 4) AS value FROM t WHERE type IN ('BIGINT', 'UBIGINT', 'DOUBLE')")
def rounded_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of a body, at any depth, rounded to four places."""
    return rounded(values(_priced(spark, sf_dir)), 4)


@query("""WITH x AS (SELECT l_orderkey, string_agg('amounts' || chr(10) || CAST(l_quantity AS BIGINT) || chr(10) || l_linenumber || chr(10) || 'artifact_id' || chr(10) || 'line-' || l_orderkey || '-' || l_linenumber || chr(10) || 'part' || chr(10) || 'artifact_id' || chr(10) || 'part-' || l_partkey || chr(10) || 'bulk' || chr(10) || CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END, chr(10) ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS s FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, sha256('artifact_id' || chr(10) || 'order-' || o_orderkey || chr(10) || 'customer' || chr(10) || 'artifact_id' || chr(10) || 'cust-' || c_custkey || chr(10) || 'name' || chr(10) || c_name || chr(10) || 'nation' || chr(10) || c_nationkey || chr(10) || 'lines' || chr(10) || s || chr(10) || 'none' || chr(10) || chr(10) || 'note' || chr(10)) AS public_hash FROM orders JOIN x ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey""")
def nested_public_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys and values of nested bodies, whose amounts are whole numbers here: those have one spelling."""
    bodies = order_bodies(spark, sf_dir, lambda x: (x["l_quantity"].cast("bigint"), x["l_linenumber"].cast("bigint")))
    return public_texts(values(bodies)).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("public_hash"))
