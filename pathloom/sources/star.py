"""The star-schema tables as nested resources (see model.star).

Flat resources are pruned by Catalyst. An order's items are gathered by an
aggregate, through which nothing is pruned, so `resource` takes the expressions
that will read it: only the item's fields they name are gathered, and the items
are put in order only if an expression can tell.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.lang import tree as t
from pathloom.lang.parser import parse


def _reference(kind: str, col: str):
    return F.when(F.col(col).isNotNull(), F.struct(F.concat(F.lit(kind + "/"), F.col(col).cast("string")).alias("reference")))


def _flat(table: str, key: str, kind: str, fields: dict, sf: str, spark: SparkSession) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.select(
        F.lit(kind).alias("resourceType"), F.col(key).cast("string").alias("id"), *[(_reference(*v) if isinstance(v, tuple) else F.col(v)).alias(k) for k, v in fields.items()]
    )


FLAT = {
    "Region": ("region", "r_regionkey", {"name": "r_name"}),
    "Nation": ("nation", "n_nationkey", {"name": "n_name", "region": ("Region", "n_regionkey")}),
    "Customer": ("customer", "c_custkey", {"name": "c_name", "nation": ("Nation", "c_nationkey"), "balance": "c_acctbal", "segment": "c_mktsegment"}),
    "Supplier": ("supplier", "s_suppkey", {"name": "s_name", "nation": ("Nation", "s_nationkey"), "balance": "s_acctbal"}),
    "Part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "Event": ("events", "event_id", {"ts": "ts", "user": "user_id", "type": "event_type", "value": "value", "props": "props"}),
    "Page": ("pages", "page_id", {"url": "url", "html": "html"}),
    "Vector": ("embeddings", "vec_id", {"value": "embedding", "label": "label"}),
}
#: A setting: where orders are stored as nested Parquet, if they are.
STORED = "pathloom.star.orders"
#: Items in a total order: line numbers alone repeat.
ITEM = ("line", "part", "supplier", "quantity", "price", "discount", "tax", "returnFlag", "lineStatus", "shipDate")
_ITEM_FROM = dict(zip(ITEM, ("l_linenumber", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")))


#: Functions that look at no more of an item than their arguments do; the first line gives the same in any order.
_BARE = {
    "count", "empty", "exists", "all", "where",
    "select", "first", "last", "tail", "skip", "take", "aggregate", "sort",
}
_ANY_ORDER = {
    "count", "empty", "exists", "all", "where", "not", "allTrue", "anyTrue", "allFalse", "anyFalse", "distinct", "isDistinct", "intersect", "exclude", "combine", "subsetOf", "supersetOf",
    "sum", "min", "max", "avg", "iif", "abs", "round", "ceiling", "floor", "upper", "lower", "length", "toString", "toInteger", "toQuantity", "toDecimal", "hasValue",
}
_ITEMS = "item"


def _whole(n: t.Node) -> bool:
    """Whether a path's results are items, not fields of them."""
    if isinstance(n, t.Name):
        return n.name == _ITEMS
    if isinstance(n, t.Dot):
        return _whole(n.left) if isinstance(n.right, t.Call) and n.right.name in _BARE - {"select", "aggregate", "count", "empty", "exists", "all"} else _whole(n.right)
    return isinstance(n, t.Index) and _whole(n.of)


def needed(expressions: Iterable[str]) -> tuple[set[str] | None, bool]:
    """Fields of an order's items that expressions name (None: maybe all), and
    whether the items' order may matter."""
    names: set[str] = set()
    every, ordered = False, False

    def visit(n: t.Node) -> None:
        nonlocal every, ordered
        if isinstance(n, t.Name):
            names.add(n.name)
        elif isinstance(n, t.Dot) and isinstance(n.right, t.Call):
            every |= _whole(n.left) and n.right.name not in _BARE
            ordered |= n.right.name not in _ANY_ORDER
        elif isinstance(n, t.Call):
            every |= n.name in ("children", "descendants", "repeat")
        elif isinstance(n, (t.Index, t.Special)):
            ordered |= not isinstance(n, t.Special) or n.name != "this"
        elif isinstance(n, (t.Binary, t.TypeOp)):
            parts = (n.left, n.right) if isinstance(n, t.Binary) else (n.of,)
            every |= any(_whole(x) for x in parts)
            ordered |= isinstance(n, t.Binary) and n.op in ("=", "!=", "~", "!~")
        for f in n.__dataclass_fields__:
            v = getattr(n, f)
            for x in v if isinstance(v, tuple) else (v,):
                if isinstance(x, t.Node):
                    visit(x)

    for e in expressions:
        tree = parse(e)
        every |= _whole(tree)
        visit(tree)
    if _ITEMS not in names:
        return set(), False
    # without a path of its own a field's comparison is of single values
    return None if every else names & set(ITEM), ordered


def orders(spark: SparkSession, sf: str, expressions: Iterable[str] | None = None) -> DataFrame:
    """One shuffle of each side on the order's key; items sorted within the row."""
    kept, ordered = (None, True) if expressions is None else needed(expressions)
    o = spark.read.parquet(f"{sf}/orders.parquet")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    fields = [(_reference(*v) if isinstance(v, tuple) else F.col(v)).alias(k) for k, v in _ITEM_FROM.items() if kept is None or k in kept]
    # an item without fields is still an item
    value = F.struct(*(fields or [F.lit(None).cast("int").alias("line")]))
    if ordered:
        # numbers sort before the references' texts
        order = [F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c")]
        if kept is not None:
            # what the whole item would be sorted by further
            order += [F.col(v).alias(k) for k, v in list(_ITEM_FROM.items())[3:]]
        items = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("k"), value.alias("v")))).alias("item"))
        items = items.withColumn("item", F.transform("item", lambda x: x["v"]))
    else:
        items = line.groupBy("l_orderkey").agg(F.collect_list(value).alias("item"))
    joined = o.join(items, o["o_orderkey"] == items["l_orderkey"], "left")
    return joined.select(
        F.lit("Order").alias("resourceType"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("priority"),
        _reference("Customer", "o_custkey").alias("customer"),
        "item",
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    lab = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("of"), F.struct("quality", "toxic").alias("label"))
    return d.join(lab, d["doc_id"] == lab["of"], "left").select(
        F.lit("Document").alias("resourceType"), F.col("doc_id").cast("string").alias("id"), "text", "lang", "source", F.col("n_chars").alias("chars"), "label"
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("n"), "role", "text"))).alias("turn")).select(
        F.lit("Conversation").alias("resourceType"), F.col("conv_id").cast("string").alias("id"), "turn"
    )


def resource(spark: SparkSession, sf: str, kind: str, expressions: Iterable[str] | None = None) -> DataFrame:
    """expressions: all that will be read of it, where that is known."""
    if kind == "Order":
        stored = spark.conf.get(STORED, None)
        return spark.read.parquet(stored) if stored else orders(spark, sf, expressions)
    if kind == "Document":
        return documents(spark, sf)
    if kind == "Conversation":
        return conversations(spark, sf)
    table, key, fields = FLAT[kind]
    return _flat(table, key, kind, fields, sf, spark)
