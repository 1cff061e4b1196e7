"""Queries over the star-schema resources, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.api import Engine, View, column, criteria
from pathloom.model.star import STAR
from pathloom.operators import closure, joins, lift
from pathloom.sources import star

ENGINE = Engine(STAR, now="2024-05-06T07:08:09.123Z")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_IT = f"it as (select *, row_number() over (partition by l_orderkey order by {_ORDER}) as rn from lineitem)"
_O = "select cast(o_orderkey as varchar) as id"


def _scalar(name: str, kind: str, columns: dict[str, str], sql: str) -> None:
    """Scalar columns of each resource, with its id."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ENGINE.project(star.resource(spark, sf, kind, columns.values()), columns, kind=kind, keep=["id"])

    QUERIES[name], SQL[name] = run, sql


def _rows(name: str, kind: str, expression: str, sql: str) -> None:
    """id, position and value of each result; positions tell the items' order."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ENGINE.evaluate(star.resource(spark, sf, kind, [expression, "item.line.first()"]), expression, kind=kind)

    QUERIES[name], SQL[name] = run, sql


def _query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def _per_order(name: str, columns: dict[str, str], values: str) -> None:
    """Columns of each order; SQL values over its items `i` (null without any)."""
    _scalar(name, "Order", columns, f"with {_IT} {_O}, {values} from orders o left join it i on i.l_orderkey = o.o_orderkey group by o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority")


# navigation, filtering, existence
_rows("nav_flatten", "Order", "Order.item.quantity", f"with {_IT} select cast(l_orderkey as varchar) as id, cast(rn - 1 as int) as position, l_quantity as value from it join orders on o_orderkey = l_orderkey")
_query("where_exists", f"{_O} from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")(
    lambda s, sf: ENGINE.filter(star.resource(s, sf, "Order", ["Order.item.exists(returnFlag = 'R')"]), "Order.item.exists(returnFlag = 'R')").select("id")
)
_rows("where_items", "Order", "item.where(quantity > 45 and discount >= 0.05).price", f"with {_IT}, w as (select *, row_number() over (partition by l_orderkey order by rn) as p from it where l_quantity > 45 and l_discount >= 0.05) select cast(l_orderkey as varchar) as id, cast(p - 1 as int) as position, l_extendedprice as value from w join orders on o_orderkey = l_orderkey")
_rows("select_body", "Order", "item.select(price * (1 - discount)).select($this.round(4))", f"with {_IT} select cast(l_orderkey as varchar) as id, cast(rn - 1 as int) as position, round(l_extendedprice * (1 - l_discount), 4) as value from it join orders on o_orderkey = l_orderkey")
_per_order("all_vacuous", {"ok": "item.all(discount < 0.1)"}, "coalesce(bool_and(l_discount < 0.1), true) as ok")
_per_order("count_items", {"n": "item.count()", "none": "item.empty()"}, "count(i.l_orderkey) as n, count(i.l_orderkey) = 0 as none")
_per_order(
    "bool_folds",
    {"at": "item.select(quantity > 10).allTrue()", "ot": "item.select(quantity > 49).anyTrue()", "af": "item.select(tax > 0.07).allFalse()", "of": "item.select(tax > 0.01).anyFalse()"},
    "coalesce(bool_and(l_quantity > 10), true) as at, coalesce(bool_or(l_quantity > 49), false) as ot, coalesce(bool_and(not l_tax > 0.07), true) as af, coalesce(bool_or(not l_tax > 0.01), false) as of",
)
_scalar("of_type_is", "Order", {"a": "status is string", "b": "total is integer", "c": "status.ofType(string)", "d": "(status as string).length()"}, f"{_O}, true as a, false as b, o_orderstatus as c, length(o_orderstatus)::bigint as d from orders")
_D = "select cast(d.doc_id as varchar) as id"
_DL = "from documents d left join labels l on l.doc_id = d.doc_id"
_scalar("type_reflection", "Document", {"a": "label.quality.type().name", "b": "label.type().namespace", "c": "label.quality.is(integer)", "d": "label.quality is string"}, f"{_D}, case when quality is not null then 'integer' end as a, case when l.doc_id is not null then 'Star' end as b, case when quality is not null then true end as c, case when quality is not null then false end as d {_DL}")
_scalar(
    "values_and_variables",
    "Document",
    {
        "a": "label.quality.hasValue()", "b": "label.quality.getValue()", "c": "label.single().toxic", "d": "lang.union(source).count()", "e": "lang !~ 'EN'", "f": "label.quality.as(integer)",
        "g": "defineVariable('n', chars * 2).select(%n + chars)", "h": "chars.trace('chars') > 5L", "i": "/* whole */ chars * 1.5 // and half", "j": "label.quality.union(label.toxic).sum()", "k": "(label.quality | {}).count()", "l": "(label.toxic = 1) = true",
    },
    f"{_D}, case when quality is not null then true end as a, quality::bigint as b, toxic::bigint as c, (case when lang = source then 1 else (lang is not null)::int + (source is not null)::int end)::bigint as d, lower(lang) <> 'en' as e, quality::bigint as f, "
    f"n_chars * 3 as g, n_chars > 5 as h, n_chars * 1.5::double as i, case when quality is not null then quality + case when toxic = quality then 0 else toxic end end::bigint as j, (quality is not null)::bigint as k, toxic = 1 as l {_DL}",
)

# aggregates
_per_order(
    "agg_folds",
    {"s": "item.price.sum().round(2)", "lo": "item.price.min()", "hi": "item.price.max()", "mean": "item.quantity.avg().round(6)"},
    "round(sum(l_extendedprice), 2) as s, min(l_extendedprice) as lo, max(l_extendedprice) as hi, round(avg(l_quantity), 6) as mean",
)
_per_order("aggregate_fold", {"t": "item.quantity.aggregate($total + $this, 0)", "top": "item.line.aggregate(iif($this > $total, $this, $total), 0)"}, "coalesce(sum(l_quantity), 0)::double as t, coalesce(max(l_linenumber), 0)::bigint as top")
_per_order("aggregate_index", {"t": "item.aggregate($total + $index, 0)"}, "coalesce(sum(rn - 1), 0)::bigint as t")

# subsetting, sets, sort
_per_order(
    "subsetting",
    {"f": "item.first().price", "l": "item.last().price", "t": "item.tail().count()", "s": "item.skip(2).price.first()", "k": "item.take(2).count()", "i": "item[1].price"},
    "max(l_extendedprice) filter (rn = 1) as f, arg_max(l_extendedprice, rn) as l, greatest(count(i.l_orderkey) - 1, 0)::bigint as t, max(l_extendedprice) filter (rn = 3) as s, least(count(i.l_orderkey), 2)::bigint as k, max(l_extendedprice) filter (rn = 2) as i",
)
_per_order(
    "set_functions",
    {
        "d": "item.returnFlag.distinct().count()",
        "u": "(item.returnFlag | item.lineStatus).count()",
        "x": "item.returnFlag.intersect('R' | 'A').count()",
        "e": "item.returnFlag.exclude('N').count()",
        "c": "item.returnFlag.combine(item.lineStatus).count()",
        "q": "item.returnFlag.isDistinct()",
        "sub": "item.lineStatus.subsetOf('O' | 'F')",
        "sup": "item.returnFlag.supersetOf('R')",
    },
    "count(distinct l_returnflag) as d, len(list_distinct(list_concat(coalesce(list(l_returnflag) filter (l_returnflag is not null), []), coalesce(list(l_linestatus) filter (l_linestatus is not null), []))))::bigint as u, count(distinct l_returnflag) filter (l_returnflag in ('R', 'A')) as x, count(*) filter (l_returnflag <> 'N') as e, 2 * count(i.l_orderkey) as c, count(distinct l_returnflag) = count(l_returnflag) as q, coalesce(bool_and(l_linestatus in ('O', 'F')), true) as sub, coalesce(bool_or(l_returnflag = 'R'), false) as sup",
)
_per_order("sort_keys", {"a": "item.sort(-price, line).price.first()", "b": "item.sort(returnFlag, -quantity, price).first().quantity"}, f"max(l_extendedprice) as a, arg_min(l_quantity, (l_returnflag, -l_quantity, l_extendedprice)) as b")
_per_order("membership", {"a": "'R' in item.returnFlag", "b": "item.line contains 3", "c": "item.returnFlag.exists($this = 'A')"}, "coalesce(bool_or(l_returnflag = 'R'), false) as a, coalesce(bool_or(l_linenumber = 3), false) as b, coalesce(bool_or(l_returnflag = 'A'), false) as c")
_per_order("index_variable", {"a": "item.where($index > 1).count()", "b": "item.select($index).sum()"}, "greatest(count(i.l_orderkey) - 2, 0)::bigint as a, sum(rn - 1)::bigint as b")
_per_order("equality_collections", {"a": "item.line = item.line", "b": "item.take(2).returnFlag ~ item.take(2).returnFlag", "c": "item.line != item.line.take(1)"}, "case when count(i.l_orderkey) > 0 then true end as a, true as b, case when count(i.l_orderkey) > 0 then count(i.l_orderkey) > 1 end as c")

# logic and control
_scalar("iif_implies", "Order", {"v": "iif(status = 'F', total, 0)", "w": "(status = 'F') implies (total > 1000)"}, f"{_O}, case when o_orderstatus = 'F' then o_totalprice else 0 end as v, not (o_orderstatus = 'F') or o_totalprice > 1000 as w from orders")
_scalar(
    "three_valued",
    "Document",
    {"a": "label.toxic = 1 and lang = 'en'", "b": "label.toxic = 1 or lang = 'en'", "c": "(label.toxic = 1) xor (lang = 'en')", "d": "(label.toxic = 1) implies (lang = 'en')", "e": "(label.toxic = 1).not()", "f": "label.exists()"},
    "select cast(d.doc_id as varchar) as id, (toxic = 1) and (lang = 'en') as a, (toxic = 1) or (lang = 'en') as b, (toxic = 1) <> (lang = 'en') as c, not (toxic = 1) or (lang = 'en') as d, not (toxic = 1) as e, l.doc_id is not null as f from documents d left join labels l on l.doc_id = d.doc_id",
)
_scalar("coalesce_fn", "Document", {"q": "coalesce(label.quality, -1)"}, "select cast(d.doc_id as varchar) as id, coalesce(quality, -1)::bigint as q from documents d left join labels l on l.doc_id = d.doc_id")
_scalar("arithmetic", "Order", {"a": "(total * 2 + 1).round(2)", "b": "total div 7", "c": "(total mod 7).round(6)", "d": "(total / 3).round(6)", "e": "-total", "f": "total / 0"}, f"{_O}, round(o_totalprice * 2 + 1, 2) as a, cast(trunc(o_totalprice / 7) as bigint) as b, round(o_totalprice % 7, 6) as c, round(o_totalprice / 3, 6) as d, -o_totalprice as e, cast(null as double) as f from orders")
_scalar("comparisons", "Customer", {"a": "balance < 0", "b": "balance >= 1000.5", "c": "name > 'Customer#000000100'", "d": "segment ~ 'building'"}, "select cast(c_custkey as varchar) as id, c_acctbal < 0 as a, c_acctbal >= 1000.5 as b, c_name > 'Customer#000000100' as c, lower(c_mktsegment) = 'building' as d from customer")

# strings
_C = "select cast(c_custkey as varchar) as id"
_scalar(
    "strings_basic",
    "Customer",
    {"u": "name.upper()", "l": "name.lower()", "n": "name.length()", "s": "name.substring(2, 4)", "t": "name.substring(500)", "i": "name.indexOf('0')", "j": "name.lastIndexOf('0')", "st": "name.startsWith('Cust')", "e": "name.endsWith('7')", "c": "name.contains('12')"},
    f"{_C}, upper(c_name) as u, lower(c_name) as l, length(c_name)::bigint as n, substr(c_name, 3, 4) as s, case when length(c_name) > 500 then substr(c_name, 501) end as t, (instr(c_name, '0') - 1)::bigint as i, case when instr(c_name, '0') = 0 then -1 else length(c_name) - instr(reverse(c_name), '0') end::bigint as j, starts_with(c_name, 'Cust') as st, suffix(c_name, '7') as e, contains(c_name, '12') as c from customer",
)
_scalar(
    "strings_regex",
    "Customer",
    {"m": "name.matches('[0-9]{3}7$')", "f": "name.matchesFull('[A-Z].*')", "r": "name.replaceMatches('0+', '-')", "x": "name.replace('0', 'oo')", "g": "segment.replaceMatches('([A-Z])([A-Z])', '$2$1')"},
    f"{_C}, regexp_matches(c_name, '[0-9]{{3}}7$') as m, regexp_full_match(c_name, '[A-Z].*') as f, regexp_replace(c_name, '0+', '-', 'g') as r, replace(c_name, '0', 'oo') as x, regexp_replace(c_mktsegment, '([A-Z])([A-Z])', '\\2\\1', 'g') as g from customer",
)
_scalar(
    "strings_split_join",
    "Customer",
    {"a": "name.split('#')[1]", "b": "name.toChars().count()", "c": "name.toChars().distinct().sort().join('')", "d": "(segment & '/' & name).trim()", "e": "name.split('0').join('+')"},
    f"{_C}, str_split(c_name, '#')[2] as a, length(c_name)::bigint as b, array_to_string(list_sort(list_distinct(str_split(c_name, ''))), '') as c, trim(c_mktsegment || '/' || c_name) as d, array_to_string(str_split(c_name, '0'), '+') as e from customer",
)
_scalar(
    "strings_encode",
    "Customer",
    {"h": "name.encode('hex')", "b": "name.encode('base64')", "back": "name.encode('base64').decode('base64')", "e": "('<' & name & '>').escape('html')", "j": "('\"' & name).escape('json')", "un": "('&lt;' & name).unescape('html')"},
    f"{_C}, lower(hex(c_name)) as h, base64(encode(c_name)) as b, c_name as back, '&lt;' || c_name || '&gt;' as e, '\\\"' || c_name as j, '<' || c_name as un from customer",
)

# mathematics, conversions
_scalar(
    "math_functions",
    "Customer",
    {"a": "balance.abs()", "b": "balance.ceiling()", "c": "balance.floor()", "d": "balance.truncate()", "e": "balance.round(1)", "f": "balance.abs().sqrt().round(6)", "g": "(balance.abs() + 1).ln().round(6)", "h": "(balance / 10000).exp().round(6)", "i": "(balance.abs() + 1).log(10).round(6)", "j": "(balance / 100).power(2).round(4)"},
    f"{_C}, abs(c_acctbal) as a, ceil(c_acctbal)::bigint as b, floor(c_acctbal)::bigint as c, trunc(c_acctbal)::bigint as d, round(c_acctbal, 1) as e, round(sqrt(abs(c_acctbal)), 6) as f, round(ln(abs(c_acctbal) + 1), 6) as g, round(exp(c_acctbal / 10000), 6) as h, round(ln(abs(c_acctbal) + 1) / ln(10), 6) as i, round(pow(c_acctbal / 100, 2), 4) as j from customer",
)
_scalar(
    "conversions",
    "Customer",
    {"a": "id.toInteger() + 1", "b": "name.toInteger()", "c": "name.convertsToInteger()", "d": "id.toDecimal() / 4", "e": "balance > 0", "f": "id.convertsToQuantity()", "g": "id.toLong()", "h": "(balance > 0).toString()", "i": "'true'.toBoolean()", "j": "id.convertsToBoolean()"},
    f"{_C}, c_custkey + 1 as a, cast(null as bigint) as b, false as c, cast(c_custkey as double) / 4 as d, c_acctbal > 0 as e, true as f, c_custkey as g, cast(c_acctbal > 0 as varchar) as h, true as i, c_custkey in (0, 1) as j from customer",
)

# dates, quantities
_scalar(
    "date_components",
    "Order",
    {"y": "date.yearOf()", "m": "date.monthOf()", "d": "date.dayOf()", "h": "date.hourOf()", "i": "date.minuteOf()", "s": "date.secondOf()", "t": "date.dateOf().toString()", "p": "date.precision()"},
    f"{_O}, year(o_orderdate)::bigint as y, month(o_orderdate)::bigint as m, day(o_orderdate)::bigint as d, hour(o_orderdate)::bigint as h, minute(o_orderdate)::bigint as i, second(o_orderdate)::bigint as s, strftime(o_orderdate, '%Y-%m-%d') as t, 17::bigint as p from orders",
)
_scalar(
    "date_arithmetic",
    "Order",
    {"a": "(date + 3 months).dateOf().toString()", "b": "(date - 10 days).toString()", "c": "date < @1996-01-01", "e": "date.lowBoundary(8).toString()", "f": "date + 1 year > @1997-06-30"},
    f"{_O}, strftime(o_orderdate + interval 3 month, '%Y-%m-%d') as a, strftime(o_orderdate - interval 10 day, '%Y-%m-%dT%H:%M:%S.%g') as b, case when o_orderdate < timestamp '1996-01-01' then true when o_orderdate >= timestamp '1996-01-02' then false end as c, strftime(o_orderdate, '%Y-%m-%d') as e, case when o_orderdate + interval 1 year >= timestamp '1997-07-01' then true when o_orderdate + interval 1 year < timestamp '1997-06-30' then false end as f from orders",
)
_query("date_filter", f"{_O} from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01' and o_totalprice > 100000")(
    lambda s, sf: ENGINE.filter(star.resource(s, sf, "Order"), "date > @1994 and date < @1996 and total > 100000").select("id")
)


@_query("clock", f"{_O}, o_orderdate::date < date '1996-06-15' as past, o_orderdate::date = date '1996-06-15' as same, hour(o_orderdate) < 12 as early from orders")
def _clock(spark, sf):
    e = Engine(STAR, now="1996-06-15T12:00:00.000Z")
    columns = {"past": "date.dateOf() < today()", "same": "date.dateOf() = now().dateOf()", "early": "date.hourOf() < timeOfDay().hourOf()"}
    return e.project(star.resource(spark, sf, "Order", columns.values()), columns, kind="Order", keep=["id"])


_scalar(
    "temporal_conversions",
    "Event",
    {"a": "ts.toString().toDateTime() = ts", "b": "ts.toString().convertsToDateTime()", "c": "ts.dateOf().toString().toDate().dayOf()", "d": "ts.timeOf().toString().toTime().minuteOf()", "e": "ts.millisecondOf()", "f": "type.convertsToDate()", "g": "(ts.toString() & 'Z').toDateTime().timezoneOffsetOf()", "h": "ts.toString().substring(11).convertsToTime()", "i": "type.toTime().empty()"},
    "select cast(event_id as varchar) as id, true as a, true as b, day(ts)::bigint as c, minute(ts)::bigint as d, (millisecond(ts) % 1000)::bigint as e, false as f, 0.0::double as g, true as h, true as i from events",
)
_per_order(
    "quantities",
    {"a": "item.where((quantity.toString() & ' \\'kg\\'').toQuantity() > 20000 'g').count()", "b": "(total.toQuantity() + 1 '1').value.round(2)", "c": "1 'kg' = 1000 'g'", "d": "7 days = 1 week", "e": "(1 year).comparable(1 'a')"},
    "count(*) filter (l_quantity > 20)::bigint as a, round(o_totalprice + 1, 2) as b, true as c, true as d, true as e",
)


def _priced(spark: SparkSession, sf: str, digits: str) -> DataFrame:
    return star.resource(spark, sf, "Part").withColumn("price", F.col("price").cast(digits))


@_query("boundaries", "select cast(p_partkey as varchar) as id, floor((cast(p_retailprice as decimal(18,4)) - 0.00005::decimal(18,5)) * 10)::double / 10 as lo, ceil((cast(p_retailprice as decimal(18,4)) + 0.00005::decimal(18,5)) * 10)::double / 10 as hi, (cast(p_retailprice as decimal(18,4)) - 0.00005::decimal(18,5))::double as edge, 4::bigint as places from part")
def _edges(spark, sf):
    out = ENGINE.project(_priced(spark, sf, "decimal(12,4)"), {"lo": "price.lowBoundary(1)", "hi": "price.highBoundary(1)", "edge": "price.lowBoundary(8)", "places": "price.precision()"}, kind="Part", keep=["id"])
    return out.select("id", *[F.col(x).cast("double").alias(x) for x in ("lo", "hi", "edge")], "places")


@_query(
    "decimals",
    "with p as (select *, cast(p_retailprice as decimal(24,8)) as x from part) select cast(p_partkey as varchar) as id, round(x::double / 7, 9) as q, cast(x * 1.00000001::decimal(10,8) as double) as m, cast(x + 0.00000001::decimal(12,8) as double) as s, "
    "cast(x - p_size as double) as d, round(cast(x % 7.5::decimal(4,1) as double), 8) as r, cast(floor(x / 7) as bigint) as i, true as back, -cast(x as double) as neg, round((x::double + p_size) / 2, 8) as mean from p",
)
def _decimals(spark, sf):
    e = {"q": "(price / 7).round(9)", "m": "price * 1.00000001", "s": "price + 0.00000001", "d": "price - size", "r": "price mod 7.5", "i": "price div 7", "back": "price / 3 * 3 ~ price", "neg": "-price", "mean": "price.combine(size).avg().round(8)"}
    out = ENGINE.project(_priced(spark, sf, "decimal(20,8)"), e, kind="Part", keep=["id"])
    return out.select("id", "i", "back", *[F.col(x).cast("double").alias(x) for x in ("q", "m", "s", "d", "r", "neg", "mean")])


@_query(
    "quantity_columns",
    f"with {_IT}, w as (select l_orderkey, sum(l_quantity) as grams, count(*) as n from lineitem group by 1) {_O}, round(sum(case when l_linenumber % 2 = 0 then l_quantity * 1000 else l_quantity end), 3) as total, count(*) filter (l_quantity > 10) as heavy, "
    "bool_or(l_linenumber % 2 = 1) and bool_or(l_linenumber % 2 = 0) as mixed from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey",
)
def _mixed_units(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    unit = F.when(F.col("l_linenumber") % 2 == 0, "kg").otherwise("g")
    df = line.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_list(F.struct(F.col("l_quantity").cast("decimal(18,3)").alias("value"), unit.alias("unit"))).alias("weight"))
    e = Engine()
    out = e.project(df, {"total": "weight.sum()", "heavy": "weight.where(value > 10).count()", "mixed": "weight.unit.distinct().count() > 1"}, keep=["id"])
    grams = F.when(F.col("total.unit") == "kg", F.col("total.value") * 1000).otherwise(F.col("total.value"))
    orders = star.resource(spark, sf, "Order", []).select("id")
    return out.join(orders, "id").select("id", F.round(grams.cast("double"), 3).alias("total"), F.col("heavy").cast("bigint").alias("heavy"), "mixed")


@_query("typed_results", f"{_O}, o_orderstatus as value, 'Star.string' as type from orders")
def _typed(spark, sf):
    return ENGINE.evaluate(star.resource(spark, sf, "Order", []), "Order.status", kind="Order", typed=True).select("id", "value", F.lit("Star.string").alias("type"))


# tree, schemaless data, narrative, vectors
_scalar("children_count", "Document", {"n": "children().count()", "d": "label.descendants().count()", "all": "descendants().count()"}, f"{_D}, 3 + (text is not null)::bigint + (lang is not null)::bigint + (source is not null)::bigint + (l.doc_id is not null)::bigint as n, (quality is not null)::bigint + (toxic is not null)::bigint as d, 3 + (text is not null)::bigint + (lang is not null)::bigint + (source is not null)::bigint + (l.doc_id is not null)::bigint + (quality is not null)::bigint + (toxic is not null)::bigint as all {_DL}")


@_query("props_variant", "select cast(event_id as varchar) as id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract(props, '$.k') is not null as has from events")
def _props(spark, sf):
    df = star.resource(spark, sf, "Event").select("id", F.parse_json("props").alias("props"))
    e = Engine()
    return e.project(df, {"k": "props.k.toInteger()", "has": "props.k.exists()"}, keep=["id"])


_scalar("narrative", "Page", {"ok": "html.htmlChecks()"}, None)
del SQL["narrative"]
_scalar("vector_ops", "Vector", {"n": "value.select($this * $this).sum().round(4)", "m": "value.max()", "c": "value.count()"}, "select cast(vec_id as varchar) as id, round(list_sum([x::double * x::double for x in embedding]), 4) as n, list_max(embedding)::double as m, len(embedding)::bigint as c from embeddings")
_scalar("conversation_turns", "Conversation", {"n": "turn.count()", "first": "turn.first().role", "chars": "turn.select(text.length()).sum()", "users": "turn.where(role = 'user').count()"}, "select cast(conv_id as varchar) as id, count(*) as n, arg_min(role, (turn, role, text)) as first, sum(length(text))::bigint as chars, count(*) filter (role = 'user') as users from conversations group by conv_id")


# joins, closure, datasets
@_query("resolve_join", "select cast(o_orderkey as varchar) as id, n_name as nation from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def _resolve(spark, sf):
    o = star.resource(spark, sf, "Order").drop("item")
    with_customer = joins.resolve(ENGINE, o, "customer", star.resource(spark, sf, "Customer"), "Customer", kind="Order")
    flat = with_customer.select(F.col("id").alias("order"), "resolved.*")
    with_nation = joins.resolve(ENGINE, flat, "nation", star.resource(spark, sf, "Nation"), "Nation", kind="Customer")
    return with_nation.select(F.col("order").alias("id"), F.col("resolved.name").alias("nation"))


@_query("env_join", f"{_O}, c_mktsegment as segment from orders left join customer on c_custkey = o_custkey")
def _env(spark, sf):
    o = star.resource(spark, sf, "Order").drop("item")
    found = joins.lookup(ENGINE, o, "customer.reference", star.resource(spark, sf, "Customer"), "'Customer/' & id", "customers", env_kind="Customer", kind="Order")
    return Engine().project(found, {"segment": "customers.first().segment"}, keep=["id"])


_query("semi_join", "select cast(c_custkey as varchar) as id from customer where c_custkey in (select o_custkey from orders)")(
    lambda s, sf: joins.semi(ENGINE, star.resource(s, sf, "Customer"), "'Customer/' & id", star.resource(s, sf, "Order").drop("item"), "customer.reference", env_kind="Order", kind="Customer").select("id")
)
_query("anti_join", "select cast(c_custkey as varchar) as id from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")(
    lambda s, sf: joins.semi(ENGINE, star.resource(s, sf, "Customer"), "'Customer/' & id", ENGINE.filter(star.resource(s, sf, "Order").drop("item"), "total > 300000", kind="Order"), "customer.reference", env_kind="Order", kind="Customer", anti=True).select("id")
)


@_query(
    "repeat_tree",
    "with e as (select 'Region/' || n_regionkey as p, 'Nation/' || n_nationkey as c from nation union all select 'Nation/' || c_nationkey, 'Customer/' || c_custkey from customer) "
    "select e.p as root, e.c as node, 1 as depth from e where e.p like 'Region/%' union all select a.p, b.c, 2 from e a join e b on b.p = a.c where a.p like 'Region/%'",
)
def _tree(spark, sf):
    nations, customers, regions = (star.resource(spark, sf, k) for k in ("Nation", "Customer", "Region"))
    edges = [
        Engine(STAR).project(df, {"parent": f"{up}.reference", "child": f"'{kind}/' & id"}, kind=kind) for df, up, kind in ((nations, "region", "Nation"), (customers, "nation", "Customer"))
    ]
    roots = Engine(STAR).project(regions, {"root": "'Region/' & id"}, kind="Region")
    return closure.descend(edges[0].unionByName(edges[1]), roots)


_query("lift_aggregate", "select round(sum(l_extendedprice), 2) as total, count(*) as n, max(l_quantity) as top from lineitem join orders on o_orderkey = l_orderkey")(
    lambda s, sf: lift.aggregate(ENGINE, star.resource(s, sf, "Order", ["Order.item.price"]), "Order.item.price", {"total": "sum", "n": "count"}, "Order").select(F.round("total", 2).alias("total"), "n").crossJoin(
        lift.aggregate(ENGINE, star.resource(s, sf, "Order", ["Order.item.quantity"]), "Order.item.quantity", {"top": "max"}, "Order")
    )
)
_query("lift_distinct", "select distinct l_returnflag as value from lineitem join orders on o_orderkey = l_orderkey")(lambda s, sf: lift.distinct(ENGINE, star.resource(s, sf, "Order", ["Order.item.returnFlag"]), "Order.item.returnFlag", "Order"))
_query("lift_group", "select c_mktsegment as segment, count(c_acctbal) as n, round(sum(c_acctbal), 2) as total from customer group by 1")(
    lambda s, sf: lift.group(ENGINE, star.resource(s, sf, "Customer"), {"segment": "segment"}, {"n": ("count", "balance"), "total": ("sum", "balance")}, "Customer").withColumn("total", F.round("total", 2))
)
_query("lift_top", "select cast(o_orderkey as varchar) as id, o_totalprice as total from orders order by o_totalprice desc, id limit 10")(
    lambda s, sf: lift.top(ENGINE, star.resource(s, sf, "Order").drop("item"), "total", 10, "Order").select("id", "total")
)


# projections, constraints, views, functions
@_query(
    "project_rows",
    f"with {_IT} {_O}, upper(o_orderstatus) as status, case o_orderpriority when '1-URGENT' then 'now' when '2-HIGH' then 'soon' end as speed, coalesce(max(l_extendedprice) filter (rn = 1), -1) as lead, case when o_orderstatus in ('F', 'O') then o_orderstatus end as known, o_totalprice > 100000 as big, round(o_totalprice / 2, 4) as half "
    "from orders left join it on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus, o_orderpriority, o_totalprice",
)
def _project(spark, sf):
    return ENGINE.project(
        star.resource(spark, sf, "Order", ["item.first().price"]),
        {
            "status": "status.upper()",
            "speed": {"path": "priority", "choices": {"1-URGENT": "now", "2-HIGH": "soon"}},
            "lead": {"path": "item.first().price", "default": -1},
            "known": {"path": "status", "enum": ["F", "O"]},
            "big": {"test": "total > 100000"},
            "half": "%half.round(4)",
        },
        kind="Order",
        variables={"half": "total / 2"},
        keep=["id"],
    )


class OrderView(View):
    type = "Order"
    env = {"limit": 150000}
    variables = {"lines": "item.count()"}
    number = column("id")
    lines = column("%lines")
    dear = criteria("total > %limit")


@_query("view_rows", f"{_O}, cast(o_orderkey as varchar) as number, (select count(*) from lineitem where l_orderkey = o_orderkey) as lines, o_totalprice > 150000 as dear from orders")
def _view(spark, sf):
    return OrderView.project(ENGINE, star.resource(spark, sf, "Order", ["item.count()"]), keep=["id"])


@_query(
    "constraints",
    f"{_O}, 'total-positive' as \"constraint\", 'error' as severity from orders where not coalesce(o_totalprice > 1000, false) union all {_O}, 'has-items', 'warning' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey) union all {_O}, 'few-lines', 'error' from orders where (select count(*) from lineitem where l_orderkey = o_orderkey) > 6",
)
def _constraints(spark, sf):
    rules = [
        {"key": "total-positive", "expression": "total > 1000"},
        {"key": "has-items", "expression": "item.exists()", "severity": "warning"},
        {"key": "few-lines", "expression": "item.count() <= 6"},
    ]
    return ENGINE.check_constraints(star.resource(spark, sf, "Order", [r["expression"] for r in rules]), rules, kind="Order").select("id", "constraint", "severity")


@_query("custom_functions", f"{_O}, round(o_totalprice * 0.9, 4) as net, o_totalprice > 200000 as vip, 'ORD-' || o_orderkey as tag from orders")
def _custom(spark, sf):
    e = ENGINE.with_(
        functions={
            "net": "total * (1 - %rate)",
            "isVip": {"expression": "total > 200000", "criteria": True},
            "tagged": lambda x, prefix: x.with_(col=F.concat(prefix.col, x.col)),
        },
        env={"rate": 0.1},
    )
    return e.project(star.resource(spark, sf, "Order"), {"net": "net().round(4)", "vip": "isVip()", "tag": "id.tagged('ORD-')"}, kind="Order", keep=["id"])


_query("criteria_filter", f"{_O} from orders where o_totalprice > 100000 and exists (select 1 from lineitem where l_orderkey = o_orderkey)")(
    lambda s, sf: ENGINE.filter(star.resource(s, sf, "Order", ["total > 100000 and item.exists()"]), "total > 100000 and item.exists()", kind="Order").select("id")
)


@_query("row_index", "select cast(r_regionkey as varchar) as id, row_number() over (order by r_regionkey) - 1 as i, count(*) over () as n from region")
def _index(spark, sf):
    return ENGINE.project(star.resource(spark, sf, "Region"), {"i": "%rowIndex", "n": "%rowTotal"}, kind="Region", keep=["id"], row_order="id")



