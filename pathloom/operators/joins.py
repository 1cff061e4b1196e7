"""References and environment collections as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.api.engine import Engine, fresh
from pathloom.plans import coll as c


def resolve(engine: Engine, df: DataFrame, reference: str, target: DataFrame, target_kind: str, key: str = "id", kind: str | None = None, keep_unresolved: bool = False) -> DataFrame:
    """df with `resolved`, the resource that a reference names: an equi-join on
    type and id. Spark broadcasts the target, if its statistics allow. Several
    references give a row each. References that lead nowhere drop the row, or
    leave a null."""
    ref = engine.compile(df, reference, kind)
    text = c.mapped(ref, lambda r: r["reference"] if ref.ty.name == "Struct" else r, c.STRING)
    ref_, key_ = fresh(df, "ref_of"), fresh(df, "key_of")
    rows = df.withColumn(ref_, text.col) if text.single else df.withColumn(ref_, F.explode_outer(text.col) if keep_unresolved else F.explode(text.col))
    names = target.columns
    side = target.select(F.concat(F.lit(f"{target_kind}/"), F.col(key)).alias(key_), F.struct(*names).alias("resolved"))
    return rows.join(side, rows[ref_] == side[key_], "left" if keep_unresolved else "inner").drop(ref_, key_)


def lookup(engine: Engine, df: DataFrame, left: str, env: DataFrame, right: str, name: str, env_kind: str | None = None, kind: str | None = None, key: str = "id") -> DataFrame:
    """`%env.where(right = %context.left)` for all rows at once: df with the
    matching rows of env as an array of structs. One shuffle of each side, none
    where Spark broadcasts; the matches are gathered by the row's key."""
    probe = c.as_one(engine.compile(df, left, kind)).col
    build = c.as_one(engine.compile(env, right, env_kind)).col
    p, k = fresh(df, "probe"), fresh(df, "build")
    packed = env.select(build.alias(k), F.struct(*env.columns).alias("v")).where(F.col(k).isNotNull())
    gathered = packed.groupBy(k).agg(F.sort_array(F.collect_list("v")).alias(name))
    rows = df.withColumn(p, probe)
    out = rows.join(gathered, rows[p] == gathered[k], "left").drop(p, k)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(gathered.schema[name].dataType)))


def semi(engine: Engine, df: DataFrame, left: str, env: DataFrame, right: str, env_kind: str | None = None, kind: str | None = None, anti: bool = False) -> DataFrame:
    """Rows whose value is (or is not) among env's: `left in %env.right`."""
    p, k = fresh(df, "probe"), fresh(df, "build")
    rows = df.withColumn(p, c.as_one(engine.compile(df, left, kind)).col)
    values = engine.compile(env, right, env_kind)
    side = env.select(values.col.alias(k) if values.single else F.explode(values.col).alias(k))
    return rows.join(side, rows[p] == side[k], "left_anti" if anti else "left_semi").drop(p)
