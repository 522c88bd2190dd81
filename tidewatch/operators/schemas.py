"""Convergence of schemas (Q11): what each environment has to change so that all have the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import ranked

#: Whole numbers by width, and the decimal digits that each needs.
WHOLE = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
DECIMAL = "^decimal\\(([0-9]+),([0-9]+)\\)$"


def widest(types: Column) -> Column:
    """The least type that holds the values of all ``types`` (an array of names): the join of a lattice.

    Whole numbers widen among themselves; with decimals to a decimal with room for every
    whole and fractional digit (double beyond 38); with float to double unless they are
    tinyint or smallint. Date, timestamp_ntz and timestamp widen in this order. All else
    meets in string. The join of a type with one that holds it is that one, so
    another round changes nothing.
    """
    only = lambda *names: F.forall(types, lambda t: t.isin(*names))
    number = lambda t: t.isin(*WHOLE) | t.rlike(DECIMAL)
    digits = lambda t: F.coalesce(F.create_map(*[F.lit(x) for kv in WHOLE.items() for x in kv])[t], F.regexp_extract(t, DECIMAL, 1).try_cast("int") - F.regexp_extract(t, DECIMAL, 2).try_cast("int"))
    places = F.array_max(F.transform(types, lambda t: F.coalesce(F.regexp_extract(t, DECIMAL, 2).try_cast("int"), F.lit(0))))
    whole = F.array_max(F.transform(types, digits))
    by_width = F.element_at(F.array(*[F.lit(w) for w in WHOLE]), F.array_max(F.transform(types, lambda t: F.array_position(F.array(*[F.lit(w) for w in WHOLE]), t))).cast("int"))
    exact = F.when(whole + places <= 38, F.concat(F.lit("decimal("), (whole + places).cast("string"), F.lit(","), places.cast("string"), F.lit(")"))).otherwise("double")
    return (
        F.when(F.size(types) == 1, types[0])
        .when(only(*WHOLE), by_width)
        .when(F.forall(types, number), exact)
        .when(only("float", "tinyint", "smallint"), "float")
        .when(F.forall(types, lambda t: number(t) | t.isin("float", "double")), "double")
        .when(only("date", "timestamp_ntz"), "timestamp_ntz")
        .when(only("date", "timestamp_ntz", "timestamp"), "timestamp")
        .otherwise("string")
    )


def changes(snapshots: DataFrame, environments: list[str]) -> DataFrame:
    """What each environment lacks: env, table_name, column_name, change, data_type, nullable (both as they are to be).

    snapshots: env, table_name, column_name, data_type, nullable, one row for each column.
    change: ``create`` (the environment has no such table), ``add``, ``retype``, ``relax``
    (nulls must be allowed), or ``retype,relax``. Nothing is dropped or narrowed. A column is
    nullable if it is in some environment, or if some environment has its table
    without it (rows there have no value yet). Null flags count as nullable, rows with a
    null name don't count. One aggregation by column and one by table; no pairs of environments.
    """
    rows = snapshots.where("env IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL")
    rows = rows.select("env", "table_name", "column_name", "data_type", F.coalesce("nullable", F.lit(True)).alias("nullable"))
    has = F.map_from_entries(F.collect_list(F.struct("env", F.struct("data_type", "nullable"))))
    columns = rows.groupBy("table_name", "column_name").agg(has.alias("has"), F.array_sort(F.collect_set("data_type")).alias("types"), F.bool_or("nullable").alias("nullable"))
    tables = rows.groupBy("table_name").agg(F.collect_set("env").alias("homes"))
    met = columns.join(tables, "table_name")
    needs = F.col("nullable") | (F.size(F.array_except("homes", F.map_keys("has"))) > 0)
    each = met.select("table_name", "column_name", "homes", "has", widest(F.col("types")).alias("data_type"), needs.alias("nullable"), F.explode(F.array(*[F.lit(e) for e in environments])).alias("env"))
    now = F.col("has")[F.col("env")]
    retype, relax = now["data_type"] != F.col("data_type"), F.col("nullable") & ~now["nullable"]
    change = (
        F.when(~F.array_contains("homes", F.col("env")), "create")
        .when(now.isNull(), "add")
        .otherwise(F.concat_ws(",", F.when(retype, "retype"), F.when(relax, "relax")))
    )
    return each.select("env", "table_name", "column_name", change.alias("change"), "data_type", "nullable").where("change <> ''")


def applied(snapshots: DataFrame, made: DataFrame) -> DataFrame:
    """The snapshots once ``changes`` are made."""
    columns = ["env", "table_name", "column_name"]
    return snapshots.select(*columns, "data_type", "nullable").join(made, columns, "left_anti").unionByName(made.select(*columns, "data_type", "nullable"))


def statements(made: DataFrame) -> DataFrame:
    """env, no, statement: ``changes`` as DDL in an order that works: tables first, then columns, types, null rules; by name within each."""
    name = lambda c: F.concat(F.lit("`"), F.regexp_replace(c, "`", "``"), F.lit("`"))
    table, column = name(F.col("table_name")), name(F.col("column_name"))
    typed = F.concat(column, F.lit(" "), F.col("data_type"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
    new = made.where("change = 'create'").groupBy("env", "table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_name", typed.alias("typed")))), lambda x: x["typed"]), ", ").alias("columns"))
    new = new.select("env", F.lit(1).alias("step"), "table_name", F.lit("").alias("column_name"), F.concat(F.lit("CREATE TABLE "), table, F.lit(" ("), F.col("columns"), F.lit(")")).alias("statement"))
    alter, has = F.concat(F.lit("ALTER TABLE "), table), lambda kind: F.array_contains(F.split("change", ","), kind)
    steps = [
        F.when(has("add"), F.struct(F.lit(2).alias("step"), F.concat(alter, F.lit(" ADD COLUMN "), column, F.lit(" "), F.col("data_type")).alias("statement"))),
        F.when(has("retype"), F.struct(F.lit(3).alias("step"), F.concat(alter, F.lit(" ALTER COLUMN "), column, F.lit(" TYPE "), F.col("data_type")).alias("statement"))),
        F.when(has("relax"), F.struct(F.lit(4).alias("step"), F.concat(alter, F.lit(" ALTER COLUMN "), column, F.lit(" DROP NOT NULL")).alias("statement"))),
    ]
    old = made.select("env", "table_name", "column_name", F.inline(F.array_compact(F.array(*steps)))).select(*new.columns)
    order = [F.asc("step"), F.asc("table_name"), F.asc("column_name")]
    return ranked(new.unionByName(old), ["env"], order, "no").select("env", "no", "statement")
