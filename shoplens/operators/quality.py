"""Data-quality checks. Bad rows are flagged or counted, never removed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.expr import as_col, count_rows, line_revenue, padding_chars, ratio, rows_of
from ..plans.joins import lookup_join


def _tall(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """Turn one summary row into one row per entry (a struct column)."""
    return df.select(F.inline(F.array(*entries)))


def profile(df: DataFrame, name: str, date_cols: Sequence[str] = ()) -> DataFrame:
    """Row count, and the earliest and latest day of each date column."""
    aggs = [count_rows().alias("n")]
    for c in date_cols:
        aggs += [F.min(F.to_date(c)).alias(f"lo_{c}"), F.max(F.to_date(c)).alias(f"hi_{c}")]
    no_date = F.lit(None).cast("date")
    entries = [(c, F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in date_cols]
    entries = entries or [(None, no_date, no_date)]
    return _tall(
        df.agg(*aggs),
        [
            F.struct(
                F.lit(name).alias("table_name"),
                F.col("n").alias("n_rows"),
                F.lit(c).cast("string").alias("column_name"),
                lo.alias("first_date"),
                hi.alias("last_date"),
            )
            for c, lo, hi in entries
        ],
    )


def profile_all(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """:func:`profile` of many tables, stacked."""
    return reduce(DataFrame.unionByName, [profile(df, n, cols) for n, (df, cols) in tables.items()])


# In the row-level checks below, ``row_id`` names columns telling child rows apart.
# Rows of a hot key are spread by them; without it all columns are read for that.


def outside_parent_window(
    child: DataFrame,
    parent: DataFrame,
    key: str,
    ts: str,
    start: str,
    end: str,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Child rows dated before their parent's start or after its end.

    ``end`` is a day and compares as midnight, so a time during the end day is outside.
    """
    window = parent.select(key, F.col(start).alias("_start"), F.col(end).alias("_end"))
    at = F.col(ts)
    return (
        lookup_join(child, window, [key])
        .where((at < F.col("_start").cast("timestamp_ntz")) | (at > F.col("_end").cast("timestamp_ntz")))
        .drop("_start", "_end")
    )


def flag_before(df: DataFrame, date_col: str, cutoff, flag: str = "before_cutoff") -> DataFrame:
    """All rows, with a flag on those dated before the cutoff."""
    return df.withColumn(flag, F.coalesce(F.col(date_col) < F.lit(cutoff), F.lit(False)))


def before_date(df: DataFrame, date_col: str, cutoff) -> DataFrame:
    """How many rows are dated before the cutoff."""
    return df.agg(
        count_rows().alias("n_rows"), F.count_if(F.col(date_col) < F.lit(cutoff)).alias("n_before")
    ).withColumn("before_pct", ratio("n_before", "n_rows", 2, 100))


def orphans(
    child: DataFrame, parent: DataFrame, keys: Sequence[str], parent_keys: Sequence[str] | None = None, name: str = ""
) -> DataFrame:
    """Rows of ``child`` without a key, and rows whose key has no parent.

    Child rows are counted per key before the join, so both sides carry one row per key.
    """
    keys = list(keys)
    per_key = child.groupBy(*keys).agg(count_rows().alias("_n"))
    known = (
        parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys or keys, keys)])
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return per_key.join(known, keys, "left").agg(
        F.lit(name).alias("relation"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(no_key, F.col("_n"))), F.lit(0)).alias("n_null_key"),
        F.coalesce(F.sum(F.when(~no_key & F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("n_orphan"),
    )


class Relation(NamedTuple):
    """Rows of ``child`` whose ``keys`` must be ``parent_keys`` of a row of ``parent``; ``where`` restricts the child, ``parent_where`` the parent."""

    name: str
    child: str
    keys: Sequence[str]
    parent: str
    parent_keys: Sequence[str]
    where: str | None = None
    parent_where: str | None = None


def orphan_report(tables: Mapping[str, DataFrame], relations: Sequence[Relation]) -> DataFrame:
    """:func:`orphans` of many relations in one pass: each table is read once, and one shuffle serves all relations.

    Keys that relations compare belong to one key space. Each row of a table becomes one row for each of its key columns, which marks the
    sides (table, keys, condition) that it is on. They are counted per space and key, combined on the map side, so a key
    that many rows hold is one row; an orphan's key has rows on the child's side and none on the parent's.
    """
    sides: list[tuple] = []
    space: dict[tuple, int] = {}
    for r in relations:
        ends = [(r.child, tuple(r.keys), r.where), (r.parent, tuple(r.parent_keys), r.parent_where)]
        for e in ends:
            if e not in space:
                sides.append(e)
                # Sides on the same columns share their rows, so they share a space as well.
                space[e] = next((space[s] for s in sides[:-1] if s[:2] == e[:2]), len(sides))
        one, other = space[ends[0]], space[ends[1]]
        space = {s: one if k == other else k for s, k in space.items()}
    slot = {s: [t for t in sides if space[t] == space[s]].index(s) for s in sides}
    slots = 1 + max(slot.values())

    types = {c.name: c.dataType for t in tables for c in tables[t].schema if any(c.name in s[1] and s[0] == t for s in sides)}
    whole = all(len(s[1]) == 1 for s in sides) and all(isinstance(t, IntegralType) for t in types.values())

    def key(columns: tuple) -> Column:
        if whole:
            return F.col(columns[0]).cast("bigint")
        if len(columns) == 1:
            return F.col(columns[0]).cast("string")
        parts = [F.col(c).cast("string") for c in columns]  # concat is NULL if a part is; lengths keep ("a", "bc") from ("ab", "c")
        return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])

    stacked = []
    for t in dict.fromkeys(s[0] for s in sides):
        entries = []
        for columns in dict.fromkeys(s[1] for s in sides if s[0] == t):
            own = [s for s in sides if s[:2] == (t, columns)]
            marks = []
            for i in range(slots):
                side = next((s for s in own if slot[s] == i), None)
                marks.append(F.lit(0) if side is None else F.lit(1) if side[2] is None else F.when(F.expr(side[2]), 1).otherwise(0))
            entries.append([F.lit(space[own[0]]), key(columns), *[m.cast("int") for m in marks]])
        names = ["space", "key", *[f"s{i}" for i in range(slots)]]
        if len(entries) == 1:
            stacked.append(tables[t].select(*[c.alias(n) for c, n in zip(entries[0], names)]))
        else:
            stacked.append(tables[t].select(F.stack(F.lit(len(entries)), *[c for e in entries for c in e])).toDF(*names))
    per_key = reduce(DataFrame.unionByName, stacked).groupBy("space", "key").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(slots)])

    sums, rows = [], []
    for i, r in enumerate(relations):
        child = (r.child, tuple(r.keys), r.where)
        n, here = F.col(f"s{slot[child]}"), F.col("space") == space[child]
        known = F.col(f"s{slot[r.parent, tuple(r.parent_keys), r.parent_where]}") > 0
        for what, rule in (("rows", here), ("null_key", here & F.col("key").isNull()), ("orphan", here & F.col("key").isNotNull() & ~known)):
            sums.append(F.coalesce(F.sum(F.when(rule, n)), F.lit(0)).alias(f"{what}_{i}"))
        rows.append(F.struct(F.lit(r.name).alias("relation"), *[F.col(f"{w}_{i}").alias(f"n_{w}") for w in ("rows", "null_key", "orphan")]))
    return _tall(per_key.agg(*sums), rows)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(count_rows().alias("n_rows")).where("n_rows > 1")


def null_sweep(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count of every column, in one pass."""
    cols = list(cols or df.columns)
    counts = df.agg(count_rows().alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])
    return _tall(
        counts,
        [
            F.struct(
                F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"null_{c}").alias("n_null")
            )
            for c in cols
        ],
    )


def null_by(df: DataFrame, group: str, col: str) -> DataFrame:
    """NULL and non-NULL rows of ``col`` per value of ``group``."""
    return (
        df.groupBy(group)
        .agg(count_rows().alias("total"), F.count(col).alias("n_present"))
        .withColumn("n_null", F.col("total") - F.col("n_present"))
    )


def null_rule_holds(df: DataFrame, col: str, should_be_null: Column) -> DataFrame:
    """Whether ``col`` is NULL exactly where the rule says so, for every row."""
    as_expected = F.col(col).isNull() == F.coalesce(should_be_null, F.lit(False))
    return df.agg(
        F.lit(col).alias("column_name"),
        count_rows().alias("n_rows"),
        F.count_if(~as_expected).alias("n_failed"),
        F.coalesce(F.bool_and(as_expected), F.lit(True)).alias("holds"),
    )


def whitespace_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with leading or trailing blanks."""
    return (
        df.where(padding_chars(col) != 0)
        .select(F.col(col).alias("value"), padding_chars(col).alias("whitespace_chars"))
        .distinct()
    )


def near_duplicate_values(df: DataFrame, col: str) -> DataFrame:
    """Values that differ only in case or padding and would split a GROUP BY."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(rows_of(df).alias("n"))
        .groupBy(F.lower(F.trim("value")).alias("normalized"))
        .agg(
            count_rows().alias("n_variants"),
            F.min("value").alias("sample_low"),
            F.max("value").alias("sample_high"),
            F.sum("n").alias("n_rows"),
        )
        .where("n_variants > 1")
    )


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking a rule, once per broken rule, in one pass over the table."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    any_broken = reduce(lambda a, b: a | b, rules.values())
    return df.where(any_broken).withColumn("rule", F.explode(broken))


def violation_counts(df: DataFrame, rules: Mapping[str, Column], table: str) -> DataFrame:
    """Checked and failing rows per rule, in one pass over the table."""
    counts = df.agg(count_rows().alias("n"), *[F.count_if(cond).alias(f"bad_{name}") for name, cond in rules.items()])
    return _tall(counts, [_result(name, table, F.col("n"), F.col(f"bad_{name}")) for name in rules])


def before_parent(
    child: DataFrame,
    parent: DataFrame,
    key: str,
    child_date: str,
    parent_date: str,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Child rows dated before their parent, such as orders placed before signup."""
    dates = parent.select(key, F.col(parent_date).alias("_parent_date"))
    return (
        lookup_join(child, dates, [key])
        .where(F.col(child_date) < F.col("_parent_date"))
        .withColumnRenamed("_parent_date", parent_date)
    )


def refund_exceeds_line(
    returns: DataFrame,
    items: DataFrame,
    keys: Sequence[str] = ("order_id", "product_id"),
    refund: str = "refund_amount",
    line_value: Column | str | None = None,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Returns refunded above the charged value of their order line."""
    value = line_revenue() if line_value is None else as_col(line_value)
    lines = items.select(*keys, value.alias("item_line_value"))
    return lookup_join(returns, lines, keys).where(F.col(refund) > F.col("item_line_value"))


def refund_exceeds_order(
    returns: DataFrame,
    orders: DataFrame,
    key: str = "order_id",
    refund: str = "refund_amount",
    net: str = "net_amount",
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Returns refunded above the net amount of their whole order."""
    nets = orders.select(key, F.col(net).alias("order_net_amount"))
    return lookup_join(returns, nets, [key]).where(F.col(refund) > F.col("order_net_amount"))


def reconcile(df: DataFrame, expected: Column, actual: str, scale: int = 2) -> DataFrame:
    """Rows where ``expected`` rounded to ``scale`` differs from ``actual``; NULLs do not count."""
    off = F.round(expected, scale) != F.col(actual)
    return df.agg(count_rows().alias("n_rows"), F.count_if(off).alias("n_mismatched")).withColumn(
        "mismatched_pct", ratio("n_mismatched", "n_rows", 2, 100)
    )


def censored_tail(
    orders: DataFrame,
    returns: DataFrame | None = None,
    days: int | None = None,
    order_date: str = "order_date",
    return_date: str = "return_date",
    flag: str = "return_window_open",
) -> DataFrame:
    """Flag orders so recent that their returns may not have arrived yet.

    The window is ``days`` long, or as long as the last return trails the last order.
    """
    last_order = orders.agg(F.max(order_date)).scalar()
    if days is None:
        if returns is None:
            raise ValueError("give returns or days")
        length = F.datediff(returns.agg(F.max(F.to_date(return_date))).scalar(), last_order)
    else:
        length = F.lit(days)
    return orders.withColumn(
        flag, F.coalesce(F.datediff(last_order, F.col(order_date)) < length, F.lit(False))
    )


def _result(check: str, table: str, checked: Column, failed: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check_name"),
        F.lit(table).alias("table_name"),
        checked.cast("bigint").alias("n_checked"),
        failed.cast("bigint").alias("n_failed"),
    )


def as_result(df: DataFrame, check: str, table: str, checked: str, failed: str) -> DataFrame:
    """Bring a one-row check into the shape of :func:`quality_report`."""
    return _tall(df, [_result(check, table, F.col(checked), F.col(failed))])


def table_checks(
    df: DataFrame, table: str, rules: Mapping[str, Column], lookups: Sequence[tuple[DataFrame, Sequence[str]]] = ()
) -> DataFrame:
    """Checked and failing rows per rule, in one pass over ``df``; rules may also use the columns of ``lookups`` (table, keys).

    A lookup holds one row per key. Rows without a match are checked too, with NULLs, so that the pass counts all rows.
    """
    for lookup, keys in lookups:
        df = lookup_join(df, lookup, keys, "left")
    return violation_counts(df, rules, table)


def relation_checks(
    parent: DataFrame,
    parent_table: str,
    child: DataFrame,
    child_table: str,
    key: str,
    parent_rules: Mapping[str, Column] | None = None,
    child_rules: Mapping[str, Column] | None = None,
    orphan: str | None = None,
    outside: tuple[str, str, str | None, str | None] | None = None,
) -> DataFrame:
    """Rules on a parent, rules on its child and checks between them, with one scan of each.

    ``orphan`` names the check that child keys exist; ``outside`` is (check, child time, parent's first day, parent's last day), as in
    :func:`outside_parent_window`. The child is summed per key first, for ``outside`` with its rows per day, at most two entries a day.
    Both sides of the full join then hold one row per key (``key`` must be unique in ``parent``), so each parent row is counted once.
    """
    parent_rules, child_rules = parent_rules or {}, child_rules or {}
    flags = {f"_c{i}": rule for i, rule in enumerate(child_rules.values())}
    sums = [count_rows().alias("_n"), *[F.count_if(rule).alias(f) for f, rule in flags.items()]]
    if outside:
        day = F.to_date(outside[1])
        late = F.col(outside[1]).cast("timestamp_ntz") > day.cast("timestamp_ntz")
        per_key = child.groupBy(F.col(key).alias("_key"), day.alias("_day"), late.alias("_late")).agg(*sums).groupBy("_key").agg(
            *[F.sum(c).alias(c) for c in ("_n", *flags)], F.collect_list(F.struct("_day", "_late", F.col("_n").alias("n"))).alias("_days")
        )
    else:
        per_key = child.groupBy(F.col(key).alias("_key")).agg(*sums)
    rows = parent.withColumn("_known", F.lit(True)).join(per_key, F.col(key) == F.col("_key"), "full_outer")

    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    aggs = {"p": F.count("_known"), "c": total("_n")}
    results = [(name, parent_table, "p", f"p{i}") for i, name in enumerate(parent_rules)]
    aggs |= {f"p{i}": F.count_if(F.col("_known") & rule) for i, rule in enumerate(parent_rules.values())}
    results += [(name, child_table, "c", f) for name, f in zip(child_rules, flags)]
    aggs |= {f: total(f) for f in flags}
    if orphan:
        aggs["orphans"] = total(F.when(F.col("_known").isNull() & F.col("_key").isNotNull(), F.col("_n")))
        results.append((orphan, child_table, "c", "orphans"))
    if outside:
        name, _, start, end = outside

        def bad(d: Column) -> Column:
            early = d["_day"] < F.col(start) if start else F.lit(False)
            late = (d["_day"] > F.col(end)) | ((d["_day"] == F.col(end)) & d["_late"]) if end else F.lit(False)
            return F.coalesce(early, F.lit(False)) | F.coalesce(late, F.lit(False))

        aggs["outside"] = total(F.aggregate(F.filter("_days", bad), F.lit(0).cast("bigint"), lambda n, d: n + d["n"]))
        results.append((name, child_table, "c", "outside"))
    return _tall(rows.agg(*[c.alias(f"_agg_{n}") for n, c in aggs.items()]), [_result(check, table, F.col(f"_agg_{n}"), F.col(f"_agg_{bad}")) for check, table, n, bad in results])


def quality_report(results: Sequence[DataFrame]) -> DataFrame:
    """Stack check results and add the failure rate and a verdict."""
    stacked = reduce(DataFrame.unionByName, results)
    return stacked.withColumn("failed_pct", ratio("n_failed", "n_checked", 2, 100)).withColumn(
        "verdict", F.when(F.col("n_failed") == 0, "pass").otherwise("flag")
    )
