"""Constraint audits and snapshot differences, as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from watchframe.operators.probes import union
from watchframe.schemas import CHECKS, FOREIGN_KEYS, UNIQUE, Check, ForeignKey, Unique


def duplicate_keys(df: DataFrame, unique: Unique) -> DataFrame:
    """Keys that occur more than once, with their row count. NULL keys never clash."""
    rows = df.filter(unique.where) if unique.where else df
    keys = [F.expr(k).alias(f"key{i}") for i, k in enumerate(unique.keys)]
    names = [f"key{i}" for i in range(len(keys))]
    return rows.select(*keys).dropna().groupBy(*names).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphan_keys(child: DataFrame, parent: DataFrame, column: str, parent_column: str = "id") -> DataFrame:
    """Referenced values without a parent row, with their row count.

    References collapse to distinct values before they meet the parent table.
    """
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n_rows"))
    return used.join(parent.select(F.col(parent_column).alias("key")), "key", "left_anti")


def orphan_rows(child: DataFrame, parent: DataFrame, column: str, parent_column: str = "id") -> DataFrame:
    """Child rows whose reference has no parent."""
    ids = parent.select(F.col(parent_column).alias("_id"))
    return child.filter(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_id"), "left_anti")


def broken_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Every row with the names of the checks it breaks, one output row each, in one pass."""
    marks = [F.when(~F.expr(c.expression), F.lit(c.name)) for c in checks]
    broken = F.filter(F.array(*marks), lambda r: r.isNotNull())
    return df.select("*", F.explode(broken).alias("rule"))


def delete_effects(tables: Mapping[str, DataFrame], parent: str, deleted: DataFrame, foreign_keys: Sequence[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """What deleting parent rows (their key in column ``id``) does to every table that refers to them.

    ``effect`` is removed, cleared or blocked.
    """
    words = {"cascade": "removed", "set_null": "cleared", "restrict": "blocked"}
    gone = deleted.select(F.col("id").alias("_id")).distinct()
    parts = []
    for fk in foreign_keys:
        if fk.parent != parent or fk.table not in tables:
            continue
        hit = tables[fk.table].join(gone, F.col(fk.column) == F.col("_id"), "left_semi")
        parts.append(hit.groupBy(F.col(fk.column).cast("string").alias("key")).agg(F.count("*").alias("n_rows")).select(
            F.lit(fk.table).alias("table"), F.lit(fk.column).alias("column"), F.lit(words[fk.on_delete]).alias("effect"),
            "key", "n_rows"))
    return union(parts)


def delete_plan(
    tables: Mapping[str, DataFrame], parent: str, deleted: DataFrame, folder: str, foreign_keys: Sequence[ForeignKey] = FOREIGN_KEYS,
) -> DataFrame:
    """What deleting rows of ``parent`` (their key in column ``id``) does to all tables, however far cascades reach.

    Every key is a delete of its own. Its reach is a fixpoint: rows that refer to a reached row by ``cascade`` are reached, round
    by round, each stored in ``folder``; a row already reached is not followed again, so references may go in circles. A
    reference by ``restrict`` to any reached row blocks the whole delete of that key, also if the referring row were reached
    itself; then only what blocks it is listed. One row per ``key``, ``table`` and ``column``: the ``effect`` (removed, cleared
    or blocked) on ``n_rows`` references. Keys are compared as text. NULL keys reach nothing.
    """
    spark = deleted.sparkSession
    known = [fk for fk in foreign_keys if fk.table in tables]
    if any(fk.parent_column != "id" for fk in known):
        raise ValueError("references must be to the column id")
    referred = {fk.parent for fk in known}
    key = F.col("id").cast("string")
    start = f"{folder}/round=0/table={parent}"
    deleted.filter(F.col("id").isNotNull()).select(key.alias("key"), key.alias("id")).distinct().write.parquet(start)
    # the parts of each table's reached rows; a round follows only what the round before added
    reached, added = {parent: [start]}, {parent: start}

    def hits(fk: ForeignKey, rows: DataFrame) -> DataFrame:
        child = tables[fk.table]
        own = child["id"] if "id" in child.columns else F.lit(None)
        refs = child.select(F.col(fk.column).cast("string").alias("_ref"), own.cast("string").alias("_own"))
        return refs.join(rows, F.col("_ref") == F.col("id"))

    number = 0
    while added:
        number += 1
        found: dict[str, list[DataFrame]] = {}
        for fk in known:
            if fk.on_delete == "cascade" and fk.parent in added and fk.table in referred:
                rows = hits(fk, spark.read.parquet(added[fk.parent])).filter("_own IS NOT NULL")
                found.setdefault(fk.table, []).append(rows.select("key", F.col("_own").alias("id")))
        added = {}
        for table, parts in found.items():
            fresh = union(parts).distinct()
            if table in reached:
                fresh = fresh.join(spark.read.parquet(*reached[table]), ["key", "id"], "left_anti")
            path = f"{folder}/round={number}/table={table}"
            fresh.write.parquet(path)
            if not spark.read.parquet(path).isEmpty():
                added[table] = path
        for table, path in added.items():
            reached.setdefault(table, []).append(path)

    words = {"cascade": "removed", "set_null": "cleared", "restrict": "blocked"}
    parts = [
        hits(fk, spark.read.parquet(*reached[fk.parent])).groupBy("key").agg(F.count("*").alias("n_rows")).select(
            "key", F.lit(fk.table).alias("table"), F.lit(fk.column).alias("column"), F.lit(words[fk.on_delete]).alias("effect"), "n_rows")
        for fk in known if fk.parent in reached]
    if not parts:
        return spark.createDataFrame([], "key string, table string, column string, effect string, n_rows bigint")
    union(parts).write.parquet(f"{folder}/effects")
    effects = spark.read.parquet(f"{folder}/effects")
    blocked = effects.filter("effect = 'blocked'")
    return blocked.unionByName(effects.filter("effect <> 'blocked'").join(blocked.select("key").distinct(), "key", "left_anti"))


def cascade_removed(child: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """Child rows that go with their parent."""
    return child.join(deleted.select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_semi")


def cascade_kept(child: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """The child table after the delete."""
    return child.join(deleted.select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_anti")


def set_null(child: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """The child table with references to deleted rows cleared."""
    gone = deleted.select(F.col("id").alias("_id")).distinct()
    joined = child.join(gone, F.col(column) == F.col("_id"), "left")
    kept = F.when(F.col("_id").isNull(), F.col(column)).alias(column)
    return joined.select(*[kept if c == column else F.col(c) for c in child.columns])


def restrict_blockers(child: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """Deleted keys that are still referred to, with the number of references."""
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n_rows"))
    return used.join(deleted.select("id").distinct(), "id", "left_semi")


def audit_tables(
    tables: Mapping[str, DataFrame], unique: Sequence[Unique] = UNIQUE,
    foreign_keys: Sequence[ForeignKey] = FOREIGN_KEYS, checks: Sequence[Check] = CHECKS,
) -> DataFrame:
    """Broken constraints of a set of tables: ``table``, ``rule``, number of offending keys and rows.

    Every table is read once. A row gives one entry for each rule it takes part in: its unique keys, the ids it offers, the ids
    it refers to (both in the space of the parent's column) and the checks it breaks. Entries are counted per key before they
    are shuffled, so a key that many rows share is one entry of each task; then the ids offered and referred to meet.
    """
    known = [fk for fk in foreign_keys if fk.table in tables and fk.parent in tables]
    nothing = F.lit("")

    def entry(kind: str, rule: str, space: str, key: Column, when: Column) -> Column:
        fields = {"kind": F.lit(kind), "rule": F.lit(rule), "space": F.lit(space), "key": key}
        return F.when(when, F.struct(*[c.alias(name) for name, c in fields.items()]))

    parts = []
    for table, df in tables.items():
        entries = []
        for u in (u for u in unique if u.table == table):
            rule, columns = f"unique:{','.join(u.keys)}", [F.expr(k) for k in u.keys]
            complete = reduce(and_, [c.isNotNull() for c in columns])
            key = F.to_json(F.array(*[c.cast("string") for c in columns]))
            entries.append(entry("unique", rule, f"{table} {rule}", key, complete & F.expr(u.where) if u.where else complete))
        for column in dict.fromkeys(fk.parent_column for fk in known if fk.parent == table):
            entries.append(entry("offered", "", f"{table}.{column}", F.col(column).cast("string"), F.col(column).isNotNull()))
        for fk in (fk for fk in known if fk.table == table):
            # compared as the parent's type, so 7 and 7.0 are one key
            key = F.col(fk.column).cast(tables[fk.parent].schema[fk.parent_column].dataType).cast("string")
            key = F.coalesce(key, F.concat(F.lit("unlike:"), F.col(fk.column).cast("string")))
            entries.append(entry(
                "referred", f"foreign_key:{fk.column}->{fk.parent}", f"{fk.parent}.{fk.parent_column}", key, F.col(fk.column).isNotNull()))
        for c in (c for c in checks if c.table == table):
            entries.append(entry("check", c.name, f"{table} {c.name}", nothing, ~F.expr(c.expression)))
        if entries:
            parts.append(df.select(F.lit(table).alias("table"), F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))))
    counted = union(parts).groupBy("table", "kind", "rule", "space", "key").agg(F.count("*").alias("n_rows"))
    # a key has one entry for each rule about it, however many rows it has
    met = counted.filter("kind <> 'unique' OR n_rows > 1").groupBy("space", "key").agg(
        F.bool_or(F.col("kind") == "offered").alias("known"), F.collect_list(F.struct("table", "kind", "rule", "n_rows")).alias("uses"))
    broken = met.select("known", F.inline("uses")).filter("kind IN ('unique', 'check') OR (kind = 'referred' AND NOT known)")
    n_keys = F.sum(F.when(F.col("kind") == "check", F.col("n_rows")).otherwise(1)).alias("n_keys")
    return broken.groupBy("table", "rule").agg(n_keys, F.sum("n_rows").alias("n_rows"))


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], live: Column | None = None) -> DataFrame:
    """Rows added, updated, removed or unchanged by key, comparing every field.

    ``live`` limits both sides, so a row switched off counts as removed. ``old`` and ``new`` hold the
    row before and after.
    """
    if live is not None:
        old, new = old.filter(live), new.filter(live)
    fields = [c for c in new.columns if c not in key]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*fields).alias(name))

    joined = side(old, "old").join(side(new, "new"), list(key), "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated"))
    return joined.select(*key, change.alias("change"), "old", "new")


def content_version(content: Column) -> Column:
    """Version of a text or binary content."""
    return F.sha2(content, 256)


def row_version(columns: Sequence[str]) -> Column:
    """Version of a row; a NULL differs from an empty text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def hash_sums(version: Column) -> list[Column]:
    """Sums of the pieces of row versions, whatever the order of the rows; each task adds up its own."""
    return [F.sum(F.conv(F.substring(version, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]


def table_version(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One version for a whole table, whatever the order of its rows."""
    h = df.select(row_version(columns or df.columns).alias("h"))
    total = h.agg(F.count("*").alias("n"), *hash_sums(F.col("h")))
    return total.select("n", F.sha2(F.to_json(F.struct("n", *[f"s{i}" for i in range(4)])), 256).alias("version"))
