"""Two sources of records made one, ledgers, links between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.operators.graph import connected_components
from parchmill.session import discard, settled


def reconciled(app: DataFrame, other: DataFrame, key: str, fields: list[str], link: str) -> DataFrame:
    """A full outer join: the application's fields where it has them, gaps filled from the other side, the other side's
    link added, rows of one side kept with their origin, and rows of the other side without a key appended."""
    keyed, orphans = other.where(F.col(key).isNotNull()), other.where(F.col(key).isNull())
    a = app.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = keyed.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], link, F.lit(True).alias("_b"))
    where = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "app").otherwise("other")
    joined = a.join(b, key, "full").select(key, *[F.coalesce(f"a_{f}", f"b_{f}").alias(f) for f in fields], link, where.alias("origin"))
    return joined.unionByName(orphans.select(key, *fields, link, F.lit("orphan").alias("origin")))


def filled_urls(artifacts: DataFrame, summary: DataFrame, doc: str, artifact: str, url: str) -> DataFrame:
    """Artifacts whose url is missing get it from the summary row of the same document and artifact."""
    known = summary.select(doc, artifact, F.col(url).alias("_url"))
    return artifacts.join(known, [doc, artifact], "left").withColumn(url, F.coalesce(F.nullif(F.col(url), F.lit("")), "_url")).drop("_url")


def duplicates_to_remove(rows: DataFrame, ident: str, keys: list[str], rank: list[str]) -> DataFrame:
    """Rows that share any key are one thing, also by way of others; all but the highest rank of each go. A key's rows
    are linked to its first, so a common key makes as many edges as rows."""
    links = None
    for key in keys:
        has = rows.where(F.col(key).isNotNull()).select(ident, key)
        first = has.groupBy(key).agg(F.min(ident).alias("_first"))
        part = has.join(first, key).select(F.col(ident).alias("src"), F.col("_first").alias("dst"))
        links = part if links is None else links.unionByName(part)
    parts = connected_components(settled(links.where("src <> dst"), "same"))
    best = rows.join(parts.withColumnRenamed("node", ident), ident)
    top = best.groupBy("component").agg(F.max(F.struct(*rank, (-F.col(ident)).alias("_id"))).alias("_top"))
    return best.join(top, "component").where(F.struct(*rank, (-F.col(ident)).alias("_id")) != F.col("_top")).select(ident, "component")


def first_sharing(rows: DataFrame, probe: DataFrame, key: str, ident: str, owner: str) -> DataFrame:
    """For each probe the earliest stored row of its owner with the same key."""
    first = rows.groupBy(owner, key).agg(F.min(ident).alias("first"))
    return probe.join(first, [owner, key])


def lineage(artifacts: DataFrame, ident: str, parent: str, order: list[str], doc: str, paths: bool = False) -> DataFrame:
    """The forest of versions: (doc, id, depth, cyclic). A parent that is not there makes a root; a cycle's rows, which no root
    reaches, have depth 0. Each round doubles the stretch of ancestors that a row has seen, so a chain of n versions takes
    log n joins. With `paths` also path, which sorts a document's rows depth first and siblings by `order`; a path is as long
    as its depth, so ask for it only where chains are short."""
    known = artifacts.select(doc, F.col(ident).alias(parent), F.lit(True).alias("_has"))
    own = [F.array(F.struct(*order, ident)).alias("path")] if paths else []
    linked = artifacts.join(known, [doc, parent], "left").select(doc, ident, F.when(F.col("_has"), F.col(parent)).alias("up"), *own)
    state = settled(linked.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)), "lineage")
    longest, stretch = state.groupBy(doc).count().agg(F.max("count")).first()[0] or 0, 1
    while stretch <= longest and not state.where("up is not null").isEmpty():
        above = [F.col("path").alias("_path")] if paths else []
        ahead = state.select(doc, F.col(ident).alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"), *above)
        longer = [F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")] if paths else []
        further = state.join(ahead, [doc, "up"], "left").select(doc, ident, F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), *longer)
        before, state = state, settled(further, "lineage")
        discard(before)
        stretch *= 2
    cyclic = F.col("up").isNotNull()
    last = [F.when(cyclic, F.slice("path", -1, 1)).otherwise(F.col("path")).alias("path")] if paths else []
    return state.select(doc, ident, F.when(cyclic, 0).otherwise(F.col("depth")).alias("depth"), cyclic.alias("cyclic"), *last)


def missing_on_either(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Violations: keys that only one of two tables knows."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit(f"missing_in_{names[1]}").alias("violation")).unionByName(b.join(a, key, "left_anti").select(key, F.lit(f"missing_in_{names[0]}").alias("violation")))


def merged_ledger(disk: DataFrame, session: DataFrame, removed: DataFrame, ident: str, attempts: str, terminal: Column) -> DataFrame:
    """Ledgers united: attempts by the greater, rows that the disk removed stay removed, terminal ones drop their counter."""
    a = disk.select(ident, F.col(attempts).alias("_a"))
    b = session.select(ident, F.col(attempts).alias("_b"))
    both = a.join(b, ident, "full").join(removed.select(ident), ident, "left_anti")
    return both.select(ident, F.greatest("_a", "_b").alias("_n")).select(ident, F.when(~terminal, F.col("_n")).alias(attempts))
