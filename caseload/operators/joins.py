"""Lookups, deduplication, quality-review merge and reconciliation.

Lookups carry no broadcast hint: Spark broadcasts a dimension when its measured size is below the
threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload import dims
from caseload.functions import values


def _lookup(df: DataFrame, col: str, dim: DataFrame, key: str, value: str) -> DataFrame:
    one = dim.groupBy(F.col(key).cast("string").alias("_key")).agg(F.max(value).alias("_value"))
    joined = df.join(one, F.col(col).cast("string") == F.col("_key"), "left")
    name = F.coalesce("_value", F.col(col).cast("string"))
    return joined.withColumn(col, name).drop("_key", "_value")


def lookup_owner(df: DataFrame, owners: DataFrame, col: str = "ticket_owner") -> DataFrame:
    """Owner id to name from ``owners(id, name)``; unknown ids pass through."""
    return _lookup(df, col, owners, "id", "name")


def lookup_pipeline(df: DataFrame, pipelines: DataFrame, col: str = "pipeline") -> DataFrame:
    """Pipeline id to label from ``pipelines(id, label)``; unknown ids pass through."""
    return _lookup(df, col, pipelines, "id", "label")


def lookup_agent(df: DataFrame, directory: DataFrame, col: str = "agent_id",
                 agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """``agent_name`` and ``is_bot`` from ``directory(id, name, type)``, then from the known
    bot ids, else ``Unknown``."""
    one = directory.groupBy(F.col("id").cast("string").alias("_id")).agg(
        F.max(F.struct("name", "type")).alias("_agent"))
    joined = df.join(one, F.col(col).cast("string") == F.col("_id"), "left")
    known_bot = values.lookup(F.col(col).cast("string"), agents.bot_ids)
    name = F.when(F.col("_id").isNotNull(), F.coalesce("_agent.name", F.lit("Unknown")))
    is_bot = F.when(F.col("_id").isNotNull(), F.col("_agent.type").eqNullSafe("bot"))
    return joined.withColumns({
        "agent_name": F.when(F.col(col).isNotNull(), F.coalesce(name, known_bot, F.lit("Unknown"))),
        "is_bot": F.coalesce(is_bot, known_bot.isNotNull()),
    }).drop("_id", "_agent")


def dedup(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order.

    ``row_number = 1`` lets Spark keep one row per key in every map task before the shuffle, so a
    key with very many copies does not reach one task as a whole.
    """
    keys = [key] if isinstance(key, str) else key
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def explode_agents(df: DataFrame, col: str = "human_agents") -> DataFrame:
    """One row per known team member named in the comma-separated list."""
    one = df.where(F.coalesce(F.col(col), F.lit("")) != "").withColumn(
        "_name", F.explode(F.split(col, ",")))
    team = values.lookup(F.trim(F.lower("_name")), dims.TEAM_NAMES)
    return one.withColumn("human_agent", team).where(F.col("human_agent").isNotNull()).drop("_name")


def integrate_qa(main: DataFrame, qa: DataFrame, key: str = "ticket_id",
                 order: list[str] | None = None) -> DataFrame:
    """The first review row of each key overwrites the ``QA - *`` columns; every main row stays."""
    marked = [c for c in qa.columns if c.startswith("QA - ")]
    if not marked:
        renamed = {c: f"QA - {c}" for c in qa.columns if c != key and c not in (order or [])}
        qa = qa.withColumnsRenamed(renamed)
        marked = list(renamed.values())
    first = dedup(qa.where(F.col(key).isNotNull()), key, order or marked)
    packed = first.select(F.col(key).alias("_key"), F.struct(*[f"`{c}`" for c in marked]).alias("_qa"))
    joined = main.join(packed, F.col(key) == F.col("_key"), "left")
    out = [F.col(f"`{c}`") for c in main.columns if c not in marked]
    for c in marked:
        new = F.col("_qa").getField(c)
        # A matched review overwrites, also with NULL; unmatched rows keep what they had.
        old = F.col(f"`{c}`") if c in main.columns else F.lit("")
        out.append(F.when(F.col("_key").isNotNull(), new).otherwise(old).alias(c))
    return joined.select(*out)


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows on each side, keys on one side only, and whether the row counts match."""
    # One shuffle for both sides; repeated keys are added up before it.
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = (
        a.select(key, one.alias("n"), none.alias("m"))
        .unionByName(b.select(key, none.alias("n"), one.alias("m")))
        .groupBy(key).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    )
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("right_rows"),
        F.count_if((F.col("n") > 0) & (F.col("m") == 0)).alias("left_only_keys"),
        F.count_if((F.col("m") > 0) & (F.col("n") == 0)).alias("right_only_keys"),
        F.coalesce(F.sum("n") == F.sum("m"), F.lit(True)).alias("counts_match"),
    )


BUCKETS = 4_096


def _compared(df: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """Key, bucket, the row's hash and its values; maps and variants count as their JSON text."""
    plain = lambda c: df.schema[c].dataType.typeName() not in ("map", "variant")
    values_ = [(F.col(f"`{c}`") if plain(c) else F.to_json(f"`{c}`")).alias(c) for c in columns]
    rows = df.select(F.col(key).alias("key"), F.struct(*values_).alias("row"))
    marked = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(buckets)))
    # Nulls leave a hash as it was, so which values are missing is hashed too.
    missing = F.concat(*[F.isnull(f"row.`{c}`").cast("int").cast("string") for c in columns]) if columns else F.lit("")
    return marked.withColumn("hash", F.xxhash64(F.col("key").isNull(), "key", missing, "row"))


def reconcile_contents(a: DataFrame, b: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """J11 by values: one row per key whose rows differ, with the kind of difference and the fields.

    Both sides are first reduced to a count and a checksum per bucket of keys, combined before the shuffle; only
    buckets that differ are compared row by row, so equal tables cost one scan each and a shuffle of checksums.
    Kinds are ``left only``, ``right only``, ``changed`` (with the names of the fields, and both rows as JSON) and
    ``repeated``: a key that has several rows on a side, and not the same ones on the other. A missing key is a
    key like any other. Columns that one side lacks are not compared.
    """
    columns = [c for c in a.columns if c in b.columns and c != key]
    kinds = {c: (a.schema[c].dataType, b.schema[c].dataType) for c in [key, *columns]}
    text = [c for c, (x, y) in kinds.items() if x != y]
    a, b = (df.withColumns({c: F.col(f"`{c}`").cast("string") for c in text}) if text else df for df in (a, b))
    left, right = (_compared(df, key, columns, buckets) for df in (a, b))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    wide = F.col("hash").cast("decimal(38,0)")
    sums = (
        left.select("bucket", wide.alias("x"), one.alias("n"), none.alias("m"))
        .unionByName(right.select("bucket", (-wide).alias("x"), none.alias("n"), one.alias("m")))
        .groupBy("bucket").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("m").alias("m")))
    # At most ``buckets`` rows.
    differing = F.broadcast(sums.where("x <> 0 or n <> m").select("bucket"))
    side = lambda df, name: df.join(differing, "bucket", "left_semi").groupBy("key").agg(
        F.count("*").alias(f"{name}_n"), F.sum(wide).alias(f"{name}_x"), F.max_by("row", "hash").alias(name))
    both = side(left, "l").alias("l").join(
        side(right, "r").alias("r"), F.col("l.key").eqNullSafe(F.col("r.key")), "full")
    fields = F.array_compact(F.array(*[
        F.when(~F.col(f"l.l.`{c}`").eqNullSafe(F.col(f"r.r.`{c}`")), F.lit(c)) for c in columns]).cast("array<string>"))
    kind = (
        F.when(F.col("r_n").isNull(), "left only").when(F.col("l_n").isNull(), "right only")
        .when((F.col("l_n") > 1) | (F.col("r_n") > 1), "repeated").otherwise("changed"))
    same = F.coalesce((F.col("l_n") == F.col("r_n")) & (F.col("l_x") == F.col("r_x")), F.lit(False))
    return both.where(~same).select(
        F.when(F.col("l_n").isNotNull(), F.col("l.key")).otherwise(F.col("r.key")).alias(key), kind.alias("kind"),
        F.when(kind == "changed", fields).alias("fields"),
        F.to_json("l.l").alias("left_row"), F.to_json("r.r").alias("right_row"))
