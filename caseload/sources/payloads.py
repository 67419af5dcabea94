"""Nested API payloads to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload import dims
from caseload.functions import times, values


def explode_ratings(df: DataFrame, col: str = "records") -> DataFrame:
    """Daily map to rows; days without a rating are dropped."""
    day = df.select(F.explode(col).alias("date", "r")).select(
        "date", F.coalesce("r.good", F.lit(0)).alias("good"), F.coalesce("r.bad", F.lit(0)).alias("bad"))
    total = day.withColumn("total", F.col("good") + F.col("bad")).where("total > 0")
    return total.withColumn("satisfaction_pct", values.percent(F.col("good"), F.col("total")))


def flatten_tickets(df: DataFrame, properties: list[str]) -> DataFrame:
    """Named properties plus id, creation and update time."""
    return df.select(
        *[F.try_element_at("properties", F.lit(p)).alias(p) for p in properties],
        F.col("id").alias("ticket_id"),
        F.col("createdAt").alias("created_at"),
        F.col("updatedAt").alias("updated_at"),
    )


def ticket_payloads(df: DataFrame, col: str = "payload") -> DataFrame:
    """S11 from JSON text: one ticket per object, or per element of a page's ``results``.

    Returns the columns that ``flatten_tickets`` reads, whatever else the objects hold; nested property values stay JSON
    text. Text that is no JSON object gives no row.
    """
    page = df.select(F.try_parse_json(F.col(f"`{col}`")).alias("v"))
    many = F.try_variant_get("v", "$.results", "array<variant>")
    one = page.select(F.explode(F.coalesce(many, F.array("v"))).alias("v")).where(_kind("v", "OBJECT"))
    return one.select(*[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in ("id", "createdAt", "updatedAt")],
                      F.try_variant_get("v", "$.properties", "map<string,string>").alias("properties"))


def _kind(v, name: str) -> Column:
    """Whether a variant is an object, an array or a scalar of a type."""
    return F.coalesce(F.schema_of_variant(v).startswith(name), F.lit(False))


def chat_payloads(df: DataFrame, col: str = "payload") -> DataFrame:
    """JSON text of chats in any of the API's shapes to the columns of ``schema.CHAT_PAYLOAD``.

    A chat may be wrapped in ``chat``; its thread is ``thread``, or the first of ``threads`` when that is missing
    or empty; properties are an object or a list of name and value under ``items``; tags are texts or objects with a
    name. A part of another type than expected is missing, and so is empty text where a time or an id is meant. Text
    that is no JSON object gives no row.
    """
    text = lambda v, path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    array = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    node = lambda v, path: F.try_variant_get(v, path, "variant")
    objects = lambda v, path: F.filter(array(v, path), lambda x: _kind(x, "OBJECT"))
    chat = df.select(F.try_parse_json(F.col(f"`{col}`")).alias("v")).where(_kind("v", "OBJECT"))
    chat = chat.select(F.when(_kind(node("v", "$.chat"), "OBJECT"), node("v", "$.chat")).otherwise(F.col("v")).alias("v"))
    single = _kind(node("v", "$.thread"), "OBJECT") & (F.schema_of_variant(node("v", "$.thread")) != "OBJECT<>")
    listed = node("v", "$.properties.items")
    chat = chat.select(
        "v", F.when(single, node("v", "$.thread")).otherwise(node("v", "$.threads[0]")).alias("t"),
        F.when(_kind(listed, "ARRAY"), objects("v", "$.properties.items")).alias("items"))
    item = lambda name: node(F.try_element_at(
        F.filter("items", lambda i: F.try_variant_get(i, "$.name", "string") == name), F.lit(-1)), "$.value")
    chat = chat.withColumns({n: F.when(F.col("items").isNotNull(), item(n)).otherwise(node("v", f"$.properties.{n}"))
                             for n in ("rating", "source")})
    tag = lambda x: F.when(_kind(x, "OBJECT"), F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit(""))).otherwise(
        F.try_variant_get(x, "$", "string"))
    times_of = ("created_at", "started_at", "ended_at", "last_event_created_at")
    event = lambda e: F.struct(*[text(e, f"$.{f}").alias(f) for f in ("type", "created_at", "author_type")])
    return chat.select(
        text("v", "$.id").alias("id"), *[text("v", f"$.{f}").alias(f) for f in ("created_at", "started_at", "last_event_created_at")],
        F.transform(objects("v", "$.users"), lambda u: F.struct(text(u, "$.id").alias("id"), text(u, "$.type").alias("type"))).alias("users"),
        F.struct(*[text("t", f"$.{f}").alias(f) for f in times_of], F.transform(objects("t", "$.events"), event).alias("events")).alias("thread"),
        F.struct(
            F.struct(F.try_variant_get("rating", "$.score", "double").alias("score"),
                     F.try_variant_get("rating", "$.comment", "string").alias("comment")).alias("rating"),
            F.struct(F.try_variant_get("source", "$.type", "string").alias("type")).alias("source")).alias("properties"),
        F.transform(array("v", "$.tags"), tag).alias("tags"))


def _seconds(start: Column, end: Column) -> Column:
    return times.micros_between(times.parse_iso(start), times.parse_iso(end)) / F.lit(1000000.0)


def _not_negative(name: str) -> Column:
    return F.when(F.col(name) < 0, F.lit(0.0)).otherwise(F.col(name))


def _staff_map(spark, directory: DataFrame, agents: dims.AgentRegistry) -> Column:
    """``id -> (name, type)`` as one value that the whole query shares; a repeated id has its greatest name."""
    known = spark.createDataFrame([(i, n, "bot") for i, n in agents.bot_ids.items()], "id string, name string, type string")
    listed = directory.select(F.col("id").cast("string").alias("id"), "name", "type", F.lit(1).alias("given"))
    both = listed.union(known.withColumn("given", F.lit(0))).where("id is not null")
    one = both.groupBy("id").agg(F.max(F.struct("given", "name", "type")).alias("s"))
    return one.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("s.name", "s.type"))))).scalar()


def parse_chat_payload(df: DataFrame, directory: DataFrame | dict[str, tuple[str, str]],
                       agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """One flat row per chat payload (``schema.CHAT_PAYLOAD`` columns, see ``chat_payloads``).

    ``directory`` is the staff list, ``id, name, type`` as in ``lookup_agent``, or the same as a dict; ids that it
    lacks are looked up among the known bot ids and are ``Unknown`` otherwise. The list is one value of the plan,
    read once, so it must be of the size of a staff.
    """
    spark = df.sparkSession
    if isinstance(directory, dict):
        directory = spark.createDataFrame(
            [(i, n, t) for i, (n, t) in directory.items()], "id string, name string, type string")
    bot_labels = sorted({n for n in agents.bots.values()} - {"Test Bot"})

    def describe(found):
        name = F.coalesce(found["entry"]["name"], F.lit("Unknown"))
        is_bot = found["entry"]["type"].eqNullSafe(F.lit("bot")) | F.lower(name).contains("bot") | name.isin(bot_labels)
        return F.struct(found["id"].alias("id"), name.alias("name"), is_bot.alias("is_bot"))

    entries = _staff_map(spark, directory, agents)
    users = F.filter("users", lambda u: u["type"].isin("agent", "bot"))
    # Each id is looked up once.
    staff = F.transform(F.transform(users, lambda u: F.struct(
        u["id"].alias("id"), F.try_element_at("_directory", u["id"]).alias("entry"))), describe)
    base = df.withColumn("_directory", entries).withColumn("_staff", F.coalesce(staff, F.array().cast(
        "array<struct<id:string,name:string,is_bot:boolean>>")))
    base = base.withColumns({
        "_humans": F.transform(F.filter("_staff", lambda a: ~a["is_bot"]), lambda a: a["name"]),
        "_bots": F.transform(F.filter("_staff", lambda a: a["is_bot"]), lambda a: a["name"]),
        "_first": F.get("_staff", F.lit(0)),
        "_events": F.coalesce("thread.events", F.array().cast(
            "array<struct<type:string,created_at:string,author_type:string>>")),
    })
    primary = F.when(F.col("_first.id").isNotNull(), F.col("_first.name"))
    score = F.col("properties.rating.score")

    said = lambda kinds_: F.try_element_at(F.transform(
        F.filter("_events", lambda e: (e["type"] == "message") & e["author_type"].isin(kinds_)
                 & e["created_at"].isNotNull()), lambda e: e["created_at"]), F.lit(1))
    at = lambda i: F.try_element_at("_events", F.lit(i))["created_at"]
    # Spans get columns of their own, as each of them is used more than once below.
    base = base.withColumns({
        "_event_span": _seconds(at(1), at(-1)),
        "_thread_span": _seconds(F.coalesce("thread.started_at", "thread.created_at"),
                                 F.coalesce("thread.ended_at", "thread.last_event_created_at")),
        "_wait": _seconds(said(["customer"]), said(["agent", "bot"])),
        "_bot": F.try_element_at("_bots", F.lit(-1)),
    })
    bot = F.col("_bot")
    kind = F.when(bot.isNotNull() & (F.size("_humans") == 0), "bot").otherwise("human")
    duration = F.when(F.col("_event_span") > 0, F.col("_event_span")).otherwise(
        F.coalesce(_not_negative("_thread_span"), F.lit(0.0)))
    created = F.coalesce("created_at", "started_at", "last_event_created_at",
                         "thread.started_at", "thread.created_at", "thread.last_event_created_at")
    return base.select(
        F.col("id").alias("chat_id"),
        times.parse_iso(created).alias("created_ts_utc"),
        primary.alias("primary_agent"),
        F.when(kind == "bot", bot).otherwise(primary).alias("display_agent"),
        kind.alias("agent_type"),
        (bot.isNotNull() & (F.size("_humans") > 0)).alias("bot_transfer"),
        values.score_text(score).alias("rate_raw"),
        score.cast("double").alias("rating_value"),
        F.coalesce("properties.rating.comment", F.lit("")).alias("rating_comment"),
        score.isNotNull().alias("has_rating"),
        F.coalesce("properties.source.type", F.lit("unknown")).alias("source"),
        F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"),
        (duration / 60).alias("duration_minutes"),
        _not_negative("_wait").alias("first_response_seconds"),
        F.array_join("_humans", ",").alias("human_agents"),
        F.coalesce(bot, F.lit("")).alias("bot_agent"),
        F.size("_staff").alias("num_agents"),
    )
