"""The user directory: prioritised union of sources, ranked suggestions, and mentions in prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import mentioned_ids, mentioned_names
from parlance.functions.values import or_else
from parlance.operators.predicates import mention_match
from parlance.operators.retrieve import merged
from parlance.sources.schema import SUGGESTED

_FIELDS = ("id", "username", "globalName", "avatar", "discriminator", "bot")


def normalised(users: DataFrame) -> DataFrame:
    """PRJ2: defaults of a user's fields; either spelling of the global name."""
    has = set(users.columns)
    pick = lambda c: F.col(c) if c in has else F.lit(None)
    both = F.coalesce(pick("globalName").cast("string"), pick("global_name").cast("string"))
    return users.select(F.col("id").cast("string").alias("id"), or_else(pick("username").cast("string"), "User").alias("username"), both.alias("globalName"), *(pick(c).cast("string").alias(c) for c in ("avatar", "discriminator")), F.coalesce(pick("bot").cast("boolean"), F.lit(False)).alias("bot"))


def members(guild_members: DataFrame, users: DataFrame) -> DataFrame:
    """JOIN3: members (user_id, nick) with their user rows; 'Member', or the nick, where there is none."""
    known = normalised(users).withColumnRenamed("id", "user_id")
    return guild_members.join(known, "user_id", "left").select(F.col("user_id").alias("id"), or_else(F.col("username"), F.col("nick"), "Member").alias("username"), or_else(F.col("nick"), F.col("globalName")).alias("globalName"), "avatar", "discriminator", F.coalesce("bot", F.lit(False)).alias("bot"))


def gathered(*sources: DataFrame) -> DataFrame:
    """SET2, AGG3: users of several sources, the first source that has one wins; ``priority`` keeps the order."""
    parts = [normalised(s).withColumn("priority", F.lit(i)) for i, s in enumerate(sources)]
    return merged(parts, "id", last=False)


def ranked(name: Column) -> list[Column]:
    """The order of users that match a lower-case name: those first whose username or global name begins with it."""
    begins = F.lower("username").startswith(name) | F.coalesce(F.lower("globalName").startswith(name), F.lit(False))
    return [F.when(begins, 0).otherwise(1), F.collate("username", "unicode"), F.col("id")]


def suggested(users: DataFrame, query: str = "", limit: int = SUGGESTED) -> DataFrame:
    """TOP3: with no query the first users as gathered; else matches, names that begin with the query first."""
    q = query.strip().lower()
    if not q:
        order = ["priority", "id"] if "priority" in users.columns else ["id"]
        return users.orderBy(*order).limit(limit)
    return users.where(mention_match(q)).orderBy(*ranked(F.lit(q))).limit(limit)


def _grams(text: Column) -> Column:
    """All runs of one to three characters."""
    size = F.char_length(text)

    def runs(k: int) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1))), lambda i: text.substr(i, F.lit(k)))
        return F.when(size >= k, own).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def prompt_mentions(prompts: DataFrame, users: DataFrame) -> DataFrame:
    """Users that prompts (prompt_id, text) mention, each once: by id (unknown ones as user_<id>), then by name, an
    exact name before a part of one. Names meet users by a join on lower-case names; only those without an exact
    match are compared with parts of names."""
    own = users.select(*(F.col(c) for c in _FIELDS))
    ids = prompts.select("prompt_id", F.posexplode(mentioned_ids(F.col("text"))).alias("pos", "id"))
    by_id = ids.join(own, "id", "left").select("prompt_id", F.lit(0).alias("kind"), "pos", "id", F.coalesce("username", F.concat(F.lit("user_"), F.col("id"))).alias("username"), "globalName")
    names = prompts.select("prompt_id", F.posexplode(mentioned_names(F.col("text"))).alias("pos", "name")).withColumn("name", F.lower("name"))
    spelled = own.select("id", "username", "globalName", F.explode(F.array_distinct(F.array(F.lower("username"), F.lower(F.coalesce("globalName", "username"))))).alias("name"))
    exact = names.join(spelled, "name")
    rest = names.join(spelled.select("name").distinct(), "name", "left_anti")
    # parts of names meet by the run of up to three characters that the fewest users have
    known = own.select("id", "username", "globalName")
    grams = known.select("*", F.explode(_grams(F.array_join(F.array(F.lower("username"), F.lower("globalName")), "\n"))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("_n"))
    whole = F.when(F.char_length("name") < 3, F.array("name")).otherwise(F.filter(_grams(F.col("name")), lambda g: F.char_length(g) == 3))
    asked = rest.select("name").distinct().select("name", F.explode(whole).alias("gram")).join(often, "gram", "left")
    asked = asked.groupBy("name").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("name", "x.gram")
    inside = asked.join(grams, "gram").where(F.contains(F.lower("username"), F.col("name")) | F.coalesce(F.contains(F.lower("globalName"), F.col("name")), F.lit(False))).drop("gram")
    inside = rest.join(inside, "name").select("prompt_id", "pos", "name", "id", "username", "globalName")
    same = rest.join(known, F.col("id") == F.col("name"))
    both = exact.select("prompt_id", "pos", "name", "id", "username", "globalName").unionByName(inside).unionByName(same.select("prompt_id", "pos", "name", "id", "username", "globalName")).distinct()
    first = F.row_number().over(Window.partitionBy("prompt_id", "pos").orderBy(*ranked(F.col("name"))))
    by_name = both.withColumn("_rank", first).where("_rank = 1").select("prompt_id", F.lit(1).alias("kind"), "pos", "id", "username", "globalName")
    once = F.row_number().over(Window.partitionBy("prompt_id", "id").orderBy("kind", "pos"))
    return by_id.unionByName(by_name).withColumn("_rank", once).where("_rank = 1").drop("_rank")
