"""Folding chats into conversations: people, groups with the same members, and groups whose members changed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import display_number, first_token, last_initial, normalize_handle
from ..schema import FuzzyRule
from .components import components

PARTICIPANTS = "array<struct<handle_id:bigint,identifier:string,label:string>>"
CONVERSATION = (
    "id string, display_name string, chat_ids array<bigint>, target_handles array<bigint>, identifiers array<string>, "
    "last_message_date double, message_count bigint, primary_identifier string, is_contact boolean, is_group boolean, "
    f"participants {PARTICIPANTS}, group_name string"
)
_COLUMNS = [
    "id", "display_name", "chat_ids", "target_handles", "identifiers", "last_message_date", "message_count",
    "primary_identifier", "is_contact", "is_group", "participants", "group_name",
]


def _set(c: Column) -> Column:
    return F.sort_array(F.collect_set(c))


def people(summaries: DataFrame, contacts: DataFrame, handles: DataFrame, region: str = "US") -> DataFrame:
    """1:1 chats folded into people: by contact name where there is one, else by normalized identifier.

    ``contacts (handle, name)``, ``handles (handle_id, label)``. A person gets every handle with one of their
    identifiers. The newest chat gives the primary identifier; of equally new ones the one with the largest id.
    """
    norm = normalize_handle(F.coalesce("identifier", F.concat(F.lit("h"), F.col("handle_id").cast("string"))), region)
    shared = handles.select(normalize_handle(F.col("label"), region).alias("norm"), "handle_id").groupBy("norm").agg(F.collect_set("handle_id").alias("more"))
    named = summaries.withColumn("norm", norm).join(contacts.select(F.col("handle").alias("norm"), "name"), "norm", "left").join(shared, "norm", "left")
    folded = named.groupBy(F.coalesce("name", "norm").alias("id")).agg(
        F.max("name").alias("name"), _set("chat_id").alias("chat_ids"), F.collect_set("handle_id").alias("own"), _set("norm").alias("identifiers"),
        F.max("last_message_date").alias("last_message_date"), F.sum("message_count").alias("message_count"),
        F.max_by("norm", F.struct("last_message_date", "chat_id")).alias("primary_identifier"), F.flatten(F.collect_set("more")).alias("more"),
    )
    return folded.select(
        "id", F.coalesce("name", "id").alias("display_name"), "chat_ids",
        F.sort_array(F.array_union("own", F.coalesce("more", F.array().cast("array<bigint>")))).alias("target_handles"),
        "identifiers", "last_message_date", "message_count", "primary_identifier", F.col("name").isNotNull().alias("is_contact"),
        F.lit(False).alias("is_group"), F.array().cast(PARTICIPANTS).alias("participants"), F.lit(None).cast("string").alias("group_name"),
    )


def speaker_labels(roster: DataFrame, names: DataFrame) -> DataFrame:
    """``roster (id, handle_id, identifier)`` with ``label``: what its group calls each member.

    First name; ``First L.`` if others have the first name; the full name if that doesn't tell them apart either. A
    member without a name is shown by number.
    """
    r = roster.join(names.select(F.col("handle").alias("identifier"), "name"), "identifier", "left")
    r = r.withColumn("first", first_token(F.col("name"))).withColumn("initial", last_initial(F.col("name")))
    alike = F.count("name").over(Window.partitionBy("id", "first"))
    closer = F.count("name").over(Window.partitionBy("id", "first", F.coalesce("initial", F.lit(""))))
    label = (
        F.when(F.col("name").isNull(), display_number(F.col("identifier")))
        .when(F.col("alike") < 2, F.col("first"))
        .when(F.col("initial").isNotNull() & (F.col("closer") < 2), F.concat("first", F.lit(" "), "initial", F.lit(".")))
        .otherwise(F.col("name"))
    )
    return r.withColumn("alike", alike).withColumn("closer", closer).withColumn("label", label).drop("name", "first", "initial", "alike", "closer")


def _participants(roster: DataFrame, names: DataFrame | None, *order: str) -> DataFrame:
    """``(id, participants)``: the members of ``roster`` in the given order, labelled where names are given."""
    labelled = roster.withColumn("label", F.lit(None).cast("string")) if names is None else speaker_labels(roster, names)
    packed = F.sort_array(F.collect_list(F.struct(*order, F.struct("handle_id", "identifier", "label").alias("p"))))
    return labelled.groupBy("id").agg(F.transform(packed, lambda x: x["p"]).alias("participants"))


def _shown(groups: DataFrame) -> DataFrame:
    """The columns that follow from the participants."""
    identifiers = F.sort_array(F.array_distinct(F.transform("participants", lambda p: p["identifier"])))
    joined = F.array_join("identifiers", ", ")
    return groups.withColumn("participants", F.coalesce("participants", F.array().cast(PARTICIPANTS))).withColumn("identifiers", identifiers).withColumn(
        "display_name", F.coalesce("group_name", F.when(joined != "", joined), "primary_identifier")
    )


def groups(summaries: DataFrame, handles: DataFrame, counts: DataFrame, names: DataFrame | None = None, region: str = "US") -> DataFrame:
    """Group chats with exactly the same members folded into one conversation; without members each stands alone.

    ``counts (chat_id, handle_id, message_count)`` put the most active members first; ties go by identifier. Where
    chats have several names the name of the one with the least id stays. The id of a group without members has the
    chat's number, so that ids differ.
    """
    roster = F.array_join(F.transform("participant_handles", lambda h: h.cast("string")), ",")
    keyed = summaries.withColumn("id", F.concat(F.lit("group:"), F.when(F.size("participant_handles") > 0, roster).otherwise(F.concat(F.lit("empty:"), F.col("chat_id").cast("string")))))
    folded = keyed.groupBy("id").agg(
        _set("chat_id").alias("chat_ids"), F.first("participant_handles").alias("handle_list"), F.sum("message_count").alias("message_count"),
        F.max("last_message_date").alias("last_message_date"), F.min_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("chat_id"))).alias("group_name"),
        F.max_by(F.coalesce("identifier", F.concat(F.lit("group"), F.col("chat_id").cast("string"))), F.struct("last_message_date", "chat_id")).alias("primary_identifier"),
    )
    volume = keyed.select("id", "chat_id").join(counts, "chat_id").groupBy("id", "handle_id").agg(F.sum("message_count").alias("n"))
    members = (
        folded.select("id", F.explode("handle_list").alias("handle_id"))
        .join(handles.select("handle_id", normalize_handle(F.col("label"), region).alias("identifier")), "handle_id", "left")
        .withColumn("identifier", F.coalesce("identifier", F.concat(F.lit("h"), F.col("handle_id").cast("string"))))
        .join(volume, ["id", "handle_id"], "left").withColumn("less", -F.coalesce("n", F.lit(0)))
    )
    out = folded.join(_participants(members, names, "less", "identifier", "handle_id"), "id", "left")
    out = out.withColumn("target_handles", F.sort_array(F.array_distinct("handle_list"))).withColumn("is_contact", F.lit(False)).withColumn("is_group", F.lit(True))
    return _shown(out).select(*_COLUMNS)


def fuzzy_pairs(conversations: DataFrame, rule: FuzzyRule = FuzzyRule()) -> DataFrame:
    """``(a, b)``, ids of groups with ``a < b`` that are one group whose members changed.

    Either one roster holds the other, at most ``max_roster_delta`` larger and not too much; or the rosters overlap
    very much and the groups have the same name. Any such pair shares a member that is among the rarest of the smaller
    roster: both rules leave out at most ``d`` members of either roster, where ``d`` follows from its size, so groups
    meet on their ``d + 1`` rarest members only, not on everybody they share.
    """
    g = conversations.filter("is_group").select("id", F.array_distinct("target_handles").alias("h"), "group_name").filter(F.size("h") >= rule.min_roster_size)
    seen = g.select("id", "h", "group_name", F.explode("h").alias("m"))
    rarity = seen.groupBy("m").agg(F.count("*").alias("f"))
    rest = F.greatest(F.lit(rule.max_roster_delta), F.floor(F.size("r") * (1 - rule.min_jaccard) + 1e-9).cast("int"))
    short = (
        seen.join(rarity, "m").groupBy("id", "h", "group_name").agg(F.sort_array(F.collect_list(F.struct("f", "m"))).alias("r"))
        .withColumn("r", F.transform(F.slice("r", 1, rest + 1), lambda x: x["m"]))
        .select("id", "h", "group_name", "r", F.posexplode("r").alias("p", "m"))
        .select("id", "h", "group_name", "r", "m", (F.size("h") - F.col("p")).alias("k"))
    )
    side = lambda x: short.select("m", *[F.col(c).alias(n + x) for c, n in (("id", ""), ("h", "h"), ("group_name", "n"), ("k", "k"), ("r", "r"))])
    a, b = side("a"), side("b")
    # From the first member they share on, the rest of both rosters must suffice for either rule.
    larger, smaller = F.greatest(F.size("ha"), F.size("hb")), F.least(F.size("ha"), F.size("hb"))
    enough = F.least("ka", "kb") >= F.least(smaller.cast("double"), larger * rule.min_jaccard - 1e-9)
    first = F.get(F.array_intersect("ra", "rb"), F.lit(0)) == F.col("m")  # so each pair comes once
    return a.join(b, "m").filter((F.col("a") < F.col("b")) & enough & first & fuzzy_match(F.col("ha"), F.col("hb"), F.col("na"), F.col("nb"), rule)).select("a", "b")


def fuzzy_match(ha: Column, hb: Column, na: Column, nb: Column, rule: FuzzyRule = FuzzyRule()) -> Column:
    """Are two rosters, each without repeats, one group's."""
    shared, larger, smaller = F.size(F.array_intersect(ha, hb)), F.greatest(F.size(ha), F.size(hb)), F.least(F.size(ha), F.size(hb))
    holds = (shared == smaller) & (larger - smaller <= rule.max_roster_delta) & (smaller / larger >= rule.min_subset_ratio)
    close = (shared / (larger + smaller - shared) >= rule.min_jaccard) & (na == nb) & (na != "")
    return (smaller >= rule.min_roster_size) & ((shared == larger) | holds | F.coalesce(close, F.lit(False)))


def clusters(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, cluster)`` for each group that has a pair; a cluster has the id of its newest member.

    From the newest group on (of equally new ones by id), each that is free begins a cluster, and takes in every free
    group that matches all members so far. Groups that no chain of pairs connects can't meet, so this runs component by
    component; one component, of ids and dates alone, is one task.
    """
    ids = conversations.select("id", "last_message_date")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    part = components(pairs).withColumnRenamed("node", "id")
    edges = both.join(part.withColumnRenamed("id", "a"), "a").groupBy("component", "a").agg(F.collect_list("b").alias("near"))
    edges = edges.withColumnRenamed("a", "id").join(ids, "id")

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["last_message_date", "id"], ascending=[False, True], kind="stable")
        near = {i: set(n) for i, n in zip(group["id"], group["near"], strict=True)}
        of: dict[str, str] = {}
        for i in near:
            if i in of:
                continue
            members = [i]
            of[i] = i
            for j in near:
                if j not in of and all(j in near[m] for m in members):
                    members.append(j)
                    of[j] = i
        return pd.DataFrame({"id": list(of), "cluster": list(of.values())})

    return edges.groupBy("component").applyInPandas(greedy, "id string, cluster string")


def fuzzy_merge(conversations: DataFrame, names: DataFrame | None = None, rule: FuzzyRule = FuzzyRule()) -> DataFrame:
    """``conversations`` with each cluster of groups as one: chats and members joined, counts summed, the newest first."""
    found = clusters(conversations, fuzzy_pairs(conversations, rule))
    several = found.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1")
    mapped = found.join(several, "cluster", "left_semi")
    alone = conversations.join(mapped, "id", "left_anti")
    inside = conversations.join(mapped, "id")
    newest = Window.partitionBy("cluster").orderBy(F.desc("last_message_date"), "id")
    ranked = inside.withColumn("age", F.row_number().over(newest))
    folded = ranked.groupBy("cluster").agg(
        _flat("chat_ids"), _flat("target_handles"), F.max("last_message_date").alias("last_message_date"), F.sum("message_count").alias("message_count"),
        F.min_by("group_name", F.when(F.coalesce("group_name", F.lit("")) != "", F.col("age"))).alias("group_name"),
        F.min_by("primary_identifier", "age").alias("primary_identifier"),
    )
    members = ranked.select(F.col("cluster").alias("id"), "age", F.posexplode("participants").alias("place", "p")).select("id", "age", "place", "p.handle_id", "p.identifier", F.col("p.label").alias("had"))
    first = Window.partitionBy("id", "handle_id").orderBy("age", "place")
    members = members.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    rosters = _participants(members.drop("had"), names, "age", "place") if names is not None else members.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("age", "place", F.struct("handle_id", "identifier", F.col("had").alias("label")).alias("p")))), lambda x: x["p"]).alias("participants")
    )
    out = folded.join(rosters.withColumnRenamed("id", "cluster"), "cluster").withColumn("id", F.concat(F.lit("group:"), F.array_join(F.transform("target_handles", lambda h: h.cast("string")), ",")))
    merged = _shown(out.withColumn("is_contact", F.lit(False)).withColumn("is_group", F.lit(True))).select(*_COLUMNS)
    return alone.select(*_COLUMNS).unionByName(merged)


def _flat(name: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)


def list_conversations(
    one_to_one: DataFrame, group_chats: DataFrame, handles: DataFrame, counts: DataFrame, contacts: DataFrame, stitch: str = "exact", region: str = "US"
) -> DataFrame:
    """People and groups, newest first (ties by id). ``stitch``: ``exact``, or ``fuzzy`` to follow changing members."""
    if stitch not in ("exact", "fuzzy"):
        raise ValueError(f"unknown stitch {stitch}")
    names = None if contacts.isEmpty() else contacts
    many = groups(group_chats, handles, counts, names, region)
    if stitch == "fuzzy":
        many = fuzzy_merge(many, names)
    return people(one_to_one, contacts, handles, region).unionByName(many).orderBy(F.desc("last_message_date"), "id")


def render_info(conversations: DataFrame) -> DataFrame:
    """``(conversation_id, number, group_name, participant_labels)``; the latter two for groups only."""
    labels = F.transform("participants", lambda p: F.coalesce(p["label"], p["identifier"]))
    joined = F.array_join(labels, ", ")
    name = F.coalesce("group_name", F.when(joined != "", joined), "display_name")
    return conversations.select(
        F.col("id").alias("conversation_id"), F.col("primary_identifier").alias("number"),
        F.when(F.col("is_group"), name).alias("group_name"), F.when(F.col("is_group"), labels).alias("participant_labels"),
    )


def resolved_labels(labels: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(handle_id, label, matched)``: the name of each handle where the contacts ``(handle, name)`` have one, else the
    label it has. One join for a whole session; persist it where many exports follow."""
    named = labels.withColumn("handle", normalize_handle(F.col("label"))).join(contacts.select("handle", "name").dropDuplicates(["handle"]), "handle", "left")
    return named.select("handle_id", F.coalesce("name", "label").alias("label"), F.col("name").isNotNull().alias("matched"))
