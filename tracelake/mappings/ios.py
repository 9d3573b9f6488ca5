"""Messages, calls, contacts and calendars of iOS."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import texts as T
from tracelake.functions import values as V

from .joins import SHORT, UNDECIDED, carried, children, listed, lookup, marked


def messages(t: Mapping[str, DataFrame]) -> DataFrame:
    """Messages with their handle, the members of their chats, their attachments, and whether they are marked deleted."""
    out = lookup(t["message"], "handle_id", t["handle"], "ROWID", {"address": "id"}, "handle_state")
    if "chat_handle_join" in t:
        links, people = t["chat_message_join"], t["chat_handle_join"].withColumnRenamed("chat_id", "_chat")
        people = lookup(people, "handle_id", t["handle"], "ROWID", {"_member": "id"}, "_state")
        chats = children(links, "chat_id", people, "_chat", "chat_handle_join", {"_people": listed(F.col("_member"))}, ("handle_id", "_member"))
        # The members of a message's chat aren't known where the chat's aren't; a chat without any member is no chat here.
        told = F.col("_people").isNotNull()
        if UNDECIDED in chats.columns:
            told = told | F.array_contains(UNDECIDED, "chat_handle_join") | F.array_contains(SHORT, "chat_handle_join")
        held = chats.where(told)
        out = children(out, "ROWID", held, "message_id", "chat_message_join", {"members": F.min_by("_people", "chat_id"), "chats": F.count_distinct("chat_id")}, ("chat_id",), ("chats",))
    else:
        out = out.withColumns({"members": F.lit(None).cast("string"), "chats": F.lit(0).cast("bigint")})
    if "message_attachment_join" in t:
        out = children(out, "ROWID", t["message_attachment_join"], "message_id", "message_attachment_join", {"attachments": F.count_distinct("attachment_id")}, ("attachment_id",), ("attachments",))
    else:
        out = out.withColumn("attachments", F.lit(0).cast("bigint"))
    if "chat_recoverable_message_join" in t:  # newer schemas
        out = marked(out, "ROWID", t["chat_recoverable_message_join"], "message_id", "chat_recoverable_message_join", "_gone")
    else:
        out = out.withColumn("_gone", F.lit(False))
    direction = F.when(F.col("is_from_me") == 1, "out").when(F.col("is_from_me") == 0, "in").otherwise("unknown")
    return out.select(F.col("ROWID").alias("rowid"), V.cocoa_auto_us(F.col("date")).alias("ts"), direction.alias("direction"), "address", "handle_state", "members", "chats", "attachments", F.col("_gone").alias("deleted"), *carried(out))


#: Kinds of calls, properties of contact values.
CALL_KINDS = {1: "voice", 8: "video", 16: "audio"}
PHONE, EMAIL = 3, 4


def calls(t: Mapping[str, DataFrame]) -> DataFrame:
    """Calls; an outgoing one that nobody answered has no known outcome."""
    out, answered = F.col("ZORIGINATED"), F.col("ZANSWERED")
    direction = F.when(out == 1, "out").when(out == 0, "in").otherwise("unknown")
    outcome = F.when(answered == 1, "answered").when((out == 0) & (answered == 0), "missed").otherwise("unknown")
    ts = T.cocoa_us(F.col("ZDATE").cast("double"))
    end = F.when(F.col("ZDURATION") >= 0, ts + (F.col("ZDURATION") * 1_000_000).cast("bigint"))
    kind = V.named(F.col("ZCALLTYPE"), CALL_KINDS)
    return t["ZCALLRECORD"].select(F.col("Z_PK").alias("rowid"), ts.alias("ts"), end.alias("end_ts"), direction.alias("direction"), outcome.alias("outcome"), kind.alias("kind"), F.col("ZADDRESS").alias("address"), *carried(t["ZCALLRECORD"]))


def calls_legacy(t: Mapping[str, DataFrame]) -> DataFrame:
    """Calls of the older table; what its flags mean isn't read, so directions and outcomes are unknown."""
    ts = V.unix_us(F.col("date"), "s")
    end = F.when(F.col("duration") >= 0, ts + F.col("duration") * 1_000_000)
    return t["call"].select(F.col("ROWID").alias("rowid"), ts.alias("ts"), end.alias("end_ts"), F.lit("unknown").alias("direction"), F.lit("unknown").alias("outcome"), "address", F.col("flags").alias("raw_flags"), *carried(t["call"]))


def contacts(t: Mapping[str, DataFrame]) -> DataFrame:
    """Persons with labelled phones and e-mail addresses, and their groups; each child table is aggregated by person first.

    With their tables: postal addresses, whose values have entries of their own, and the store that a person is in.
    """
    values = lookup(t["ABMultiValue"], "label", t["ABMultiValueLabel"], "ROWID", {"_label": "value"}, "_state")
    shown = F.concat_ws("=", T.unwrap_label(F.coalesce("_label", F.lit(""))), "value")
    of = lambda kind: listed(F.when(F.col("property") == kind, shown))
    held = {"phones": of(PHONE), "emails": of(EMAIL), "unlabelled": F.count_if(F.col("_state") == "unresolved")}
    groups = lookup(t["ABGroupMembers"], "group_id", t["ABGroup"], "ROWID", {"_group": "Name"}, "_state")
    out = children(t["ABPerson"], "ROWID", values, "record_id", "ABMultiValue", held, ("property", "label", "value"), ("unlabelled",))
    out = children(out, "ROWID", groups, "member_id", "ABGroupMembers", {"groups": listed(F.col("_group"))}, ("group_id",))
    more = []
    if "ABMultiValueEntry" in t:
        parts = lookup(t["ABMultiValueEntry"], "key", t["ABMultiValueEntryKey"], "ROWID", {"_part": "value"}, "_state")
        line = F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "_part", "value"))), "; ")
        whole = children(t["ABMultiValue"], "UID", parts, "parent_id", "ABMultiValueEntry", {"_line": line}, ("key", "value"))
        out = children(out, "ROWID", whole.where("_line IS NOT NULL"), "record_id", "addresses", {"addresses": F.array_sort(F.collect_set("_line"))}, ("property",))
        more.append("addresses")
    if "ABStore" in t:
        out = lookup(out, "StoreID", t["ABStore"], "ROWID", {"store": "Name"}, "store_state")
        more += ["store", "store_state"]
    name = F.concat_ws(" ", "First", "Last")
    return out.select(F.col("ROWID").alias("rowid"), F.lit(None).cast("bigint").alias("ts"), name.alias("name"), "phones", "emails", "groups", "unlabelled", *more, *carried(out))


def calendar(t: Mapping[str, DataFrame]) -> DataFrame:
    """Events with calendar, place, guests, alarms and how many days are left out of their recurrence."""
    out = lookup(t["CalendarItem"], "calendar_id", t["Calendar"], "ROWID", {"calendar": "title"}, "calendar_state")
    out = lookup(out, "location_id", t["Location"], "ROWID", {"location": "title"}, "location_state")
    people = lookup(t["Participant"], "identity_id", t["Identity"], "ROWID", {"_who": "display_name"}, "_state")
    listing = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = children(out, "ROWID", people, "owner_id", "Participant", {"attendees": listed(F.col("_who")), "unresolved": F.count_if(F.col("_state") != "found")}, ("identity_id",), ("unresolved",))
    out = children(out, "ROWID", t["Alarm"], "calendaritem_owner_id", "Alarm", {"alarms": listing("trigger_interval")}, ("trigger_interval",))
    out = children(out, "ROWID", t["Recurrence"], "owner_id", "Recurrence", {"frequency": F.min("frequency")}, ("frequency",))
    out = children(out, "ROWID", t["ExceptionDate"], "owner_id", "ExceptionDate", {"left_out": F.count_distinct("date")}, ("date",), ("left_out",))
    time = lambda c: T.cocoa_us(F.col(c).cast("double"))
    return out.select(
        F.col("ROWID").alias("rowid"), time("start_date").alias("ts"), time("end_date").alias("end_ts"), F.col("summary").alias("title"), (F.col("all_day") == 1).alias("all_day"),
        "calendar", "calendar_state", "location", "location_state", "attendees", "unresolved", "alarms", "frequency", "left_out", *carried(out),
    )
