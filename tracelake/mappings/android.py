"""Messages, calls, contacts and calendars of Android."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import values as V

from .joins import carried, children, is_unknown, joined_text, listed, lookup

#: Boxes and address types of MMS, attendee states.
MMS_BOXES = {1: "in", 2: "out", 3: "draft", 4: "out"}
MMS_ADDRESSES = {129: "bcc", 130: "cc", 137: "from", 151: "to"}
ATTENDEES = {0: "none", 1: "accepted", 2: "declined", 3: "invited", 4: "tentative"}


def thread_members(threads: DataFrame, addresses: DataFrame) -> DataFrame:
    """thread, members, unresolved: the addresses behind a thread's ids; ids without an address are counted, not dropped."""
    ids = threads.where(~is_unknown(threads, "_id", "recipient_ids")).select(F.col("_id").alias("thread"), F.explode(F.split(F.trim("recipient_ids"), " +")).alias("_rid"))
    found = lookup(ids.withColumn("_rid", F.expr("try_cast(_rid AS bigint)")), "_rid", addresses, "_id", {"address": "address"}, "_state")
    return found.groupBy("thread").agg(listed(F.col("address")).alias("members"), F.sum((F.col("_state") != "found").cast("bigint")).alias("unresolved"))


def sms(t: Mapping[str, DataFrame]) -> DataFrame:
    threads = t["threads"]
    members = thread_members(threads, t["canonical_addresses"])
    # A thread whose id or members can't be read may be that of any message that finds none.
    lost = threads.agg(F.count_if(is_unknown(threads, "_id", "recipient_ids"))).scalar() if carried(threads) else None
    out = lookup(t["sms"], "thread_id", members, "thread", {"members": "members", "_bad": "unresolved"}, "thread_state", lost)
    state = F.when((F.col("thread_state") == "found") & (F.col("_bad") > 0), "partial").otherwise(F.col("thread_state"))
    return out.select(F.col("_id").alias("rowid"), V.unix_us(F.col("date"), "ms").alias("ts"), V.named(F.col("type"), V.SMS_DIRECTIONS).alias("direction"), F.col("type").alias("raw_type"), "address", "members", state.alias("thread_state"), "body", *carried(out))


def mms(t: Mapping[str, DataFrame]) -> DataFrame:
    """Messages with their addresses by role, their text parts in order, and how many other parts they have."""
    role = V.named(F.col("type"), MMS_ADDRESSES)
    of = lambda r: listed(F.when(role == r, F.col("address")))
    out = children(t["pdu"], "_id", t["addr"], "msg_id", "addr", {"sender": of("from"), "receivers": of("to"), "copies": of("cc")}, ("address", "type"))
    text, layout = F.col("ct") == "text/plain", F.col("ct") == "application/smil"
    body = joined_text(["seq", "_id"], F.when(text, F.col("text")), "\n")
    out = children(out, "_id", t["part"], "mid", "part", {"body": body, "attachments": F.sum((~text & ~layout).cast("bigint"))}, ("ct", "text", "seq"), ("attachments",))
    return out.select(F.col("_id").alias("rowid"), V.unix_us(F.col("date"), "s").alias("ts"), V.named(F.col("msg_box"), MMS_BOXES).alias("direction"), F.col("msg_box").alias("raw_box"), "sender", "receivers", "copies", "body", "attachments", *carried(out))


def calls(t: Mapping[str, DataFrame]) -> DataFrame:
    ts = V.unix_us(F.col("date"), "ms")
    direction = F.when(F.col("type") == 2, "out").when(F.col("type").isin(1, 3, 4, 5, 6, 7), "in").otherwise("unknown")
    end = F.when(F.col("duration") >= 0, ts + F.col("duration") * 1_000_000)
    return t["calls"].select(F.col("_id").alias("rowid"), ts.alias("ts"), end.alias("end_ts"), direction.alias("direction"), V.call_outcome(F.col("type"), F.col("duration")).alias("outcome"), F.col("type").alias("raw_type"), "number", *carried(t["calls"]))


def contacts(t: Mapping[str, DataFrame]) -> DataFrame:
    """Raw contacts with their phones and addresses; data rows of an unknown kind are counted.

    With their tables: the account that a contact belongs to, and contacts of which only the deletion is left.
    """
    rows = lookup(t["data"], "mimetype_id", t["mimetypes"], "_id", {"mimetype": "mimetype"}, "_state")
    kind = F.substring_index("mimetype", "/", -1)
    of = lambda k: listed(F.when(kind == k, F.col("data1")))
    held = {"phones": of("phone_v2"), "emails": of("email_v2"), "unknown": F.sum((F.col("_state") != "found").cast("bigint"))}
    out = children(t["raw_contacts"], "_id", rows, "raw_contact_id", "data", held, ("mimetype_id", "data1"), ("unknown",))
    more = []
    if "accounts" in t:
        out = lookup(out, "account_id", t["accounts"], "_id", {"account": "account_name", "account_type": "account_type"}, "account_state")
        more = ["account", "account_type", "account_state"]
    out = out.select(F.col("_id").alias("rowid"), F.lit(None).cast("bigint").alias("ts"), F.col("display_name").alias("name"), (F.col("deleted") == 1).alias("deleted"), "phones", "emails", "unknown", *more, *carried(out))
    if "deleted_contacts" in t:
        gone = t["deleted_contacts"]
        out = out.unionByName(gone.select(F.col("contact_id").alias("rowid"), V.unix_us(F.col("contact_deleted_timestamp"), "ms").alias("ts"), F.lit(True).alias("deleted"), *carried(gone)), allowMissingColumns=True)
    return out


def calendar(t: Mapping[str, DataFrame]) -> DataFrame:
    """Events with their calendar, attendees by state and reminders in order; each child table is aggregated by event first.

    With their tables, which not every version has: alerts, extended properties and the times before conversion.
    """
    state = V.named(F.col("attendeeStatus"), ATTENDEES)
    out = lookup(t["Events"], "calendar_id", t["Calendars"], "_id", {"calendar": "calendar_displayName"}, "calendar_state")
    out = children(out, "_id", t["Attendees"], "event_id", "Attendees", {"attendees": listed(F.concat_ws("=", "attendeeEmail", state))}, ("attendeeEmail", "attendeeStatus"))
    out = children(out, "_id", t["Reminders"], "event_id", "Reminders", {"reminders": F.array_join(F.array_sort(F.collect_set("minutes")), ",")}, ("minutes",))
    more = []
    if "CalendarAlerts" in t:
        out = children(out, "_id", t["CalendarAlerts"], "event_id", "CalendarAlerts", {"alerts": F.count("*"), "next_alert": F.min(V.unix_us(F.col("alarmTime"), "ms"))}, ("alarmTime",), ("alerts",))
        more += ["alerts", "next_alert"]
    if "ExtendedProperties" in t:
        pair = F.struct(F.col("name").alias("name"), F.col("value").alias("value"))
        out = children(out, "_id", t["ExtendedProperties"], "event_id", "ExtendedProperties", {"properties": F.array_sort(F.collect_set(pair))}, ("name", "value"))
        more.append("properties")
    if "EventsRawTimes" in t:
        out = lookup(out, "_id", t["EventsRawTimes"], "event_id", {"raw_start": "dtstart2445", "raw_end": "dtend2445"}, "raw_times_state")
        more += ["raw_start", "raw_end", "raw_times_state"]
    return out.select(F.col("_id").alias("rowid"), V.unix_us(F.col("dtstart"), "ms").alias("ts"), V.unix_us(F.col("dtend"), "ms").alias("end_ts"), "title", "calendar", "calendar_state", (F.col("deleted") == 1).alias("deleted"), "attendees", "reminders", *more, *carried(out))
