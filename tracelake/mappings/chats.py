"""Messages, calls and contacts of chat apps on both systems, over decoded tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import texts as T
from tracelake.functions import values as V

from . import identity
from .joins import carried, children, listed, lookup, marked

#: Results of calls.
CALL_RESULTS = {2: "rejected", 4: "missed", 5: "answered", 3: "unavailable"}


def _direction(c: str) -> Column:
    return F.when(F.col(c) == 1, "out").when(F.col(c) == 0, "in").otherwise("unknown")


def purge_bounds(jobs: DataFrame) -> DataFrame:
    """chat, jobs, first_job, purged_to, purged_starred_to: how far the delete jobs of a chat reach, and the first of them.

    A job's bound is the last message that it deletes; a row of the chat up to the greatest bound is covered.
    """
    return jobs.groupBy(F.col("chat_row_id").alias("chat")).agg(
        F.count("*").alias("jobs"), F.min("_id").alias("first_job"), F.max("deleted_message_row_id").alias("purged_to"), F.max("deleted_starred_message_row_id").alias("purged_starred_to")
    )


def whatsapp_messages(t: Mapping[str, DataFrame]) -> DataFrame:
    """Messages with chat and sender, media, what they quote, reactions, whether revoked, and whether a delete job covers them.

    With their tables, which not every version has: what the app itself says in a chat, places, cards, and what the aliases among
    chat and sender stand for.
    """
    chats = lookup(t["chat"], "jid_row_id", t["jid"], "_id", {"_chat": "raw_string"}, "_s")
    out = lookup(t["message"], "chat_row_id", chats, "_id", {"chat": "_chat", "subject": "subject"}, "chat_state")
    out = lookup(out, "sender_jid_row_id", t["jid"], "_id", {"sender": "raw_string"}, "sender_state")
    out = children(out, "_id", t["message_media"], "message_row_id", "message_media", {"media": listed(F.col("file_path"))}, ("file_path",))
    out = children(out, "_id", t["message_quoted"], "message_row_id", "message_quoted", {"quotes": F.min("key_id")}, ("key_id",))
    out = marked(out, "_id", t["message_revoked"], "message_row_id", "message_revoked", "revoked")
    out = children(out, "_id", t["message_add_on"], "parent_message_row_id", "message_add_on", {"reactions": listed(F.col("reaction"))}, ("reaction",))
    out = out.join(purge_bounds(t["deleted_chat_job"]).withColumnRenamed("chat", "_job"), F.col("chat_row_id") == F.col("_job"), "left")
    bound = F.when(F.col("starred") == 1, F.col("purged_starred_to")).otherwise(F.col("purged_to"))
    out = out.withColumn("_covered", F.coalesce(F.col("_id") <= bound, F.lit(False)))
    covered, more = F.col("_covered"), []
    if "message_system" in t:
        out = children(out, "_id", t["message_system"], "message_row_id", "message_system", {"system_action": F.min("action_type")}, ("action_type",))
        more.append("system_action")
    if "message_location" in t:
        place = F.struct("latitude", "longitude")
        out = children(out, "_id", t["message_location"], "message_row_id", "message_location", {"location": F.min(place)}, ("latitude", "longitude"))
        more.append("location")
    if "message_vcard" in t:
        out = children(out, "_id", t["message_vcard"], "message_row_id", "message_vcard", {"cards": F.count("*")}, (), ("cards",))
        more.append("cards")
    if identity.SOURCE in t:
        out = identity.resolved(identity.resolved(out, "chat", t, "_chat_alias"), "sender", t, "_sender_alias")
        out = identity.stated(out, ["_chat_alias", "_sender_alias"])
        more += ["lid_map", "lid_unmapped", "lid_unresolved", "lid_ambiguous", "lid_undecided"]
    return out.select(
        F.col("_id").alias("rowid"), V.unix_us(F.col("timestamp"), "ms").alias("ts"), _direction("from_me").alias("direction"), "chat", "subject", "chat_state", "sender", "sender_state",
        F.col("text_data").alias("body"), "media", "quotes", "reactions", "revoked", covered.alias("purged"), *more, *carried(out),
    )


def whatsapp_legacy_messages(t: Mapping[str, DataFrame]) -> DataFrame:
    """Messages of the older schema: chats are addresses, and what is quoted is a table of its own. Status 6 is a message of the app."""
    out = lookup(t["messages"], "key_remote_jid", t["chat_list"], "key_remote_jid", {"subject": "subject"}, "chat_state")
    out = lookup(out, "quoted_row_id", t["messages_quotes"], "_id", {"quotes": "data"}, "quote_state") if "quoted_row_id" in out.columns else out.withColumns({"quotes": F.lit(None).cast("string"), "quote_state": F.lit("none")})
    status = F.col("status") if "status" in out.columns else F.lit(None).cast("int")
    sender = F.when(F.col("key_from_me") == 0, F.coalesce(F.nullif("remote_resource", F.lit("")) if "remote_resource" in out.columns else F.lit(None), F.col("key_remote_jid")))
    return out.select(
        F.col("_id").alias("rowid"), V.unix_us(F.col("timestamp"), "ms").alias("ts"), _direction("key_from_me").alias("direction"), F.col("key_remote_jid").alias("chat"), "subject", "chat_state", sender.alias("sender"),
        F.col("data").alias("body"), "quotes", "quote_state", F.coalesce(status == 6, F.lit(False)).alias("system"), *carried(out),
    )


def whatsapp_calls(t: Mapping[str, DataFrame]) -> DataFrame:
    out = lookup(t["call_log"], "jid_row_id", t["jid"], "_id", {"address": "raw_string"}, "address_state")
    people = lookup(t["call_log_participant_v2"], "jid_row_id", t["jid"], "_id", {"_who": "raw_string"}, "_s")
    ts = V.unix_us(F.col("timestamp"), "ms")
    end = F.when(F.col("duration") >= 0, ts + F.col("duration") * 1_000_000)
    more = []
    if identity.SOURCE in t:
        people = identity.resolved(people, "_who", t, "_alias")
        more = ["lid_map", "lid_unmapped", "lid_unresolved", "lid_ambiguous", "lid_undecided"]
    who = {"participants": listed(F.col("_who"))} | ({"_aliases_of": F.collect_set("_alias")} if more else {})
    out = children(out, "_id", people, "call_log_row_id", "call_log_participant_v2", who, ("jid_row_id", "_who"))
    if more:
        out = identity.resolved(out, "address", t, "_own_alias")
        out = identity.stated(out.withColumn("_aliases_of", F.coalesce("_aliases_of", F.array().cast(out.schema["_aliases_of"].dataType))), ["_own_alias", "_aliases_of"])
    return out.select(F.col("_id").alias("rowid"), ts.alias("ts"), end.alias("end_ts"), _direction("from_me").alias("direction"), V.named(F.col("call_result"), CALL_RESULTS).alias("outcome"), (F.col("video_call") == 1).alias("video"), "address", "address_state", "participants", *more, *carried(out))


def whatsapp_contacts(t: Mapping[str, DataFrame]) -> DataFrame:
    """Contacts with the parts of their address; the name shown is the user's own, else the contact's."""
    j = V.jid_parts(F.col("jid"))
    name = F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("wa_name", F.lit("")))
    return t["wa_contacts"].select(F.col("_id").alias("rowid"), F.lit(None).cast("bigint").alias("ts"), name.alias("name"), "number", j["user"].alias("user"), j["server"].alias("server"), (F.col("is_whatsapp_user") == 1).alias("uses_app"), *carried(t["wa_contacts"]))


def ios_whatsapp_messages(t: Mapping[str, DataFrame]) -> DataFrame:
    """Messages with their session, the group member that sent them and their media; a key 0 is none."""
    keyed = t["ZWAMESSAGE"].withColumns({c: F.nullif(c, F.lit(0)) for c in ("ZCHATSESSION", "ZGROUPMEMBER", "ZMEDIAITEM")})
    out = lookup(keyed, "ZCHATSESSION", t["ZWACHATSESSION"], "Z_PK", {"chat": "ZCONTACTJID", "partner": "ZPARTNERNAME"}, "chat_state")
    out = lookup(out, "ZGROUPMEMBER", t["ZWAGROUPMEMBER"], "Z_PK", {"member": "ZMEMBERJID"}, "member_state")
    out = lookup(out, "ZMEDIAITEM", t["ZWAMEDIAITEM"], "Z_PK", {"media": "ZMEDIALOCALPATH"}, "media_state")
    more = []
    if "ZWAMESSAGEINFO" in t:
        out = children(out, "Z_PK", t["ZWAMESSAGEINFO"], "ZMESSAGE", "ZWAMESSAGEINFO", {"receipts": F.count("ZRECEIPTINFO")}, ("ZRECEIPTINFO",), ("receipts",))
        more = ["receipts"]
    sender = F.when(F.col("ZISFROMME") == 0, F.coalesce("member", "chat"))
    return out.select(F.col("Z_PK").alias("rowid"), T.cocoa_us(F.col("ZMESSAGEDATE").cast("double")).alias("ts"), _direction("ZISFROMME").alias("direction"), "chat", "partner", "chat_state", sender.alias("sender"), "member_state", "media", "media_state", F.col("ZTEXT").alias("body"), *more, *carried(out))


def ios_whatsapp_calls(t: Mapping[str, DataFrame]) -> DataFrame:
    """Calls; the direction is that of their aggregate, if that has this one call alone."""
    keyed = t["ZWACDCALLEVENT"].withColumn("Z1CALLEVENTS", F.nullif("Z1CALLEVENTS", F.lit(0)))
    sizes = keyed.groupBy(F.col("Z1CALLEVENTS").alias("_k")).agg(F.count("*").alias("_calls"))
    out = lookup(keyed, "Z1CALLEVENTS", t["ZWAAGGREGATECALLEVENT"], "Z_PK", {"_in": "ZINCOMING", "_video": "ZVIDEO"}, "_s")
    out = out.join(sizes, F.col("Z1CALLEVENTS") == F.col("_k"), "left")
    state = F.when(F.col("_s") == "none", "no-aggregate").when(F.col("_s") != "found", "unresolved").when(F.col("_calls") > 1, "several-calls").when(F.col("_in").isNull(), "undecided").otherwise("aggregate")
    direction = F.when(state != "aggregate", "unknown").when(F.col("_in") == 1, "in").when(F.col("_in") == 0, "out").otherwise("unknown")
    ts = T.cocoa_us(F.col("ZDATE").cast("double"))
    end = F.when(F.col("ZDURATION") >= 0, ts + (F.col("ZDURATION") * 1_000_000).cast("bigint"))
    return out.select(F.col("Z_PK").alias("rowid"), ts.alias("ts"), end.alias("end_ts"), direction.alias("direction"), state.alias("direction_state"), (F.col("_video") == 1).alias("video"), F.col("ZOUTCOME").alias("raw_outcome"), *carried(out))


def call_aggregates(t: Mapping[str, DataFrame]) -> DataFrame:
    """aggregate, calls, answered, first_ts, last_ts, seconds of what each aggregate links, those without any call too."""
    calls = t["ZWACDCALLEVENT"].groupBy(F.col("Z1CALLEVENTS").alias("_k")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("ZDURATION") > 0).alias("answered"), F.min("ZDATE").alias("first"), F.max("ZDATE").alias("last"), F.sum("ZDURATION").alias("seconds")
    )
    out = t["ZWAAGGREGATECALLEVENT"].join(calls, F.col("Z_PK") == F.col("_k"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    time = lambda c, n: T.cocoa_us(F.col(c).cast("double")).alias(n)
    return out.select(F.col("Z_PK").alias("aggregate"), zero("calls"), zero("answered"), time("first", "first_ts"), time("last", "last_ts"), zero("seconds"))


def ios_whatsapp_contacts(t: Mapping[str, DataFrame]) -> DataFrame:
    j = V.jid_parts(F.col("ZWHATSAPPID"))
    return t["ZWAADDRESSBOOKCONTACT"].select(F.col("Z_PK").alias("rowid"), F.lit(None).cast("bigint").alias("ts"), F.col("ZFULLNAME").alias("name"), F.col("ZPHONENUMBER").alias("number"), j["user"].alias("user"), j["server"].alias("server"), *carried(t["ZWAADDRESSBOOKCONTACT"]))


def telegram_messages(t: Mapping[str, DataFrame]) -> DataFrame:
    """Messages with their dialog: a user, a group (negative ids) or a secret chat (ids above 32 bits)."""
    uid = F.col("uid")
    kind = F.when(uid >= 1 << 32, "secret").when(uid < 0, "chat").when(uid > 0, "user")
    source = t["messages_v2"] if "messages_v2" in t else t["messages"]  # newer versions keep the older table, without what came later
    keyed = source.withColumns({"_kind": kind, "_u": F.when(kind == "user", uid), "_c": F.when(kind == "chat", -uid), "_e": F.when(kind == "secret", F.floor(uid / (1 << 32)))})
    out = lookup(keyed, "_e", t["enc_chats"], "uid", {"_eu": "user"}, "_es")
    out = out.withColumn("_u", F.coalesce("_u", "_eu"))
    out = lookup(out, "_u", t["users"], "uid", {"_un": "name"}, "_us")
    out = lookup(out, "_c", t["chats"], "uid", {"_cn": "name"}, "_cs")
    state = F.when(F.col("_kind") == "chat", F.col("_cs")).when((F.col("_kind") == "secret") & (F.col("_es") != "found"), F.col("_es")).otherwise(F.col("_us"))
    return out.select(F.col("mid").alias("rowid"), V.unix_us(F.col("date"), "s").alias("ts"), _direction("out").alias("direction"), F.col("_kind").alias("dialog_kind"), F.coalesce("_un", "_cn").alias("dialog"), state.alias("dialog_state"), F.col("message").alias("body"), *carried(out))


def telegram_contacts(t: Mapping[str, DataFrame]) -> DataFrame:
    out = lookup(t["contacts"], "uid", t["users"], "uid", {"name": "name", "phone": "phone"}, "user_state")
    return out.select(F.col("uid").alias("rowid"), F.lit(None).cast("bigint").alias("ts"), "name", "phone", (F.col("mutual") == 1).alias("mutual"), "user_state", *carried(out))
