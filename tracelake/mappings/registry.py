"""What each mapping needs and emits, and whether a set of tables can be mapped."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.payloads import Field, violation

from . import android, browsers, chats, ios
from .joins import FACTS, carried, unknowns

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Parser:
    name: str
    version: str
    emits: tuple[str, ...]
    needs: Mapping[str, tuple[str, ...]]  # table: columns
    run: Callable[[Tables], DataFrame]


PARSERS = {
    p.name: p
    for p in (
        Parser("chromium.history", "1", ("web_visit",), {"urls": ("id", "url"), "visits": ("id", "url", "visit_time")}, browsers.chromium_visits),
        Parser("chromium.downloads", "1", ("download",), {"downloads": ("id", "start_time", "state"), "downloads_url_chains": ("id", "chain_index", "url")}, browsers.chromium_downloads),
        Parser("safari.history", "1", ("web_visit",), {"history_items": ("id", "url"), "history_visits": ("id", "history_item", "visit_time")}, browsers.safari_history),
        Parser("android.sms", "1", ("message",), {"sms": ("_id", "thread_id", "date", "type"), "threads": ("_id", "recipient_ids"), "canonical_addresses": ("_id", "address")}, android.sms),
        Parser("android.mms", "1", ("message",), {"pdu": ("_id", "date", "msg_box"), "addr": ("msg_id", "address", "type"), "part": ("mid", "seq", "ct", "text")}, android.mms),
        Parser("android.calllog", "1", ("call",), {"calls": ("_id", "number", "date", "duration", "type")}, android.calls),
        Parser("android.contacts", "1", ("contact",), {"raw_contacts": ("_id", "display_name", "deleted"), "data": ("raw_contact_id", "mimetype_id", "data1"), "mimetypes": ("_id", "mimetype")}, android.contacts),
        Parser("android.calendar", "1", ("calendar_event",), {"Events": ("_id", "calendar_id", "dtstart"), "Calendars": ("_id",), "Attendees": ("event_id",), "Reminders": ("event_id", "minutes")}, android.calendar),
        Parser("ios.sms", "1", ("message",), {"message": ("ROWID", "handle_id", "date", "is_from_me"), "handle": ("ROWID", "id"), "chat_message_join": ("chat_id", "message_id")}, ios.messages),
        Parser("chromium.searches", "1", ("web_search",), {"keyword_search_terms": ("keyword_id", "url_id", "term"), "urls": ("id", "url", "last_visit_time")}, browsers.chromium_searches),
        Parser("ios.calls", "1", ("call",), {"ZCALLRECORD": ("Z_PK", "ZDATE", "ZDURATION", "ZORIGINATED", "ZANSWERED", "ZCALLTYPE", "ZADDRESS")}, ios.calls),
        Parser("ios.calls.legacy", "1", ("call",), {"call": ("ROWID", "address", "date", "duration", "flags")}, ios.calls_legacy),
        Parser("ios.addressbook", "1", ("contact",), {"ABPerson": ("ROWID", "First", "Last"), "ABMultiValue": ("record_id", "property", "label", "value"), "ABMultiValueLabel": ("ROWID", "value"), "ABGroupMembers": ("group_id", "member_id"), "ABGroup": ("ROWID", "Name")}, ios.contacts),
        Parser("ios.calendar", "1", ("calendar_event",), {"CalendarItem": ("ROWID", "start_date", "end_date", "calendar_id", "location_id"), "Calendar": ("ROWID", "title"), "Location": ("ROWID", "title"), "Participant": ("owner_id", "identity_id"), "Identity": ("ROWID", "display_name"), "Alarm": ("calendaritem_owner_id", "trigger_interval"), "Recurrence": ("owner_id", "frequency"), "ExceptionDate": ("owner_id", "date")}, ios.calendar),
        Parser("android.whatsapp.msgstore", "1", ("message",), {"message": ("_id", "chat_row_id", "from_me", "timestamp", "sender_jid_row_id"), "chat": ("_id", "jid_row_id", "subject"), "jid": ("_id", "raw_string"), "message_media": ("message_row_id", "file_path"), "message_quoted": ("message_row_id", "key_id"), "message_revoked": ("message_row_id",), "message_add_on": ("parent_message_row_id", "reaction"), "deleted_chat_job": ("_id", "chat_row_id", "deleted_message_row_id", "deleted_starred_message_row_id")}, chats.whatsapp_messages),
        Parser("android.whatsapp.msgstore.legacy", "1", ("message",), {"messages": ("_id", "key_remote_jid", "key_from_me", "timestamp", "data"), "chat_list": ("key_remote_jid", "subject"), "messages_quotes": ("_id", "data")}, chats.whatsapp_legacy_messages),
        Parser("android.whatsapp.calls", "1", ("call",), {"call_log": ("_id", "jid_row_id", "from_me", "timestamp", "duration", "call_result", "video_call"), "call_log_participant_v2": ("call_log_row_id", "jid_row_id"), "jid": ("_id", "raw_string")}, chats.whatsapp_calls),
        Parser("android.whatsapp.contacts", "1", ("contact",), {"wa_contacts": ("_id", "jid", "number", "display_name", "wa_name", "is_whatsapp_user")}, chats.whatsapp_contacts),
        Parser("ios.whatsapp.chats", "1", ("message",), {"ZWAMESSAGE": ("Z_PK", "ZCHATSESSION", "ZISFROMME", "ZMESSAGEDATE", "ZTEXT", "ZGROUPMEMBER", "ZMEDIAITEM"), "ZWACHATSESSION": ("Z_PK", "ZCONTACTJID", "ZPARTNERNAME"), "ZWAGROUPMEMBER": ("Z_PK", "ZMEMBERJID"), "ZWAMEDIAITEM": ("Z_PK", "ZMEDIALOCALPATH")}, chats.ios_whatsapp_messages),
        Parser("ios.whatsapp.calls", "1", ("call",), {"ZWACDCALLEVENT": ("Z_PK", "ZDATE", "ZDURATION", "ZOUTCOME", "Z1CALLEVENTS"), "ZWAAGGREGATECALLEVENT": ("Z_PK", "ZINCOMING", "ZVIDEO")}, chats.ios_whatsapp_calls),
        Parser("ios.whatsapp.contacts", "1", ("contact",), {"ZWAADDRESSBOOKCONTACT": ("Z_PK", "ZWHATSAPPID", "ZFULLNAME", "ZPHONENUMBER")}, chats.ios_whatsapp_contacts),
        Parser("android.telegram", "1", ("message",), {"messages": ("mid", "uid", "out", "date", "message"), "users": ("uid", "name", "phone"), "chats": ("uid", "name"), "enc_chats": ("uid", "user")}, chats.telegram_messages),
        Parser("android.telegram.contacts", "1", ("contact",), {"contacts": ("uid", "mutual"), "users": ("uid", "name", "phone")}, chats.telegram_contacts),
    )
}


#: Tables that a mapping reads where they are there, with the columns that it needs of them.
OPTIONAL: dict[str, dict[str, tuple[str, ...]]] = {
    "android.contacts": {"accounts": ("_id", "account_name", "account_type"), "deleted_contacts": ("contact_id", "contact_deleted_timestamp")},
    "android.calendar": {"CalendarAlerts": ("event_id", "alarmTime"), "ExtendedProperties": ("event_id", "name", "value"), "EventsRawTimes": ("event_id", "dtstart2445", "dtend2445")},
    "ios.sms": {"chat_handle_join": ("chat_id", "handle_id"), "message_attachment_join": ("message_id", "attachment_id"), "chat_recoverable_message_join": ("message_id",)},
    "ios.addressbook": {"ABMultiValueEntry": ("parent_id", "key", "value"), "ABMultiValueEntryKey": ("ROWID", "value"), "ABStore": ("ROWID", "Name")},
    "safari.history": {"history_tombstones": ("id", "start_time", "end_time", "url")},
    "android.whatsapp.msgstore": {"message_system": ("message_row_id", "action_type"), "message_location": ("message_row_id", "latitude", "longitude"), "message_vcard": ("message_row_id",), "jid_map": ("lid_row_id", "jid_row_id")},
    "android.whatsapp.calls": {"jid_map": ("lid_row_id", "jid_row_id")},
    "ios.whatsapp.chats": {"ZWAMESSAGEINFO": ("ZMESSAGE", "ZRECEIPTINFO")},
    "android.telegram": {"messages_v2": ("mid", "uid", "out", "date", "message")},
}


def probe(parser: Parser, tables: Tables, entropy: float | None = None, companions: bool = False) -> str:
    """Whether a set of tables can be mapped.

    encrypted: the file's bytes look random (entropy in bits of a byte, above 7.9) and no table was read; deferred: a companion
    may still bring the tables that are missing, so the mapping is to be tried; not-applicable: none of its tables;
    unsupported-schema: a table or a column is missing, of optional tables too; applicable.
    """
    if entropy is not None and entropy > 7.9 and not tables:
        return "encrypted"
    needs = {t: c for t, c in {**parser.needs, **OPTIONAL.get(parser.name, {})}.items() if t in parser.needs or t in tables}
    whole = all(t in tables and set(c) <= set(tables[t].columns) for t, c in needs.items())
    if whole:
        return "applicable"
    if companions:
        return "deferred"
    return "unsupported-schema" if any(t in tables for t in parser.needs) else "not-applicable"


def records(parser: Parser, tables: Tables, name: str | None = None) -> DataFrame:
    """parser, type, rowid, ts and the mapping's other columns as JSON, with what isn't known: unread cells and joins that nobody can decide.

    Rows that carry the facts of a recovery give them as ``recovery``.
    """
    if (state := probe(parser, tables)) != "applicable":
        raise ValueError(f"{parser.name}: {state}")
    out = parser.run(tables)
    rest = [c for c in out.columns if c not in ("rowid", "ts", *carried(out))]
    facts = [F.col(FACTS).alias("recovery")] if FACTS in out.columns else []
    return out.select(F.lit(name or parser.name).alias("parser"), F.lit(parser.emits[0]).alias("type"), "rowid", "ts", F.to_json(F.struct(*rest, *unknowns(out))).alias("payload"), *facts)


def claimed(spark: SparkSession) -> DataFrame:
    """parser, platform, name of the table that each parser drives; what both platforms have (browsers) counts on both."""
    rows = [(p.name, platform, next(iter(p.needs))) for p in PARSERS.values() for platform in ([p.name.split(".")[0]] if p.name.startswith(("android.", "ios.")) else ["android", "ios"])]
    return spark.createDataFrame(rows, "parser string, platform string, name string")


def parser_hash(parser: Parser) -> str:
    """A digest of what a parser is called, needs and emits, and of the code of its mapping: another one is another parser."""
    what = [parser.name, parser.version, sorted(parser.emits), sorted((t, sorted(c)) for t, c in parser.needs.items()), inspect.getsource(parser.run)]
    return hashlib.sha256(json.dumps(what).encode()).hexdigest()


#: What payloads of each type of record must have.
TYPES: dict[str, tuple[Field, ...]] = {}


def register_type(name: str, fields: tuple[Field, ...]) -> None:
    """Adds a type; a second one of that name is an error."""
    if name in TYPES:
        raise ValueError(f"{name}: registered twice")
    TYPES[name] = fields


_DIRECTION = Field("direction", values=("in", "out", "draft", "unknown"), required=True)
register_type("message", (_DIRECTION, Field("attachments", kind="number")))
register_type("call", (Field("direction", values=("in", "out", "unknown"), required=True), Field("outcome", values=("answered", "missed", "rejected", "blocked", "voicemail", "cancelled", "unavailable", "unknown")), Field("kind", values=("voice", "video", "audio", "unknown"))))
register_type("contact", (Field("name"), Field("deleted", kind="bool"), Field("mutual", kind="bool"), Field("uses_app", kind="bool")))
register_type("web_visit", (Field("kind", values=("visit", "url", "item", "tombstone"), required=True), Field("url"), Field("deleted", kind="bool")))
register_type("web_search", (Field("term", required=True), Field("url")))
register_type("download", (Field("state", values=("in_progress", "complete", "cancelled", "interrupted", "unknown"), required=True), Field("hops", kind="number")))
register_type("calendar_event", (Field("title"), Field("all_day", kind="bool"), Field("deleted", kind="bool"), Field("end_ts", kind="number")))


def rejected(recs: DataFrame) -> DataFrame:
    """Records (type, payload) whose payload breaks its type's schema, with how; an unknown type breaks it too."""
    wrong = F.lit("unknown type")
    for name, fields in TYPES.items():
        wrong = F.when(F.col("type") == name, violation(F.col("payload"), fields)).otherwise(wrong)
    return recs.withColumn("wrong", wrong).where("wrong IS NOT NULL")


#: Paths of databases.
NAMERS = {
    r"/(?:app_chrome|app_webview)/[^/]+/History$": "chromium.history", r"/Safari/History\.db$": "safari.history", r"/com\.android\.providers\.telephony/databases/mmssms\.db$": "android.sms",
    r"/com\.android\.providers\.contacts/databases/calllog\.db$": "android.calllog", r"/com\.android\.providers\.contacts/databases/contacts2\.db$": "android.contacts",
    r"/com\.android\.providers\.calendar/databases/calendar\.db$": "android.calendar", r"/SMS/sms\.db$": "ios.sms", r"/CallHistory\.storedata$": "ios.calls", r"/AddressBook\.sqlitedb$": "ios.addressbook",
    r"/Calendar\.sqlitedb$": "ios.calendar", r"/com\.whatsapp/databases/msgstore\.db$": "android.whatsapp.msgstore", r"/com\.whatsapp/databases/wa\.db$": "android.whatsapp.contacts",
    r"/ChatStorage\.sqlite$": "ios.whatsapp.chats", r"/CallHistory\.sqlite$": "ios.whatsapp.calls", r"/ContactsV2\.sqlite$": "ios.whatsapp.contacts", r"/org\.telegram\.messenger/files/cache4\.db$": "android.telegram",
}


def named(paths: DataFrame, path: str) -> DataFrame:
    """paths with the parser that reads a file of that name; null if none does: names are those of the apps' databases."""
    out = F.lit(None).cast("string")
    for pattern, parser in NAMERS.items():
        out = F.when(F.col(path).rlike(pattern), parser).otherwise(out)
    return paths.withColumn("parser", out)


#: Names of database files alone, for copies outside of their apps' folders, and what tables a database has that no name gives away.
FILE_NAMES = {"mmssms.db": "android.sms", "calllog.db": "android.calllog", "contacts2.db": "android.contacts", "calendar.db": "android.calendar", "msgstore.db": "android.whatsapp.msgstore", "wa.db": "android.whatsapp.contacts", "sms.db": "ios.sms", "ChatStorage.sqlite": "ios.whatsapp.chats"}


def named_by_chain(files: DataFrame, path: str, tables: str) -> DataFrame:
    """files with ``parser`` and ``namer``: the first of a chain that names a file.

    path: the place where its app keeps it; name: the file's name; tables: the one parser all of whose tables are among the
    file's (an array of names). Several such parsers name nothing.
    """
    by_path = F.lit(None).cast("string")
    for pattern, parser in NAMERS.items():
        by_path = F.when(F.col(path).rlike(pattern), parser).otherwise(by_path)
    name = F.substring_index(path, "/", -1)
    by_name = F.lit(None).cast("string")
    for known, parser in FILE_NAMES.items():
        by_name = F.when(name == known, parser).otherwise(by_name)
    fits = F.array_compact(F.array(*[F.when(F.size(F.array_except(F.array(*[F.lit(t) for t in p.needs]), F.col(tables))) == 0, p.name) for p in PARSERS.values()]))
    by_tables = F.when(F.size(fits) == 1, fits[0])
    namer = F.when(by_path.isNotNull(), "path").when(by_name.isNotNull(), "name").when(by_tables.isNotNull(), "tables")
    return files.withColumns({"parser": F.coalesce(by_path, by_name, by_tables), "namer": namer})
