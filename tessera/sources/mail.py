"""Mail and calendar JSON, parsed with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

_BODY = "struct<data:string,size:bigint,attachmentId:string>"
_LEAF = f"struct<mimeType:string,filename:string,body:{_BODY}>"
_PART2 = f"struct<mimeType:string,filename:string,body:{_BODY},parts:array<{_LEAF}>>"
_PART = f"struct<mimeType:string,filename:string,body:{_BODY},parts:array<{_PART2}>>"
MAIL = f"array<struct<id:string,threadId:string,payload:struct<mimeType:string,filename:string,headers:array<struct<name:string,value:string>>,body:{_BODY},parts:array<{_PART}>>>>"
_TIME = "struct<dateTime:string,date:string>"
_PERSON = "struct<displayName:string,email:string,responseStatus:string>"
_ITEM = f"struct<id:string,summary:string,description:string,location:string,organizer:{_PERSON},attendees:array<{_PERSON}>,start:{_TIME},end:{_TIME},recurrence:array<string>,status:string>"
CALENDAR = f"struct<items:array<{_ITEM}>>"
#: Attachments that are fetched.
ALLOWED = (".pdf", ".doc", ".docx", ".txt", ".xlsx", ".xls", ".csv", ".pptx")


def decoded(data: Column) -> Column:
    """Text of url-safe base64, with or without padding."""
    plain = F.translate(F.regexp_replace(data, r"[=\s]", ""), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def header(headers: Column, name: str) -> Column:
    """The last header of that name, whatever its case; none: empty."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def people(value: Column) -> Column:
    """Name and address of everybody whom a header names, in order."""
    return F.transform(text.addresses(value), lambda p: text.let(text.clean_sender(p), lambda s: F.struct(s["email"].alias("email"), s["name"].alias("name"))))


def body(payload: Column) -> Column:
    """The first plain text: of the payload, or of its direct parts; none: empty."""
    parts = F.filter(payload["parts"], lambda p: (p["mimeType"] == "text/plain") & (F.coalesce(p["body"]["data"], F.lit("")) != ""))
    own = F.when((payload["mimeType"] == "text/plain") & (F.coalesce(payload["body"]["data"], F.lit("")) != ""), payload["body"]["data"])
    return F.coalesce(decoded(F.coalesce(own, F.get(parts, F.lit(0))["body"]["data"])), F.lit(""))


def attachments(payload: Column) -> Column:
    """Named parts of up to three levels: filename, mime_type, size."""
    none = F.array().cast(f"array<{_LEAF}>")
    leaf = lambda p: F.struct(p["mimeType"].alias("mimeType"), p["filename"].alias("filename"), p["body"].alias("body"))
    level1 = F.coalesce(F.transform(payload["parts"], leaf), none)
    level2 = F.flatten(F.transform(payload["parts"], lambda p: F.coalesce(F.transform(p["parts"], leaf), none)))
    level3 = F.flatten(F.transform(payload["parts"], lambda p: F.flatten(F.transform(p["parts"], lambda q: F.coalesce(F.transform(q["parts"], leaf), none)))))
    every = F.concat(level1, F.coalesce(level2, none), F.coalesce(level3, none))
    named = F.filter(every, lambda p: F.coalesce(p["filename"], F.lit("")) != "")
    return F.transform(named, lambda p: F.struct(p["filename"].alias("filename"), F.coalesce(p["mimeType"], F.lit("")).alias("mime_type"), F.coalesce(p["body"]["size"], F.lit(0)).alias("size")))


def _array(content: Column) -> Column:
    """An object is an array of one."""
    return F.when(content.rlike(r"^\s*\["), content).otherwise(F.concat(F.lit("["), content, F.lit("]")))


def messages(rows: DataFrame, content: str = "content", raw: bool = False) -> DataFrame:
    """A row for each message of each object: headers, body and attachments.

    ``raw`` keeps the From header as name and address; else it is taken apart.
    """
    parsed = rows.withColumn("__m", F.explode(F.from_json(_array(F.make_valid_utf8(F.col(content).cast("string"))), MAIL))).withColumn("__h", F.col("__m.payload.headers"))
    sender = header(F.col("__h"), "From")
    split = text.clean_sender(sender)
    found = attachments(F.col("__m.payload"))
    return parsed.select(
        *[c for c in rows.columns if c != content],
        F.col("__m.id").alias("message_key"),
        F.coalesce("__m.threadId", F.lit("")).alias("thread_id"),
        header(F.col("__h"), "Subject").alias("subject"),
        (sender if raw else split["name"]).alias("sender_name"),
        (sender if raw else split["email"]).alias("sender_email"),
        *[people(header(F.col("__h"), name)).alias(c) for name, c in (("To", "recipients"), ("Cc", "cc"), ("Bcc", "bcc"))],
        text.parse_time(header(F.col("__h"), "Date")).alias("received_at"),
        header(F.col("__h"), "Message-ID").alias("message_id"),
        header(F.col("__h"), "In-Reply-To").alias("in_reply_to"),
        body(F.col("__m.payload")).alias("body"),
        F.coalesce(found, F.array().cast("array<struct<filename:string,mime_type:string,size:bigint>>")).alias("attachments"),
    ).withColumns({"attachment_count": F.size("attachments"), "has_attachments": F.size("attachments") > 0})


def events(rows: DataFrame, content: str = "content") -> DataFrame:
    """A row for each calendar item of each object (``items`` or a single one)."""
    source = F.make_valid_utf8(F.col(content).cast("string"))
    many, one = F.from_json(source, CALENDAR)["items"], F.from_json(source, _ITEM)
    items = F.coalesce(many, F.when(one["summary"].isNotNull() | one["start"].isNotNull(), F.array(one)), F.array().cast(f"array<{_ITEM}>"))
    e = F.col("__e")
    people = F.transform(F.coalesce(e["attendees"], F.array().cast(f"array<{_PERSON}>")), lambda a: F.struct(F.coalesce(a["displayName"], F.lit("")).alias("name"), F.coalesce(a["email"], F.lit("")).alias("email"), F.coalesce(a["responseStatus"], F.lit("")).alias("response")))
    start, end = F.coalesce(e["start"]["dateTime"], e["start"]["date"]), F.coalesce(e["end"]["dateTime"], e["end"]["date"])
    return rows.withColumn("__e", F.explode(items)).select(
        *[c for c in rows.columns if c != content],
        e["id"].alias("event_key"),
        F.coalesce(e["summary"], F.lit("")).alias("title"),
        F.coalesce(e["description"], F.lit("")).alias("description"),
        F.coalesce(e["location"], F.lit("")).alias("location"),
        F.coalesce(e["organizer"]["displayName"], F.lit("")).alias("organizer_name"),
        F.coalesce(e["organizer"]["email"], F.lit("")).alias("organizer_email"),
        people.alias("attendees"),
        text.parse_time(start).alias("start_time"),
        text.parse_time(end).alias("end_time"),
        e["start"]["date"].isNotNull().alias("is_all_day"),
        e["recurrence"].alias("recurrence"),
        F.coalesce(e["status"], F.lit("confirmed")).alias("status"),
    )


def allowed_attachments(rows: DataFrame, column: str = "attachments", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """A row for each attachment with an allowed extension, with its place."""
    out = rows.select("*", F.posexplode(column).alias("attachment_index", "__a")).drop(column)
    out = out.select(*[c for c in out.columns if c != "__a"], "__a.*")
    return out.filter(text.extension(F.col("filename")).isin(*allowed))
