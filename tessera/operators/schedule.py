"""Events from schedule-like texts, by expressions and windows over their lines.

Every line is typed by itself. Dates that are listed before a timed line belong to it; what other lines
need of the text before is a count, a first or a last value over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as texts

# How dates, times and lines to skip are written.
WEEKDAY = r"(?U)Th[ứ]\s+\S+\s*[-–—]\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
NAMED_DATE = r"(?U)Ng[àa]y\s+([0-9]{1,2})/([0-9]{1,2})(?:/([0-9]{4}))?"
PLAIN_DATE = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
TIMED = r"(?Us)^([0-9]{1,2}):([0-9]{2})\s*[-–—]\s*([0-9]{1,2}):([0-9]{2})\s*[|]?\s*(.+)"
RULE = r"^[-–—=| ]+$"
HEADINGS = ("lịch", "mục đích")
COLUMN_NAMES = ("thời gian", "công việc")
LEISURE = ("nghỉ", "tự học", "đọc sách", "đọc tài liệu", "gym")

#: Kinds of lines that matter.
WEEKDAY_LINE, NAMED_LINE, PLAIN_LINE, TIMED_LINE, OTHER_LINE = range(5)


def date_in(line: Column, pattern: str, year: int) -> Column:
    """The date that ``pattern`` finds first, null where there is none or it is impossible."""
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).cast("int")
    y = F.coalesce(part(3), F.lit(year))
    return F.when(y > 0, F.try_make_timestamp_ntz(y, part(2), part(1), F.lit(0), F.lit(0), F.lit(0)))


def typed_lines(df: DataFrame, text: str, key: str, year: int) -> DataFrame:
    """document_id, doc (a number for each row of ``df``), n, line, kind, date, and times and name of timed lines.

    Texts without anything like a date give no lines: nothing in them has a day.
    """
    rows = df.select(F.col(key).alias("document_id"), F.col(text).alias("t")).filter(F.col("t").rlike("[0-9]/[0-9]"))
    rows = rows.withColumn("doc", F.monotonically_increasing_id())
    lines = rows.select("document_id", "doc", F.posexplode(F.split("t", "\n")).alias("n", "raw"))
    lines = lines.select("document_id", "doc", (F.col("n") + 1).alias("n"), texts.strip(F.col("raw")).alias("line"))
    lines = lines.withColumn("low", F.lower("line"))
    skipped = (F.col("line") == "") | F.col("line").rlike(RULE)
    for h in HEADINGS:
        skipped = skipped | F.col("low").startswith(h)
    skipped = skipped | (F.col("low").contains(COLUMN_NAMES[0]) & F.col("low").contains(COLUMN_NAMES[1]))
    # Every date has digits around a slash, and every time begins a line: other lines don't meet the patterns.
    has_date, digit = F.col("line").rlike("[0-9]/[0-9]"), F.col("line").rlike("^[0-9]")
    found = {f"d{i}": F.when(has_date, date_in(F.col("line"), p, year)) for i, p in enumerate((WEEKDAY, NAMED_DATE, PLAIN_DATE))}
    lines = lines.filter(~skipped).withColumns(found)
    timed = digit & F.col("line").rlike(TIMED)
    plain = ~F.col("line").rlike("^[0-9]") & (F.length("line") > 3)
    kind = F.when(F.col("d0").isNotNull(), WEEKDAY_LINE).when(F.col("d1").isNotNull(), NAMED_LINE).when(F.col("d2").isNotNull(), PLAIN_LINE).when(timed, TIMED_LINE).when(plain, OTHER_LINE)
    lines = lines.withColumn("kind", kind).filter("kind is not null")
    part = lambda i: F.when(F.col("kind") == TIMED_LINE, F.regexp_extract("line", TIMED, i))
    clock = [part(i).cast("int").alias(c) for i, c in enumerate(("h1", "m1", "h2", "m2"), 1)]
    leisure = F.lit(False)
    for w in LEISURE:
        leisure = leisure | F.col("low").contains(w)
    return lines.select("document_id", "doc", "n", "line", "kind", F.coalesce("d0", "d1", "d2").alias("date"), *clock, texts.strip(part(5)).alias("said"), leisure.alias("leisure"))


def dated(lines: DataFrame) -> DataFrame:
    """``lines`` with what the text around says of them.

    possible: a timed line with times that exist. listed: a date that waits for the next such line; dates are
    listed from the first named one on, if that comes before any timed line. block: the lines up to and with
    the next possible timed line. waiting: the first date listed so far in the block; entry: the block's timed
    line; today: the day that was set last, by a date that isn't listed or by a block's first listed one.
    """
    doc, ordered = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("n")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    block, so_far = Window.partitionBy("doc", "block"), Window.partitionBy("doc", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    rows = lines.withColumns({
        "possible": (kind == TIMED_LINE) & (F.greatest("h1", "h2") <= 23) & (F.greatest("m1", "m2") <= 59),
        "first_timed": F.min(F.when(kind == TIMED_LINE, F.col("n"))).over(doc),
        "first_named": F.min(F.when(kind == NAMED_LINE, F.col("n"))).over(doc),
    })
    rows = rows.withColumns({
        "listed": kind.isin(WEEKDAY_LINE, NAMED_LINE) & F.coalesce((F.col("n") >= F.col("first_named")) & (F.col("first_timed").isNull() | (F.col("first_named") < F.col("first_timed"))), F.lit(False)),
        "block": F.coalesce(F.count_if("possible").over(before), F.lit(0)),
    })
    rows = rows.withColumns({
        "waiting": F.first(F.when(F.col("listed"), F.col("date")), ignorenulls=True).over(so_far),
        "entry": F.max(F.when(F.col("possible"), F.struct("n", "line", "said", "h1", "m1", "h2", "m2"))).over(block),
    })
    sets = F.when(kind.isin(WEEKDAY_LINE, NAMED_LINE, PLAIN_LINE) & ~F.col("listed"), F.col("date")).when(F.col("possible"), F.col("waiting"))
    return rows.withColumn("today", F.last(sets, ignorenulls=True).over(before))


def extract(df: DataFrame, text: str, key: str, year: int = 2026) -> DataFrame:
    """A row for each distinct entry (by start and name, the first) of each text, with the key of its document.

    A date in a line holds for the lines below; dates listed before an entry all get it. An end at or
    before the start is an hour later. Lines without a time are tentative, unless they name leisure.
    An impossible time skips its line. Null and empty texts, and texts without dates, have no entries;
    rows that share a key have their own. Lines of texts with dates are shuffled once, by text.
    """
    rows = dated(typed_lines(df, text, key, year))
    at = lambda day, h, m: day + F.make_dt_interval(F.lit(0), h, m)
    null = F.lit(None).cast("timestamp_ntz")
    e = F.col("entry")
    timed = lambda day: F.struct(e["n"].alias("line_number"), F.col("n").alias("place"), e["said"].alias("name"), at(day, e["h1"], e["m1"]).alias("effective_start"), at(day, e["h2"], e["m2"]).alias("end"), e["line"].alias("raw_text"))
    untimed = lambda day: F.struct(F.col("n").alias("line_number"), F.col("n").alias("place"), F.col("line").alias("name"), day.alias("effective_start"), null.alias("end"), F.col("line").alias("raw_text"))
    day = F.coalesce(F.when(F.col("first_timed").isNull() | (F.col("n") < F.col("first_timed")), F.col("waiting")), F.col("today"))
    found = F.when(F.col("listed") & e.isNotNull(), timed(F.col("date"))).when(F.col("possible") & F.col("waiting").isNull() & F.col("today").isNotNull(), timed(F.col("today")))
    found = found.when((F.col("kind") == OTHER_LINE) & ~F.col("leisure") & day.isNotNull(), untimed(day))
    rows = rows.select("document_id", "doc", found.alias("f")).filter("f is not null")
    rows = rows.groupBy("doc", F.col("f.effective_start").alias("effective_start"), F.col("f.name").alias("name")).agg(F.min(F.struct("f", "document_id")).alias("r"))
    later = F.when(F.col("r.f.end") > F.col("effective_start"), F.col("r.f.end")).otherwise(F.col("r.f.end") + F.expr("interval 1 hour"))
    rows = rows.select(F.col("r.document_id").alias("document_id"), "name", "effective_start", later.alias("effective_end"), F.col("r.f.line_number").alias("line_number"), F.col("r.f.raw_text").alias("raw_text"))
    timed_entry = F.col("effective_end").isNotNull()
    minutes = F.timestamp_diff("MINUTE", F.col("effective_start"), F.col("effective_end")).cast("int")
    return rows.select("document_id", "name", "effective_start", "effective_end", F.when(timed_entry, 2).otherwise(1).alias("importance"), F.when(timed_entry, "active").otherwise("tentative").alias("status"), "line_number", "raw_text", minutes.alias("duration_minutes"))
