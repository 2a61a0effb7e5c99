"""Raw objects: listing, reading, sniffing, and readers by format."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import extension, media_type, strip

#: Bytes of a JSON object that are sniffed.
SNIFFED = 262_144


def objects(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Objects under a path: uri, bucket, object_key, filename, size_bytes, modified, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path)
    key = F.regexp_extract("path", r"^[a-z0-9]+:/+(.*)$", 1)
    bucket = F.when(F.col("path").startswith("file:"), "local").otherwise(F.regexp_extract("path", r"^[a-z0-9]+://([^/]+)/", 1))
    return rows.select(F.col("path").alias("uri"), bucket.alias("bucket"), key.alias("object_key"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def listed(rows: DataFrame) -> DataFrame:
    """A listing without contents: the column isn't read."""
    return rows.drop("content")


def with_extension(rows: DataFrame, ext: str) -> DataFrame:
    return rows.filter(F.lower("filename").endswith(ext.lower()))


def with_metadata(rows: DataFrame) -> DataFrame:
    """With checksum, extension, media type and a source URI."""
    return rows.withColumns({"checksum": F.sha2("content", 256), "extension": extension(F.col("filename")), "mime_type": media_type(F.col("filename")), "source": F.concat_ws("/", F.lit("store:/"), "bucket", "object_key")})


def source_type(rows: DataFrame) -> Column:
    """email, calendar or document, by name and, for JSON, by the keys of the first object."""
    head = F.make_valid_utf8(F.substring("content", 1, SNIFFED).cast("string"))
    parsed = F.try_parse_json(head)
    has = lambda k: F.try_variant_get(parsed, f"$.{k}", "string").isNotNull() | F.try_variant_get(parsed, f"$[0].{k}", "string").isNotNull()
    some = lambda k: F.regexp_like(head, F.lit(rf'^\s*[\[{{]?[\s\S]*?"{k}"\s*:'))
    is_json = extension(F.col("filename")) == ".json"
    cut = F.length("content") > SNIFFED
    mail = has("id") | has("threadId") | (cut & some("threadId"))
    calendar = has("items") | has("summary") | (cut & some("items"))
    return F.when(is_json & mail & ~has("start"), "email").when(is_json & calendar, "calendar").when(is_json & mail, "email").otherwise("document")


# ---- documents ---------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, one a line; then a blank line and the rows of tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def said(p) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    lines = [s for p in body.findall(f"{_W}p") if (s := said(p)).strip()]
    tables = []
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            tables.append(" | ".join("\n".join(said(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")))
    return "\n".join(lines) + ("\n\n" + "\n".join(tables) if tables else "")


def xlsx_text(data: bytes) -> str:
    """For each sheet a header line and its rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_S}sheets"):
            out.append(f"=== Sheet: {sheet.get('name')} ===")
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in root.iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.findall(f"{_S}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                    column = 0
                    for ch in letters:
                        column = column * 26 + ord(ch) - 64
                    v = c.find(f"{_S}v")
                    value = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells[column] = strings[int(value)] if c.get("t") == "s" and value else value
                out.append(" | ".join(cells.get(i, "") for i in range(1, max(cells, default=0) + 1)))
    return "\n".join(out)


_PDF_SHOWN = re.compile(rb"/([^\s/<>\[\]()]+)\s+[-\d.]+\s+Tf|\[((?:[^\[\]()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)\s*(Tj|'|\")|(T\*|Td|TD|ET)", re.S)
_PDF_STRING = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}


def _inflated(raw: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(raw)
    except zlib.error:
        return raw


def _pdf_bytes(shown: bytes) -> bytes:
    """What a literal or hexadecimal string of a PDF holds."""
    if shown[:1] == b"<":
        digits = re.sub(rb"\s", b"", shown[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else _PDF_ESCAPES.get(e[1], e[1]), shown[1:-1], flags=re.S)


def _to_unicode(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code, from a font's table."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out, width = {}, 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, value in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)], width = text(value), max(width, len(code) // 2)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, value, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            width = max(width, len(low) // 2)
            values = re.findall(rb"<([0-9A-Fa-f]+)>", listed)
            for k, code in enumerate(range(int(low, 16), min(int(high, 16), int(low, 16) + 65535) + 1)):
                if value:
                    first = text(value)
                    out[code] = first[:-1] + chr(ord(first[-1]) + k)
                elif k < len(values):
                    out[code] = text(values[k])
    return width, out


def pdf_text(data: bytes) -> str:
    """Text that the pages of a PDF show: strings of Tj, TJ and their kin in plain or deflated streams.

    Codes of fonts with a table to Unicode are read by it, others as Latin-1. Streams that don't show
    text give none; pages are separated by a blank line. Encrypted files give no sensible text.
    """
    if not data.startswith(b"%PDF"):
        return ""
    objects: dict[int, bytes] = {int(n): body for n, body in re.findall(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
    stream = lambda body: _inflated(m[1]) if (m := re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)) else b""
    for body in list(objects.values()):  # objects that are packed in streams
        if re.search(rb"/Type\s*/ObjStm", body) and (first := re.search(rb"/First\s+(\d+)", body)):
            packed, start = stream(body), int(first[1])
            heads = [int(x) for x in packed[:start].split()]
            places = list(zip(heads[::2], heads[1::2], strict=False))
            for (n, at), (_, end) in zip(places, [*places[1:], (0, len(packed) - start)], strict=True):
                objects.setdefault(n, packed[start + at : start + end])
    fonts: dict[bytes, tuple[int, dict[int, str]]] = {}
    for body in [*objects.values()]:
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+0\s+R", body):
            if (font := objects.get(int(n))) and (table := re.search(rb"/ToUnicode\s+(\d+)\s+0\s+R", font)) and int(table[1]) in objects:
                fonts[name] = _to_unicode(stream(objects[int(table[1])]))

    def said(shown: bytes, font: bytes | None) -> str:
        raw = _pdf_bytes(shown)
        if font not in fonts:
            return raw.decode("latin-1")
        width, table = fonts[font]
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        raw = _inflated(m[1])
        if b"BT" not in raw:
            continue
        lines, font = [], None
        for shown in _PDF_SHOWN.finditer(raw):
            if shown[1]:
                font = shown[1]
            elif shown[5]:
                lines.append("\n")
            else:
                lines += [said(x, font) for x in ([shown[3]] if shown[3] else _PDF_STRING.findall(shown[2]))]
        text = re.sub(r"\n+", "\n", "".join(lines)).strip()
        if text:
            pages.append(text)
    return "\n\n".join(pages)


def csv_text(data: bytes) -> str:
    """Cells joined by bars, a line for each row; quoting may span lines."""
    import csv

    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline="")))


#: Readers that run in Python, by extension: functions of the bytes.
PARSERS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".doc": docx_text, ".pdf": pdf_text, ".xlsx": xlsx_text, ".xls": xlsx_text, ".csv": csv_text}


def txt_text(content: Column) -> Column:
    """UTF-8 with replacement of what isn't."""
    return F.make_valid_utf8(content.cast("string"))


#: Readers that are expressions, by extension: functions of the content column.
READERS: dict[str, Callable[[Column], Column]] = {".txt": txt_text}


def register_reader(ext: str, reader: Callable[[Column], Column]) -> None:
    """Reads an extension by an expression."""
    PARSERS.pop(ext.lower(), None)
    READERS[ext.lower()] = reader


def register_parser(ext: str, parser: Callable[[bytes], str]) -> None:
    """Reads an extension by a Python function of the bytes."""
    READERS.pop(ext.lower(), None)
    PARSERS[ext.lower()] = parser


#: Bytes of documents that a worker reads before it hands their texts on; a longer one goes by itself.
READ_BYTES = 1 << 20


def slices(contents: pd.Series, limit: int = READ_BYTES) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows with about ``limit`` bytes together."""
    begin, total = 0, 0
    for i, n in enumerate(len(x) if x is not None else 0 for x in contents):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(contents):
        yield begin, len(contents)


def _parsed(allowed: tuple[str, ...]):
    parsers = {e: f for e, f in PARSERS.items() if e in allowed}

    @F.pandas_udf(T.StructType.fromDDL("text string, error string"))
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for extensions, contents in batches:
            for begin, end in slices(contents):
                out = []
                for ext, data in zip(extensions.iloc[begin:end], contents.iloc[begin:end], strict=True):
                    try:
                        out.append((parsers[ext](bytes(data)) if data is not None else None, None))
                    except Exception as e:  # whatever is wrong with a document, its row says so
                        out.append((None, f"{type(e).__name__}: {e}"[:500]))
                yield pd.DataFrame(out, columns=["text", "error"])

    return parse


def document_text(rows: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """``rows`` with text and read_error by extension (by default all that have a reader), in one pass.

    Contents that an expression reads, or nobody does, aren't sent to Python. A document of any size is
    read. Other extensions have the empty text and no error; a document that its reader can't read has
    the empty text and the reason.
    """
    allowed = allowed if allowed is not None else (*READERS, *PARSERS)
    ext, content = F.col("extension"), F.col("content")
    found = _parsed(allowed)(ext, F.when(ext.isin(*[e for e in PARSERS if e in allowed]), content))
    out = rows.withColumn("__read", found)
    text = F.col("__read.text")
    for e in READERS:
        if e in allowed:
            text = F.when(ext == e, READERS[e](content)).otherwise(text)
    return out.withColumns({"text": F.coalesce(text, F.lit("")), "read_error": F.col("__read.error")}).drop("__read")


def first_available(ids: DataFrame, key: str, *tiers: DataFrame) -> DataFrame:
    """The content of each id from the first of several stores that has it; none: null."""
    out = ids
    for i, tier in enumerate(tiers):
        out = out.join(tier.groupBy(key).agg(F.min("content").alias(f"__c{i}")), key, "left")
    return out.withColumn("content", F.coalesce(*[F.col(f"__c{i}") for i in range(len(tiers))])).drop(*[f"__c{i}" for i in range(len(tiers))])


def pending(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that aren't done yet."""
    return found.join(done.select(key).distinct(), key, "left_anti")


def since(rows: DataFrame, at: str, state: DataFrame) -> DataFrame:
    """Rows after the last crawl; all if there was none. ``state`` has last_crawl_at."""
    mark = state.agg(F.max("last_crawl_at").alias("__mark"))  # one row
    return rows.join(F.broadcast(mark)).filter(F.col("__mark").isNull() | (F.col(at) > F.col("__mark"))).drop("__mark")


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **params) -> DataFrame:
    """SQL with named parameters; ``tables`` stand for the names in braces, without a view that others would see."""
    return spark.sql(sql, args=params or None, **(tables or {}))


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")
