"""Files into tables: text of unknown encoding, nested documents, image headers, records that don't parse, versions."""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE

LEGACY = ("cp932", "euc_jp")
INVISIBLE_RUN = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), INVISIBLE) + "]")
# What plain text is made of, and the half-width kana that give away a wrong decoding.
PLAUSIBLE = re.compile(r"[\u3000-\u303f\u3041-\u309f\u30a0-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff5e\x00-\x7f\s]")
HALF_KANA = re.compile(r"[\uff61-\uff9f]")


def plausible(text: str) -> float:
    """The share of ordinary characters less twice that of half-width kana; 0 for nothing."""
    return (len(PLAUSIBLE.findall(text)) - 2 * len(HALF_KANA.findall(text))) / len(text) if text else 0.0


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8 if it is that, else the more plausible of the legacy encodings, else UTF-8 with replacements."""
    plain = data[3:] if data.startswith(b"\xef\xbb\xbf") else data
    try:
        return plain.decode(), "utf-8-bom" if plain is not data else "utf-8"
    except UnicodeDecodeError:
        pass
    found = []
    for name in LEGACY:
        try:
            text = plain.decode(name)
            found.append((plausible(text), name, text))
        except UnicodeDecodeError:
            continue
    if found:
        _, name, text = max(found, key=lambda x: x[0])
        return text, name
    return plain.decode(errors="replace"), "replaced"


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds text and encoding to rows of bytes (S6): valid UTF-8 stays in the JVM, only other files go through Python."""
    @F.pandas_udf("struct<text:string,encoding:string>")
    def legacy(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if d is None else decode(bytes(d)) for d in data], columns=["text", "encoding"])

    fine = F.is_valid_utf8(F.col(content).cast("string")) & (F.substring(F.hex(content), 1, 6) != "EFBBBF")
    plain = files.withColumn("__fine", F.coalesce(fine, F.lit(True)))
    good = plain.filter("__fine").withColumns({"text": F.col(content).cast("string"), "encoding": F.when(F.col(content).isNotNull(), "utf-8")})
    odd = plain.filter("not __fine").withColumn("__d", legacy(content)).withColumns({"text": F.col("__d.text"), "encoding": F.col("__d.encoding")}).drop("__d")
    return good.unionByName(odd).drop("__fine")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"))


CHAPTERS = "array<struct<idx int, title string, paragraphs array<string>>>"


def body_paragraphs(content: list) -> list[str]:
    """Paragraphs of a body in order, those of table cells and of tables in them where the table stands."""
    out, stack = [], [iter(content or [])]
    while stack:
        for element in stack[-1]:
            if "paragraph" in element:
                runs = (e.get("textRun") or {} for e in element["paragraph"].get("elements", []))
                text = INVISIBLE_RUN.sub("", "".join(r.get("content") or "" for r in runs)).strip("\n")
                if text.strip():
                    out.append(text)
            elif "table" in element:
                cells = [c for row in element["table"].get("tableRows", []) for c in row.get("tableCells", [])]
                stack.append(iter([x for c in cells for x in c.get("content", [])]))
                break
        else:
            stack.pop()
    return out


def tab_paragraphs(tab: dict) -> list[str]:
    """Paragraphs of a tab and of all tabs below it, however deep."""
    out, waiting = [], [tab]
    while waiting:
        now = waiting.pop()
        out += body_paragraphs(((now.get("documentTab") or {}).get("body") or {}).get("content", []))
        waiting += reversed(now.get("childTabs") or [])
    return out


def flatten_documents(docs: DataFrame, *, key: list[str], raw: str = "raw", children: bool = True) -> DataFrame:
    """Exported documents (JSON) -> a chapter per top tab: key, idx, title, paragraphs; tabs of any depth follow their parent.

    Nesting has no bound, so the JSON is walked in Python, Arrow batch by batch; what is no JSON object has no chapters.
    """
    @F.pandas_udf(CHAPTERS)
    def chapters(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[dict]:
            try:
                tabs = json.loads(text or "").get("tabs") or []
            except (ValueError, AttributeError):
                return []
            own = tab_paragraphs if children else lambda t: tab_paragraphs({**t, "childTabs": []})
            return [{"idx": k, "title": (t.get("tabProperties") or {}).get("title", "").strip() or f"Chapter {k}", "paragraphs": own(t)} for k, t in enumerate(tabs, 1)]

        return texts.map(of)

    return docs.select(*key, F.explode(chapters(raw)).alias("c")).select(*key, "c.*")


#: How files of each kind begin.
MAGIC = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "474946383761"), ("gif", "474946383961"), ("pdf", "255044462D"))
MOST_PIXELS = 200_000


def image_kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 32))
    kind = F.when(F.substring(head, 1, 8) == "52494646", F.when(F.substring(head, 17, 8) == "57454250", "webp"))
    kind = F.coalesce(kind, F.when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("68656963", "68656978", "6D696631"), "heic"))
    for name, magic in reversed(MAGIC):
        kind = F.when(F.substring(head, 1, len(magic)) == magic, name).otherwise(kind)
    return F.coalesce(kind, F.lit("unknown"))


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    text = F.hex(F.substring(content, at + 1, size))
    if little:
        text = F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(text, 16, 10).cast("long")


def jpeg_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Width and height of JPEG headers: a walk over segments to the frame header."""
    for batch in batches:
        sizes = []
        for data in batch["head"]:
            at, found = 2, (0, 0)
            while at + 9 < len(data) and data[at] == 0xFF:
                marker = data[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    found = struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
                    break
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0] if not 0xD0 <= marker <= 0xD9 else 2
            sizes.append(found)
        yield batch.drop(columns=["head"]).assign(width=[s[0] for s in sizes], height=[s[1] for s in sizes])


def image_inventory(files: DataFrame, key: str = "path") -> DataFrame:
    """files(key, content) -> key, kind, width, height, refused (why a kind is not taken); sizes out of reason are 0."""
    rows = files.select(key, F.col("content").alias("c")).withColumn("kind", image_kind(F.col("c")))
    c, kind = F.col("c"), F.col("kind")
    form = F.hex(F.substring(c, 13, 4))
    v8x = lambda a: _number(c, a, 3, True) + 1
    bits = _number(c, 21, 4, True)
    width = F.when(kind == "png", _number(c, 16, 4)).when(kind == "gif", _number(c, 6, 2, True)).when(form == "56503858", v8x(24)).when(form == "56503820", _number(c, 26, 2, True).bitwiseAND(0x3FFF)).when(form == "5650384C", bits.bitwiseAND(0x3FFF) + 1)
    height = F.when(kind == "png", _number(c, 20, 4)).when(kind == "gif", _number(c, 8, 2, True)).when(form == "56503858", v8x(27)).when(form == "56503820", _number(c, 28, 2, True).bitwiseAND(0x3FFF)).when(form == "5650384C", F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1)
    fixed = rows.filter("kind <> 'jpeg'").select(key, "kind", F.coalesce(width, F.lit(0)).cast("long").alias("width"), F.coalesce(height, F.lit(0)).cast("long").alias("height"))
    key_type = files.schema[key].dataType.simpleString()
    walked = rows.filter("kind = 'jpeg'").select(key, "kind", F.col("c").alias("head")).mapInPandas(jpeg_sizes, f"`{key}` {key_type}, kind string, width long, height long")
    every = fixed.unionByName(walked)
    sane = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") <= MOST_PIXELS) & (F.col("height") <= MOST_PIXELS)
    refused = F.when(F.col("kind").isin("png", "jpeg", "webp"), None).when(F.col("kind") == "heic", "convert-first").when(F.col("kind") == "pdf", "not-an-image").otherwise("unsupported")
    return every.withColumns({"__s": sane, "refused": refused}).withColumns({"width": F.when(F.col("__s"), F.col("width")).otherwise(0), "height": F.when(F.col("__s"), F.col("height")).otherwise(0)}).drop("__s")


#: Bytes of a file that say what it is; a JPEG's frame header is looked for beyond them, segment by segment.
HEAD = 64


def _frame(read: Callable[[int, int], bytes], size: int) -> bytes:
    """A JPEG cut down to its frame header: segments before it are passed over by their lengths."""
    at = 2
    while at + 9 < size:
        head = read(at, 9)
        if len(head) < 9 or head[0] != 0xFF:
            break
        marker = head[1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return b"\xff\xd8" + head + bytes(9)
        at += 2 + struct.unpack(">H", head[2:4])[0] if not 0xD0 <= marker <= 0xD9 else 2
    return b"\xff\xd8\xff"


def image_heads(places: DataFrame, key: str = "path") -> DataFrame:
    """places(key, file, start, size): images in files, alone or many to a file -> key, content (as much as says what it is), bytes_read.

    Ranges are read where they lie, through `pyarrow.fs`: HEAD bytes of each image, and of a JPEG nine bytes of each segment up
    to the frame header. What `image_inventory` says of this content it says of the whole. A file that is gone or shorter
    than said gives the bytes that are there.
    """
    kind = dict(places.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, object] = ("", None)
        for batch in batches:
            heads, counts = [], []
            for file, start, size in zip(batch["file"], batch["start"], batch["size"], strict=True):
                if held[0] != file:
                    if held[1]:
                        held[1].close()
                    store, at = fs.FileSystem.from_uri(file)
                    try:
                        held = (file, store.open_input_file(at))
                    except FileNotFoundError:
                        held = (file, None)
                taken = 0

                def read(at: int, n: int, f=held[1], start=int(start), size=int(size)) -> bytes:
                    nonlocal taken
                    n = max(0, min(n, size - at))
                    data = f.read_at(n, start + at) if f and n else b""
                    taken += len(data)
                    return data

                head = read(0, HEAD)
                heads.append(_frame(read, int(size)) if head.startswith(b"\xff\xd8\xff") else head)
                counts.append(taken)
            yield pd.DataFrame({key: batch[key], "content": heads, "bytes_read": counts})
        if held[1]:
            held[1].close()

    return places.select(key, "file", "start", "size").mapInPandas(run, f"`{key}` {kind}, content binary, bytes_read long")


def pack(contents: DataFrame, folder: str, key: str = "path") -> DataFrame:
    """contents(key, content) -> places(key, file, start, size): a file in the folder for each partition, contents one after another. A task that is run again writes a file of its own."""
    kind = dict(contents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, start = f"{uuid.uuid4().hex}.pack", 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                data = [x if x is not None else b"" for x in batch["content"]]
                sizes = [len(x) for x in data]
                starts = [start + x for x in itertools.accumulate(sizes, initial=0)][: len(sizes)]
                for x in data:
                    out.write(x)
                start += sum(sizes)
                yield pd.DataFrame({key: batch[key], "file": f"{folder}/{name}", "start": starts, "size": sizes})

    return contents.select(key, "content").mapInPandas(run, f"`{key}` {kind}, file string, start long, size long")


def parse_or_quarantine(rows: DataFrame, schema: str, *, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(rows with `record`, quarantine: raw bytes under their hash). What does not parse is kept, never dropped."""
    parsed = rows.withColumn("record", F.from_json(raw, schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    broken = F.coalesce(F.col("record.__bad").isNotNull() | F.col("record").isNull(), F.lit(True))
    good = parsed.filter(~broken).withColumn("record", F.col("record").dropFields("__bad"))
    return good, parsed.filter(broken).select(F.sha2(raw, 256).alias("hash"), F.col(raw).alias("raw")).distinct()


def previous_version(versions: DataFrame, *, key: list[str], version: str = "version") -> DataFrame:
    """The version before the newest of each key."""
    order = Window.partitionBy(*key).orderBy(F.desc(version))
    return versions.withColumn("__n", F.row_number().over(order)).filter("__n = 2").drop("__n")


def write_version(rows: DataFrame, path: str, *, version: int) -> None:
    """A snapshot under its version; a version that is written again is replaced whole."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def keep_two_versions(spark: SparkSession, path: str, *, key: list[str]) -> DataFrame:
    """All versions of a sink -> the newest and the one before of each key, `slot` current or previous; older ones are not kept."""
    order = Window.partitionBy(*key).orderBy(F.desc("version"))
    rows = spark.read.parquet(path).withColumn("__n", F.row_number().over(order)).filter("__n <= 2")
    return rows.withColumn("slot", F.when(F.col("__n") == 1, "current").otherwise("previous")).drop("__n")


def library(records: DataFrame) -> DataFrame:
    """Work records with an id, by creation time."""
    return records.filter("id is not null and id <> ''").orderBy("created_at", "id")


def read_library(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return library(spark.read.schema(schema).json(path))


def write_accepted(rows: DataFrame, readable: str, audit: str, by: str = "work_id") -> None:
    """Both sinks of a run, partition by partition: only valid rows are readable, all are audited."""
    for frame, path in ((rows.filter("ok"), readable), (rows, audit)):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
