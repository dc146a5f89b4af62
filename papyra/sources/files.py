"""Files of an archive: found, hashed, read page by page.

Text, RTF and the zipped office formats are read with what Python has. PDF,
images and the old office formats need packages that may be missing; their
pages come out empty, marked with the reader's name, and wait for recognition.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import rules

SUFFIXES = {x: kind for kind, xs in rules.EXTENSIONS.items() for x in xs}
#: A page's words with their boxes, as shares of the page, from engines that have them.
BOXES = "array<struct<t:string,x0:double,y0:double,x1:double,y1:double>>"
PAGE = f"path string, page int, text string, engine string, words {BOXES}"


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def suffix_of(name: str) -> str:
    """:func:`suffix` of one name on the driver."""
    return name.rpartition(".")[2].lower() if "." in name else ""


def reader(path: Column | str) -> Column:
    """The kind of reader of a file by its suffix; null for an unsupported one."""
    table = F.create_map(*(x for k, v in SUFFIXES.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(table, suffix(path))


#: Changed files that are read by their names; of more, the whole folder is read.
MOST_PATHS = 10_000


def _found(spark: SparkSession, folder: str | list[str], recursive: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if not recursive:
        # paths begin with a scheme, the folder may not
        own = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "", folder).strip("/")
        files = files.where(F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), r"^[a-z][a-z0-9+.-]*:/*", "") == own)
    return files.withColumns({"mtime": F.col("modificationTime").cast("double"), "reader": reader("path")}).where("reader is not null")


def scan(spark: SparkSession, folder: str | list[str], recursive: bool = True) -> DataFrame:
    """(path, sha256, mtime, length, reader, content) of the supported files below a folder, or of a list of files."""
    return _found(spark, folder, recursive).select("path", F.sha2("content", 256).alias("sha256"), "mtime", "length", "reader", "content")


def listed(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, mtime, length) of the supported files below a folder: no content is read."""
    return _found(spark, folder, recursive).select("path", "mtime", "length")


def changed(spark: SparkSession, folder: str, known: DataFrame, recursive: bool = True) -> DataFrame:
    """:func:`scan` of the files whose time or length isn't that of ``known`` (path, mtime, size): only they are read."""
    there = listed(spark, folder, recursive)
    own = known.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    same = (F.abs(F.col("mtime") - F.col("_mtime")) < 0.001) & (F.col("length") == F.col("_size"))
    new = there.join(own, "path", "left").where(~F.coalesce(same, F.lit(False))).select("path")
    some = [r["path"] for r in new.limit(MOST_PATHS + 1).collect()]
    if not some:
        return scan(spark, folder, recursive).limit(0)
    if len(some) <= MOST_PATHS:
        return scan(spark, some)
    return scan(spark, folder, recursive).join(new, "path", "left_semi")


#: Groups of an RTF file that hold no text of the document.
_RTF_ASIDE = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "themedata", "listtable", "listoverridetable", "rsidtbl", "generator", "xmlnstbl", "datastore", "latentstyles"}
_RTF_PART = re.compile(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)")


def rtf_text(raw: str) -> str:
    """Words of an RTF file: text outside of tables of settings, ``\\uN`` and ``\\'hh`` (in the code page of the file) decoded, white space collapsed."""
    page = next((f"cp{n}" for n in re.findall(r"\\ansicpg(\d+)", raw)[:1]), "cp1252")
    out: list[str] = []
    # of each open group: whether it is left out, and the stand-ins that follow a \uN
    groups, skip = [(False, 1)], 0
    for m in _RTF_PART.finditer(raw):
        code, byte, word, number, sign, brace, text = m.groups()
        aside, stand_ins = groups[-1]
        if brace == "{":
            groups.append(groups[-1])
        elif brace:
            groups[1:] = groups[1:-1]
        elif sign == "*" or word in _RTF_ASIDE:
            groups[-1] = (True, stand_ins)
        elif aside:
            continue
        elif code:
            out.append(chr(int(code) % 65536))
            skip = stand_ins
        elif byte:
            if skip:
                skip -= 1
            else:
                try:
                    out.append(bytes.fromhex(byte).decode(page, "replace"))
                except LookupError:
                    out.append(" ")
        elif word == "uc":
            groups[-1] = (aside, int(number or 1))
        elif word in ("par", "line", "tab", "cell", "row", "page", "sect"):
            out.append("\n")
        elif sign:
            out.append(sign if sign in "\\{}" else " " if sign in "~_\n\r" else "")
        elif text:
            out.append(text[skip:])
            skip = max(0, skip - len(text))
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return " ".join(joined.split())


def safe_name(name: str) -> str:
    """A file name without folders, of word characters, dots, hyphens and spaces only."""
    last = re.split(r"[/\\]", name)[-1]
    return re.sub(r"[^\w.\- ]+", "_", last).strip(" .") or "file"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def _table_rows(node: ElementTree.Element) -> Iterator[str]:
    for row in (x for x in node.iter() if _local(x.tag) == "tr"):
        cells = (" ".join(_texts(c).split()) for c in row if _local(c.tag) == "tc")
        yield " | ".join(c for c in cells if c)


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id -> the part of the package that it names, for one part."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    own = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read(path)) if x.get("TargetMode") != "External"}
    return {k: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}") for k, t in own.items()}


def _relation(node: ElementTree.Element) -> str | None:
    return next((v for k, v in node.items() if k.endswith("}id")), None)


def word_pages(content: bytes) -> list[str]:
    """One page: paragraphs, then table rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find("{*}body")
    out = [t for p in body if _local(p.tag) == "p" and (t := _texts(p).strip())]
    out += [r for t in body if _local(t.tag) == "tbl" for r in _table_rows(t) if r.strip(" |")]
    return ["\n".join(out)]


def excel_pages(content: bytes) -> list[str]:
    """A page for each sheet in the workbook's order: its name, then rows without blank cells. Sheets are found by their relations, or by number where a file has none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, related = set(z.namelist()), _related(z, "xl/workbook.xml")
        strings = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        out = []
        for k, sheet in enumerate((x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"), 1):
            part = related.get(_relation(sheet) or "", f"xl/worksheets/sheet{k}.xml")
            lines = [f"Sheet: {sheet.get('name')}"]
            for row in (x for x in ElementTree.fromstring(z.read(part)).iter() if _local(x.tag) == "row") if part in names and "/worksheets/" in part else ():
                cells = []
                for c in row:
                    value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                    value = strings[int(value)] if c.get("t") == "s" and value else _texts(c) if c.get("t") == "inlineStr" else value
                    if value.strip():
                        cells.append(value.strip())
                if cells:
                    lines.append(" | ".join(cells))
            out.append("\n".join(lines))
    return out


def _slides(z: zipfile.ZipFile) -> list[str]:
    """The slides in the order of the presentation, or of their numbers where a file names no order."""
    numbered = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
    if "ppt/presentation.xml" not in z.namelist():
        return numbered
    related = _related(z, "ppt/presentation.xml")
    ordered = [related.get(_relation(x) or "") for x in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(x.tag) == "sldId"]
    return [n for n in ordered if n in z.namelist()] or numbered


def slide_pages(content: bytes) -> list[str]:
    """A page for each slide: its place, paragraphs of its shapes, table rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out = []
        for k, name in enumerate(_slides(z), 1):
            root = ElementTree.fromstring(z.read(name))
            tables = [x for x in root.iter() if _local(x.tag) == "tbl"]
            inside = {id(p) for t in tables for p in t.iter()}
            lines = [t for p in root.iter() if _local(p.tag) == "p" and id(p) not in inside and (t := _texts(p).strip())]
            out.append("\n".join([f"Slide {k}", *lines, *(r for t in tables for r in _table_rows(t) if r.strip(" |"))]))
    return out


def text_pages(content: bytes) -> list[str]:
    """One page. Texts that aren't UTF-8 are read in the Arabic code page rather than with their letters dropped."""
    for name in ("utf-8-sig", "cp1256", "latin-1"):
        try:
            return [content.decode(name)]
        except UnicodeDecodeError:
            continue
    return [content.decode("latin-1")]


READERS: dict[str, Callable[[bytes], list[str]]] = {"text": text_pages, "rtf": lambda b: [rtf_text(text_pages(b)[0])], "word": word_pages, "excel": excel_pages, "slides": slide_pages}


def pages(files: DataFrame, readers: dict[str, Callable[[bytes], list]] | None = None) -> DataFrame:
    """(path, page, text, engine, words) of the files of :func:`scan`: a row for each page. A file that can't be read gives one empty page with the error's name as engine.

    A reader returns a text for each page, or the text and its words as dictionaries of ``BOXES``.
    """
    importable(files.sparkSession)
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["reader"], batch["content"], strict=True):
                if kind not in known:
                    out.append((path, 1, "", f"{kind}:no-reader", None))
                    continue
                try:
                    each = ((t, None) if isinstance(t, str) else t for t in known[kind](bytes(content)))
                    out += [(path, k, t, kind, words) for k, (t, words) in enumerate(each, 1)]
                except Exception as error:  # noqa: BLE001  a broken file is a result
                    out.append((path, 1, "", f"{kind}:error:{type(error).__name__}", None))
            yield pd.DataFrame(out, columns=["path", "page", "text", "engine", "words"])

    return files.select("path", "reader", "content").mapInPandas(run, PAGE)


def whole_texts(found: DataFrame) -> DataFrame:
    """(path, text, engine): the pages of each file in order, the engines as a sorted list."""
    rows = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), F.array_join(F.array_sort(F.collect_set("engine")), ", ").alias("engine"))
    return rows.select("path", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), "engine")
