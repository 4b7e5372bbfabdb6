"""Documents from files: text, DOCX and (where a reader is installed) PDF, one row a file, failures as rows of their own kind."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.scalars import blank, extension, line_count

SCHEMA = "path string, file_name string, extension string, size bigint, text string, encoding string, page_count int, metadata map<string,string>, warnings array<string>, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A reader takes a file's bytes to (text, encoding, pages, metadata, warnings).
Reading = tuple[str, str | None, int | None, dict[str, str], list[str]]
Reader = Callable[[bytes], Reading]


class Extractors:
    """The readers of files by extension: those for text, DOCX and PDF, or others that are registered."""

    def __init__(self, readers: dict[str, Reader] | None = None):
        self._kinds: dict[str, Reader] = {self.normalised(e): r for e, r in (READERS if readers is None else readers).items()}

    @staticmethod
    def normalised(ext: str) -> str:
        """With its dot and in small letters; refused if it is empty or holds a blank, a slash or another dot."""
        e = ext.strip().lower()
        e = e if e.startswith(".") else "." + e
        if not re.fullmatch(r"\.[^\s/\\.]+", e):
            raise ValueError(f"not an extension: {ext!r}")
        return e

    def register(self, ext: str, reader: Reader, replace: bool = False) -> None:
        e = self.normalised(ext)
        if not callable(reader):
            raise TypeError("a reader is a function of a file's bytes")
        if e in self._kinds and not replace:
            raise ValueError(f"{e} is registered")
        self._kinds[e] = reader

    def unregister(self, ext: str) -> None:
        del self._kinds[self.normalised(ext)]

    def get(self, ext: str) -> Reader | None:
        return self._kinds.get(self.normalised(ext))

    def __contains__(self, ext: str) -> bool:
        return self.get(ext) is not None

    def all(self) -> dict[str, Reader]:
        return dict(self._kinds)

    def extensions(self) -> list[str]:
        return sorted(self._kinds)

    def counts(self) -> tuple[int, int]:
        """(distinct readers, extensions)."""
        return len(set(self._kinds.values())), len(self._kinds)


def text_of(content: bytes) -> tuple[str, str]:
    """(text, encoding): the first of UTF-8, with its mark, Windows-1252 and Latin-1 that fits."""
    for name in ("utf-8-sig" if content[:3] == b"\xef\xbb\xbf" else "utf-8", "cp1252", "latin-1"):
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 fits all bytes")


def _paragraph(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out).strip()


def _table(t: ET.Element) -> str:
    rows = []
    for r in t.findall(W + "tr"):
        cells = [" ".join(filter(None, (_paragraph(p) for p in c.iter(W + "p")))) for c in r.findall(W + "tc")]
        if any(cells):
            rows.append("\t".join(cells))
    return "\n".join(rows)


def docx_of(content: bytes) -> tuple[str, dict[str, str], list[str]]:
    """(text, counts, warnings): paragraphs and tables in order, then headers and footers that differ, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        blocks, paragraphs, tables = [], 0, 0
        for x in body if body is not None else ():
            if x.tag == W + "p":
                paragraphs += 1
                blocks.append(_paragraph(x))
            elif x.tag == W + "tbl":
                tables += 1
                blocks.append(_table(x))
        for part in ("header", "footer"):
            seen: list[str] = []
            for n in sorted(n for n in names if re.fullmatch(rf"word/{part}\d*\.xml", n)):
                t = "\n".join(filter(None, (_paragraph(p) for p in ET.fromstring(z.read(n)).iter(W + "p"))))
                if t and t not in seen:
                    seen.append(t)
            blocks += seen
        images = sum(n.startswith("word/media/") for n in names)
    text = "\n\n".join(b for b in blocks if b)
    warnings = ([] if text else ["no text"]) + ([f"{images} images are not read"] if images else [])
    return text, {"extractor": "docx", "paragraphs": str(paragraphs), "tables": str(tables), "images": str(images)}, warnings


def pdf_of(content: bytes) -> tuple[str, int, dict[str, str], list[str]]:
    """(text, pages, metadata, warnings) of the text layer; needs ``pypdf``."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted and not reader.decrypt(""):
        raise ValueError("encrypted")
    pages = [(p.extract_text() or "").strip() for p in reader.pages]
    empty = [str(i + 1) for i, t in enumerate(pages) if not t]
    meta = {k.lstrip("/"): str(v) for k, v in (reader.metadata or {}).items() if str(v).strip()}
    warnings = ([] if pages else ["no pages"]) + ([f"pages without text: {', '.join(empty)}"] if empty else [])
    return "\n\n".join(p for p in pages if p), len(pages), meta | {"extractor": "pdf"}, warnings


def _txt(content: bytes) -> Reading:
    text, encoding = text_of(content)
    return text.replace("\r\n", "\n").replace("\r", "\n"), encoding, 1, {"extractor": "txt"}, []


def _docx(content: bytes) -> Reading:
    text, meta, warnings = docx_of(content)
    return text, None, None, meta, warnings


def _pdf(content: bytes) -> Reading:
    text, pages, meta, warnings = pdf_of(content)
    return text, None, pages, meta, warnings


READERS: dict[str, Reader] = {".txt": _txt, ".docx": _docx, ".pdf": _pdf}


def pasted(df: DataFrame, text: str = "text", name: str = "pasted-text.txt") -> DataFrame:
    """Texts given as such as documents: named, with their size in bytes, and an id made of their content; blank ones have an error."""
    t = F.col(text)
    return df.select(
        F.concat(F.lit("pasted:"), F.sha2(t, 256)).alias("path"), F.lit(name).alias("file_name"), F.lit(".txt").alias("extension"), F.octet_length(t).cast("bigint").alias("size"), t.alias("text"), F.lit("utf-8").alias("encoding"),
        F.lit(1).alias("page_count"), F.create_map(F.lit("extractor"), F.lit("text")).alias("metadata"), F.array().cast("array<string>").alias("warnings"), F.when(t.isNull() | blank(t), "empty document").alias("error"),
    )


def documents(spark: SparkSession, path: str, extractors: Extractors | None = None) -> DataFrame:
    """One row for each file below ``path``; ``error`` is null where it was read.

    Files without an extension, of an unknown kind, encrypted or broken come out with an error and no text. Files of no
    bytes don't come out: Spark's file source skips them.
    """
    readers = (extractors or Extractors()).all()
    src = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")
    src = src.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).withColumn("extension", extension(F.col("file_name")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                text = encoding = error = pages = None
                meta, warnings = {}, []
                try:
                    reader = readers.get(r.extension)
                    if not r.extension:
                        error = "no extension"
                    elif reader is None:
                        error = f"unsupported extension {r.extension}"
                    elif not r.size:
                        error = "empty file"
                    else:
                        text, encoding, pages, meta, warnings = reader(bytes(r.content))
                except Exception as e:  # a broken file is a row, not a failed job
                    error, text = f"{type(e).__name__}: {e}"[:300], None
                rows.append((r.path, r.file_name, r.extension, r.size, text, encoding, pages, meta, warnings, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return src.select("path", "size", "content", "file_name", "extension").mapInPandas(read, SCHEMA)


def contract(df: DataFrame) -> DataFrame:
    """Documents in their agreed form: trimmed names, blank values as null, blank warnings dropped, lines counted."""
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    count = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return df.select(
        "path", given(F.col("file_name")).alias("file_name"), extension(F.concat(F.lit("."), F.regexp_replace(F.trim("extension"), r"^\\.", ""))).alias("extension"), count("size").alias("size"), "text", F.lower(given(F.col("encoding"))).alias("encoding"), count("page_count").alias("page_count"), "metadata",
        F.filter(F.transform("warnings", lambda x: F.trim(x)), lambda x: x != "").alias("warnings"), line_count(F.col("text")).alias("line_count"), blank(F.col("text")).alias("is_empty"), (F.size("warnings") > 0).alias("has_warnings"), F.length("text").alias("character_count"), "error",
    )


def quarantined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with text that isn't blank, and all others with why."""
    bad = F.col("error").isNotNull() | F.col("text").isNull() | blank(F.col("text"))
    return df.where(~bad), df.where(bad).select("path", F.coalesce("error", F.lit("empty document")).alias("reason"))


def paths_checked(df: DataFrame, column: str = "path", extensions: list[str] | None = None) -> DataFrame:
    """``df`` with ``problem``: why a path can't be read by its name, or null: it is empty, or has no or an unknown extension."""
    p, known = F.trim(F.col(column)), extensions or Extractors().extensions()
    ext = extension(F.element_at(F.split(p, "/"), -1))
    return df.withColumn("problem", F.when(p.isNull() | (p == ""), "no path").when(ext == "", "no extension").when(~ext.isin(*known), F.concat(F.lit("unsupported extension "), ext)))


def with_document_facts(results: DataFrame, docs: DataFrame, key: str = "path") -> DataFrame:
    """Results of texts from files with the facts of their file: name, extension, size, encoding, pages, lines, signs, metadata and warnings."""
    facts = docs.select(key, *[F.col(c).alias(f"document_{c}") for c in ("file_name", "extension", "size", "encoding", "page_count", "line_count", "character_count", "is_empty", "has_warnings", "metadata", "warnings")])
    return results.join(facts, key, "left")
