"""Documents from files: txt, docx and pptx by the standard library, pdf by a plug-in.

Files are read by Spark's binaryFile source, one row each, and decoded in Arrow batches. What cannot
be read becomes a row with an error, never an empty text.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import cleaned, filled
from lectern.functions.urls import EXTENSIONS, MAX_FILE_BYTES, extension
from lectern.operators.batches import pieces

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SAMPLE_TEXT = "A sample document. It stands in where no file is given, so that a run without input shows every section."


def text_of_txt(raw: bytes) -> str:
    return raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def _runs(paragraph: ElementTree.Element, ns: str, breaks: dict[str, str]) -> str:
    marks = {f"{ns}{k}": v for k, v in breaks.items()}
    return "".join(e.text or "" if e.tag == f"{ns}t" else marks.get(e.tag, "") for e in paragraph.iter())


def text_of_docx(raw: bytes) -> str:
    """Paragraphs of the body first, then every table under its number, whatever their order was."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    read = lambda p: _runs(p, _W, {"tab": "\t", "br": "\n", "cr": "\n"})
    parts = [t for p in body.findall(f"{_W}p") if (t := read(p).strip())]
    for k, table in enumerate(body.findall(f"{_W}tbl"), 1):
        rows = []
        for row in table.findall(f"{_W}tr"):
            cells = ["\n".join(read(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")]
            if any(cells):
                rows.append(" | ".join(cells))
        if rows:
            parts.append(f"[Table {k}]\n" + "\n".join(rows))
    return "\n\n".join(parts)


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    try:
        tree = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    out = {}
    for rel in tree.findall(f"{_REL}Relationship"):
        steps = [] if rel.get("Target", "").startswith("/") else folder.split("/")
        for step in rel.get("Target", "").strip("/").split("/"):
            if step == "..":
                steps = steps[:-1]
            else:
                steps.append(step)
        out[rel.get("Id")] = "/".join(steps)
    return out


def _shape_texts(root: ElementTree.Element) -> list[str]:
    out = []
    for body in root.iter(f"{_P}txBody"):
        text = "\n".join(_runs(p, _A, {"br": "\n"}) for p in body.findall(f"{_A}p")).strip()
        if text:
            out.append(text)
    return out


def text_of_pptx(raw: bytes) -> str:
    """Slides in order, each with its shapes' texts and its notes; empty ones keep their number."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        deck = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        links = _related(z, "ppt/presentation.xml")
        parts = []
        for k, slide in enumerate(deck.iter(f"{_P}sldId"), 1):
            name = links[slide.get(f"{_R}id")]
            lines = _shape_texts(ElementTree.fromstring(z.read(name)))
            for target in _related(z, name).values():
                if "/notesSlide" in target:
                    notes = ElementTree.fromstring(z.read(target))
                    for shape in notes.iter(f"{_P}sp"):
                        kind = shape.find(f".//{_P}ph")
                        if kind is not None and kind.get("type") == "body" and (t := "\n".join(_shape_texts(shape))):
                            lines.append(f"[Notes] {t}")
            if lines:
                parts.append(f"[Slide {k}]\n" + "\n".join(lines))
    return "\n\n".join(parts)


def text_of_pdf(raw: bytes) -> str:
    """Pages joined by blank lines; needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("unsupported: reading pdf needs the package pypdf") from None
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages).strip()


EXTRACTORS: dict[str, Callable[[bytes], str]] = {".txt": text_of_txt, ".docx": text_of_docx, ".pptx": text_of_pptx, ".pdf": text_of_pdf}


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, ext, raw_text, error for rows of path, ext, content."""
    by = EXTRACTORS | (extractors or {})

    def one(ext: str, raw: bytes) -> tuple[str | None, str | None]:
        try:
            return by[ext](raw), None
        except Exception as e:  # whatever a broken file makes its reader raise is that row's error
            return None, f"could not read {ext}: {e}"

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            path, exts = rows.column("path"), rows.column("ext")
            got = [one(e, c.as_py()) for e, c in zip(exts.to_pylist(), rows.column("content"))]
            texts, errors = (pa.array([g[i] for g in got], path.type) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([path, exts, texts, errors], names=["path", "ext", "raw_text", "error"])

    return files.select("path", "ext", "content").mapInArrow(fn, "path string, ext string, raw_text string, error string")


def read_documents(spark: SparkSession, path: str, reject_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): path, source_filename, text, char_count; and path, error. Sizes and
    extensions are checked before any content is decoded. Spark's scan passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("ext", extension(F.col("path")))
    size_error = F.when(F.col("length") == 0, "empty file").when(F.col("length") > MAX_FILE_BYTES, "larger than 16 MiB")
    error = F.when(~F.col("ext").isin(*EXTENSIONS), F.concat(F.lit("unsupported file type "), F.col("ext"))).otherwise(size_error)
    checked = files.withColumn("refused", error)
    read = extracted(checked.where("refused IS NULL")).withColumn("text", cleaned(F.col("raw_text")))
    if reject_empty:
        read = read.withColumn("error", F.coalesce("error", F.when(F.col("text") == "", "no text in file")))
    good = read.where("error IS NULL").select("path", F.element_at(F.split("path", "/"), -1).alias("source_filename"), "text", F.length("text").alias("char_count"))
    bad = checked.where("refused IS NOT NULL").select("path", F.col("refused").alias("error")).unionByName(read.where("error IS NOT NULL").select("path", "error"))
    return good, bad


def or_sample(texts: DataFrame, column: str = "text") -> DataFrame:
    """Missing texts replaced by the built-in sample; empty ones are errors for the caller to reject."""
    return texts.withColumn(column, F.coalesce(column, F.lit(SAMPLE_TEXT))).withColumn("is_empty", F.btrim(filled(F.col(column))) == "")
