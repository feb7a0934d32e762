"""Sources: text tables, web pages, chats, office and PDF files as documents with text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: link targets that are themselves identifying.
LINK_PATTERN = r"(?i)^(mailto|tel):|[\w.+-]+@[\w-]+\.[\w.-]+|\d[\d\s().-]{7,}\d"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def from_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "text")


def from_conversations(table: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): a conversation is a document, a turn a page."""
    return table.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text")).where("text <> ''")


def from_html(pages: DataFrame) -> DataFrame:
    """(doc_id, text): visible text, scripts and tags taken out, a line for each block."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    broken = F.regexp_replace(body, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    text = F.regexp_replace(broken, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"))


def link_words(pages: DataFrame, only_identifying: bool = True) -> DataFrame:
    """(doc_id, pos, target, text): external link targets as words, ``mailto:`` and ``tel:`` cut off."""
    found = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "target"))
    found = found.where(F.col("target").rlike(LINK_PATTERN)) if only_identifying else found
    return found.select("doc_id", "pos", "target", F.regexp_replace("target", "(?i)^(mailto|tel):", "").alias("text"))


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, format, content): a file's id is the head of its content's hash. Formats other than
    pdf and docx raise an error when read."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = F.when(suffix.isin("pdf", "docx"), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path"))))
    return files.select(F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), "path", known.alias("format"), "content")


def _paragraphs(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs in reading order, those of table cells where the table stands."""
    for child in node:
        if child.tag == f"{WORD}p":
            yield child
        elif child.tag in (f"{WORD}tbl", f"{WORD}tr", f"{WORD}tc", f"{WORD}body", f"{WORD}sdt", f"{WORD}sdtContent"):
            yield from _paragraphs(child)


def docx_runs(content: bytes) -> list[tuple[int, int, str]]:
    """(paragraph, run, text) of the body and then of headers and footers, runs inside links too."""
    out, para = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = ["word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n))]
        for name in names:
            root = ElementTree.fromstring(z.read(name))
            body = root.find(f"{WORD}body")
            for p in _paragraphs(body if body is not None else root):
                for run, r in enumerate(p.iter(f"{WORD}r")):
                    out.append((para, run, "".join((t.text or "") if t.tag == f"{WORD}t" else "\t" for t in r if t.tag in (f"{WORD}t", f"{WORD}tab"))))
                para += 1
    return out


def docx_links(content: bytes) -> list[str]:
    """External link targets that are identifying."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/_rels/document.xml.rels" not in z.namelist():
            return []
        relations = ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
    targets = [r.get("Target", "") for r in relations if r.get("TargetMode") == "External"]
    return [re.sub("(?i)^(mailto|tel):", "", t) for t in targets if re.search(LINK_PATTERN.removeprefix("(?i)"), t, re.I)]


def write_docx(content: bytes, replacements: dict[int, list[tuple[int, int, str]]], links: dict[str, str] | None = None) -> bytes:
    """The file with (start, end, text) edits of its paragraphs' joined runs. An edit that crosses runs goes
    to the first; the others lose what it covers. Author fields are cleared."""
    out = io.BytesIO()
    para = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        names = z.namelist()
        order = ["word/document.xml", *sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))]
        for name in [*order, *(n for n in names if n not in order)]:
            data = z.read(name)
            if name in order:
                root = ElementTree.fromstring(data)
                body = root.find(f"{WORD}body")
                for p in _paragraphs(body if body is not None else root):
                    texts = list(p.iter(f"{WORD}t"))
                    for start, end, text in sorted(replacements.get(para, []), reverse=True):
                        at, placed = 0, False
                        for t in texts:
                            size = len(t.text or "")
                            lo, hi = max(start - at, 0), min(end - at, size)
                            if lo < hi:
                                t.text = t.text[:lo] + ("" if placed else text) + t.text[hi:]
                                placed = True
                            at += size
                    para += 1
                data = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
            elif name.endswith(".rels"):
                text = data.decode("utf-8")
                for old, fake in (links or {}).items():
                    text = text.replace(old, fake)
                data = text.encode()
            elif name == "docProps/core.xml":
                data = re.sub(rb"(<(dc:creator|cp:lastModifiedBy|dc:title|dc:subject|cp:keywords)[^>]*>)[^<]*(</)", rb"\1\3", data)
            new.writestr(name, data)
    return out.getvalue()


WORDS_DDL = (
    "doc_id string, page_no int, word_id int, text string, source string, block int, line int, para int, run int, at int, link string, x0 double, y0 double, x1 double, y1 double"
)


def docx_file_words(content: bytes, per_page: int) -> Iterator[tuple]:
    """(page_no, word_id, text, block, line, para, run, at, link) of a file's words. ``line`` counts the
    paragraph's tokens: pieces of one token, cut by a change of format, share it. ``at``: the first
    character's place in the paragraph's text. Identifying targets of links stand behind the last paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = ["word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n))]
        roots = [ElementTree.fromstring(z.read(n)) for n in names]
    para, ids = -1, {}

    def row(text: str, token: int, run: int, at: int, link: str | None = None) -> tuple:
        page = para // per_page + 1
        ids[page] = ids.get(page, -1) + 1
        return page, ids[page], text, para, token, para, run, at, link

    for root in roots:
        body = root.find(f"{WORD}body")
        for para, p in enumerate(_paragraphs(body if body is not None else root), para + 1):
            token, at, apart = -1, 0, True
            for run, r in enumerate(p.iter(f"{WORD}r")):
                for t in r:
                    if t.tag != f"{WORD}t":
                        apart = apart or t.tag in (f"{WORD}tab", f"{WORD}br")
                        continue
                    text = t.text or ""
                    for m in re.finditer(r"\S+", text):
                        token += apart or m.start() > 0
                        apart = False
                        yield row(m.group(), token, run, at + m.start())
                    apart = text[-1].isspace() if text else apart
                    at += len(text)
    for target in docx_links(content):
        para += 1
        yield row(target, 0, 0, 0, target)


def docx_words(files: DataFrame, per_page: int = 50) -> DataFrame:
    """A words table (``geometry`` says of what kind) of DOCX files, with ``run``, ``at`` and ``link``. A file
    that cannot be read has no words."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, content in frame[["doc_id", "content"]].itertuples(index=False):
                try:
                    rows += [(doc_id, page, word, text, "link" if link else "native", block, line, para, run_, at, link, *[None] * 4) for page, word, text, block, line, para, run_, at, link in docx_file_words(bytes(content), per_page)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS_DDL.split(", ")]).astype(dict.fromkeys(("x0", "y0", "x1", "y1"), "float64"))

    return files.where("format = 'docx'").select("doc_id", "content").mapInPandas(run, WORDS_DDL)


def docx_images(content: bytes) -> list[tuple[str, int, float, float]]:
    """(relation, paragraph, width, height) of embedded pictures, in points; 12,700 units are one."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for para, p in enumerate(_paragraphs(root.find(f"{WORD}body"))):
        for drawing in p.iter(f"{WORD}drawing"):
            size = next((e for e in drawing.iter() if e.tag.endswith("}extent")), None)
            width, height = (int(size.get(k, 0)) / 12700 if size is not None else 0.0 for k in ("cx", "cy"))
            out += [(e.get(f"{RELATION}embed"), para, width, height) for e in drawing.iter() if e.tag.endswith("}blip") and e.get(f"{RELATION}embed")]
    return out


def ocr_words(images: DataFrame, load: Callable[[], Callable[[bytes], list]], least_score: float = 0.5) -> DataFrame:
    """One word a line of text that an injected engine reads: (doc_id, page_no, image_no, line, text, score, x0,
    y0, x1, y1). ``images``: doc_id, page_no, image_no, png, and the image's box on the page, x0..y1, or
    nulls; boxes of lines are in page points then, else in pixels. Blank lines, and those of a lower score,
    are left out. The engine gives (four corners, text, score) for each line, or None."""

    def run(frames):
        read = load()
        for frame in frames:
            rows = []
            for doc_id, page_no, image_no, png, *box in frame[["doc_id", "page_no", "image_no", "png", "x0", "y0", "x1", "y1"]].itertuples(index=False):
                wide, high = int.from_bytes(png[16:20], "big"), int.from_bytes(png[20:24], "big")  # the PNG header's size
                sx, sy, left, top = (1.0, 1.0, 0.0, 0.0) if pd.isna(box[0]) else ((box[2] - box[0]) / wide, (box[3] - box[1]) / high, box[0], box[1])
                for line, (corners, text, score) in enumerate(read(bytes(png)) or []):
                    xs, ys = zip(*corners)
                    rows.append((doc_id, page_no, image_no, line, text.strip(), float(score), left + min(xs) * sx, top + min(ys) * sy, left + max(xs) * sx, top + max(ys) * sy))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "image_no", "line", "text", "score", "x0", "y0", "x1", "y1"])

    id_type = images.schema["doc_id"].dataType.simpleString()
    found = images.select("doc_id", "page_no", "image_no", "png", "x0", "y0", "x1", "y1").mapInPandas(run, f"doc_id {id_type}, page_no int, image_no int, line int, text string, score double, x0 double, y0 double, x1 double, y1 double")
    return found.where((F.col("text") != "") & (F.col("score") >= least_score))


def covering_boxes(words: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, page_no, entity_id, surrogate, x0..y1): for each mention in words with boxes the box around
    them all, what an image writer paints over."""
    spot = words.where("x0 is not null").select("doc_id", "page_no", "word_id", "x0", "y0", "x1", "y1")
    met = mentions.join(spot, ["doc_id", "page_no"]).where(F.col("word_id").between(F.col("w0"), F.col("w1")))
    return met.groupBy("doc_id", "page_no", "start", "entity_id", "surrogate").agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1"))).drop("start")


def parse_docx(files: DataFrame) -> DataFrame:
    """(doc_id, text): a line for each paragraph. A file that cannot be read gives a null text."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, content in frame[["doc_id", "content"]].itertuples(index=False):
                try:
                    lines: dict[int, list[str]] = {}
                    for para, _, text in docx_runs(bytes(content)):
                        lines.setdefault(para, []).append(text)
                    last = max(lines, default=-1)
                    rows.append((doc_id, "\n".join("".join(lines.get(i, [])) for i in range(last + 1))))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((doc_id, None))
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    return files.where("format = 'docx'").select("doc_id", "content").mapInPandas(run, "doc_id string, text string")


def parse_with(files: DataFrame, load: Callable[[], Callable[[bytes], list[tuple[int, str]]]]) -> DataFrame:
    """(doc_id, page_no, text) by an injected parser: PDF text, OCR. ``load`` runs once in each worker and
    returns a function from a file's bytes to (page, text) pairs."""

    def run(frames):
        parse = load()
        for frame in frames:
            rows = [(doc_id, page, text) for doc_id, content in frame[["doc_id", "content"]].itertuples(index=False) for page, text in parse(bytes(content))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_no int, text string")


def pdf_parser() -> Callable[[bytes], list[tuple[int, str]]]:
    """Page texts by an optional PDF library; raises ImportError where it is not installed."""
    import pymupdf

    def parse(content: bytes) -> list[tuple[int, str]]:
        with pymupdf.open(stream=content, filetype="pdf") as pdf:
            return [(i + 1, p.get_text()) for i, p in enumerate(pdf)]

    return parse


def types_table(spark: SparkSession, settings) -> DataFrame:
    """The enabled identifier types as a small table."""
    rows = [(t.name, list(t.regex), t.validator, list(t.context_words), t.structured, t.min_chars, t.policy) for t in settings.enabled()]
    return spark.createDataFrame(rows, "name string, regex array<string>, validator string, context_words array<string>, structured boolean, min_chars int, policy string")
