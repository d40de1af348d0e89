"""Files and texts to sections with provenance: formats by extension, markdown and paragraph splits, pages, transcripts, office files, data URLs."""

from __future__ import annotations

import io
import json
import re
import tomllib
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import extension, normalized_pdf_text, trimmed

#: Which parser an extension has.
PARSERS = {
    "text": "txt log csv tsv json xml html htm css yaml yml toml ini cfg rs py js ts jsx tsx java c cpp h hpp go rb sh bat sql".split(),
    "markdown": ["md", "markdown"],
    "pdf": ["pdf"],
    "docx": ["docx"],
    "pptx": ["pptx"],
    "audio": "wav mp3 m4a ogg flac".split(),
}
#: Media types of extensions.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml",
    "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "json": "application/json", "xml": "application/xml",
    "wav": "audio/wav", "mp3": "audio/mpeg", "ogg": "audio/ogg", "flac": "audio/flac", "m4a": "audio/mp4", "mp4": "video/mp4",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
SECTIONS = "path string, section int, text string, metadata string, error string"


def parser_of(path: Column) -> Column:
    """text, markdown, pdf, docx, pptx, audio, or null for an unknown extension."""
    known = F.create_map(*[F.lit(x) for kind, exts in PARSERS.items() for e in exts for x in (e, kind)])
    return F.try_element_at(known, extension(path))


def data_url(path: Column, content: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.concat(F.lit("data:"), F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream")), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, section, text, metadata): blank-line separated paragraphs, trimmed; blank ones go before the rest is numbered from 1."""
    parts = F.filter(F.transform(F.split("text", "\n\n", -1), trimmed), lambda p: p != "")
    found = docs.select("doc_id", F.posexplode(parts).alias("section", "text"))
    return found.withColumn("metadata", F.concat(F.lit("paragraph:"), (F.col("section") + 1).cast("string")))


def markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, section, text, metadata): every line that starts with # begins a section named by it; blank sections go."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    heading = F.col("t").startswith("#")
    order = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("section", F.sum(heading.cast("int")).over(order)).withColumn("heading", F.when(heading, trimmed(F.regexp_replace("t", "^#+", ""))))
    by = lines.groupBy("doc_id", "section").agg(F.max("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("line", "t", heading.alias("own")))).alias("ls"))
    text = trimmed(F.array_join(F.transform(F.filter("ls", lambda x: ~x["own"]), lambda x: x["t"]), "\n"))
    return by.select("doc_id", F.col("section").cast("int").alias("section"), text.alias("text"), F.concat(F.lit("section:"), F.coalesce("heading", F.lit("intro"))).alias("metadata")).where("text <> ''")


def pages_of(docs: DataFrame) -> DataFrame:
    """Extracted page text by form feeds, numbered with their gaps; texts without one by paragraphs."""
    clean = docs.withColumn("text", normalized_pdf_text(F.col("text")))
    paged = clean.where(F.col("text").contains("\f")).select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("section", "text"))
    paged = paged.withColumn("text", trimmed(F.col("text"))).where("text <> ''").withColumn("metadata", F.concat(F.lit("page:"), (F.col("section") + 1).cast("string")))
    return paged.unionByName(paragraphs(clean.where(~F.col("text").contains("\f"))))


def transcript(segments: DataFrame) -> DataFrame:
    """(doc_id, section, text, metadata) of (doc_id, segments: array of text, start_ms, end_ms)."""
    found = segments.select("doc_id", F.posexplode("segments").alias("section", "s"))
    return found.select("doc_id", "section", F.col("s.text").alias("text"), F.concat(F.lit("audio:"), F.col("s.start_ms").cast("string"), F.lit("ms-"), F.col("s.end_ms").cast("string"), F.lit("ms")).alias("metadata"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(element: ElementTree.Element) -> str:
    return "".join(e.text or "" for e in element.iter() if _local(e.tag) == "t")


def _rows(element: ElementTree.Element) -> str:
    """A table's cells joined by tabs, rows by newlines."""
    return "\n".join("\t".join(" ".join(filter(None, (_texts(p).strip() for p in cell.iter() if _local(p.tag) == "p"))) for cell in row if _local(cell.tag) == "tc") for row in element.iter() if _local(row.tag) == "tr")


def docx_sections(data: bytes) -> list[tuple[str, str]]:
    """(text, metadata) of a word-processing file's paragraphs and tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    out, n = [], {"p": 0, "tbl": 0}
    for e in body:
        kind = _local(e.tag)
        text = _texts(e).strip() if kind == "p" else _rows(e) if kind == "tbl" else ""
        if text.strip():
            n[kind] += 1
            out.append((text, f"{'paragraph' if kind == 'p' else 'table'}:{n[kind]}"))
    return out


def pptx_sections(data: bytes) -> list[tuple[str, str]]:
    """(text, metadata) of a slide file: slides in numeric order, numbered by place; tables on their own."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for number, name in enumerate(names, 1):
            tree = ElementTree.fromstring(z.read(name))
            tables = [e for e in tree.iter() if _local(e.tag) == "tbl"]
            inside = {id(p) for t in tables for p in t.iter()}
            text = "\n".join(filter(None, (_texts(p).strip() for p in tree.iter() if _local(p.tag) == "p" and id(p) not in inside)))
            if text:
                out.append((text, f"slide:{number}"))
            out += [(_rows(t), f"slide:{number}:table:{k}") for k, t in enumerate(tables, 1) if _rows(t).strip()]
    return out


def sections(files: DataFrame) -> DataFrame:
    """Sections of ``files`` (path, content: what Spark's binaryFile source reads); a file that can't be parsed is a row with an error, the rest go on."""
    known = files.select("path", "content", parser_of(F.col("path")).alias("kind"))

    def of(path: str, content: bytes, kind: str | None) -> list[tuple]:
        try:
            if kind == "docx":
                found = docx_sections(content)
            elif kind == "pptx":
                found = pptx_sections(content)
            elif kind == "markdown":
                found, name, lines = [], "intro", []
                for line in [*content.decode(errors="replace").split("\n"), "#"]:
                    if line.startswith("#"):
                        if "\n".join(lines).strip():
                            found.append(("\n".join(lines).strip(), f"section:{name}"))
                        name, lines = line.lstrip("#").strip(), []
                    else:
                        lines.append(line)
            elif kind == "text":
                parts = [p.strip() for p in content.decode(errors="replace").split("\n\n") if p.strip()]
                found = [(p, f"paragraph:{k}") for k, p in enumerate(parts, 1)]
            elif kind == "audio":
                found = [("(transcription pending)", "audio:pending")]
            else:
                return [(path, None, None, None, "no parser for this kind of file")]
        except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
            return [(path, None, None, None, f"{type(e).__name__}: {e}")]
        return [(path, k, text, meta, None) for k, (text, meta) in enumerate(found)]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for f in frame.itertuples(index=False) for r in of(f.path, bytes(f.content), f.kind)]
            yield pd.DataFrame(rows, columns=["path", "section", "text", "metadata", "error"]).astype({"section": "Int32"})

    return known.mapInPandas(run, SECTIONS)


def folder(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a folder's own files (not its subfolders') that have a parser."""
    exts = ",".join(e for kind in PARSERS.values() for e in kind)
    return sections(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{exts}}}").load(path))


def configured(files: DataFrame, table: str = "models") -> DataFrame:
    """(path, id, name, settings, error): the entries of the ``table`` list of TOML and JSON configuration files (path, content: what Spark's binaryFile source reads).

    ``settings`` is an entry's JSON. A list alone is taken as the table. A file that can't be parsed is a row with an error, the rest go on.
    """

    def entries(path: str, content: bytes) -> list[tuple]:
        try:
            parsed = tomllib.loads(content.decode()) if path.lower().endswith(".toml") else json.loads(content)
            found = parsed if isinstance(parsed, list) else parsed.get(table, [])
            return [(path, e.get("id"), e.get("name"), json.dumps(e, sort_keys=True, default=str), None) for e in found]
        except (ValueError, AttributeError) as error:
            return [(path, None, None, None, str(error))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in entries(path, content)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "id", "name", "settings", "error"])

    wanted = files.select("path", "content").where(F.lower("path").rlike(r"\.(toml|json)$"))
    return wanted.mapInArrow(run, "path string, id string, name string, settings string, error string")
