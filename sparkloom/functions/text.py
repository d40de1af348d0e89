"""Text functions as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_BYTES = 65_536


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalized_pdf_text(x: Column) -> Column:
    """Ligatures spelled out, soft hyphens and private-use bullets dropped, dashes, ellipses and no-break spaces made plain."""
    for ligature, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "..."}.items():
        x = F.replace(x, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(F.translate(x, " –—­", " --"), "[-]", "")


def page_label(metadata: Column, whole_paragraph: bool = True) -> Column:
    """"Page 3" of "page:3:...", likewise slides; paragraphs keep the rest (or its first field); others stay."""
    second = F.split_part(metadata, F.lit(":"), F.lit(2))
    rest = F.substr(metadata, F.lit(11))
    return (
        F.when(metadata.startswith("page:"), F.concat(F.lit("Page "), second))
        .when(metadata.startswith("slide:"), F.concat(F.lit("Slide "), second))
        .when(metadata.startswith("paragraph:"), F.concat(F.lit("Paragraph "), rest if whole_paragraph else second))
        .otherwise(metadata)
    )


def prefix_caption(x: Column, n: int = 400) -> Column:
    return F.left(x, F.lit(n))


def context_caption(page: Column, number: Column, half: int = 200) -> Column:
    """The middle of a page's text; a blank page says what it is."""
    start = F.greatest(F.floor(F.length(page) / 2) - half, F.lit(0)).cast("int")
    return F.when(trimmed(page) == "", F.format_string("(embedded media #%d)", number)).otherwise(trimmed(F.substr(page, start + 1, F.lit(2 * half))))


def prefix_of_bytes(x: Column, n: int) -> Column:
    """The first n bytes, less a character that they would cut in two."""
    head = F.substring(F.encode(x, "utf-8"), 1, n)
    whole = F.when(F.octet_length(x) <= n, x)
    tail_free = F.regexp_replace(F.decode(head, "iso-8859-1"), "(?s)(?:[À-ß]|[à-ï][\u0080-¿]?|[ð-÷][\u0080-¿]{0,2})$", "")
    return F.coalesce(whole, F.decode(F.encode(tail_free, "iso-8859-1"), "utf-8"))


def suffix_of_bytes(x: Column, n: int) -> Column:
    """The last n bytes, from the next whole character on."""
    tail = F.decode(F.substring(F.encode(x, "utf-8"), -n, n), "iso-8859-1")
    return F.when(F.octet_length(x) <= n, x).otherwise(F.decode(F.encode(F.regexp_replace(tail, "^[\u0080-¿]+", ""), "iso-8859-1"), "utf-8"))


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer the question from the context alone. Say so if the context does not hold the answer.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def session_title(x: Column, n: int = 32) -> Column:
    """The first words of a message on one line, at most n characters and an ellipsis."""
    line = F.regexp_replace(F.trim(x), "\n+", " ")
    return F.when(F.length(line) == 0, "New Chat").when(F.length(line) > n, F.concat(F.left(line, F.lit(n)), F.lit("…"))).otherwise(line)


def extension(path: Column) -> Column:
    """Lower-cased, or "unknown"."""
    found = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(found == "", "unknown").otherwise(found)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), -1)


def english_tokens(x: Column) -> Column:
    """Words (ASCII letters, digits, underscores, anything beyond ASCII) and single marks, between spaces."""
    return F.array_join(F.regexp_extract_all(x, F.lit(r"((?:[A-Za-z0-9_]|[^\x00-\x7F])+|[^\s])"), 1), " ")


def sentences(x: Column) -> Column:
    """Sentences with their marks, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"([^.!?]+[.!?]+|[^.!?]+$)"), 1), trimmed), lambda s: s != "")


def without_markup(x: Column) -> Column:
    """Tags, addresses of pages and of mail as spaces or nothing, white space collapsed."""
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"https?://\S+|www\.\S+", "")
    x = F.regexp_replace(x, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "")
    return collapsed(x)


def spelled_acronyms(x: Column) -> Column:
    """Capitals of 2 to 6 letters apart: "PDFs" to "P D F s"."""
    marked = F.split(F.regexp_replace(x, r"\b([A-Z]{2,6})(s?)\b", "\u0001$1\u0002$2\u0001"), "\u0001")
    spelled = lambda p: F.when(p.contains("\u0002"), F.trim(F.regexp_replace(F.replace(p, F.lit("\u0002"), F.lit("")), "(?<=.)(?=.)", " "))).otherwise(p)
    return F.array_join(F.transform(marked, spelled), "")


def detokenized(pieces: Column) -> Column:
    """Pieces with U+2581 for spaces joined; special ones in angle brackets dropped."""
    plain = F.filter(pieces, lambda p: ~(p.startswith("<") & p.endswith(">")))
    return F.trim(F.replace(F.array_join(plain, ""), F.lit("▁"), F.lit(" ")))


def slug(x: Column) -> Column:
    """Lower case, anything but letters, digits, - and _ as -, eight digits of a hash after."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9_-]", "-"), "^-+|-+$", ""), F.lit("-"), F.left(F.sha2(x, 256), F.lit(8)))


def human_size(n: Column, largest: str = "TB") -> Column:
    """Bytes in steps of 1024, in units up to ``largest``."""
    out, units = None, ("B", "KB", "MB", "GB", "TB")
    for power, unit in enumerate(units[: units.index(largest) + 1]):
        text = F.concat(F.format_number(n / 1024**power, 1), F.lit(" " + unit))
        out = F.when(n < 1024 ** (power + 1), text) if out is None else out.when(n < 1024 ** (power + 1), text)
    return out.otherwise(text)


def words(x: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1)


#: The lower-case form of each byte of a word, 0 for others.
_LETTERS = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalnum() else 0 for i in range(256))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words`` of an Arrow batch's texts: how many each has, and all of them in order. Nulls have none."""
    texts = pc.fill_null(texts, "")
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    read = bytes(memoryview(texts.buffers()[2])[edges[0] : edges[-1]])
    for letter, small in (("\u212a", "k"), ("\u0130", "i\u0307")):  # the two others that lower-case has an a-z for
        if letter.encode() in read:
            return words_of(pc.replace_substring(texts, letter, small))
    letters = np.frombuffer(read.translate(_LETTERS), np.uint8)
    edges = edges - edges[0]
    inside = letters != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    between = edges[(edges > 0) & (edges < len(letters))]  # words end with their text
    first[between], last[between - 1] = inside[between], inside[between - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int32)
    return np.diff(np.searchsorted(starts, edges)), pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.compress(inside, letters)))


#: Classes as a classifier names them.
CLASS_NAMES = {"NoRetrieval": "no_retrieval", "SimpleRAG": "simple_rag", "MultiDoc": "multi_doc", "Summarization": "summarization"}


def class_label(x: Column) -> Column:
    """A classifier's name of a class as the library writes it; others in lower case."""
    known = F.create_map(*[F.lit(v) for pair in CLASS_NAMES.items() for v in pair])
    return F.coalesce(known[x], F.lower(x))


def grade_payload(x: Column) -> Column:
    """struct(query, context) of "Query: ... Context: ...", trimmed; null where a part is missing or empty."""
    part = lambda k: trimmed(F.regexp_extract(trimmed(x), r"(?s)\AQuery:(.*?)Context:(.*)\z", k))
    return F.when((part(1) != "") & (part(2) != ""), F.struct(part(1).alias("query"), part(2).alias("context")))


def error_line(x: Column) -> Column:
    """From the first "main: error:", or else "error:", or else "ERROR:" to the line's end; without any, the first line that isn't empty."""
    found = [F.regexp_extract(x, rf"({mark}[^\r\n]*)", 1) for mark in ("main: error:", "error:", "ERROR:")]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.regexp_extract(x, r"([^\r\n]+)", 1))


def int_list(x: Column) -> Column:
    """The integers that a list begins with, between commas or white space, up to what is none."""
    head = F.regexp_extract(x, r"\A(\s*[+-]?\d+(?:[,\s]+[+-]?\d+|(?=[+-]\d)[+-]\d+)*)", 1)
    return F.transform(F.regexp_extract_all(head, F.lit(r"([+-]?\d+)"), 1), lambda n: n.cast("int"))


def key_values(x: Column, between: str = ":") -> Column:
    """A map of "key: value" lines, keys and values trimmed; lines without the mark are left out, the last of a key counts."""
    lines = F.filter(F.split(x, "\n"), lambda line: line.contains(between))
    pairs = F.transform(lines, lambda line: F.struct(trimmed(F.substring_index(line, between, 1)).alias("k"), trimmed(F.substring(line, F.instr(line, between) + len(between), F.length(line))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def table_cells(x: Column) -> Column:
    """Markdown whose table rows (lines between bars) have line breaks and bullets that a cell can hold."""
    row = lambda line: F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(?i)<br\s*/?>", "<br/>"), r"(\|\s*)-\s+", "$1• "), r"<br/>\s*-\s+", "<br/>• ")
    lines = F.split(x, "\n", -1)
    return F.array_join(F.transform(lines, lambda line: F.when(line.rlike(r"^\|.+\|$"), row(line)).otherwise(line)), "\n")
