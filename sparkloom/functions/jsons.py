"""JSON out of model answers: arrays and objects found and mended, dialogues, requirements in read-me texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<speaker: string, text: string>>"


def mended_array(raw: str | None) -> str | None:
    """The first array of a text; one that was cut off ends after its last whole object. None where there is none."""
    if not raw or (start := raw.find("[")) < 0:
        return None
    depth, quoted, escaped, last = 0, False, False, -1
    for i in range(start, len(raw)):
        c = raw[i]
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if c == "}" and depth == 1:
                last = i
            if depth == 0:
                body = raw[start:i].rstrip()
                return body.removesuffix(",") + "]"
    return raw[start : last + 1] + "]" if last >= 0 else None


@F.pandas_udf(T.StringType())
def array_of(raw: pd.Series) -> pd.Series:
    return raw.map(mended_array)


def dialogue(raw: Column, speaker_a: Column, voice_a: Column, voice_b: Column) -> Column:
    """array of (speaker, text, voice); null where a line lacks speaker or text."""
    turns = F.from_json(array_of(raw), TURNS)
    whole = ~F.exists(turns, lambda t: t["speaker"].isNull() | t["text"].isNull())
    voice = lambda t: F.when(t["speaker"] == speaker_a, voice_a).otherwise(voice_b)
    return F.when(whole, F.transform(turns, lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"), voice(t).alias("voice"))))


def object_of(raw: Column) -> Column:
    """The text itself if it starts with a brace, else a fenced block, else from the first brace to the last."""
    fenced, wide = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(F.trim(raw).startswith("{"), F.trim(raw)).when(fenced != "", fenced).when(wide != "", wide)


def least_ram_gb(readme: Column) -> Column:
    """The smallest amount of memory between 0 and 1024 GB that a text asks for."""
    found = F.regexp_extract_all(F.lower(readme), F.lit(r"(\d+(?:\.\d+)?)\s*(?:gb|gib)\s*(?:of\s+)?(?:ram|memory|vram)"), 1)
    return F.array_min(F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: (x > 0) & (x < 1024)))


def context_length(readme: Column) -> Column:
    """The largest context length that a text names, k counting 1024."""
    found = F.regexp_extract_all(F.lower(readme), F.lit(r"(\d+k?)[ -]*(?:tokens? )?context"), 1)
    return F.array_max(F.transform(found, lambda x: F.when(x.endswith("k"), F.regexp_replace(x, "k", "").cast("long") * 1024).otherwise(x.cast("long"))))


def embedding_request(texts: Column) -> Column:
    """Texts as the JSON array that an embedding server takes."""
    return F.to_json(texts)


def requested_texts(request: Column) -> Column:
    """The texts of such a request; what is no array of strings is one text."""
    found = F.from_json(request, "array<string>")
    return F.when(request.rlike(r"^\s*\[") & found.isNotNull(), found).otherwise(F.array(request))


def embeddings_of(response: Column) -> Column:
    """The vectors of an embedding server's answer, in the order in which they stand there; null without ``data``."""
    return F.transform(F.from_json(response, "data array<struct<embedding: array<float>, index: int>>")["data"], lambda d: d["embedding"])


#: A mind map: three levels of children below the root; deeper ones are cut off by the schema.
_NODE = "struct<label: string, title: string>"
for _ in range(3):
    _NODE = f"struct<label: string, title: string, children: array<{_NODE}>>"


def mind_map_rows(answer: Column, query: Column) -> Column:
    """array<struct<path, label>> of a mind map's JSON: the root's label is its title, or the query; blank labels are "Untitled"; null where the answer is no object."""
    named = lambda c: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("Untitled"))
    root = F.from_json(answer, _NODE)
    title = F.coalesce(*[F.when(F.trim(root[c]) != "", F.trim(root[c])) for c in ("label", "title")], F.trim(query))
    rows = F.array(F.struct(F.lit("0").alias("path"), title.alias("label")))

    def below(nodes: Column, depth: int) -> Column:
        own = F.transform(nodes, lambda n, i: F.struct(i.cast("string").alias("path"), named(n["label"]).alias("label")))
        if depth == 1:
            return own
        deeper = F.flatten(F.transform(nodes, lambda n, i: F.transform(F.coalesce(below(n["children"], depth - 1), F.array().cast("array<struct<path: string, label: string>>")), lambda c: F.struct(F.concat_ws(".", i.cast("string"), c["path"]).alias("path"), c["label"].alias("label")))))
        return F.concat(own, deeper)

    children = F.transform(F.coalesce(below(root["children"], 3), F.array().cast("array<struct<path: string, label: string>>")), lambda c: F.struct(F.concat(F.lit("0."), c["path"]).alias("path"), c["label"].alias("label")))
    return F.when(root.isNotNull() & answer.rlike(r"^\s*\{"), F.concat(rows, children))
