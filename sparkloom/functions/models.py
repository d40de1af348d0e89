"""Slots for models, by task: replaceable functions from columns to a column, with plain deterministic defaults."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import words

DIM = 64


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """Signed feature hashing of words, unit length; zeros for no words."""

    def of(text: str | None) -> np.ndarray:
        out = np.zeros(DIM, np.float32)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            out[h % DIM] += 1 if h >> 16 & 1 else -1
        size = float(np.linalg.norm(out))
        return out / size if size else out

    return texts.map(of)


def overlap_grade(query: Column, passage: Column) -> Column:
    """The share of a query's distinct words that the passage has."""
    q = F.array_distinct(words(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(passage))) / F.size(q))


def question_class(query: Column) -> Column:
    """struct(label, confidence) by plain cues."""
    low = F.lower(query)
    label = F.when(low.rlike(r"summar|overview|main points"), "summarization").when(low.rlike(r"compare|difference|both"), "multi_doc").when(low.rlike(r"^\s*(hi|hello|thanks)\b"), "no_retrieval").otherwise("simple_rag")
    return F.struct(label.alias("label"), F.when(label == "simple_rag", 0.5).otherwise(0.95).alias("confidence"))


def needs_retrieval(label: Column, confidence: Column, n_documents: Column) -> Column:
    """No documents, or a sure no_retrieval: no; unsure answers count as simple_rag."""
    return (n_documents > 0) & ~((F.when(confidence < 0.5, "simple_rag").otherwise(label) == "no_retrieval") & (confidence > 0.9))


def label_in(answer: Column) -> Column:
    """The class that a free answer names."""
    low = F.lower(answer)
    return F.when(low.contains("no_retrieval"), "no_retrieval").when(low.contains("summarization"), "summarization").when(low.contains("multi_doc"), "multi_doc").otherwise("simple_rag")


def first_sentences(text: Column, n: int = 2) -> Column:
    from sparkloom.functions.text import sentences

    return F.array_join(F.slice(sentences(text), 1, n), " ")


def rephrasings(answer: Column, n: int = 3) -> Column:
    """The first n lines of an answer, without numbers in front."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda s: F.trim(s)), lambda x: x != "")
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^\d+[.):]?\s*(?=.)", "")), 1, n)


def alternating_script(context: Column, turns: Column) -> Column:
    """JSON lines of two speakers, A and B, who say a text's first sentences in turn."""
    from sparkloom.functions.text import sentences

    said = F.transform(F.slice(sentences(context), F.lit(1), turns), lambda s, i: F.struct(F.when(i % 2 == 0, "A").otherwise("B").alias("speaker"), s.alias("text")))
    return F.to_json(said)


def tone(text: Column, voice: Column) -> Column:
    """A steady tone of a tenth of a second a word, lower for the first voice."""
    from sparkloom.functions.audio import RATE

    step = F.when(voice == "a", 2 * np.pi * 110 / RATE).otherwise(2 * np.pi * 165 / RATE)
    samples = F.size(words(text)) * (RATE // 10)
    return F.when(samples == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), samples - 1), lambda i: 0.3 * F.sin(i * step)))


def as_it_is(query: Column) -> Column:
    """No model: the question itself."""
    return query


#: Task name to function; programs put their own models here.
TASKS: dict[str, Callable[..., Column]] = {"embed": hashed_embedding, "grade": overlap_grade, "classify": question_class, "summarize": first_sentences, "hyde": as_it_is, "rephrase": as_it_is, "enrich": first_sentences, "podcast": alternating_script, "tts": tone}


def run(task: str, *columns: Column) -> Column:
    return TASKS[task](*columns)
