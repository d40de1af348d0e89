"""Queries that have no SQL, against plain versions in memory over the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
from sparkloom.functions import models
from sparkloom.operators import raptor
from sparkloom.plans import registry
from sparkloom.sources.tables import table


def test_ivf_kmeans(spark, sf):
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect())
    x = np.array([v for _, v in rows], float)
    k = min(32, len(x))
    centres, now = x[: k * (len(x) // k) : len(x) // k].copy(), np.zeros(len(x), int)
    for _ in range(20):
        new = np.argmax(np.round(x @ centres.T, 6), axis=1)
        moved = (new != now).any()
        now = new
        if not moved:
            break
        for c in np.unique(now):
            centres[c] = np.round(x[now == c].mean(axis=0), 6)
    want = dict(zip(*np.unique(now, return_counts=True), strict=True))
    assert {r["cell"]: r["n"] for r in registry.QUERIES["ivf_kmeans"](spark, sf).collect()} == want


def plain_sentences(text):
    return [s for s in (m.strip() for m in re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", text or "")) if s]


def embedded(text):
    out = np.zeros(models.DIM, np.float32)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        out[h % models.DIM] += 1 if h >> 16 & 1 else -1
    size = float(np.linalg.norm(out))
    return out / size if size else out


def test_raptor_tree(spark, sf):
    want = set()
    for r in table(spark, sf, "documents").collect():
        level = [(i, t, embedded(t)) for i, t in enumerate((r["text"] or "").split("\n"))] if r["text"] is not None else []
        for depth in (1, 2):
            k = raptor.n_clusters(len(level))
            if k < 2:
                break
            labels, nodes = raptor.k_means(np.array([v for _, _, v in level], float), k), []
            for c in range(k):
                own = [x for x, label in zip(level, labels, strict=True) if label == c]
                if len(own) >= raptor.LEAST_MEMBERS:
                    summary = " ".join(" ".join(plain_sentences(t)[:2]) for _, t, _ in own)
                    n = len(summary.split())
                    confidence = -2.0 if n < 15 and "document" in summary else -0.5 if n > 30 else -1.0
                    nodes.append((depth * 1_000_000 + c, summary, embedded(summary)))
                    want.add((r["doc_id"], depth, depth * 1_000_000 + c, confidence, ",".join(str(i) for i, _, _ in own), hashlib.md5(summary.encode()).hexdigest()))
            level = nodes
    got = {tuple(r[c] for c in ("doc_id", "level", "id", "confidence", "children", "summary_md5")) for r in registry.QUERIES["raptor_tree"](spark, sf).collect()}
    assert got == want and len(want) > 10


def plain_speech_chunks(text, most):
    out = []
    for sentence in re.split(r"[.!?]+", text):
        sentence = sentence.strip(" ")
        if not sentence:
            continue
        parts = [sentence]
        if len(sentence.encode()) > most:
            parts = []
            for w in re.split(r"[ \t\n\x0b\f\r]+", sentence):
                if parts and len(f"{parts[-1]} {w}".encode()) <= most:
                    parts[-1] += f" {w}"
                else:
                    parts.append(w)
        out += [p if re.search("[.!?,;:]$", p) else f"{p}," for p in parts]
    return out


def test_speech_chunks(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    want = {}
    for i, text in docs.items():
        chunks = plain_speech_chunks(text, 100) if text is not None else []
        if chunks:
            want[i] = (len(chunks), max(len(c.encode()) for c in chunks))
    assert {r["doc_id"]: (r["n"], r["longest"]) for r in registry.QUERIES["speech_chunks"](spark, sf).collect()} == want
