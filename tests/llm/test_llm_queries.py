"""Registered queries against their SQL, or their contracts, over the whole smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from oracle import rows_of, sql_rows
from tokenizers import Tokenizer

from sparkloom.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_matches_sql(spark, sf, name):
    assert rows_of(q.QUERIES[name](spark, sf)) == sql_rows(q.SQL[name], sf)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(documents):
    known = Tokenizer.from_file(q.tokenizer_file())
    order = sorted(documents)
    found = known.encode_batch([documents[d]["text"] or "" for d in order], add_special_tokens=False)
    return {d: np.array([*f.ids, 1], "<u4") for d, f in zip(order, found, strict=True)}


def test_token_shards(spark, sf, ids):
    rows = {r["doc_id"]: r for r in q.op2_token_shards(spark, sf).collect()}
    assert set(rows) == set(ids)
    start = 0
    for d in sorted(ids):
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        start += len(ids[d])


def test_packing(spark, sf, ids):
    pieces, sequences = {}, {}
    for r in q.op10_packing(spark, sf).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in ids.items():
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at
            at += n
        assert at == len(own)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding <= 0.01 * total


def test_media(spark, sf, documents):
    for r in q.op3_media(spark, sf).collect():
        data = (documents[r["doc_id"]]["text"] or "").encode()
        payload = data.ljust(max(-(-len(data) // 64), 1) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(payload) + 44 and r["feature"].startswith("audio/wav;")


def test_language(spark, sf, documents):
    rows = q.op4_language(spark, sf).collect()
    assert len(rows) == len(documents) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held]) >= 0.97


def test_quality(spark, sf):
    folder = sf.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in q.op9_quality(spark, folder).collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.95


def test_main_text(spark, sf):
    from html import unescape

    rows = {r["page_id"]: r for r in q.op5_main_text(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["text"] == want and rows[p["page_id"]]["n_chars"] == len(want)


def test_token_counts(spark, sf, documents):
    from sparkloom.llm import wordpiece

    pieces = set(wordpiece.vocabulary(q.pieces_file()))
    known = {}

    def greedy(word):
        n, rest = 0, word
        while rest:
            k = next((k for k in range(min(len(rest), 40), 0, -1) if rest[:k] in pieces), 0)
            if not k:
                return 1
            n, rest = n + 1, rest[k:]
        return n

    for r in q.op7_token_counts(spark, sf).collect():
        words = (documents[r["doc_id"]]["text"] or "").split()
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(known.setdefault(w, greedy("▁" + w)) for w in words)


def test_substring_dedup(spark, sf, documents):
    """Against brute force: all pairs of lines by exact Jaccard, all shared runs, and where removed words are kept."""
    from sparkloom.llm import decontaminate, passages

    texts = {d: r["text"] or "" for d, r in documents.items()}
    words = {d: decontaminate.normalised(t) for d, t in texts.items()}
    lines, at = {}, {}
    for d, t in sorted(texts.items()):
        begin = 0
        for line in t.split("\n"):
            w = tuple(decontaminate.normalised(line))
            if len(w) >= 5:
                lines.setdefault(w, set()).add(d)
                at.setdefault(w, []).append((d, begin, begin + len(w)))
            begin += len(w)
    order, having = list(lines), {}
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} for w in order]
    for k, s in enumerate(sets):
        for g in s:
            having.setdefault(g, []).append(k)
    root = list(range(len(order)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, s in enumerate(sets):
        common = {}
        for g in s:
            for m in having[g]:
                common[m] = common.get(m, 0) + 1
        for m, n in common.items():
            if m != k and n >= 0.8 * (len(s) + len(sets[m]) - n):
                root[find(k)] = find(m)
    kept = {}
    for k, w in enumerate(order):
        kept[find(k)] = min(kept.get(find(k), 1 << 60), *lines[w])
    gone = {d: np.zeros(len(w), bool) for d, w in words.items()}
    lost = {d: np.zeros(len(w), bool) for d, w in words.items()}  # lines for which one merely alike is kept
    for k, w in enumerate(order):
        for d, a, b in at[w]:
            if d != kept[find(k)]:
                gone[d][a:b] = True
                lost[d][a:b] |= min(lines[w]) != kept[find(k)]
    rows = {r["doc_id"]: r for r in q.op8_substring_dedup(spark, sf).collect()}
    assert set(rows) == set(texts)
    cut = {d: np.zeros(len(w), bool) for d, w in words.items()}
    for d, r in rows.items():
        for x in r["removed"]:
            cut[d][x["start"] : x["end"]] = True
        assert r["n_removed"] == cut[d].sum() and r["repeated"] == (r["n_removed"] > 0)
    expected = sum(g.sum() for g in gone.values())
    assert expected > 500 and sum((gone[d] & cut[d]).sum() for d in gone) >= 0.99 * expected
    # What else goes is an exact run of 25 words or more of another document, and nothing goes that isn't kept.
    runs = {}
    for d, w in words.items():
        for p in range(len(w) - 24):
            runs.setdefault(tuple(w[p : p + 25]), set()).add(d)
    for d, w in words.items():
        shared = np.zeros(len(w), bool)
        for p in range(len(w) - 24):
            if len(runs[tuple(w[p : p + 25])]) > 1:
                shared[p : p + 25] = True
        assert not (cut[d] & ~gone[d] & ~shared).any()
    after = {d: [x for x, c in zip(w, cut[d], strict=True) if not c] for d, w in words.items()}
    assert {d: decontaminate.normalised(r["text"]) for d, r in ((r["doc_id"], r) for r in passages.rewritten(spark.read.parquet(f"{sf}/documents.parquet")).collect())} == after
    left = {}
    for w in after.values():
        for p in range(len(w)):
            left.setdefault(tuple(w[p : p + 5]), []).append((w, p))
    for d, w in words.items():
        p, pieces, n = 0, 0, 0
        wanted = cut[d] & ~lost[d]
        while p < len(w):
            if not wanted[p]:
                p += 1
                continue
            best = 1
            for u, k in left.get(tuple(w[p : p + 5]), []):
                m = 0
                while p + m < len(w) and k + m < len(u) and wanted[p + m] and u[k + m] == w[p + m]:
                    m += 1
                best = max(best, m)
            p, pieces, n = p + best, pieces + 1, n + best
        assert pieces <= 2 + n / 10, (d, pieces, n)
    long = {}
    for d, w in after.items():
        for p in range(len(w) - 49):
            long.setdefault(tuple(w[p : p + 50]), set()).add(d)
    assert not [1 for s in long.values() if len(s) > 1]
