"""Spelling variants, conversation repair and exact search on nulls, empty and long inputs, ties, repeated rows, empty tables and clashing columns, against brute force."""

import functools
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, html, kdtree, media, repair, spelling

# ---- spelling


def damaged_counts(docs, damage):
    counts = Counter()
    for key, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if damage and h % damage == 0 else run] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(x, key=lambda v: (-counts[v], v), default=None) for w, x in near.items()}
    form = {w: v if v is not None and counts[v] >= 2 * counts[w] else None for w, v in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def spelled(spark, docs, block=spelling.BLOCK, damage=97):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "gram", "size", "key", "near", "form")})
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(spelling.word_counts(df, damage=damage), block=block).collect()}


@pytest.fixture(scope="module")
def misspelt():
    r = random.Random(3)
    words = ["".join(r.choice("abeinrstéÀ÷ÿ") for _ in range(r.randint(4, 9))) for _ in range(60)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "zzzzzy" * 30, "zzzzzy" * 29 + "zzzzzx", "zzzzzy" * 30 + "q", "q" + "zzzzzy" * 30]
    docs = []
    for i in range(400):
        own = [r.choice(words) for _ in range(30)]
        for k in range(len(own)):
            if r.random() < 0.3:
                w, p = own[k], r.randrange(len(own[k]))
                own[k] = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("abeé") + w[p:], w[:p] + r.choice("abeé") + w[p + 1 :]])
        docs.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in own) + "Ātail 中word 12x_y"))
    return [*docs, (None, docs[0][1]), (7, None), (8, ""), (9, docs[9][1]), (9, docs[9][1])]


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_variants(spark, misspelt, block):
    assert spelled(spark, misspelt, block) == grouped(damaged_counts(misspelt, 97))


def test_variants_without_damage_and_of_long_text(spark):
    text = "colour " * 200_000 + "color " * 5 + "colours " * 100_000 + "colr " * 3
    assert spelled(spark, [(1, text)], damage=None) == grouped(damaged_counts([(1, text)], None))


def test_no_words(spark):
    assert spelled(spark, []) == set() == spelled(spark, [(1, None), (2, "a b c"), (3, "rare words here")])


# ---- repair

SPACES = " \t\n\x0b\x0c\r"
ROLES = ["system", "user", "assistant", "tool", "uploader", "", None]
TEXTS = ["Hello.", "Why?", "cut off", "", "  \n", " ", "ok! ", "Hello.", None, "end.\x0b", "no stop\t"]


def cheapest(rows):
    """(cost, audit, lines) by trying everything, a row at a time."""
    gone, cut, seen = [], [], set()
    for role, text in rows:
        blank, last = not text.strip(SPACES), text.rstrip(SPACES)[-1:]
        gone.append(blank or (role, text) in seen)
        cut.append(not gone[-1] and last not in ".!?")
        seen.add((role, text))
    onward = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def rest(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            to = onward[last][-1]
            cost, audit, lines = rest(i, to, inserted + 1)
            options.append((cost + 3, "I" + audit, ({"u": "user:", "a": "assistant:"}[to], *lines)))
        if i < len(rows):
            cost, audit, lines = rest(i + 1, last, 0)
            options.append((cost + 4, "D" + audit, lines))
            role, text = rows[i]
            if not gone[i]:
                if role[:1] and role[:1] in onward[last]:
                    cost, audit, lines = rest(i + 1, role[:1], 0)
                    options.append((cost + 3 * cut[i], "K" + audit, (f"{role}:{text}", *lines)))
                to = onward[last][-1]
                cost, audit, lines = rest(i + 1, to, 0)
                options.append((cost + 3 + 3 * cut[i], "R" + audit, ({"u": "user:", "a": "assistant:"}[to] + text, *lines)))
        return min(options, default=(10**9, "", ()))

    return rest(0, "", 0)


def expected(rows):
    """The report on (turn, role, text) rows of a conversation."""
    rows = sorted(((t, r or (" " if r is None else ""), " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    cost, audit, lines = cheapest([r[1:] for r in rows])
    seen, faults = set(), Counter()
    for _, role, text in rows:
        if not text.strip(SPACES):
            faults["blank"] += 1
        elif (role, text) in seen:
            faults["duplicate"] += 1
        elif text.rstrip(SPACES)[-1] not in ".!?":
            faults["truncated"] += 1
        seen.add((role, text))
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(spark, rows, damage=False, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "id", "pos", "seg", "state", "present", "how", "audit")})
    return {r["conv_id"]: tuple(r[c] for c in REPORT) for r in repair.report(repair.messages(df, damage=damage), **how).collect()}


@pytest.fixture(scope="module")
def talks():
    r, rows = random.Random(8), []
    for conv in [None, *range(250)]:
        for _ in range(r.randint(1, 9)):
            rows.append((conv, r.choice([None, r.randint(0, 12)]), r.choice(ROLES if r.random() < 0.5 else ROLES[:3]), r.choice(TEXTS) if r.random() < 0.6 else f"text {r.randint(0, 99)}."))
    return rows


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(None if conv is None else str(conv), []).append(tuple(row))
    return out


@pytest.mark.parametrize("how", [{}, {"most_rows": 2, "segment": 2}, {"most_chars": 20, "segment": 3}])
def test_repair(spark, talks, how):
    assert reported(spark, talks, **how) == {conv: expected(rows) for conv, rows in by_conversation(talks).items()}


def test_damage(spark, talks):
    want = {}
    for conv, rows in by_conversation(talks).items():
        kept = []
        for turn, role, text in rows:
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = " " if text is None else text
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        want[conv] = expected(kept)
    assert reported(spark, talks, True) == want == reported(spark, talks, True, most_rows=1, segment=2)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()


def test_long_conversations(spark):
    r = random.Random(1)
    rows = [(5, t, r.choice(["user", "assistant", "assistant"]), f"text {t}" + r.choice([".", "", "."])) for t in range(3_000)]
    rows += [(5, 3_001, "user", "x" * 300_000), (6, 0, "user", "y" * 2_000_000 + "."), (7, 1, "user", "same."), (7, 1, "user", "same."), (7, 1, "user", "same.")]
    want = {conv: expected(own) for conv, own in by_conversation(r for r in rows if r[0] != 5).items()}
    found = reported(spark, rows)
    assert {k: v for k, v in found.items() if k != "5"} == want
    assert found == reported(spark, rows, most_rows=100, segment=97) == reported(spark, rows, most_rows=10_000)


def test_no_conversations(spark):
    assert reported(spark, []) == {} == reported(spark, [], True)


def test_search_is_exact():
    r = random.Random(2)
    for _ in range(300):
        rows = [(r.choice(["system", "user", "assistant", "x"]), r.choice(["a", "b.", "c.", f"{r.random()}."])) for _ in range(r.randint(0, 8))]
        seen, gone, cut = set(), [], []
        for row in rows:
            gone.append(row in seen)
            cut.append(row not in seen and not row[1].endswith("."))
            seen.add(row)
        assert next(iter(repair.search([x[0][:1] for x in rows], gone, cut).values())) == cheapest(rows)[:2]


# ---- search


def nearest(rows, k=20, every=20):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(64 * x) for x in v)

    known = [(i, [int(np.floor(64 * float(x))) for x in v], n) for n, (i, v) in enumerate(rows) if fine(v)]
    out = []
    for i, v, n in known:
        if i is not None and i % every == 0:
            scores = [(max(-kdtree.LARGEST, min(kdtree.LARGEST, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w, m in known if m != n and len(w) == len(v)]
            scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, parts=3, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(parts).withColumns({c: F.lit(1) for c in ("id", "shard", "rank", "dim", "score", "query_id")})
    return sorted((tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in kdtree.topk(df, 20, F.col("vec_id") % 20 == 0, **how).collect()), key=str)


def floats(v):
    return np.asarray(v, np.float32).tolist()


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    rows = [(i, floats(r.normal(0, 0.2, 6))) for i in range(700)]
    rows += [(i, floats([0.5] * 6)) for i in range(700, 900)]  # ties
    rows += [(900 + i, floats(r.normal(0, 1, 3))) for i in range(30)] + [(940, []), (941, []), (960, [])]
    rows += [(980, None), (1000, [None] * 6), (1001, [0.1, float("nan"), 0.1, 0.1, 0.1, 0.1]), (1020, [float("inf")] * 6), (None, [2.0] * 6), (None, [2.0] * 6), (20, rows[20][1]), (20, [1.0] * 6), (21, [1.0] * 6)]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard": 40}, {"shard": 1}])
def test_topk(spark, vectors, how, monkeypatch):
    rows = vectors if how.get("shard") != 1 else vectors[-80:]
    if how:
        monkeypatch.setattr(kdtree, "GROUP_NUMBERS", 700)
        monkeypatch.setattr(kdtree, "BLOCK_NUMBERS", 60)
    assert searched(spark, rows, **how) == nearest(rows)


def test_topk_of_large_numbers(spark):
    rows = [(i, [10.0 ** (i % 30), -(10.0 ** (i % 7)), 1.0]) for i in range(60)] + [(100, [1e308, 0.0, 0.0]), (120, [1e300, 1e300, 1.0])]
    assert searched(spark, rows, kind="double", shard=16) == nearest(rows)


def test_topk_of_nothing(spark):
    assert searched(spark, []) == [] == searched(spark, [(1, [1.0]), (2, [2.0])])
    assert searched(spark, [(0, [1.0])]) == []


def test_trees_leave_boxes_out():
    r = np.random.default_rng(1)
    centres = r.normal(0, 40, (20, 8))
    vectors = np.floor(np.repeat(centres, 200, axis=0) + r.normal(0, 1, (4000, 8)))
    tree, order = kdtree.build(vectors)
    held, best = vectors[order], kdtree.Best(10, 5)
    compared = sum(kdtree.search(tree, held, np.arange(4000)[order], np.full(4000, 2, np.int8), centres[q : q + 1], best, np.array([q])) for q in range(10))
    leaves = int((tree.spans[:, 2] == 0).sum())
    assert compared < 10 * leaves / 3
    for at, (low, high, (first, last, _, _)) in enumerate(zip(*tree, strict=True)):
        assert (held[first:last].min(axis=0) == low).all() and (held[first:last].max(axis=0) == high).all(), at
    for q in range(10):
        scores = vectors @ centres[q]
        assert best.scores[q].tolist() == sorted(scores.astype(np.int64).tolist(), reverse=True)[:5]


# ---- media and column names


def riff(form, *chunks, size=None):
    body = form + b"".join(kind + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1) for kind, data in chunks)
    return b"RIFF" + (len(body) if size is None else size).to_bytes(4, "little") + body


FMT = (b"fmt ", bytes([1, 0, 1, 0, 64, 31, 0, 0, 64, 31, 0, 0, 1, 0, 8, 0]))


def walked(d):
    """RIFF files found by walking every header on its own."""
    out = []
    for at in range(len(d)):
        if d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
            continue
        chunks, form = media.riff_chunks(d, at), d[at + 8 : at + 12]
        if chunks is None:
            continue
        if form == b"WAVE":
            place, n = chunks.get(b"fmt ", (0, 0))
            if b"data" not in chunks or n < 16:
                continue
            channels, rate, align, bits = int.from_bytes(d[place + 2 : place + 4], "little"), int.from_bytes(d[place + 4 : place + 8], "little"), int.from_bytes(d[place + 12 : place + 14], "little"), int.from_bytes(d[place + 14 : place + 16], "little")
            if not channels or not rate or align != channels * ((bits + 7) // 8):
                continue
        elif not set(chunks) & ({b"VP8 ", b"VP8L", b"VP8X"} if form == b"WEBP" else {b"LIST"}):
            continue
        out.append((at, 8 + int.from_bytes(d[at + 4 : at + 8], "little")))
    return out


def found_riff(d):
    return [(f.offset, f.length) for f in media.find_media(d) if f.mime in ("audio/wav", "image/webp", "video/x-msvideo")]


def test_riff_as_by_single_walks():
    r = random.Random(6)
    cases = [riff(b"WAVE", FMT, (b"data", b"abc")), riff(b"WAVE", FMT, (b"data", b"abc"))[:-1], riff(b"WEBP", (b"VP8 ", b"x" * 9)), riff(b"AVI ", (b"LIST", b"")), riff(b"WAVE"), riff(b"WAVE", (b"data", b"")), riff(b"WAVE", FMT, (b"data", b"abc"), size=47)]
    for _ in range(400):
        inner = r.choice(cases)
        parts = [r.choice(cases), r.choice([b"", b"ab", b"RIFF"]), riff(b"WAVE", FMT, (b"data", inner + r.choice([b"", b"z"])), size=r.choice([None, None, 20, 60])), r.choice(cases)]
        r.shuffle(parts)
        d = bytearray(b"".join(parts))
        for _ in range(r.choice([0, 0, 1, 3])):
            d[r.randrange(len(d))] = r.choice([0, 1, 8, 9, 16, 255])
        assert found_riff(bytes(d)) == walked(bytes(d))


def test_riff_in_linear_time():
    """Headers hidden in each other's chunks: 640 KB, whose single walks would take minutes."""
    import time

    unit = b"RIFF\x20\x7f\x7f\0WAVEJUNK\x0c\0\0\0"
    d = unit * 20_000
    began = time.perf_counter()
    media.find_media(d)
    assert time.perf_counter() - began < 10


def test_declared_types_are_corrected(spark):
    texts = ["", "a", "ab", "abc", "text with " + "words " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in media.described(media.sniff(media.stored_texts(df))).collect()}
    assert {i: r["corrected"] for i, r in rows.items()} == {i: len(t) % 3 != 0 for i, t in enumerate(texts)} and all(r["n_embedded"] == 0 for r in rows.values())


def test_stages_keep_columns_of_any_name(spark, sf):
    import corpus_pipeline

    line = " ".join(f"word{i}" for i in range(40))
    rows = [(0, line + "\nfirst part of it"), (1, line + "\nand something else entirely here"), (2, line + "\nfirst part of it"), (None, line), (3, None)]
    names = ("__id", "__cut", "__digest", "__gone", "id", "cut", "digest", "gone", "row", "class_key")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.substring_dedup):
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in got for c in names)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()} == {0, None, 3}


# ---- main text by the template


def said(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["river", "stone", "light", "walked", "under", "old", "bridge", "morning", "quiet", "town"]) for _ in range(n)).capitalize() + "."


def extracted(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    return [r["text"] for r in sorted(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["page_id"])]


def test_articles_beside_teaser_cards(spark):
    """The story is a main part's or a plain element's; the only article elements are cards."""
    for form in (
        "<body><nav><a>Home</a></nav><main><h1>{h}</h1><p>{a}</p><p>{b}</p></main><div class=more-stories><article><h3>{c}</h3></article><article><h3>Other</h3></article></div></body>",
        "<body><div class=post><h1>{h}</h1><p>{a}</p><p>{b}</p></div><section class=latest><article><h3>{c}</h3></article></section></body>",
        "<body><main><h1>{h}</h1><p>{a}</p><p>{b}</p><div class=grid><article><h3>{c}</h3></article></div></main></body>",
    ):
        for n in (1, 2, 10):
            pages = [("http://cards.example/x", form.format(h=said(3, i), a=said(40, 100 + i), b=said(30, 200 + i), c=said(4, 300 + i))) for i in range(n)]
            assert extracted(spark, pages) == [f"{said(3, i)}\n{said(40, 100 + i)}\n{said(30, 200 + i)}" for i in range(n)], (form, n)


def test_article_that_goes_on_outside(spark):
    form = "<body><article><h1>{h}</h1><p>{a}</p></article><div class=entry><p>{b}</p></div><div><p>Read on</p></div></body>"
    pages = [("http://on.example/x", form.format(h=said(3, i), a=said(40, 100 + i), b=said(35, 200 + i))) for i in range(6)]
    assert extracted(spark, pages) == [f"{said(3, i)}\n{said(40, 100 + i)}\n{said(35, 200 + i)}" for i in range(6)]


def test_unmarked_menus_and_notices(spark):
    """On a host of two pages what both have goes; on one of one page a list of links does."""
    form = "<body><div><a>Home</a> <a>News</a> <a>About us</a></div><div>We use cookies to make this site better for you.</div><div><h1>{h}</h1><p>{a}</p></div></body>"
    pages = [(f"http://{host}.example/x", form.format(h=said(3, i), a=said(40, 100 + i))) for i, host in enumerate(["two", "two", "many", "many", "many", "many"])]
    assert extracted(spark, pages) == [f"{said(3, i)}\n{said(40, 100 + i)}" for i in range(6)]
    alone = "<body><div><a>Home</a> <a>News</a></div><div><h1>{h}</h1><p>{a}</p></div></body>".format(h=said(3, 1), a=said(40, 2))
    assert extracted(spark, [("http://one.example/x", alone)]) == [f"{said(3, 1)}\n{said(40, 2)}"]


def test_the_template_matters(spark):
    form = "<body><div class=box><p>Call us on any day of the week before noon or after, as you like it best.</p></div><div class=text><p>{a}</p></div></body>"
    rows = [(i, "http://t.example/x", form.format(a=said(30, i))) for i in range(5)]
    tokens = html.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).head()["tokens"]
    assert html.main_text(rows[0][2], tokens) == said(30, 0)
    assert html.main_text(rows[0][2], ()) == f"Call us on any day of the week before noon or after, as you like it best.\n{said(30, 0)}"


def test_templates_by_gathered_vectors(spark, sf):
    """Classes of tokens by their occurrence vectors, gathered, on the smallest tables."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    hosts = {}
    for r in pages.select(html.host_of(F.col("url")).alias("host"), "html").collect():
        hosts.setdefault(r["host"], []).append(r["html"])
    want = {}
    for host, own in hosts.items():
        counts, places = [], {}
        for page in own:
            count, order = Counter(), {0: -1}
            for node in html.nodes(page):
                token = html.string_token(node) if node.kind == "text" else node.token
                if token:
                    count[token] += 1
                    order.setdefault(token, len(order))
            counts.append(count)
            for token, rank in order.items():
                places.setdefault(token, []).append(rank)
        classes = {}
        for token in set().union(*counts):
            vector, string = tuple(c[token] for c in counts), token > 0 and token % 2 == 1
            n = sum(v > 0 for v in vector)
            least = max(min(html.STRING_PAGES, max(2, len(own))), html.STRING_SHARE * len(own)) if string else html.FREQUENT * len(own)
            if n > 1 and n >= least:
                classes.setdefault(vector, []).append((sum(places[token]) / n, token))
        for members in classes.values():
            if len(members) >= html.LARGE and html.nests([t for _, t in sorted(members)]):
                want.setdefault(host, set()).update(t for _, t in members)
    assert {r["host"]: set(r["tokens"]) for r in html.templates(pages).collect()} == want and len(want) > 1


# ---- decontamination


def occurrences(words, items, n):
    hit, ids = set(), set()
    for i, text in items:
        own = decontaminate.normalised(text)
        for at in range(max(1, len(own) - n + 1)) if own else ():
            window = own[at : at + n]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    ids.add(i)
    return hit, ids


def test_windows_by_half_windows():
    """Every window of every item, tried everywhere, against pieces that are grown to both sides."""
    r = random.Random(1)
    for _ in range(1500):
        n = r.choice([1, 2, 3, 4, 5, 10])
        vocabulary = [f"w{i}" for i in range(r.choice([2, 3, 6, 30]))]
        items = [(r.choice([str(k), "x", None]), " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))) for k in range(r.randint(0, 5))]
        doc = " ".join(r.choice([*vocabulary, "unknown"]) for _ in range(r.randint(0, 40)))
        if items and r.random() < 0.6:
            doc += f" {items[0][1]} {doc}"
        words = decontaminate.normalised(doc)
        ranges, ids = decontaminate.hits(words, decontaminate.automaton(items, n))
        assert (set(np.flatnonzero(decontaminate.covered(ranges, len(words))).tolist()), ids) == occurrences(words, items, n), (n, items, doc)


def test_words_have_codes_of_their_own():
    codes = {decontaminate._code(k) for k in range(0, decontaminate.BLOCK_WORDS, 7)}
    assert len(codes) == len(range(0, decontaminate.BLOCK_WORDS, 7)) and {len(c) for c in codes} == {decontaminate.WIDTH}


def test_repetitive_texts_in_bounded_time():
    import time

    known = decontaminate.automaton([("a", "na " * 3_000), ("b", "na na na bat man")], 10)
    began = time.perf_counter()
    ranges, ids = decontaminate.hits(decontaminate.normalised("na " * 20_000 + "bat man"), known)
    assert time.perf_counter() - began < 60 and ids == {"a", "b"} and decontaminate.covered(ranges, 20_002).all()


def test_long_items_and_many_words_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 40)
    r = random.Random(4)
    items = [(str(k), " ".join(f"w{r.randrange(400)}" for _ in range(r.choice([5, 30, 200])))) for k in range(12)]
    table = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    docs = [(k, " ".join([prose_of(r, 30), *items[k % 12][1].split()[k % 7 : k % 7 + 3 + k], prose_of(r, 30)])) for k in range(60)]
    blocks = list(decontaminate.item_blocks(table, "item_id", "text", 10**9, 10, most_words=150))
    assert len(blocks) > 1 and all(len({w for _, t in b for w in t.split()}) <= 150 or len(b) == 1 for b in blocks)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for how in ({}, {"block_chars": 700}):
        found = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in decontaminate.scan(frame, table, **how).collect()}
        for k, text in docs:
            hit, ids = occurrences(decontaminate.normalised(text), items, 10)
            assert found[k] == (len(hit), sorted(ids)), (k, how)


def prose_of(r, n):
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))
