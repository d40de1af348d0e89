"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import components, decontaminate, html, jaccard, language, media, packing, passages, quality, queries, sample, similar, sstable, tokens, words, wordpiece
from sparkloom.llm.common import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    """A table with clashing column names."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit(1) for c in ("node", "label", "blk", "ids", "shard", "kept_in", "lang_pred", "score", "start", "n", "weight", "class_id")})


RANDOM = random.Random(5)
VOCAB = [f"w{i}" for i in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def grams(text, n=5):
    w = decontaminate.normalised(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


# Words and hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9é日 -\n.", max_size=30), max_size=6))
def test_words_of_many_texts(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    whole = np.frombuffer(b"".join(data), np.uint8)
    found = words.words_of(whole, offsets)
    lower = b"".join(data).translate(decontaminate.TABLE)
    for i, t in enumerate(texts):
        a, b = found.first[i], found.first[i + 1]
        assert [lower[s:e] for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)] == decontaminate.normalised(t)
    g = words.grams_of(found)
    for i, t in enumerate(texts):
        assert len(set(g.values[g.first[i] : g.first[i + 1]].tolist())) == len(grams(t))


def test_bands():
    b = words.bands_for(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**b.rows) ** b.bands >= 0.9999 and b.bands * b.rows <= 128


# 1


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(["x"] * 300_000)
    texts = [None, "", "!!!", f"See: {item.upper()}!", f"a {item[:-7]} b", "short ITEM here", f"é {item}, and {item}", long + " " + item, "one two three four five six seven eight nine"]
    benchmark = spark.createDataFrame([(10, item), (2, item), (3, "short item"), (4, None), (5, "...")], "item_id long, text string")
    table = docs(spark, texts)
    rows = {r["doc_id"]: r for r in decontaminate.scan(table, benchmark).collect()}
    assert [rows[i]["n_hit"] for i in range(9)] == [0, 0, 0, 12, 11, 2, 24, 12, 0]
    assert rows[3]["item_ids"] == ["10", "2"] and rows[4]["n_items"] == 2 and rows[5]["item_ids"] == ["3"]
    assert [texts[3][s["start"] : s["end"]] for s in rows[3]["spans"]] == [item.upper()] and texts[6][rows[6]["spans"][0]["start"] :].startswith("one")
    assert rows[7]["n_words"] == 300_012
    # many small automata find the same
    parts = {r["doc_id"]: r for r in decontaminate.scan(table, benchmark, block_chars=1).collect()}
    assert {i: tuple(r) for i, r in parts.items()} == {i: tuple(r) for i, r in rows.items()}
    twice = table.where("doc_id in (3, 4)").unionByName(table.where("doc_id = 3")).withColumn("doc_id", F.struct(F.lit(None).cast("int").alias("a b"), F.lit(7).alias("row")))
    assert sorted(r["n_hit"] for r in decontaminate.scan(twice, benchmark, block_chars=1).collect()) == [11, 12, 12]
    assert decontaminate.scan(table, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(table.limit(0), benchmark).count() == 0


# 2 and 10


ODD = ["It's we'll can't<|endoftext|>x", "é é Ünï ß ΣΑΣ \x1c a\x85b", "naïve 　日本語 a b 12 ½ ① ​ x", "", "a\x00b \x7f c", "ĲĳǅȺİ", "it's x's'sy 'll'LL'RE'req 'v 'e !'s ''s '", "'", "a'", "1's 22 ²3", " lead", "trail ", "\n", "x" * 5000, None]


def test_encoder():
    known = tokens.Encoder(queries.tokenizer_file())
    whole = Tokenizer.from_file(queries.tokenizer_file())
    assert [i.tolist() for i in known.encode(ODD)] == [whole.encode(t or "", add_special_tokens=False).ids for t in ODD]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=25), min_size=1, max_size=4))
def test_encoder_on_any_latin(texts):
    known = tokens.encoder(queries.tokenizer_file())
    assert [i.tolist() for i in known.encode(texts)] == [known.whole.encode(t, add_special_tokens=False).ids for t in texts]


def twins():
    """Two words of 1,024 letters, each the other's complement in the Thue-Morse sequence: any polynomial hash modulo a power of two takes them for one."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), bits


def test_words_of_one_hash_stay_apart():
    a, b, _ = twins()
    v = np.frombuffer((a + b).encode(), np.uint8)
    h = tokens.span_hashes(v, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] == h[1]
    texts = [a, b, f"{a} {b} {b} x {a} x y", f"{b} {a}"]
    known = tokens.Encoder(queries.tokenizer_file())
    assert [i.tolist() for i in known.encode(texts)] == [known.whole.encode(t, add_special_tokens=False).ids for t in texts]
    automaton = wordpiece.Automaton(wordpiece.vocabulary(queries.pieces_file()))
    assert wordpiece.Counter(automaton).counts(texts)[1].tolist() == [sum(automaton.count("▁" + w) for w in t.split()) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=4), min_size=1, max_size=20), st.integers(1, 3))
def test_distinct(spans, buckets):
    values = np.frombuffer("".join(spans).encode() + b"x", np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    real = tokens.span_hashes
    tokens.span_hashes = lambda v, a, b: np.array([len(s) % buckets for s in spans], np.uint64)  # far too few hashes
    try:
        where, number = tokens.distinct(values, ends - [len(s) for s in spans], ends)
    finally:
        tokens.span_hashes = real
    assert [spans[where[k]] for k in number] == spans and len({spans[w] for w in where}) == len(where)


def test_shards(spark):
    texts = [*ODD, *(prose(60, i) for i in range(300))]
    table = docs(spark, texts).unionByName(docs(spark, texts[:1])).withColumn("doc_id", F.col("doc_id") * 3 - 5)
    out = sstable.write(table.repartition(5), shared_path(spark, "t"), queries.tokenizer_file())
    rows = sstable.read(out).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted([i * 3 - 5 for i in range(len(texts))] + [-5])
    known = tokens.encoder(queries.tokenizer_file())
    want = spark.createDataFrame([(-5,), (-4,), (1,), (3 * 200 - 5,), (10**15,), (None,)], "doc_id long")
    found = {}
    for r in sstable.lookup(out, want).collect():
        found.setdefault(r["doc_id"], []).append(r["ids"])
    assert {k: len(v) for k, v in found.items()} == {-5: 2, 1: 1, 595: 1} and found[595] == [[*known.encode([texts[200]])[0].tolist(), 1]]
    nameless = spark.createDataFrame([(None, "a b"), (None, None), (2, "c")], "doc_id long, text string")
    back = sstable.write(nameless, shared_path(spark, "t"), queries.tokenizer_file())
    assert [(r["doc_id"], r["n_tokens"]) for r in sstable.read(back).orderBy("start").collect()][2] == (2, 2) and sstable.lookup(back, want).count() == 0
    reader = sstable.Reader(out.rows[0]["path"])
    assert sum(reader.may_hold(sstable.key_of(10**9 + i)) for i in range(1000)) < 60
    assert sstable.read(sstable.write(table.limit(0), shared_path(spark, "t"), queries.tokenizer_file())).count() == 0


def test_damaged_shard(spark, tmp_path):
    out = sstable.write(docs(spark, ["a b c"]), str(tmp_path / "s"), queries.tokenizer_file())
    path = out.rows[0]["path"].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[5] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(sstable.Reader(path).scan())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=40), st.integers(1, 6))
def test_packer(sizes, most_open):
    packer, out = packing.Packer((64, 5, 40), most_open), []
    for d, (n, loss) in enumerate(sizes):
        out += list(packer.add(packing.Piece(d, 0, np.arange(n, dtype=np.uint32), n, n - min(loss, n))))
    out += list(packer.close())
    seen = {}
    for sequence in out:
        assert 0 < len(sequence) <= 5 and sum(map(len, sequence)) <= 64 and sum(p.loss for p in sequence) <= 40
        for p in sequence:
            seen.setdefault(p.doc_id, []).append((p.start, len(p)))
    for d, (n, _) in enumerate(sizes):
        at = 0
        for start, size in sorted(seen[d]):
            assert start == at
            at += size
        assert at == n


def test_packing_nulls(spark):
    rows = packing.pack(docs(spark, [None, "", None]), queries.tokenizer_file()).collect()
    assert sorted((r["doc_id"], r["length"], r["doc_tokens"]) for r in rows) == [(0, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert packing.pack(docs(spark, ["x"]).limit(0), queries.tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, ["x"]), queries.tokenizer_file(), max_loss_tokens=0)


# 3


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media(spark):
    gif = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd" + b"\x11\xff\0\x22" + b"\xff\xd9"
    wav = media.wav(b"abc")
    bmp = b"BM" + struct.pack("<IIIIiiHH", 60, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 30
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hi")
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    for data, mime in ((png(), "image/png"), (gif, "image/gif"), (jpeg, "image/jpeg"), (wav, "audio/wav"), (bmp, "image/bmp"), (z.getvalue(), "application/zip"), (gzip.compress(b"x" * 99), "application/gzip"), (pdf, "application/pdf")):
        assert media.find_media(data)[0] == media.Found(0, len(data), mime)
        assert not [f for f in media.find_media(data[:-3]) if f.offset == 0 and f.mime == mime], mime
        assert media.Found(7, len(data), mime) in media.find_media(b"junk BM" + data + b"tail")
    rows = [(1, png(), "image/gif"), (2, b"xx" + gif + png(), "text/plain"), (3, None, None), (4, b"", "a/b"), (5, b"plain", None)]
    table = spark.createDataFrame(rows, "id int, media binary, declared_type string")
    s = {r["id"]: r for r in media.sniff(table).collect()}
    assert (s[1]["media_type"], s[1]["corrected"]) == ("image/png", True) and s[3]["media_type"] is None and s[4]["media_type"] is None and s[5]["media_type"] is None
    assert s[2]["media_type"] == "text/plain" and [e["type"] for e in s[2]["embedded"]] == ["image/gif", "image/png"]
    assert sorted(bytes(r["media"]) for r in media.carve(media.sniff(table)).collect()) == sorted([gif, png()])


def test_media_in_linear_time():
    import time

    page = b"OggS\0\0" + b"\0" * 20 + b"\1\4data"
    box = struct.pack(">I4s", 8, b"ftyp")
    chunk = png()[:33] + struct.pack(">I", 200_000) + b"IDAT"
    for unit in (b"PK\x03\x04", b"PK\x05\x06" + b"\0" * 18, page, box, chunk, b"\xff\xd8\xff\xda\0\2", b"\xff\xd8\xff\xda\0\2" + b"\xff\0" * 40, b"GIF89a\1\0\1\0\0\0\0\x21\0\1", b"%PDF-1.4 ", b"BM", b"\x1f\x8b\x08"):
        begin = time.monotonic()
        media.find_media(unit * (2_000_000 // len(unit)))
        assert time.monotonic() - begin < 30, unit[:20]
    assert [f.offset for f in media.find_media(page * 3 + page[:5] + b"\4" + page[6:])] == [0, 32, 64, 96]


def test_media_texts(spark):
    texts = [None, "", "é" * 32, "x" * 64, "x" * 65, "x" * 65, "RIFF____WAVE"]
    rows = {r["doc_id"]: r for r in media.described(media.sniff(media.stored_texts(docs(spark, texts)))).collect()}
    assert [rows[i]["payload_bytes"] for i in range(7)] == [64, 64, 64, 64, 128, 128, 64]
    assert rows[4]["media_sha256"] == rows[5]["media_sha256"] and rows[0]["payload_sha256"] == rows[1]["payload_sha256"]


# 4


def test_codes():
    for k in (2, 3, 4, 6, 9, 40):
        c = language.code(k)
        assert len({tuple(r) for r in c}) == k and all(-1 in col and 1 in col for col in c.T)
        assert k < 3 or min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= (2 if k == 3 else c.shape[1] // 5)


def test_decoding_of_a_known_case():
    """Bits decide by weighted logistic loss, against a sum by hand; a word between two codewords is ambiguous."""
    model = language.Model([("a", "aba aab abba " * 5), ("b", "cdc dcd ccdd " * 5), ("c", "efe fef eeff " * 5)] * 4)
    assert model.code.shape == (3, 3) and len({tuple(w) for w in model.code}) == 3
    model.scale, model.shift = np.ones(3), np.zeros(3)
    for bits in ([2.0, -1.0, 0.5], [0.0, 0.0, 0.0], [-3.0, 3.0, 3.0]):
        loss = [sum(t * np.log1p(np.exp(-c * x)) for t, c, x in zip(model.trust[k], model.code[k], bits, strict=True)) for k in range(3)]
        near = np.exp([-3 * v for v in loss])
        best, score, ahead = model.decode(np.array([bits]))
        assert loss[best[0]] == pytest.approx(min(loss)) and score[0] == pytest.approx(max(near) / sum(near))
        assert ahead[0] == pytest.approx((sorted(near)[-1] - sorted(near)[-2]) / sum(near))
    assert model.decode(np.zeros((1, 3)))[2][0] < 0.1


def test_sample_takes_labels_of_long_texts(spark):
    rows = [(i, "x" * 50 if i % 2 else "y" * 5_000, "short" if i % 2 else "long") for i in range(40)] + [(50, None, "none"), (51, "z", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = table.select(F.col("doc_id").alias("id"), "label")
    found = sample.labelled_sample(table, labels, sample.label_counts(labels), id_col="doc_id", text_col="text", per_label=5, most_chars=100)
    assert sorted((label, len(t)) for label, t in found) == [("long", 100)] * 5 + [("short", 50)] * 5


def test_language_cases(spark):
    model = language.Model([("a", "aba aab abba " * 5), ("b", "cdc dcd ccdd " * 5), ("c", "efe fef eeff " * 5)] * 4)
    texts = [None, "", "123 !!", "abab aba", "x" * 300_000, "cdcd", "efe", "é", "ab"]
    rows = {r["doc_id"]: r for r in language.predict(docs(spark, texts).drop("lang_pred"), model).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 3, 5, 6)] == ["und", "und", "und", "a", "b", "c"]
    assert all(rows[i]["lang_pred"] in "abc" for i in (4, 7, 8)) and rows[0]["lang_score"] == 0 and rows[0]["lang_ambiguous"]
    together = language._answers(texts, model, 0.1)
    assert together[0] == [language._answers([t], model, 0.1)[0][0] for t in texts]
    assert language._answers(["abc", None], language.Model([]), 0.1)[0] == ["und", "und"]
    assert language._answers(["abc", None], language.Model([("z", "text")]), 0.1)[:2] == (["z", "und"], [1.0, 0.0])


# 5


def page(body, n=0):
    return f"<html><body><nav><ul><li>Home<li>News</ul></nav><div class='sidebar left'>Side {n}</div><header>Site</header><article class='post-{n}'><header><h1>Title &amp; {n}</h1></header>{body}<aside>Ad</aside><section id=comments><p>me too</p></section></article><footer>Foot</footer></body></html>"


def test_main_text(spark):
    bodies = ["<p>One  <b>two</b>\n three<br>four<p>Five<script>var x='<p>no</p>';</script></p>", "<p>Same", "<p>Same<div class=notice>Cookies</div><form><p>Sign up</p></form><ul><li>a<li>b</ul>", "<table><tr><td>x<td>y</table><!-- <p>no</p> --><p>&lt;p&gt; &eacute;&#33;"]
    want = ["Title & 0\nOne two three four\nFive", "Title & 1\nSame", "Title & 2\nSame\na\nb", "Title & 3\nx\ny\n<p> é!"]
    rows = [(i, "http://h.example/a", page(b, i)) for i, b in enumerate(bodies)] + [(8, None, None), (9, "x", ""), (10, "http://one.example", "<p>alone<nav>menu</nav> text"), (11, "http://h.example/a", page(bodies[1], 1))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "tokens": F.lit(2), "text": F.lit("x")})
    for hosts in (1000, 0):  # broadcast and shuffled templates
        found = {r["page_id"]: r for r in html.extract(table, broadcast_hosts=hosts).collect()}
        assert [found[i]["text"] for i in range(4)] == want and found[11]["text"] == want[1]
        assert found[8]["text"] == found[9]["text"] == "" and found[10]["text"] == "alone\ntext" and found[0]["n_chars"] == len(want[0])
    assert html.extract(table.limit(0)).count() == 0


def test_main_text_of_two_layouts(spark):
    menu, foot = "<nav><a>Home</a></nav><div class=ad>Buy</div>", "<footer>Foot</footer>"
    others = [
        ("<body>{}<div class=story><h1>Head {}</h1><p>Story</p></div>{}</body>", "Head {}\nStory"),  # no article
        ("<body>{}<article class=featured><header><h1>Head {}</h1></header><p>Own class</p></article>{}</body>", "Head {}\nOwn class"),
        ("<body class=review>{}<p>teaser</p><div class=page><article><h1>Head {}</h1><p>Own body</p></article></div>{}</body>", "Head {}\nOwn body"),
        ("<body>{}<article></article><div><h1>Head {}</h1><p>Empty article</p></div>{}</body>", "Head {}\nEmpty article"),
    ]
    rows, want = [], {}
    for i in range(20):  # 12 pages with an article, 8 of other layouts
        form, text = ("<body>{}<p>teaser</p><article><h1>Head {}</h1><p>Usual</p></article>{}</body>", "Head {}\nUsual") if i < 12 else others[i % 4]
        rows.append((i, "http://two.example/a", f"<html>{form.format(menu, i, foot)}</html>"))
        want[i] = text.format(i)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(table).collect()} == want


@pytest.mark.parametrize("around", ["content has-sidebar", "layout-with-sidebar", "no-comments", "share-price", "job-search", "widget", "search", "sidebar"])
def test_main_text_in_marked_wrappers(around):
    for inner in ("<article>{}</article>", "<article class=post>{}</article>", "<main>{}</main>"):
        body = inner.format("<div class='entry-header'><h1>Head</h1></div><div class='masthead'><p>By me</p></div><p>Body</p><div class='site-footer'>Foot</div>")
        page = f"<html><body><nav>Home</nav><div class='left-sidebar'>Side</div><div id=wrap><div class='{around}'>{body}</div></div><div class='site-footer'>End</div></body></html>"
        assert html.main_text(page, frozenset()) == "Head\nBy me\nBody"


def test_main_text_without_main_part():
    for name, kept in (("job-search", True), ("has-sidebar", True), ("no-comments", True), ("share-price", True), ("left-sidebar", False), ("search", False), ("site-footer", False)):
        page = f"<body><p>One</p><div class='{name}'>Two</div></body>"
        assert html.main_text(page, frozenset()) == ("One\nTwo" if kept else "One")
    page = "<body><div class=entry>Entry</div><div id=comments><article>me too</article></div></body>"
    assert html.main_text(page, frozenset()) == "Entry"


def test_template_strings():
    """A host's constant text is no main text, whatever its class; copies of an article inside of it are; no page loses all."""
    form = "<body><div class=col1><p>{}</p></div><div class=col2>We <b>use</b> cookies here.</div><p>Contact us</p></body>"
    pages_ = [form.format(prose(20, 70 + i)) for i in range(6)] + ["<body><div class=col2>We <b>use</b> cookies here.</div></body>", "<body><article><p>Contact us</p></article><p>Contact us</p></body>"]
    strings = frozenset(t for t in (html.string_token(n) for n in html.nodes(pages_[0]) if n.kind == "text") if t) - {html.string_token(next(n for n in html.nodes(pages_[0]) if n.kind == "text"))}
    assert [html.main_text(p, strings) for p in pages_] == [prose(20, 70 + i) for i in range(6)] + ["We use cookies here.", "Contact us"]


def test_classes_of_a_host(spark):
    form = "<body><div class=col1><p>{}</p></div><div class=col2>We <b>use</b> cookies here.</div></body>"
    other = "<body><section><h2>{}</h2><div class=col2>Another <i>layout</i> here.</div></section></body>"
    rows = [(i, "http://t.example/x", form.format(prose(20, 70 + i))) for i in range(6)] + [(6 + i, "http://t.example/y", other.format(prose(9, 80 + i))) for i in range(3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    (found,) = html.templates(table).collect()
    paths = {n.token for i in (0, 6) for n in html.nodes(rows[i][2]) if n.kind != "text"}
    assert {t for t in found["tokens"] if t < 0 or not t & 1} == paths, "both layouts' tags, by their own vectors"
    assert len([t for t in found["tokens"] if t > 0 and t & 1]) == 3, "the strings of two thirds of the pages"
    assert {r["page_id"]: r["text"] for r in html.extract(table).collect()} == {i: prose(20, 70 + i) for i in range(6)} | {6 + i: f"{prose(9, 80 + i)}\nAnother layout here." for i in range(3)}


def test_nests():
    assert html.nests([2, 4, ~4, 1, ~2]) and html.nests([2, ~8]) and not html.nests([~2, 2]) and not html.nests([2, 4, ~2, ~4])


def test_markup_in_linear_time():
    import time

    units = ("<a b=\"", "<a b='<c d=\"", "<a ", "<div class=ad>", "<p><table>", "<p><div>", "</b>", "<!--", "<", "<script>", "<li><ul>", "<div class=ad><article>", "<dd><li>", "&amp;", "x<br>", "<p>a<!")
    for unit in units:
        begin = time.monotonic()
        page = unit * (300_000 // len(unit))
        html.main_text(page, frozenset((1,)))
        assert time.monotonic() - begin < 15, unit
    assert html.main_text("<p>One <a href=\"x>two</a> three</p><p>four", frozenset()) == "One two three\nfour"


# 6 and 8


def copies():
    base, out = [prose(120, i) for i in range(12)], []
    for i, t in enumerate(base):
        w = t.split()
        out.append(t)
        if i < 6:
            w[3], w[60] = "changed", "too"
            out.append(" ".join(w))  # near
        if i < 3:
            out += [t.upper(), t]  # the same words
        if i % 4 == 0:
            out.append(" ".join(w[:60]) + " " + prose(60, 100 + i))  # half
    near = prose(200, 77).split()
    for k in range(80):  # a large group of near copies, all different
        v = list(near)
        v[(k * 7) % 200] = f"edit{k}"
        out.append(" ".join(v))
    return [*out, None, "", "!!!", "!!!", "two words", "Two  words.", "one", "the same five words", prose(40_000, 9)]


def test_jaccard_join(spark, monkeypatch):
    texts = copies()
    sets = [grams(t) for t in texts]
    linked = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and alike(sets[i], sets[j]) >= 0.8}
    reach = list(range(len(texts)))
    for _ in range(20):
        for i, j in linked:
            reach[i] = reach[j] = min(reach[i], reach[j])
    monkeypatch.setattr(similar, "COLUMNS", 64)
    for items in (1000, 20):  # one block, and many
        monkeypatch.setattr(similar, "BLOCK_ITEMS", items)
        rows = {r["doc_id"]: r for r in jaccard.join(docs(spark, texts)).collect()}
        assert len(rows) == len(texts)
        for i in range(len(texts)):
            assert rows[i]["n_links"] == sum(a == i for a, _ in linked) and rows[i]["class_id"] == reach[i], texts[i][:50]
    assert jaccard.join(docs(spark, ["x"]).limit(0)).count() == 0


def test_jaccard_join_by_bands(spark, monkeypatch):
    """Texts that hang together by chance collisions: compared by band, with the links of all others."""
    parts = [prose(12, 2_000 + i) for i in range(90)]
    texts = [" ".join(parts[(i + k) % 90] for k in range(7)) for i in range(90)]  # neighbours share 6 of 8 parts, and so on
    for i in range(0, 90, 9):
        texts.append(texts[i] + " more words here")
    sets = [grams(t) for t in texts]
    linked = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and alike(sets[i], sets[j]) >= 0.8}
    sent = {}
    for items in (250, 4):
        monkeypatch.setattr(similar, "BLOCK_ITEMS", items)
        rows = {r["doc_id"]: r for r in jaccard.join(docs(spark, texts)).collect()}
        sent[items] = [rows[i]["n_links"] for i in range(len(texts))]
        assert sent[items] == [sum(a == i for a, _ in linked) for i in range(len(texts))]
    classes = spark.createDataFrame([(i, 50, [i // 2, 50_000 + (i + 1) // 2]) for i in range(70)], "node long, n_grams long, bands array<long>")
    work = similar.members(classes, "t").collect()
    assert len(work) == 70 and {w["banded"] for r in work for w in r["work"]} == {True}


def test_texts_of_one_polynomial_hash(spark):
    bits = twins()[2]
    a, b = (" ".join(("yes", "no")[x ^ k] for x in bits) for k in (0, 1))
    rows = {r["doc_id"]: r for r in jaccard.join(docs(spark, [a, b, a])).collect()}
    assert [rows[i]["copy_of"] for i in range(3)] == [0, 1, 0]
    cut = {r["doc_id"]: r["removed"] for r in passages.repeats(docs(spark, [f"{a}\n{prose(9, 1)}", f"{prose(9, 2)}\n{b}"]), similarity=1.01).collect()}
    assert (0, 1033) not in [tuple(x) for x in cut[1]]


def test_rows_without_id(spark):
    table = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "a b c d e f")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["copy_of"], r["n_words"]) for r in jaccard.join(table).collect()), key=str)
    assert rows == [(1, 1, 1, 1, 6), (2, 1, 1, 1, 6), (None, None, 0, None, 0), (None, None, 0, None, 6)]
    found = sorted(((r["doc_id"], r["n_removed"]) for r in passages.repeats(table).collect()), key=str)
    assert found == [(1, 0), (2, 6), (None, 0), (None, 0)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    found = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == label


def shared_runs(texts, n=50):
    """Texts that hold n words in a row of another."""
    where = {}
    for i, t in enumerate(texts):
        w = decontaminate.normalised(t)
        for p in range(len(w) - n + 1):
            where.setdefault(tuple(w[p : p + n]), set()).add(i)
    return {i for s in where.values() if len(s) > 1 for i in s}


def test_substring_dedup(spark):
    passage, inner = prose(70, 500), prose(55, 501)
    edited = passage.split()
    edited[5] = "edited"
    texts = [
        f"{prose(40, 1)}.\n{passage}\n{prose(40, 2)}", f"{prose(30, 3)}\n{passage}.", f"{prose(20, 4)} {inner} {prose(20, 5)}", f"{prose(33, 6)}, {inner.upper()}; {prose(8, 7)}", prose(90, 8), f"{prose(20, 10)}\n{' '.join(edited)}\n{prose(9, 11)}",
        None, "", "short line\nshort line", "short line", "word " * 500, "word " * 400, prose(30_000, 12), "é ñ " + inner + " ü",
    ]
    rows = {r["doc_id"]: r for r in passages.repeats(docs(spark, texts)).collect()}
    assert {i for i, r in rows.items() if r["repeated"]} == {1, 3, 5, 11, 13}
    assert rows[1]["kept_in"] == [0] and rows[1]["n_removed"] == 70 and rows[5]["n_removed"] == 70 and rows[3]["kept_in"] == rows[13]["kept_in"] == [2]
    table = docs(spark, texts)
    cut = passages.rewritten(table)
    assert cut.columns == table.columns
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert [after[i] for i in (0, 2, 4, 6, 7, 8, 9, 12)] == [texts[i] for i in (0, 2, 4, 6, 7, 8, 9, 12)]
    assert after[1] == f"{prose(30, 3)}\n" and not shared_runs(list(after.values()))
    assert passages.repeats(table.limit(0)).count() == 0


def test_what_goes_is_kept_elsewhere(spark):
    line = prose(120, 3_000).split()
    other = [*line[:60], "onlyhere", *line[61:]]
    texts = [prose(30, 3_001), " ".join(line), None, "", prose(25, 3_002), f"{prose(12, 3_003)}\n{' '.join(other)}", "", f"{prose(20, 3_004)} {' '.join(other[30:95])} {prose(22, 3_005)}", f"{prose(20, 3_006)} {' '.join(other[30:95])} {prose(22, 3_007)}"]
    after = {r["doc_id"]: r["text"] for r in passages.rewritten(docs(spark, texts)).collect()}
    assert after[1] == texts[1] and after[5] == f"{prose(12, 3_003)}\n"
    assert after[7].split().count("onlyhere") == 1, "the only text left with that word keeps it"
    assert "onlyhere" not in after[8] and after[8].split()[:20] == texts[8].split()[:20]
    rows = {r["doc_id"]: r for r in passages.repeats(docs(spark, texts)).collect()}
    for x in rows[7]["removed"]:
        assert " ".join(texts[7].split()[x["start"] : x["end"]]) in after[1]
    assert rows[5]["kept_in"] == [1] and set(rows[8]["kept_in"]) <= {1, 7}


def test_chain_of_alike_lines_goes_as_one(spark):
    words_ = prose(60, 3_100).split()
    chain = []
    for k in range(8):
        words_[k * 7] = f"step{k}"
        chain.append(" ".join(words_))
    rows = {r["doc_id"]: r for r in passages.repeats(docs(spark, chain)).collect()}
    assert [rows[i]["n_removed"] for i in range(8)] == [0] + [60] * 7 and all(rows[i]["kept_in"][0] == 0 for i in range(1, 8))


def test_no_shared_run_is_left(spark):
    r = random.Random(3)
    parts = [prose(r.randint(50, 130), 900 + i) for i in range(15)]
    texts = [" ".join(x for _ in range(4) for x in (prose(r.randint(5, 60), r.random()), r.choice(parts))).replace(" w1", "\nw1") for _ in range(60)]
    assert len(shared_runs(texts)) > 40
    rows = {x["doc_id"]: x for x in passages.repeats(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):  # what goes is held by another text
        w = decontaminate.normalised(t)
        for span in rows[i]["removed"]:
            assert span["end"] - span["start"] >= 25 and len(w) >= span["end"]
    after = [x["text"] for x in passages.rewritten(docs(spark, texts)).collect()]
    assert not shared_runs(after)


@pytest.mark.parametrize("n", [50, 51, 80, 131])
def test_whole_passage_goes(spark, n):
    parts = [prose(n, 700 + i) for i in range(12)]
    middle = [" ".join(p.split()[n // 2 - 15 : n // 2 + 15]) for p in parts]
    before = [f"{prose(20, 800 + i)} {m} {prose(21, 820 + i)}" for i, m in enumerate(middle)]  # an earlier document has only the middle
    texts = [f"{prose(33, 840 + i)} {parts[i % 12]} {prose(31, 900 + i)}" for i in range(36)]
    rows = {x["doc_id"]: x for x in passages.repeats(docs(spark, [*before, *texts])).collect()}
    for i in range(36):
        got = [(x["start"], x["end"]) for x in rows[12 + i]["removed"]]
        assert got == [(33, 33 + n)] or i < 12 and all(33 <= a < b <= 33 + n for a, b in got), (i, got)
    after = {x["doc_id"]: x["text"] for x in passages.rewritten(docs(spark, [*before, *texts])).collect()}
    assert all(after[12 + i] == f"{prose(33, 840 + i)} {prose(31, 900 + i)}" for i in range(12, 36))


def test_short_lines(spark):
    near = prose(26, 600).split()
    edited = [*near[:-1], "edited"]  # 21 of 23 five-grams in common
    texts = [f"{prose(12, 610)}\n{prose(5, 601)}\n{' '.join(near)}\n{prose(4, 603)}", f"{prose(9, 611)}\n{prose(5, 601).upper()}!\n{' '.join(edited)}\n{prose(4, 603)}\n{prose(29, 602)}", f"{prose(29, 602)}\n{prose(7, 612)}"]
    rows = {r["doc_id"]: r for r in passages.repeats(docs(spark, texts)).collect()}
    assert [[tuple(x) for x in rows[i]["removed"]] for i in range(3)] == [[], [(9, 40)], [(0, 29)]]
    assert rows[1]["kept_in"] == [0] and rows[2]["kept_in"] == [1]


# 7


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="ab", min_size=1, max_size=5), min_size=1, max_size=8), st.text(alphabet="abc", min_size=1, max_size=14))
def test_longest_match(pieces, word):
    n, rest = 0, word
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        n, rest = (n + 1, rest[k:]) if k else (1, "")
        if not k:
            break
    assert wordpiece.Automaton(pieces).count(word) == n


def test_token_count_cases(spark):
    texts = [None, "", " \n　", "hello hello", "日本語", "x" * 100_000]
    rows = {r["doc_id"]: r for r in wordpiece.count(docs(spark, texts), queries.pieces_file()).collect()}
    assert [rows[i]["n_words"] for i in range(6)] == [0, 0, 0, 2, 1, 1] and rows[3]["n_tokens"] == 2 * wordpiece.Automaton(wordpiece.vocabulary(queries.pieces_file())).count("▁hello")


# 9


def test_quality_cases(spark):
    good, bad = [prose(100, i) for i in range(60)], [" | ".join(prose(60, 300 + i).upper().split()) + "!!" for i in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)] + [(500, None, 1), (501, "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, q int")
    model = quality.train(table, table.select(F.col("doc_id").alias("id"), F.col("q").alias("label")))
    found = {r["doc_id"]: r for r in quality.score(docs(spark, [None, "", good[3], bad[3], good[3] * 200, prose(90, 999)]), model).collect()}
    assert found[2]["predicted"] == found[4]["predicted"] == found[5]["predicted"] == 1 and found[3]["predicted"] == 0 and found[0]["score"] == found[1]["score"]
    assert quality.score(table, quality.Model([])).where("score = 0.5").count() == len(rows)
    assert quality.score(table, quality.Model([("1", "x")])).where("score = 1").count() == len(rows)
    sizes = quality.Sizes(*model.how).of(good[3].encode())
    by_hand = [sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_dict_id=False).compress(good[3].encode()[i : i + 2_000])) for i in range(0, len(good[3].encode()), 2_000)) for d in model.how[:2]]
    assert sizes == (*by_hand, len(good[3].encode())) and by_hand[0] < by_hand[1] and quality.features(np.array([sizes], float)).shape == (1, 1)
    tiny = quality.Model([("1", "a"), ("0", "b")])
    assert 0 <= quality.score(table, tiny).head()["score"] <= 1


# The pipeline


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as p

    item = prose(30, 4242)
    passage = prose(80, 4243)
    base = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10_001, None), (10_002, "12 34 !!"), (10_003, f"The {item} of"), (10_004, f"{prose(40, 1)} {passage} {prose(40, 2)}"), (10_005, f"{prose(40, 3)} {passage} {prose(40, 5)}"), (10_006, prose(100, 6)), (10_007, prose(100, 6) + " more")]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], DOCS)
    base.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in p.STAGES:
        now = p.stored(stage(spark, now, str(tmp_path)), name)
        if name != "packing":
            assert now.columns == base.columns
            seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    ids = {k: set(v) for k, v in seen.items()}
    assert not ids["language_id"] & {10_001, 10_002}
    clean = {r["doc_id"] for r in base.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert len(clean - ids["language_id"]) <= 0.01 * len(clean)
    sets = {i: grams(t) for i, t in seen["near_duplicates"].items()}
    assert not [1 for i in sets for j in sets if i < j and alike(sets[i], sets[j]) >= 0.8]
    gone = ids["language_id"] - ids["near_duplicates"]
    before = {i: grams(t) for i, t in seen["language_id"].items()}
    assert 10_007 in gone and all(any(alike(before[i], before[j]) >= 0.8 for j in before if j != i) for i in gone)
    assert ids["substring_dedup"] == ids["near_duplicates"] and passage in seen["substring_dedup"][10_004] and passage not in seen["substring_dedup"][10_005]
    assert not shared_runs([t for t in seen["substring_dedup"].values()])
    assert ids["substring_dedup"] - ids["decontamination"] == {10_003}
    assert {r["doc_id"] for r in now.collect()} == ids["decontamination"]


def test_near_duplicates_of_repeated_ids(spark, sf):
    import corpus_pipeline as p

    a, b = prose(60, 4_000), prose(60, 4_001)
    rows = [(1, a), (5, b), (5, a + " x"), (5, b), (7, b), (8, ""), (8, "!"), (None, a), (9, None)]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = p.near_duplicates(spark, p.stored(table, "t"), sf)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (8, ""), (8, "!"), (None, a), (9, None)], key=str)


def test_no_clean_document_is_lost_to_language_id(spark, sf):
    import corpus_pipeline as p

    base = spark.read.parquet(f"{sf}/documents.parquet")
    # Words of several languages, none of them much likelier than the others.
    mixed = ["oieauon a ciónraue&&& enzu. eauou Chstein", "épaqueon einte. ciieado einie du schß oi erwh", "aile, osra dieeineinkeitau requement llasue.%%% tienha.", "einverau. enesquegaes$$$ ierréan", "éentioneau, ñieó*** ungberer", "a", "xyzzy"]
    more = spark.createDataFrame([(20_000 + i, t, None, "s", len(t)) for i, t in enumerate(mixed)], DOCS)
    docs_ = p.stored(base.unionByName(more), "language-cases")
    kept = {r["doc_id"] for r in p.language_id(spark, docs_, sf).collect()}
    assert kept >= {r["doc_id"] for r in docs_.collect() if r["text"] and any(c.isalpha() for c in r["text"])}


def test_places_of_a_window_meet_once(spark, monkeypatch):
    """Lengths of shared passages aren't rows that are dealt again and again, and equal lines aren't sorted, unless a window is in very many places."""
    r = random.Random(6)
    parts = [prose(r.randint(26, 110), 1_900 + i) for i in range(9)]
    texts = ["\n".join(f"{prose(r.randint(3, 30), r.random())} {' '.join(r.choice(parts).split()[r.randrange(9) :])}" for _ in range(3)) for _ in range(40)]
    plans, kept = {}, passages.stored

    def seen(df, what, **how):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, what, **how)

    monkeypatch.setattr(passages, "stored", seen)
    table = docs(spark, [*texts, None, "", *texts[:4]])
    rows = lambda **how: sorted((x["doc_id"], x["n_removed"], [tuple(s) for s in x["removed"]], x["kept_in"]) for x in passages.repeats(table, **how).collect())
    found = rows()
    assert sum(n > 0 for _, n, _, _ in found) > 30 and not {"coarse", "rest", "fine"} & plans.keys()
    assert "SortAggregate" not in plans["lines"] and "HashAggregate" in plans["lines"]
    for most in (0, 5):
        assert rows(group_rows=most) == found and {"coarse", "rest", "fine"} <= plans.keys()
