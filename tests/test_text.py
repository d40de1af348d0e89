"""Chunking, text clean-up, sections, speech, JSON, audio."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import audio, chunker, jsons, models, sizing, speech, text
from sparkloom.sources import documents


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head()["y"]


def test_chunks():
    assert chunker.chunks("Hello world, this is short.") == [(0, "Hello world, this is short.")]
    assert len(chunker.chunks("A" * 1000 + "\n\n" + "B" * 1000, 1200, 100, ("\n\n", " "))) >= 2
    words = " ".join(f"word{i}" for i in range(500))
    found = chunker.chunks(words, 200, 50, (" ",))
    assert len(found) > 1 and found[1][1].startswith(found[0][1][-50:])
    assert [t for _, t in chunker.chunks("A\n\nB\n\nC\n\nD\n\nE", 3, 0, ("\n\n",))] == ["A\n\n", "B\n\n", "C\n\n", "D\n\n", "E"]
    assert chunker.chunks("") == chunker.chunks(None) == chunker.chunks(" \n\n ") == []


@pytest.mark.parametrize("unit", ["é", "word ", "a. b\n", "\n\n", "日本"])
def test_chunks_cover_the_text(unit):
    whole = unit * 900
    data, at = whole.encode(), 0
    for start, chunk in chunker.chunks(whole):
        assert data[start : start + len(chunk.encode())] == chunk.encode()
        assert start <= at
        at = start + len(chunk.encode())
    assert not data[at:].decode().strip()


def test_chunk_numbers_run_over_sections(spark):
    df = spark.createDataFrame([(1, 0, "a b", "x"), (1, 1, "c", "y"), (2, 0, None, "z")], "doc_id long, section int, text string, metadata string")
    rows = sorted(tuple(r) for r in chunker.chunk_sections(df).collect())
    assert rows == [(1, 0, "a b", "x"), (1, 1, "c", "y")]


def test_byte_cuts(spark):
    assert one(spark, "aéé", lambda x: text.prefix_of_bytes(x, 2)) == "a"
    assert one(spark, "aéé", lambda x: text.prefix_of_bytes(x, 3)) == "aé"
    assert one(spark, "😀😀", lambda x: text.prefix_of_bytes(x, 7)) == "😀"
    assert one(spark, "aéé", lambda x: text.suffix_of_bytes(x, 3)) == "é"
    assert one(spark, "aéé", lambda x: text.suffix_of_bytes(x, 9)) == "aéé"


def test_text_functions(spark):
    assert one(spark, "\u00a0 x y\n", text.trimmed) == "x y"
    assert one(spark, "ﬁne\u00ad – o\ufb03ce…", text.normalized_pdf_text) == "fine - office..."
    assert one(spark, "hello, world!", text.english_tokens) == "hello , world !"
    assert one(spark, "PDFs of NASA", text.spelled_acronyms) == "P D F s of N A S A"
    assert one(spark, "One. Two!  Three", text.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "", text.session_title) == "New Chat"
    assert one(spark, "x" * 40, text.session_title) == "x" * 32 + "…"
    assert one(spark, "A/b.TXT", text.extension) == "txt" and one(spark, "A/b", text.extension) == "unknown"
    assert one(spark, "C:\\Dir\\File.GGUF", text.basename) == "file.gguf"
    assert one(spark, "paragraph:4:rest", text.page_label) == "Paragraph 4:rest"


def test_sections(spark, tmp_path):
    def zipped(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in files.items():
                z.writestr(name, body)
        return out.getvalue()

    w = 'xmlns:w="w"'
    docx = zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    slide = '<s xmlns:a="a"><a:p><a:t>Slide {}</a:t></a:p></s>'
    pptx = zipped({f"ppt/slides/slide{n}.xml": slide.format(n) for n in (10, 2)})
    for name, body in {"a.docx": docx, "b.pptx": pptx, "c.md": b"lead\n# One\ntext\n## Empty\n", "d.txt": b"p1\n\n\n\n p2 ", "e.wav": b"x", "bad.docx": b"no zip", "skipped.xyz": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    found = {}
    for r in documents.folder(spark, str(tmp_path)).collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["text"], r["metadata"], bool(r["error"])))
    assert found["a.docx"] == [("First", "paragraph:1", False), ("a\tb", "table:1", False)]
    assert found["b.pptx"] == [("Slide 2", "slide:1", False), ("Slide 10", "slide:2", False)]
    assert found["c.md"] == [("lead", "section:intro", False), ("text", "section:One", False)]
    assert found["d.txt"] == [("p1", "paragraph:1", False), ("p2", "paragraph:2", False)]
    assert found["e.wav"][0][1] == "audio:pending" and found["bad.docx"][0][2] and "skipped.xyz" not in found


def test_transcript(spark):
    df = spark.createDataFrame([(1, [("hi", 0, 10), ("there", 10, 25)])], "doc_id long, segments array<struct<text: string, start_ms: long, end_ms: long>>")
    assert [r["metadata"] for r in documents.transcript(df).orderBy("section").collect()] == ["audio:0ms-10ms", "audio:10ms-25ms"]


@pytest.mark.parametrize(("n", "words"), [(0, "zero"), (1, "one"), (42, "forty-two"), (1200, "twelve hundred"), (1000, "one thousand"), (-5, "negative five"), (2_000_001, "two million one")])
def test_number_words(n, words):
    assert speech.number_words(n) == words


@pytest.mark.parametrize(
    ("said", "heard"),
    [
        ("There are 1200 students.", "there are twelve hundred students."),
        ("It costs $4.99 here", "it costs four dollars and ninety-nine cents here"),
        ("up 5% to €2M", "up five percent to two million euros"),
        ("at 3:05 pm, 14:00", "at three oh five pm, fourteen hundred"),
        ("the 2nd, 1/2, 3/4", "the second, one half, three quarters"),
        ("the 1980s", "the nineteen eighties"),
        ("call 555-1234", "call five five five one two three four"),
        ("1.5e-3", "one point five times ten to the negative three"),
        ("GPT-4 is 10-20", "g p t four is ten to twenty"),
        ("can't and they're", "cannot and they are"),
        ("<b>see</b> https://x.y/z a@b.co .5", "see zero point five"),
        ("5 km at 10.0.0.1", "five kilometers at one zero dot zero dot zero dot one"),
    ],
)
def test_speakable(spark, said, heard):
    assert one(spark, said, speech.speakable) == heard


def test_speech_chunks(spark):
    assert one(spark, "One. Two! Three?", speech.speech_chunks) == ["One,", "Two,", "Three,"]
    long = one(spark, "word " * 200, lambda x: speech.speech_chunks(x, 40))
    assert max(map(len, long)) <= 41 and sum(c.count("word") for c in long) == 200


def test_json(spark):
    assert jsons.mended_array('x [{"a": 1}] y') == '[{"a": 1}]'
    assert jsons.mended_array('```json\n[{"a": "]"}, {"a": 2}, {"a"') == '[{"a": "]"}, {"a": 2}]'
    assert jsons.mended_array('[{"a": 1},]') == '[{"a": 1}]' and jsons.mended_array("none") is None and jsons.mended_array(None) is None
    assert one(spark, 'said ```json\n{"a": 1}\n``` ok', jsons.object_of) == '{"a": 1}'
    line = '[{"speaker":"A","text":"hi"},{"speaker":"B","text":"yo"}]'
    assert [t["voice"] for t in one(spark, line, lambda x: jsons.dialogue(x, F.lit("A"), F.lit("v1"), F.lit("v2")))] == ["v1", "v2"]
    assert one(spark, '[{"speaker":"A"}]', lambda x: jsons.dialogue(x, F.lit("A"), F.lit("v1"), F.lit("v2"))) is None


def test_models(spark):
    assert one(spark, "1. first\n\n2) second\nthird\nfourth", models.rephrasings) == ["first", "second", "third"]
    assert one(spark, "I say no_retrieval", models.label_in) == "no_retrieval"
    v = one(spark, "a b c", models.hashed_embedding)
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5)


def test_names_and_sizes(spark):
    for name, b in {"llama-7b-q4_k_m.gguf": 7.0, "mix-8x3b-7b": 7.0, "a-70b-7b": 70.0, "13gb-file": None, "x-1.5B": 1.5, "5bs": None}.items():
        assert one(spark, name, sizing.billions_of) == b
    for name, q in {"m-IQ4_XS.gguf": "Q4", "m-q8_0": "Q8", "m-fp16": "F16", "m-fp32": "F32", "m": "unknown", "m-q2_k": "Q2"}.items():
        assert one(spark, name, sizing.quant_of) == q
    c = spark.range(1).select(sizing.compatibility(F.lit("llama-7b-q4_k_m.gguf"), F.lit(3500), F.lit(None).cast("long"), F.lit(4096), F.lit(8), F.lit(True), F.lit(16.0), F.lit(100.0)).alias("c")).head()["c"]
    assert c["rating"] == "efficient" and c["perf_score"] == 4.0 and c["params"] == "7B"


def test_audio(spark):
    assert len(audio.resampled(np.arange(100), 100, 50)) == 50 and audio.mel_filters().shape == (128, 257)
    x = np.sin(np.arange(16_000) * 2 * np.pi * 440 / 16_000)
    m = audio.log_mel(x)
    assert m.shape[1] == 128 and abs(int(m.mean(axis=0).argmax()) - int((audio.mel_filters() @ (np.arange(257) == 14)).argmax())) <= 1
    back = audio.wav_samples(audio.wav_bytes(x))
    assert len(back) == len(x) and np.abs(back - x).max() < 1e-3
    assert len(audio.wav_samples(audio.merged_wavs([audio.wav_bytes(x), audio.wav_bytes(x)]))) == 32_000
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],)], "x array<float>")
    assert [[round(v, 2) for v in r[0]] for r in df.select(audio.emphasized(F.col("x"))).collect()] == [[1.0, 1.03, 2.06], []]


def test_table_cells(spark):
    assert one(spark, "| a | - x<BR>- y |\n- z<br>\n|<br />b|", text.table_cells) == "| a | • x<br/>• y |\n- z<br>\n|<br/>b|"


def test_embedding_messages(spark):
    assert one(spark, '["a", "b"]', jsons.requested_texts) == ["a", "b"] and one(spark, "plain", jsons.requested_texts) == ["plain"]
    assert one(spark, '{"data": [{"embedding": [1.0, 2.5], "index": 0}, {"embedding": [], "index": 1}]}', jsons.embeddings_of) == [[1.0, 2.5], []]
    assert one(spark, "{}", jsons.embeddings_of) is None and one(spark, "x", lambda x: jsons.embedding_request(F.array(x))) == '["x"]'


def test_mind_map(spark):
    answer = '{"title": "Top", "children": [{"label": " A ", "children": [{"label": "B"}]}, {"label": ""}]}'
    assert [tuple(r) for r in one(spark, answer, lambda x: jsons.mind_map_rows(x, F.lit("q")))] == [("0", "Top"), ("0.0", "A"), ("0.1", "Untitled"), ("0.0.0", "B")]
    assert [tuple(r) for r in one(spark, "{}", lambda x: jsons.mind_map_rows(x, F.lit(" q ")))] == [("0", "q")] and one(spark, "none", lambda x: jsons.mind_map_rows(x, F.lit("q"))) is None


def test_configuration_files(spark):
    files = [("a/m.toml", b'[[models]]\nid = "x"\nname = "X"\nmemory_mb = 5\n[[models]]\nid = "y"'), ("b.json", b'[{"id": "z", "name": "Z"}]'), ("bad.toml", b"= 1"), ("c.txt", b"no")]
    rows = documents.configured(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).collect()
    assert sorted((r["id"] or "", r["name"] or "", bool(r["error"])) for r in rows) == [("", "", True), ("x", "X", False), ("y", "", False), ("z", "Z", False)]
    assert '"memory_mb": 5' in next(r["settings"] for r in rows if r["id"] == "x")


def test_written_results(spark, tmp_path):
    from sparkloom.operators import runs

    runs.written_results(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 3, 1.0)], "g string, n int, ts double"), str(tmp_path), by=["g"], metric="ts", order=["n"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/all").count() == 3 and {(r["g"], r["n"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/best").collect()} == {("a", "2"), ("b", "3")}
    assert {(r["g"], r["runs"], r["mean"]) for r in spark.read.json(f"{tmp_path}/summary").collect()} == {("a", 2, 3.0), ("b", 1, 1.0)}


def test_spectra_of_many_signals(spark, monkeypatch):
    """All signals of a batch at once, in parts, against one at a time by plain steps."""
    monkeypatch.setattr(audio, "FRAMES", 7)
    r = np.random.default_rng(2)
    signals = [r.normal(0, 1, n) for n in (0, 1, 5, 100, 224, 399, 400, 1000, 0, 3000)]
    values, offsets = np.concatenate(signals), np.concatenate([[0], np.cumsum([len(x) for x in signals])])
    m, at = audio.log_mels(values, offsets)
    z = audio.standardized(m, at)
    for k, x in enumerate(signals):
        want = np.zeros((0, audio.MELS))
        if len(x):
            e = np.append(x[:1], x[1:] - audio.EMPHASIS * x[:-1])
            pad = min((audio.FFT - audio.HOP) // 2, len(x) - 1)
            e = np.pad(e, pad, mode="reflect")
            cut = [e[i : i + audio.WINDOW] * np.hanning(audio.WINDOW) for i in range(0, len(e) - audio.WINDOW + 1, audio.HOP)]
            if cut:
                want = np.log(np.abs(np.fft.rfft(np.array(cut), audio.FFT)) ** 2 @ audio.mel_filters().T + audio.FLOOR)
        np.testing.assert_allclose(m[at[k] : at[k + 1]], want, atol=1e-9)
        if len(want):
            np.testing.assert_allclose(z[at[k] : at[k + 1]], (want - want.mean(axis=0)) / (want.std(axis=0) + 1e-5), atol=1e-9)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(signals)] + [(99, None)], "k int, x array<double>").coalesce(1)
    got = {row["k"]: row["m"] for row in df.select("k", audio.mel_features(F.col("x")).alias("m")).collect()}
    assert got[99] == [] == got[0] and all(np.allclose(np.array(got[k]).reshape(-1, audio.MELS), z[at[k] : at[k + 1]]) for k in range(len(signals)))


def test_dither():
    noise = audio.dithered(np.zeros(3), 1.0)
    want = [((i * audio.DITHER_FACTOR + 1) % 2**64 >> 33) / (2**32 - 1) * 2 - 1 for i in range(3)]
    np.testing.assert_allclose(noise, want)
    assert (audio.dithered(np.ones(2), 0.0) == 1).all()
