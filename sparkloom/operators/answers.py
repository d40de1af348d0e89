"""From questions to prompts: gate, imagined answer, two legs, fusion, grades, a second try with other wordings, context, prompt; many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import audio, jsons, models, speech
from sparkloom.functions.text import answer_prompt, prefix_of_bytes, words
from sparkloom.operators import lifecycle, raptor, search
from sparkloom.sources.tables import beside, written

#: A leg: the ranking (query, id, rank) of some (query, text).
Leg = Callable[[DataFrame], DataFrame]
#: Words of the first answers that make the other wordings.
FEEDBACK = 6


def gated(questions: DataFrame, n_documents: int) -> DataFrame:
    """Questions (query, text) with ``retrieves``: whether they need the corpus."""
    return questions.withColumn("__class", models.run("classify", F.col("text"))).withColumn("retrieves", models.needs_retrieval(F.col("__class.label"), F.col("__class.confidence"), F.lit(n_documents))).drop("__class")


def sources(questions: DataFrame, chunks: DataFrame, legs: list[tuple[Leg, float]], k: int) -> DataFrame:
    """(query, id, grade, score, rank): the k best graded of the 2 k best fused chunks (id, text) of each question (query, text)."""
    pool = beside(search.top(search.fused([(leg(questions), weight) for leg, weight in legs]), 2 * k).select("query", "id", "score"), "pool")
    texts = chunks.select("id", F.col("text").alias("passage")).join(pool, "id").join(questions.select("query", "text"), "query")
    graded = texts.select("query", "id", search.grade(models.run("grade", F.col("text"), F.col("passage"))).alias("grade"), "score")
    return search.graded(graded, k)


def once_each(rows: DataFrame) -> DataFrame:
    """(query, id, ...) with an id once a query, as it scored best."""
    best = Window.partitionBy("query", "id").orderBy(F.desc("grade"), F.desc("score"))
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def feedback(questions: DataFrame, first: DataFrame, chunks: DataFrame, *, tokens=words) -> DataFrame:
    """(query, variants): other wordings of each question (query, text) from what the first try found (``first``: query, id; at most some k chunks a question): its ``FEEDBACK``
    likeliest words that the question hasn't, by the mean of their shares in these chunks (a relevance model), ties by the word. The question with the first half of them, they alone, and the
    question with all; a question that found nothing has no other wording than its own.
    """
    asked = questions.select("query", F.col("text").alias("question"), F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("own"))
    found = chunks.select("id", tokens(F.coalesce("text", F.lit(""))).alias("w")).join(first.select("query", "id").distinct(), "id").join(asked.select("query", "own"), "query")
    each = found.where(F.size("w") > 0).select("query", "own", (1 / F.size("w")).alias("share"), F.explode("w").alias("term")).where(~F.array_contains("own", F.col("term")))
    weights = each.groupBy("query", "term").agg(F.round(F.sum("share"), 9).alias("score"))
    likely = search.top(weights, FEEDBACK, ident="term").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("terms"))
    half = F.array_join(F.slice("terms", 1, FEEDBACK // 2), " ")
    every = F.array_join("terms", " ")
    variants = F.when(F.col("terms").isNull(), F.array("question")).otherwise(F.array(F.concat_ws(" ", "question", half), every, F.concat_ws(" ", "question", every)))
    return asked.join(likely, "query", "left").select("query", variants.alias("variants"))


def rephrased(questions: DataFrame) -> DataFrame:
    """(query, variants): other wordings by the model of the task ``rephrase``."""
    return questions.select("query", models.rephrasings(models.run("rephrase", F.col("text"))).alias("variants"))


def sources_of_variants(questions: DataFrame, chunks: DataFrame, legs: list[tuple[Leg, float]], k: int, wordings: DataFrame | None = None) -> DataFrame:
    """The k best sources of other wordings (query, variants) of each question, each of them searched and graded on its own."""
    wordings = rephrased(questions) if wordings is None else wordings
    variants = wordings.select(F.col("query").alias("asked"), F.posexplode("variants").alias("n", "text"))
    variants = variants.select(F.struct("asked", "n").alias("query"), "text")
    found = once_each(sources(variants.withColumn("query", F.to_json("query")), chunks, legs, k).withColumn("query", F.get_json_object("query", "$.asked")))
    kind = dict(questions.dtypes)["query"]
    order = Window.partitionBy("query").orderBy(F.desc("grade"), F.desc("score"), "id")
    return found.withColumn("query", F.col("query").cast(kind)).drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answered(questions: DataFrame, chunks: DataFrame, legs: list[tuple[Leg, float]], k: int = 5, *, least_grade: int = 2, most_bytes: int = 65_536) -> DataFrame:
    """A row a question: query, retrieves, sources (array of rank, id, title, grade, score), context, prompt.

    ``chunks``: id, doc_id, chunk_index, title, text. ``legs`` rank what they are given by its words or its vector; what they embed is the imagined answer (task ``hyde``) if they
    ask for it. A question whose best source is under ``least_grade``, or that has none, is asked once more in other words: those of the model for ``rephrase`` if there is one, else by ``feedback`` from what it found. One that needs no corpus, or finds nothing, has no sources and an
    empty context.
    """
    asked = written(gated(questions, 0 if chunks.isEmpty() else 1), "asked")
    wanted = asked.where("retrieves").select("query", "text")
    first = written(sources(wanted, chunks, legs, k), "sources")
    good = first.groupBy("query").agg(F.max("grade").alias("best")).where(F.col("best") >= least_grade)
    poor = written(wanted.join(good, "query", "left_anti"), "poor")
    found = first
    if not poor.isEmpty():
        wordings = feedback(poor, first, chunks) if models.TASKS["rephrase"] is models.as_it_is else rephrased(poor)
        both = once_each(first.join(poor.select("query"), "query").unionByName(sources_of_variants(poor, chunks, legs, k, written(wordings, "wordings"))))
        order = Window.partitionBy("query").orderBy(F.desc("grade"), F.desc("score"), "id")
        again = both.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = first.join(poor.select("query"), "query", "left_anti").unionByName(again.select(first.columns))
    found = beside(found, "found")
    # Titles and places of at most k chunks a question.
    placed = chunks.select("id", "doc_id", "chunk_index", F.coalesce("title", F.lit("Unknown")).alias("title")).join(found, "id")
    listed = placed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "grade", "score"))).alias("sources"))
    contexts = search.context(placed.select("query", "doc_id", "chunk_index", "rank"), chunks, most_bytes)
    out = asked.join(listed, "query", "left").join(contexts, "query", "left")
    context = F.coalesce("context", F.lit(""))
    return out.select("query", "retrieves", F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType)).alias("sources"), context.alias("context"), answer_prompt(context, F.col("text")).alias("prompt"))


def answered_from_trees(questions: DataFrame, nodes: DataFrame, chunks: DataFrame, legs: list[tuple[Leg, float]], k: int = 5, *, most_bytes: int | None = 65_536, **how) -> DataFrame:
    """A row a question (query, doc_id, text, vector) about one document: query, from_tree, sources (array of rank, level, id, title, score), context, prompt.

    Where the document has a summary tree (``nodes``, see ``raptor.tree``), its k nearest nodes and chunks are the sources, unsure nodes giving way to their children, and their texts, joined by blank
    lines in order of score, level and id, the context, cut at ``most_bytes`` (None: whole); a node's title is "RAPTOR Summary". Other questions are ``answered`` as usual, over all chunks.
    """
    has = questions.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
    found = beside(raptor.retrieve(nodes, chunks, has.select("query", "doc_id", "vector"), k), "retrieved")
    own = nodes.select("doc_id", "level", "id", F.col("summary").alias("passage"), F.lit("RAPTOR Summary").alias("title")).unionByName(chunks.select("doc_id", F.lit(0).alias("level"), "id", F.col("text").alias("passage"), F.coalesce("title", F.lit("Unknown")).alias("title")))
    texts = found.join(own, ["doc_id", "level", "id"])
    listed = texts.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "level", "id", "title", "score", "passage"))).alias("s"))
    context = F.array_join(F.transform("s", lambda x: F.coalesce(x["passage"], F.lit(""))), "\n\n")
    context = context if most_bytes is None else prefix_of_bytes(context, most_bytes)
    ranked = F.transform("s", lambda x, i: F.struct((i + 1).alias("rank"), x["level"].alias("level"), x["id"].alias("id"), x["title"].alias("title"), x["score"].alias("score")))
    from_tree = has.join(listed, "query", "left").select("query", "text", F.lit(True).alias("from_tree"), F.coalesce(ranked, F.array().cast("array<struct<rank:int,level:int,id:bigint,title:string,score:double>>")).alias("sources"), F.coalesce(context, F.lit("")).alias("context"))
    rest = written(questions.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti"), "without-tree")
    out = from_tree.select("query", "from_tree", "sources", "context", answer_prompt(F.col("context"), F.col("text")).alias("prompt"))
    if rest.isEmpty():
        return out
    usual = answered(rest.select("query", "text"), chunks, legs, k, **how)
    plain = F.transform("sources", lambda x: F.struct(x["rank"].alias("rank"), F.lit(0).alias("level"), x["id"].alias("id"), x["title"].alias("title"), x["score"].alias("score")))
    return out.unionByName(usual.select("query", F.lit(False).alias("from_tree"), plain.alias("sources"), "context", "prompt"))


def build_missing_trees(documents: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The trees of the wholly enriched documents (doc_id, chunk_count, enriched_count) that have none yet, all at once."""
    wanted = written(lifecycle.without_tree(documents, nodes.select("doc_id").distinct()).select("doc_id"), "without-tree")
    return raptor.tree(chunks.join(wanted, "doc_id", "left_semi"))


def podcast_lines(contexts: DataFrame, turns: int = 8) -> DataFrame:
    """(query, i, speaker, voice, text): what two speakers say about each context (query, context), by the model of the task ``podcast``; an answer that has lines without speaker or text gives none."""
    raw = models.run("podcast", F.col("context"), F.lit(turns))
    said = contexts.select("query", F.posexplode(jsons.dialogue(raw, F.lit("A"), F.lit("a"), F.lit("b"))).alias("i", "x"))
    return said.select("query", "i", "x.speaker", "x.voice", "x.text")


def podcasts(lines: DataFrame) -> DataFrame:
    """(query, n_lines, seconds, audio): the lines of each query, made ready for speech, said by the model of the task ``tts`` and joined to one file, in order. A podcast has a few lines."""
    said = lines.select("query", "i", models.run("tts", speech.speakable(F.col("text")), F.col("voice")).alias("signal"))
    whole = said.groupBy("query").agg(F.count("*").alias("n_lines"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "signal"))), lambda s: s["signal"])).alias("x"))
    return whole.select("query", "n_lines", F.round(F.size("x") / audio.RATE, 3).alias("seconds"), audio.wav_of(F.col("x")).alias("audio"))


def word_leg(chunks: DataFrame, k: int, *, tokens=words) -> Leg:
    """BM25 over the chunks' own words, of the question as it's asked."""
    return lambda questions: search.bm25(chunks, questions, k, ident="id", tokens=tokens).select("query", "id", "rank")


def vector_leg(vectors_of: DataFrame, k: int, *, ident: str = "id", vector: str = "vector") -> Leg:
    """The nearest of some (id, vector) to the embedded imagined answer."""
    return lambda questions: search.nearest(vectors_of, questions.select("query", models.run("embed", models.run("hyde", F.col("text"))).alias("vector")), k, ident=ident, vector=vector).select("query", "id", "rank")


def of_kinds(*rows: tuple[str, DataFrame]) -> DataFrame:
    """(id, vector) of several kinds under one ranking: ids become "kind:id"."""
    parts = [df.select(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("id"), "vector") for kind, df in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
