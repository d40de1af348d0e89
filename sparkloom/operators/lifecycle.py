"""Documents, chunks and what hangs on them as tables: upserts, deletes, enrichment, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordered import with_row_number


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows over ``old`` ones of the same key; one row a key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def without_documents(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table less the rows of some documents: nothing is left hanging."""
    keys = gone.select(key).distinct()
    return {name: df.join(keys, key, "left_anti") for name, df in tables.items()}


def waiting_for_enrichment(chunks: DataFrame, n: int) -> DataFrame:
    """The first n chunks that have a vector and no enriched text."""
    return chunks.where("enriched_text is null and embedding is not null").orderBy("doc_id", "chunk_index").limit(n)


def best_vector(chunks: DataFrame) -> DataFrame:
    """Chunks that can be searched, by their enriched vector where there is one."""
    return chunks.withColumn("vector", F.coalesce("enriched_embedding", "embedding")).where("vector is not null")


def listed(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunk counts and phase; counts are derived, never kept."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.count("enriched_text").alias("enriched_count"))
    phase = F.when((F.col("enriched_count") >= F.col("chunk_count")) & (F.col("chunk_count") > 0), "phase2_complete").when(F.col("enriched_count") > 0, "phase2_in_progress").otherwise("phase1_complete")
    both = documents.join(counts, "doc_id", "left").fillna(0, ["chunk_count", "enriched_count"])
    return both.withColumn("phase", phase)


def without_tree(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Wholly enriched documents that no summary tree stands for."""
    return documents.where("enriched_count >= chunk_count and chunk_count > 0").join(nodes.select("doc_id"), "doc_id", "left_anti")


def in_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows by a list of ids (rank, key): in the list's order, an id as often as it's listed, unknown ones dropped."""
    return rows.join(ids, key).orderBy("rank")


def merged_catalogs(builtin: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """Both, the built-in row where they clash."""
    return builtin.unionByName(custom.join(builtin.select(key), key, "left_anti"))


def removed(builtin: DataFrame, custom: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """(the custom rows that stay): those of some keys go; built-in rows can't be removed, and keys that aren't there are passed over."""
    return custom.join(gone.select(key).join(builtin.select(key), key, "left_anti"), key, "left_anti")


def changes(found: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action): what to insert, update or delete so that ``known`` becomes ``found``."""
    both = found.select(key, F.col(value).alias("__new")).withColumn("__found", F.lit(True)).join(known.select(key, F.col(value).alias("__old")).withColumn("__known", F.lit(True)), key, "full")
    action = F.when(F.col("__known").isNull(), "insert").when(F.col("__found").isNull(), "delete").when(~F.col("__new").eqNullSafe(F.col("__old")), "update").otherwise("keep")
    return both.select(key, action.alias("action"))


def by_priority(rows: DataFrame, task: str, n: int) -> DataFrame:
    """The first n rows whose tasks hold ``task``, with their rank: by its own priority where there is one, then the row's, then the name."""
    own = F.coalesce(F.try_element_at("task_priorities", F.lit(task)), F.col("priority"))
    best = rows.where(F.array_contains("tasks", task)).withColumn("__own", own).orderBy(F.desc("__own"), "name").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__own"), "name"))).drop("__own")


def matched_by_path(refs: DataFrame, models: DataFrame) -> DataFrame:
    """(ref, model_id): by id, else by normal path, else by base name; the smallest id among several. Three equi-joins, no OR."""
    from sparkloom.functions.text import basename

    normal = lambda c: F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    exact = refs.join(models.select(F.col("model_id").alias("ref"), F.col("model_id").alias("a")), "ref", "left")
    by_path = models.groupBy(normal("path").alias("p")).agg(F.min("model_id").alias("b"))
    by_base = models.groupBy(basename(F.col("path")).alias("n")).agg(F.min("model_id").alias("c"))
    out = exact.withColumns({"p": normal("ref"), "n": basename(F.col("ref"))}).join(by_path, "p", "left").join(by_base, "n", "left")
    return out.select("ref", F.coalesce("a", "b", "c").alias("model_id"))


def inserted_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` chunks (doc_id, position, text) after a document's old ones (doc_id, chunk_index, text): keys are (doc_id, chunk_index), numbered on by position, the same in every run."""
    last = old.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("from"))
    placed = with_row_number(new, ["doc_id"], ["position"], "place")
    keyed = placed.join(last, "doc_id", "left").select("doc_id", (F.col("place") - 1 + F.coalesce("from", F.lit(0))).cast("int").alias("chunk_index"), "text")
    return old.select("doc_id", "chunk_index", "text").unionByName(keyed)


def with_values(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``values`` set where a row of theirs has the same keys, as they were elsewhere; a null there sets nothing."""
    named = values.select(*keys, *[F.col(c).alias(f"__{c}") for c in values.columns if c not in keys])
    joined = rows.join(named, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in named.columns else F.col(c) for c in rows.columns])


def without_vector(media: DataFrame) -> DataFrame:
    """Media that wait for a vector: a caption and no embedding."""
    return media.where("embedding is null and caption <> ''")


def of_media(elements: DataFrame) -> DataFrame:
    """Parsed elements that are images or tables."""
    return elements.where(F.lower("kind").isin("image", "table"))


def newest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows, the smaller key first among those of one time."""
    return rows.orderBy(F.desc(at), F.asc(key)).limit(n)


def unregistered(found: DataFrame, registered: DataFrame) -> DataFrame:
    """Found units (rel_path, abs_path, repo_id) that are registered under none of their names (token): relative or absolute path, base name, repository; one row a path.

    Names are in lower case with forward slashes; a unit's are rows of one anti join's list, not an OR.
    """
    from sparkloom.functions.text import basename

    normal = lambda c: F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    names = F.array(normal("rel_path"), normal("abs_path"), basename(F.col("rel_path")), F.lower("repo_id"))
    known = found.select("abs_path", F.explode(names).alias("token")).join(registered.select(normal("token").alias("token")).distinct(), "token", "left_semi").select("abs_path").distinct()
    return latest(found.join(known, "abs_path", "left_anti"), "abs_path", "rel_path", "repo_id")
