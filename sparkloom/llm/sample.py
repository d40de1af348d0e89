"""Bounded samples of labelled rows: what a classifier may be fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_counts(labels: DataFrame) -> dict[str, int]:
    """Rows of each label of (id, label), label as text."""
    return {r["label"]: r["count"] for r in labels.where("label is not null and id is not null").groupBy("label").count().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, counts: dict[str, int], *, id_col: str, text_col: str, per_label: int, most_chars: int) -> list[tuple[str, str]]:
    """(label, text) of the ``per_label`` documents a label whose ids hash lowest, among those with a text; texts of more than ``most_chars`` characters
    come after all others and are cut to so many.

    ``labels``: id, label (text). Ids are chosen without texts: a threshold on the hash, from the label's count, leaves some four times ``per_label`` rows a label for
    the exact ranks, of which nulls and empty texts are left out. At most labels x ``per_label`` x ``most_chars`` characters reach the driver.
    """
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, 4.0 * per_label / n)])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    near = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("h", place).where(F.col("h") < F.element_at(share, F.col("label"))).distinct()
    text = F.col(text_col)
    texts = docs.where(F.length(text) > 0).select(F.col(id_col).alias("id"), (F.length(text) > most_chars).alias("long"), F.substring(text, 1, most_chars).alias("text"))
    # At most some four times per_label ids a label.
    order = Window.partitionBy("label").orderBy("long", "h", "id", F.xxhash64("text"))
    chosen = texts.join(F.broadcast(near), "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    return [(r["label"], r["text"]) for r in sorted(chosen.select("label", "rank", "text").collect(), key=lambda r: (r["label"], r["rank"]))]


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
