"""Model catalogs and devices as tables: discovery, status, routing candidates, alternatives; boxes of ruled tables; pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that run in the background, and those whose worker ends with them.
BACKGROUND, EPHEMERAL = ("embed", "classify", "enrich", "grade", "hyde"), ("enrich", "grade", "hyde")

#: Quantizations that cost much; for a size class, whether only with one of these, from and under how many GB of memory, what runs better, and why. The first row that fits counts.
HEAVY = ("Q8", "F16", "F32")
ALTERNATIVES = [
    ("70B", False, 16, 1e9, "13B Q4", "Similar quality for most tasks, much faster"),
    ("70B", False, 0, 16, "7B Q4", "Good quality, runs well on most systems"),
    ("30B", False, 12, 1e9, "13B Q4", "Better performance with similar capability"),
    ("30B", False, 0, 12, "7B Q4", "Good balance of quality and speed"),
    ("13B", True, 0, 1e9, "13B Q4", "Same model, much smaller footprint"),
    ("13B", False, 0, 12, "7B Q4", "Lighter model that fits your RAM"),
    ("7B", True, 0, 1e9, "7B Q4", "Same model, better performance"),
    ("7B", False, 0, 8, "3B Q4", "Smaller model that fits your RAM"),
]
#: Points of what a process shows, and tools that start applications.
APP_SCORES = {"built": 200, "product": 120, "named": 80, "tool": -200, "wrapper": -50, "below": 10}
TOOLS = ("bash", "node", "npm", "npx", "cargo", "rustc", "vite", "esbuild")


def discovered(files: DataFrame) -> DataFrame:
    """(folder, model, projector) of (path, size) rows: the largest model file of each folder, and the largest projector; folders without a model are left out."""
    f = files.where(F.lower("path").endswith(".gguf")).withColumns({"folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "file": F.regexp_extract("path", r"([^/]*)$", 1)})
    projector = F.lower("file").contains("mmproj")
    largest = lambda c: F.max_by(F.when(c, F.col("file")), F.when(c, F.struct(F.col("size"), F.col("file"))))
    return f.groupBy("folder").agg(largest(~projector).alias("model"), largest(projector).alias("projector")).where("model is not null")


def statuses(instances: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, status, memory): unloaded without instances, ready with a ready one, else loading; memory is a model's times its instances."""
    by = instances.groupBy("model_id").agg(F.count("*").alias("n"), F.bool_or(F.col("state") == "ready").alias("ready"))
    both = models.join(by, "model_id", "left")
    status = F.when(F.col("n").isNull(), "unloaded").when(F.col("ready"), "ready").otherwise("loading")
    return both.select("model_id", status.alias("status"), (F.coalesce("n", F.lit(0)) * F.col("memory_mb")).alias("memory_mb"))


def least_busy(instances: DataFrame) -> DataFrame:
    """The instance of fewest requests of each model, the smaller id on a tie."""
    return instances.groupBy("model_id").agg(F.min(F.struct("requests", "instance_id"))["instance_id"].alias("instance_id"))


def reapable(instances: DataFrame, now: Column, idle_seconds: float) -> DataFrame:
    """Broken instances, and ephemeral ones that have been idle for too long."""
    return instances.where((F.col("state") == "error") | (F.col("ephemeral") & (F.col("requests") == 0) & (now - F.col("last_used") >= idle_seconds)))


def candidates(static: Column, dynamic: Column, override: Column) -> Column:
    """Model ids to try: the override alone, else the static ones and then the dynamic, each once."""
    return F.when(override.isNotNull(), F.array(override)).otherwise(F.array_distinct(F.concat(static, dynamic)))


def task_priority(task: Column) -> Column:
    return F.when(task.isin(*BACKGROUND), "low").otherwise("high")


def is_ephemeral(task: Column) -> Column:
    return task.isin(*EPHEMERAL)


def alternative(params: Column, quant: Column, ram_gb: Column) -> Column:
    """struct(suggestion, reason): a model that would run better, by the first row of ``ALTERNATIVES`` that fits; null where there is none."""
    out = F
    for size, heavy, least, most, better, why in ALTERNATIVES:
        fits = (params == size) & (quant.isin(*HEAVY) if heavy else F.lit(True)) & (ram_gb >= least) & (ram_gb < most)
        out = out.when(fits, F.struct(F.lit(better).alias("suggestion"), F.lit(why).alias("reason")))
    return out


def app_score(name: Column, command: Column, is_root: Column, app: str = "app", product: str | None = None) -> Column:
    """How much a process looks like the application (its name, and a word of its product in commands) rather than a tool that started it: the sum of the ``APP_SCORES`` that hold."""
    signals = {
        "built": command.contains(f"/target/debug/{app}"),
        "product": command.contains(product) if product else F.lit(False),
        "named": name.isin(app, *([product] if product else [])),
        "tool": name.isin(*TOOLS),
        "wrapper": command.contains("tauri") & name.isin("node", "bash"),
        "below": ~is_root,
    }
    total = F.lit(0)
    for signal, points in APP_SCORES.items():
        total = total + F.when(signals[signal], points).otherwise(0)
    return total


def cold_start_seconds(start_ms: Column, ready_ms: Column, start_s: Column, ready_s: Column) -> Column:
    """By the application's own marks, else by the clock."""
    return F.when(start_ms.isNotNull() & ready_ms.isNotNull(), F.greatest(F.lit(0.0), (ready_ms - start_ms) / 1000.0)).when(start_s.isNotNull() & ready_s.isNotNull(), F.greatest(F.lit(0.0), ready_s - start_s))


def table_boxes(shapes: DataFrame, *, gap: float = 100.0) -> DataFrame:
    """(page, box, x1, y1, x2, y2): where runs of three and more horizontal rules of a page (four at least) stand; shapes: page, x1, y1, x2, y2."""
    from sparkloom.operators.runs import gap_groups

    flat = shapes.where("x2 - x1 > 50 and y2 - y1 < 3")
    rules = flat.join(flat.groupBy("page").count().where("count >= 4").select("page"), "page")
    by = gap_groups(rules, by="page", at="y1", gap=gap).groupBy("page", F.col("run").alias("box"))
    return by.agg(F.count("*").alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).where("n >= 3").drop("n")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def labelled(logits: Column, labels: list[str]) -> Column:
    """struct(label, confidence): the last of the largest; a class without a name is class_i."""
    p = softmax(logits)
    at = F.size(p) - F.array_position(F.reverse(p), F.array_max(p)).cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    return F.struct(F.coalesce(F.get(names, at), F.concat(F.lit("class_"), at.cast("string"))).alias("label"), F.array_max(p).alias("confidence"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def page_of(rows: DataFrame, order: list, page: int, size: int = 5) -> DataFrame:
    """A page of ordered rows, from 0: the rows up to its end, then those past its beginning."""
    return rows.orderBy(*order).offset(page * size).limit(size)


def retry_seconds(attempt: Column) -> Column:
    """Doubling from 2 s, at most 32."""
    return F.lit(2) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(4)))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """What is left at the pace so far; null before the first."""
    return F.when(done > 0, elapsed / done * (total - done)).otherwise(F.lit(None).cast("double"))


def standardized_bands(bands: DataFrame, *, by: str = "band", value: str = "value") -> DataFrame:
    """Adds z: how many deviations (of the population, and 1e-5) a value is from its band's mean; the means are joined back, so a band of any size is dealt out."""
    stats = bands.groupBy(by).agg(F.avg(value).alias("__m"), F.sqrt(F.var_pop(value)).alias("__s"))
    return bands.join(stats, by).withColumn("z", (F.col(value) - F.col("__m")) / (F.col("__s") + 1e-5)).drop("__m", "__s")
