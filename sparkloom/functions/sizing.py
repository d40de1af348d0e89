"""Will a model run on a device: parameters and quantization from file names, memory, compatibility. Column expressions over fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GB of 16-bit weights, and how many times the work of a 3-billion model, by size class.
FP16_GB = {"1B": 2.0, "3B": 6.0, "7B": 13.0, "13B": 26.0, "30B": 60.0, "70B": 140.0}
WORK = {"1B": 0.5, "3B": 1.0, "7B": 2.0, "13B": 4.0, "30B": 8.0, "70B": 16.0}
#: File size and speed by quantization level.
QUANT_SIZE = {"Q2": 0.25, "Q3": 0.35, "Q4": 0.5, "Q5": 0.65, "Q6": 0.75, "Q8": 1.0, "F16": 1.0, "F32": 2.0, "unknown": 0.5}
QUANT_BOOST = {"Q2": 1.6, "Q3": 1.3, "Q4": 1.0, "Q5": 0.85, "Q6": 0.75, "Q8": 0.6, "F16": 0.5, "F32": 0.3, "unknown": 1.0}
#: Name patterns of quantization levels, the first that is found counts.
QUANT_PATTERNS = [
    ("Q2", "iq[12]_"),
    ("Q3", "iq3_"),
    ("Q4", "iq4_"),
    ("Q2", r"q2[_-]k|[-_]q2\."),
    ("Q3", r"q3[_-]k|[-_]q3\."),
    ("Q4", r"q4[_-]k|q4_[01]|[-_]q4\.|-q4_"),
    ("Q5", r"q5[_-]k|q5_[01]|[-_]q5\.|-q5_"),
    ("Q6", r"q6[_-]k|[-_]q6\."),
    ("Q8", r"q8_0|q8[_-]k|[-_]q8\."),
    ("F16", "f16|fp16"),
    ("F32", "f32|fp32"),
]


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    out = None
    for result, pattern in rules:
        out = F.when(value.rlike(pattern), result) if out is None else out.when(value.rlike(pattern), result)
    return out.otherwise(otherwise)


def under(value: Column, limits: list[tuple], otherwise) -> Column:
    """The result of the first (limit, result) whose limit the value is below."""
    out = None
    for limit, result in limits:
        out = F.when(value < limit, result) if out is None else out.when(value < limit, result)
    return out.otherwise(otherwise)


def looked_up(key: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def memory_mb(size_mb: Column) -> Column:
    """1.3 times the file and 500 MB, to the nearest hundred."""
    return (F.floor((F.floor(size_mb * 1.3) + 500 + 50) / 100) * 100).cast("long")


def size_tier(size_mb: Column) -> Column:
    return under(size_mb, [(501, "tiny"), (1501, "small"), (4001, "medium"), (8001, "large")], "very_large")


def recommended_ram_gb(size_mb: Column) -> Column:
    return under(size_mb, [(501, 4), (1501, 8), (4001, 16), (8001, 32)], 64)


def quant_of(name: Column) -> Column:
    return first_match(F.lower(name), QUANT_PATTERNS, "unknown")


def billions_of(name: Column) -> Column:
    """Billions of parameters: of the plausible "7b" parts of a name, each takes over from the one before unless it's under nine tenths of it; null without any."""
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(name), r"\d+x[\dx]+", "x"), F.lit(r"(?:^|[-_ .])(\d+(?:\.\d+)?)b(?![si])"), 1)
    numbers = F.filter(F.transform(parts, lambda x: x.cast("double")), lambda x: (x >= 0.5) & (x <= 200))
    return F.aggregate(numbers, F.lit(None).cast("double"), lambda best, x: F.when(best.isNull() | (x > best * 0.9), x).otherwise(best))


def params_of(name: Column, size_gb: Column) -> Column:
    """Size class by name, else by what the file would weigh in 16 bits."""
    b, whole = billions_of(name), size_gb / looked_up(quant_of(name), QUANT_SIZE)
    by_name = under(b, [(2.5, "1B"), (5, "3B"), (10, "7B"), (20, "13B"), (50, "30B")], "70B")
    return F.when(b.isNotNull(), by_name).otherwise(under(whole, [(4, "1B"), (9.5, "3B"), (19.5, "7B"), (43, "13B"), (100, "30B")], "70B"))


def compatibility(name: Column, size_mb: Column, memory: Column, context: Column, cores: Column, avx2: Column, ram_gb: Column, disk_gb: Column) -> Column:
    """struct(params, quant, required_ram_gb, perf_score, ram_decision, rating): disk is looked at first, then memory, then speed."""
    quant, size_gb = quant_of(name), size_mb / 1024.0
    params = params_of(name, size_gb)
    ram = F.coalesce(memory, F.floor(size_gb * F.when(context >= 8192, 1.5).otherwise(1.3) * 1024)) / 1024.0
    score = cores * F.when(avx2, 1.0).otherwise(0.5) / looked_up(params, WORK) * looked_up(quant, QUANT_BOOST)
    decision = F.when(ram_gb < ram, "DO_NOT_DOWNLOAD").when(ram_gb < ram * 1.25, "NOT_RECOMMENDED").otherwise("OK")
    need = looked_up(params, FP16_GB) * looked_up(quant, QUANT_SIZE)
    rating = F.when((disk_gb < need) | (ram_gb < ram), "wontrun").otherwise(under(score, [(0.5, "notrecommended"), (1, "veryslow"), (2, "usable")], "efficient"))
    return F.struct(params.alias("params"), quant.alias("quant"), ram.alias("required_ram_gb"), score.alias("perf_score"), decision.alias("ram_decision"), rating.alias("rating"))
