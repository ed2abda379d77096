"""Framework detection: signals from dependencies, file names and sources, summed to a confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.sources import dims

SIGNAL = ["project", "framework", "description", "file", "weight"]


def _base(c: str = "path"):
    return F.regexp_extract(c, r"([^/]*)$", 1)


def _ext(c: str = "path"):
    return F.regexp_extract(c, r"(\.[^./]*)$", 1)


def dependency_signals(files: DataFrame) -> DataFrame:
    """From the first package.json of each project; a dev dependency overrides a dependency of its name."""
    dim = files.sparkSession.createDataFrame(dims.DEPENDENCY_SIGNS, "dep string, framework string, weight double")
    one = files.where(_base() == "package.json").withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy("ord", "path"))).where("rn = 1")
    kind = "map<string,string>"
    j = one.select("project", F.from_json("content", f"dependencies {kind}, devDependencies {kind}").alias("j"))
    none = F.create_map().cast(kind)
    dev = F.coalesce("j.devDependencies", none)
    merged = F.map_concat(F.map_filter(F.coalesce("j.dependencies", none), lambda k, v: ~F.map_contains_key(dev, k)), dev)
    deps = j.select("project", F.explode(merged).alias("dep", "version")).join(F.broadcast(dim), "dep")
    text = F.concat(F.lit("dependency: "), "dep", F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise(""))
    return deps.select("project", "framework", text.alias("description"), F.lit("package.json").alias("file"), "weight")


def _signs(files: DataFrame, rows, test) -> DataFrame:
    """One signal for each (file, sign) that fits, from an unrolled array of literal tests."""
    hits = F.filter(F.array(*[F.when(test(r), F.struct(F.lit(f).alias("framework"), F.lit(d).alias("description"), F.lit(w).alias("weight"))) for r, f, d, w in rows]), lambda x: x.isNotNull())
    return files.select("project", "path", "ord", F.explode(hits).alias("s")).select("project", "s.framework", "s.description", F.col("path").alias("file"), "s.weight", "ord")


def config_signals(files: DataFrame) -> DataFrame:
    return _signs(files, dims.CONFIG_SIGNS, lambda r: _base().rlike(r)).select(*SIGNAL)


def extension_signals(files: DataFrame) -> DataFrame:
    """The first file of each extension in a project."""
    found = _signs(files, dims.EXTENSION_SIGNS, lambda r: _ext() == r)
    w = Window.partitionBy("project", "framework", "description").orderBy("ord", "file")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*SIGNAL)


def source_signals(files: DataFrame) -> DataFrame:
    """One signal for each source file and expression."""
    rows = [(r, f, d, w) for f, r, d, w in dims.source_signs()]
    src = files.where(F.lower(_ext()).isin(*dims.SOURCE_EXTENSIONS) & (F.col("content") != ""))
    return _signs(src, rows, lambda r: F.col("content").rlike("(?d)" + r)).select(*SIGNAL)


#: In the order of the detectors; one is added by adding to this.
DETECTORS = [dependency_signals, config_signals, extension_signals, source_signals]


def signals(files: DataFrame) -> DataFrame:
    """Signals of ``files`` (project, path, content, ord: the order of the files)."""
    out = None
    for d in DETECTORS:
        out = d(files) if out is None else out.unionByName(d(files))
    return out


def detect(files: DataFrame) -> DataFrame:
    """(project, framework, version, confidence, signals); the confidence is the weights' sum, 1 at most, rounded to 6."""
    g = signals(files).groupBy("project", "framework").agg(F.round(F.least(F.lit(1.0), F.sum("weight")), 6).alias("confidence"), F.array_sort(F.collect_list(F.struct("description", "file", "weight"))).alias("signals"))
    return g.where("confidence > 0").select("project", "framework", F.lit("").alias("version"), "confidence", "signals")
