"""Text logs of recorded signals and scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.functions import naming
from slicewise.operators.joins import join_small
from slicewise.sinks.tables import landed


def _lines(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Text lines with the run they belong to. A run is one file or one folder of part files
    named ``<run>.<extension>``. The metadata column escapes paths, listings do not."""
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select("value", naming.run_of(naming.decoded(F.col("_metadata.file_path")), extension).alias("run"))
            .filter("run IS NOT NULL"))


def scan_signal_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Declarations (run, vec_id, module, signal) and samples (run, vec_id, t, v).

    A declaration is a line ``vector <id> <module> <signal>:vector ...``; a sample is a line of
    at least four tab-separated fields that starts with a digit. Lines and values that do not
    parse are left out.
    """
    return split_parts(_parsed(spark, path))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """Declarations and samples of the log in one table, told apart by ``kind``."""
    text = F.col("value")
    cut = _lines(spark, path, "vec").select(
        "run", F.when(text.startswith("vector "), F.split(F.trim(text), r"\s+")).alias("w"),
        F.when(text.substr(1, 1).between("0", "9"), F.split(text, "\t")).alias("f"))
    w, f = F.col("w"), F.col("f")
    t, v = _number(F.get(f, F.lit(2))), _number(F.get(f, F.lit(3)))
    kind = F.when(F.size(w) >= 4, "declaration").when(t.isNotNull() & v.isNotNull(), "sample")
    return cut.select(
        "run", kind.alias("kind"),
        F.coalesce(F.get(w, F.lit(1)), F.get(f, F.lit(0))).alias("vec_id"),
        F.get(w, F.lit(2)).alias("module"),
        F.substring_index(F.get(w, F.lit(3)), ":", 1).alias("signal"),
        t.alias("t"), v.alias("v")).filter("kind IS NOT NULL")


def split_parts(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (parsed.filter("kind = 'declaration'").select("run", "vec_id", "module", "signal"),
            parsed.filter("kind = 'sample'").select("run", "vec_id", "t", "v"))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def relevant_vectors(declarations: DataFrame) -> DataFrame:
    """Declarations that count, with slice, cell and scenario."""
    d = declarations.filter(naming.is_relevant(F.col("module"), F.col("signal")))
    return d.withColumns({"slice": naming.slice_of(F.col("module")),
                          "gnb": naming.cell_of(F.col("module")),
                          "scenario": naming.scenario_of(F.col("run"))})


def attach_keys(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """Samples of the relevant vectors. Ids are local to a run, so the run is part of the key.
    The declarations are few beside the samples; counted first, they are broadcast so that the
    samples are not shuffled before they are aggregated."""
    return join_small(samples, vectors, ["run", "vec_id"])


def land_signal_log(spark: SparkSession, path: str, only_relevant: bool = False
                    ) -> tuple[DataFrame, DataFrame]:
    """Keep the parsed log as Parquet by run: later scans read only the columns they need.

    With ``only_relevant`` the declarations are landed first and of the samples only those of
    vectors that count, at the price of a second pass over the text; without it everything is
    kept in one pass.
    """
    if not only_relevant:
        return split_parts(landed(_parsed(spark, path), "signals", "kind", "run"))
    declarations, samples = split_parts(_parsed(spark, path))
    declarations = landed(declarations, "declarations", "run")
    wanted = landed(relevant_vectors(declarations).select("run", "vec_id"), "relevant")
    return declarations, landed(join_small(samples, wanted, ["run", "vec_id"]), "samples", "run")


def scan_scalar_log(spark: SparkSession, path: str) -> DataFrame:
    """Scalars (run, module, name, value); nan and infinities become null."""
    w = F.split(F.trim("value"), r"\s+")
    value = _number(F.col("w")[3])
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return (_lines(spark, path, "sca").filter(F.ltrim("value").startswith("scalar "))
            .withColumn("w", w).filter(F.size("w") >= 4)
            .select("run", F.col("w")[1].alias("module"), F.col("w")[2].alias("name"),
                    F.when(~bad, value).alias("value")))


def scalar_totals(scalars: DataFrame) -> DataFrame:
    """Sent, received, bytes and lost totals per slice and cell."""
    s = scalars.filter("value IS NOT NULL").withColumns({
        "slice": naming.slice_of(F.col("module")), "gnb": naming.cell_of(F.col("module"))})

    def total(name: str, *tokens: str) -> Column:
        hit = F.col("name").contains(tokens[0])
        for t in tokens[1:]:
            hit = hit | F.col("name").contains(t)
        return F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0.0)).alias(name)
    return (s.filter("slice IS NOT NULL").groupBy("slice", "gnb").agg(
        total("sent", "packetSent:count", "cbrSentPkt:count"),
        total("received", "packetReceived:count", "cbrRcvdPkt:count"),
        total("bytes", "packetReceived:sum(packetBytes)"),
        total("lost", "cbrFrameLoss:sum")))


def run_catalog(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """Runs with a signal log, their scenario and whether a scalar log goes with them. Lists
    files only: the content column of the listing is never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path"))
    runs = files.select(naming.run_of(F.col("path"), "vec").alias("run")).filter("run IS NOT NULL")
    if prefix:
        runs = runs.filter(F.col("run").startswith(prefix))
    runs = runs.groupBy("run").agg(F.count("*").alias("n_files"))
    sca = (files.select(naming.run_of(F.col("path"), "sca").alias("run")).filter("run IS NOT NULL")
           .distinct().withColumn("has_scalars", F.lit(True)))
    return (runs.join(sca, "run", "left")
            .select("run", naming.scenario_of(F.col("run")).alias("scenario"), "n_files",
                    F.coalesce("has_scalars", F.lit(False)).alias("has_scalars")))
