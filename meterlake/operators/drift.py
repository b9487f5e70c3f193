"""Drift of record formats: what live records have that a stored corpus of shapes lacks, and the other way round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facts(shapes: DataFrame, by: str) -> DataFrame:
    """record_shapes -> (by, what, name, records): each field, kind and shape of a source. Fields and kinds count the records of all shapes that have them."""
    each = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    rest = F.filter(F.array(each("kind", F.col("kind")), each("shape", F.col("shape"))), lambda x: x["name"].isNotNull())
    fields = F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda f: each("field", f))
    return shapes.select(by, "records", F.explode(F.concat(fields, rest)).alias("f")).groupBy(by, "f.what", "f.name").agg(F.sum("records").alias("records"))


def findings(live: DataFrame, corpus: DataFrame, by: str, live_classes: DataFrame | None = None, known_classes: DataFrame | None = None) -> DataFrame:
    """(by, what, name, status, records): every fact of live records beside those of the corpus.

    live and corpus are record_shapes by source. Classes of evidence, where
    given, are (by, name) and (by, name, records) live. status is new (not in the
    corpus), missing (there only; records is 0) or known. Rows, not arrays: keys
    that are ids give any number of paths.
    """
    seen, known = facts(live, by), facts(corpus, by)
    if live_classes is not None:
        seen = seen.unionByName(live_classes.groupBy(by, "name").agg(F.sum("records").alias("records")).withColumn("what", F.lit("class")))
    if known_classes is not None:
        known = known.unionByName(known_classes.select(by, "name", F.lit("class").alias("what"), F.lit(0).cast("bigint").alias("records")))
    both = seen.withColumns({"live": F.lit(True), "kept": F.lit(False)}).unionByName(known.withColumns({"live": F.lit(False), "kept": F.lit(True)}))
    merged = both.groupBy(by, "what", "name").agg(F.max("live").alias("live"), F.max("kept").alias("kept"), F.coalesce(F.sum(F.when(F.col("live"), F.col("records"))), F.lit(0)).alias("records"))
    status = F.when(~F.col("kept"), "new").when(~F.col("live"), "missing").otherwise("known")
    return merged.select(by, "what", "name", status.alias("status"), "records")


def report(live: DataFrame, found: DataFrame, by: str, quarantine: DataFrame | None = None) -> DataFrame:
    """(by, records, unreadable, quarantined, new_fields, new_kinds, new_classes, new_shapes, missing, drift): a row for each source with records or findings.

    quarantine is (by, class, n). A source drifts if live records have anything
    new or if any is quarantined; what is only missing is no drift.
    """
    new = lambda what: F.count_if((F.col("what") == what) & (F.col("status") == "new"))
    counted = found.groupBy(by).agg(new("field").alias("new_fields"), new("kind").alias("new_kinds"), new("class").alias("new_classes"), new("shape").alias("new_shapes"), F.count_if(F.col("status") == "missing").alias("missing"))
    read = live.groupBy(by).agg(F.sum("records").alias("records"), F.sum(F.when(F.col("shape").isNull(), F.col("records")).otherwise(0)).alias("unreadable"))
    out = read.join(counted, by, "full")
    if quarantine is not None:
        out = out.join(quarantine.groupBy(by).agg(F.sum("n").alias("quarantined")), by, "full")
    else:
        out = out.withColumn("quarantined", F.lit(0))
    names = ["records", "unreadable", "quarantined", "new_fields", "new_kinds", "new_classes", "new_shapes", "missing"]
    out = out.select(by, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])
    return out.withColumn("drift", F.col("quarantined") + F.col("new_fields") + F.col("new_kinds") + F.col("new_classes") + F.col("new_shapes") > 0)
