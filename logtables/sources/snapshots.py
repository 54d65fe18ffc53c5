"""Landed metric documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("node_stats", "cat_shards", "index_stats", "indices", "cluster_health", "cluster_stats")


def read_snapshots(
    spark: SparkSession,
    path: str,
    kind: str,
    whole_files: bool = False,
    cluster_id: str | None = None,
    cluster_uuid: str | None = None,
) -> DataFrame:
    """Documents of one kind, one per line or one per file, as ``doc`` variants.

    ``snapshot`` names the document by its file and content, ``timestamp`` is its own
    or the time it landed; the cluster is the one given, else what the document says.
    Texts that are no JSON come back with ``doc`` null and their ``raw`` text.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    reader = spark.read.option("recursiveFileLookup", True)
    texts = reader.text(path, wholetext=True) if whole_files else reader.text(path, lineSep="\n")
    doc = F.try_parse_json("value")
    said = lambda name: F.try_variant_get(doc, f"$.{name}", "string")
    landed = F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss.SSSX")
    return texts.filter(F.trim("value") != "").select(
        F.lit(kind).alias("kind"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").alias("landed"),
        F.md5(F.concat_ws(":", F.col("_metadata.file_path"), F.col("value"))).alias("snapshot"),
        F.coalesce(F.lit(cluster_id), said("cluster_name")).alias("cluster_id"),
        F.coalesce(F.lit(cluster_uuid), said("cluster_uuid")).alias("cluster_uuid"),
        F.coalesce(said("timestamp"), landed).alias("timestamp"),
        doc.alias("doc"),
        F.when(doc.isNull(), F.col("value")).alias("raw"),
    )
