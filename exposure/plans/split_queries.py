"""Feeds written as files of large JSON objects and read in splits; the SQL is that of the whole-object readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposure.operators.tags import migrate_tags
from exposure.plans import render, source_queries  # noqa: F401 (registers the SQL)
from exposure.plans.projection import Projection
from exposure.plans.registry import ORACLES, query
from exposure.plans.stream_queries import run_folder
from exposure.sources import tags as tag_source, vulndb


def _written(p: Projection, documents: DataFrame, name: str) -> str:
    path = run_folder(p, name)
    documents.select("json").write.text(path)
    return path


@query()
def sc10_split_vuln_db(p):
    return vulndb.read_split(p.spark, _written(p, render.vuln_db_documents(p), "vuln-db")).drop("ord")


@query()
def sc15_split_tag_load(p):
    loaded = tag_source.read_split(p.spark, _written(p, render.tag_documents(p), "tags"))
    moved = migrate_tags(loaded, p.host_dim.select(F.lit(0).alias("scan_id"), "ip", "mac"), F.timestamp_seconds(F.lit(1800000000)))
    return moved.select("asset_key", F.array_join("labels", ";").alias("labels"), "owner", "last_ip", F.unix_seconds("last_seen").alias("last_seen"))


for _name, _like in {"sc10_split_vuln_db": "sc10_vuln_db", "sc15_split_tag_load": "sc15_tag_load"}.items():
    ORACLES[_name] = ORACLES[_like]
