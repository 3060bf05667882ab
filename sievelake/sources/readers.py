"""Readers of the source formats: JSON arrays and lines, archives of JSON, works of parallel translations, hub exports."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a revision archive: the paper's id and its version.
PAPER_MEMBER = re.compile(r"/docs/([^/]+)/v([12])\.json$")
NODES = "struct<nodes: array<struct<ntype: string, content: string>>>"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file (or a folder of files) that is one JSON array, or one object a line; blank lines are passed over.

    A file is an array if its first mark is an opening bracket. Lines are read in parallel; an array is one record to
    any reader, so whole in one task.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    first = lines.first()
    if first is not None and first[0].lstrip().startswith("["):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_paper_archive(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, version (1 or 2), nodes of every ``.../docs/<paper_id>/v<n>.json`` in the zip archives at ``path``.

    Archives are dealt to tasks one by one and their members read one after another.
    """

    def members(frames):
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [(m[1], int(m[2]), z.read(n).decode()) for n in z.namelist() if (m := PAPER_MEMBER.search("/" + n))]
                yield pd.DataFrame(found, columns=["paper_id", "version", "json"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    out = raw.mapInPandas(members, "paper_id string, version int, json string")
    return out.select("paper_id", "version", F.from_json("json", NODES)["nodes"].alias("nodes"))


WORKS = "work_id string, gt_paras array<string>, source_paras array<string>, translator_data map<string, struct<translator_paras: array<string>>>"


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works of parallel translations from Parquet or JSON lines of the schema WORKS. Pickles aren't read: loading one runs
    whatever it holds; convert it once where it is trusted."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(WORKS).parquet(path)
    return read_records(spark, path, WORKS)


def read_export(spark: SparkSession, path: str, splits: tuple[str, ...] | None = None) -> DataFrame:
    """A hub table exported as Parquet. With splits: ``path/<split>`` of each, by name, with a column ``split``; columns that a
    split lacks are null."""
    if splits is None:
        return spark.read.parquet(path)
    out = None
    for name in splits:
        part = spark.read.parquet(f"{path.rstrip('/')}/{name}").withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
