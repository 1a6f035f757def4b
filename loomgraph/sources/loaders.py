"""Readers of documents and annotated cases, and settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "id string, raw_text string, expected_triples array<struct<subject:string,predicate:string,object:string>>, expected_jsonld variant"
ANNOTATED_SCHEMA = (
    "id string, title string, sents array<array<string>>, "
    "vertexSet array<array<struct<name:string,sent_id:int,pos:array<int>,type:string>>>, labels array<struct<h:int,t:int,r:string,evidence:array<int>>>"
)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files [SRC1, SRC2]."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Sentence-level cases from a JSON array or JSON lines [SRC13]."""
    return spark.read.json(path, schema=CASE_SCHEMA, multiLine=True)


def annotated_documents(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents from a JSON array [SRC14], with doc_id for id."""
    return spark.read.json(path, schema=ANNOTATED_SCHEMA, multiLine=True).withColumnRenamed("id", "doc_id")


def case_triples(rows: DataFrame) -> DataFrame:
    """(doc_id, s, p, o) that the cases expect."""
    return rows.select(F.col("id").alias("doc_id"), F.explode("expected_triples").alias("t")).select("doc_id", F.col("t.subject").alias("s"), F.col("t.predicate").alias("p"), F.col("t.object").alias("o"))


@dataclass(frozen=True)
class Settings:
    """What operators.pipeline runs by [SRC15, EXT8, HK1-HK4]; dataclasses.replace() changes single ones."""

    max_retries: int = 2
    strict_validation: bool = True
    inject_context: bool = True
    provenance: bool = False
    linking: str = "none"
    link_confidence: float = 0.5
    kb_path: str | None = None
    coref_strategy: str = "rules"
    coref_distance: int = 3
    chunk_threshold: int = 2000
    chunk_size: int = 3500
    chunk_overlap: int = 0
    link_fuzzy: bool = True
    merge_entities: bool = False
    min_confidence: float = 0.7
    strict_dates: bool = False
    system: str | None = None

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None, prefix: str = "LOOMGRAPH_") -> Settings:
        """Each field from PREFIX + its name in capitals, where that is set. A value that can't be read is an error."""
        env = dict(os.environ) if env is None else env
        return cls._read(lambda name: (prefix + name.upper(), env.get(prefix + name.upper())))

    @classmethod
    def from_session(cls, spark: SparkSession, prefix: str = "spark.loomgraph.") -> Settings:
        """Each field from the session's setting PREFIX + its name, where that is set."""
        return cls._read(lambda name: (prefix + name, spark.conf.get(prefix + name, None)))

    @classmethod
    def _read(cls, given: Callable[[str], tuple[str, str | None]]) -> Settings:
        found: dict[str, object] = {}
        for name, f in cls.__dataclass_fields__.items():
            key, raw = given(name)
            if raw is None:
                continue
            if f.type == "bool":
                if raw.lower() not in ("true", "false", "1", "0"):
                    raise ValueError(f"{key} is neither true nor false: {raw}")
                found[name] = raw.lower() in ("true", "1")
            else:
                found[name] = {"int": int, "float": float}.get(f.type, str)(raw)
        return cls(**found)


def env_file(path: str) -> dict[str, str]:
    """The settings of a file of NAME=value lines [SRC16]; comments, blank lines and quotes around values don't count. No file, no settings."""
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        pairs = [line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}
