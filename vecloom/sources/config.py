"""Server and collection settings: strict TOML and a tab-separated catalogue."""
from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a settings file may have, with their types.
KEYS = {"data_dir": str, "http_port": int, "rpc_port": int, "api_key": str, "metric": str, "dimension": int, "memory_budget_mb": int, "flush_bytes": int, "storage_mode": str, "accuracy_profile": str}


def load_toml(text: str) -> dict:
    """Settings of a file; unknown keys, wrong types and malformed lines raise ValueError."""
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(str(e)) from e
    for k, v in found.items():
        if k not in KEYS:
            raise ValueError(f"unknown key {k!r}")
        if type(v) is not KEYS[k]:
            raise ValueError(f"{k}: expected {KEYS[k].__name__}")
    return found


def load_toml_file(path: str) -> dict:
    return load_toml(Path(path).read_text())


#: Columns of a catalogue line; later ones may be missing.
CATALOGUE = (("name", "string", None), ("dimension", "long", "0"), ("metric", "string", "l2"), ("storage_mode", "string", "hot"), ("max_vectors", "long", "0"), ("storage_quota", "long", "0"), ("max_qps", "long", "0"), ("memory_budget", "long", "0"), ("isolation", "string", "shared"), ("accuracy_profile", "string", "balanced"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of a tab-separated file; lines of fewer than three fields are left out, missing fields take their defaults."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(F.size(parts) >= 3)
    return lines.select(*[F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")), F.lit(default)).cast(kind).alias(name) for i, (name, kind, default) in enumerate(CATALOGUE)])


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n, _, _ in CATALOGUE])
    catalogue.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def format_catalogue(rows: list[dict]) -> str:
    """The same lines for a catalogue in memory."""
    return "".join("\t".join("" if r.get(n) is None else str(r[n]) for n, _, _ in CATALOGUE) + "\n" for r in rows)


def parse_catalogue(text: str) -> list[dict]:
    """The collections of a catalogue file, by the rules of `read_catalogue`."""
    out = []
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) >= 3:
            given = dict(zip([n for n, _, _ in CATALOGUE], parts))
            out.append({n: (int if kind == "long" else str)(given.get(n) or default or "") for n, kind, default in CATALOGUE})
    return out
