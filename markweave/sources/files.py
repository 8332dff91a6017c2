"""Reading of raw scores, processed tables, records, configurations and templates, from any file system that Spark reads."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markweave.functions.scores import number, target_id
from markweave.operators.descriptive import valid_samples
from markweave.operators.reshape import require
from markweave.schema import POSITIONS, SCORES, SIDE_SCORES, TRAITS

#: So many bytes of a file are looked at to find its delimiter.
SNIFFED = 256 * 1024
DELIMITERS = ",\t;|"


class Location:
    """A path on the file system it names, through Hadoop; without a scheme, on the default one."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.name = str(path)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.name)
        self._system = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._system.exists(self._path)

    def files(self, ending: str) -> list[str]:
        """Files directly in this folder by name; none if there is no such folder."""
        if not self.is_folder():
            return []
        found = (s.getPath() for s in self._system.listStatus(self._path) if s.isFile())
        return sorted(os.path.join(self.name, p.getName()) for p in found if p.getName().lower().endswith(ending))

    def is_folder(self) -> bool:
        return self.exists() and self._system.getFileStatus(self._path).isDirectory()

    def head(self, size: int) -> bytes:
        stream = self._system.open(self._path)
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()


class CsvFormat(NamedTuple):
    encoding: str
    delimiter: str


def find_csv_candidates(spark: SparkSession, folder: str | Path) -> list[str]:
    return Location(spark, folder).files(".csv")


def _header_fields(head: str) -> dict[str, int]:
    """Delimiters of the first record, outside quotation marks."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in head:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
        elif not quoted and c in "\r\n":
            break
    return counts


def detect_csv_format(spark: SparkSession, path: str | Path) -> CsvFormat:
    """Encoding and delimiter of a file, or of a folder's first: UTF-8, with or without a byte-order mark, and what parts the header into most fields."""
    place = Location(spark, path)
    head = (Location(spark, next(iter(place.files(".csv")), path)) if place.is_folder() else place).head(SNIFFED)
    cut = next((k for k in range(1, 4) if len(head) == SNIFFED and head[-k] & 0xC0 == 0xC0), 0)  # a letter that the end of the sniffed part parts
    try:
        text = head[: len(head) - cut].decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError(f"{path} is not UTF-8") from e
    fields = _header_fields(text.removeprefix("\ufeff"))
    return CsvFormat("utf-8-sig" if text.startswith("\ufeff") else "utf-8", max(DELIMITERS, key=fields.__getitem__))


def resolve_input_path(spark: SparkSession, path: str | Path | None = None, folder: str | Path | None = None) -> str:
    """The path that is named, else the one CSV file that the folder holds."""
    candidates = [str(path)] if path is not None else find_csv_candidates(spark, folder) if folder is not None else []
    match candidates:
        case [only] if Location(spark, only).exists():
            return only
        case [_, _, *_]:
            raise ValueError(f"{folder} holds {len(candidates)} CSV files; name one of {[os.path.basename(c) for c in candidates]}")
    raise FileNotFoundError(path if path is not None else f"{folder} holds no CSV file")


def with_row_numbers(df: DataFrame, name: str = "source_row_id") -> DataFrame:
    """Contiguous numbers from 0 in file order: a row's place in its input partition and the rows of the partitions before; no row is moved."""
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per input partition
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return marked.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_id", "_part", "_start")


def load_raw_scores(spark: SparkSession, path: str | Path) -> DataFrame:
    """The raw two-rater form with ``source_row_id``; header names are stripped, scores coerced, missing columns named in the error.

    Essays hold line breaks, so a file can't be split; a large collection is a folder of files, each read by a task of its own.
    """
    raw = spark.read.csv(str(path), header=True, sep=detect_csv_format(spark, path).delimiter, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    scores = [f"{s}_{p}" for p in POSITIONS for s in SIDE_SCORES]
    require(raw, ["Filename", "text_id_kaggle", "Text", *(f"Rater_{p}" for p in POSITIONS), *scores])
    return with_row_numbers(raw.withColumns({c: number(F.col(c)) for c in scores}))


def load_processed_wide(spark: SparkSession, path: str | Path) -> DataFrame:
    """A processed table (Parquet or CSV) with coerced numbers; missing columns are named in the error."""
    text = str(path)
    df = spark.read.csv(text, header=True, multiLine=True, quote='"', escape='"') if text.endswith(".csv") else spark.read.parquet(text)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    require(df, ["source_row_id", "Filename", "text_id_kaggle", "Text", "rater_id", "rater_position", *SCORES])
    numeric = [c for c in (*SCORES, "Identifying_Info", "trait_mean", "trait_min", "trait_max", "trait_std") if c in df.columns]
    return df.withColumns({c: number(F.col(c).cast("string")) for c in numeric} | {"source_row_id": F.col("source_row_id").cast("string").try_cast("bigint"), "rater_position": F.col("rater_position").cast("string").try_cast("int")})


def load_valid_data(spark: SparkSession, path: str | Path) -> DataFrame:
    """Valid rows with ``target_id``."""
    return valid_samples(load_processed_wide(spark, path)).withColumn("target_id", target_id())


def read_jsonl(spark: SparkSession, path: str | Path, schema: T.StructType) -> DataFrame:
    """JSON lines with a given schema; a missing path is an empty table, blank lines are skipped."""
    if not Location(spark, path).exists():
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).json(str(path))
    return df.where(~F.forall(F.array(*(F.col(c).isNull() for c in df.columns)), lambda x: x))


def read_optional_csv(spark: SparkSession, path: str | Path, schema: T.StructType) -> DataFrame | None:
    return spark.read.csv(str(path), header=True, schema=schema) if Location(spark, path).exists() else None


def read_target_list(spark: SparkSession, path: str | Path, field: str = "target_ids") -> DataFrame:
    """(``place``, ``target_id``) of an experiment's fixed target list, in its order."""
    return spark.read.json(str(path), multiLine=True).select(F.posexplode(field).alias("place", "target_id"))


def load_config(path: str | Path) -> dict:
    """A YAML (or JSON) configuration with the path and root it came from."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        config = json.loads(text)
    full = Path(path).resolve()
    return config | {"_config_path": str(full), "_root": str(full.parent.parent)}


def project_path(config: dict, value: str | Path) -> Path:
    """A path of a configuration; relative ones start at its root."""
    return Path(value) if Path(value).is_absolute() else Path(config["_root"]) / value


def load_templates(folder: str | Path) -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


__all__ = ["TRAITS", "find_csv_candidates", "detect_csv_format", "resolve_input_path", "load_raw_scores", "load_processed_wide", "load_valid_data", "read_jsonl", "load_config", "project_path"]
