"""Writing of tables, records, scalars and the report. Everything is computed before anything old is overwritten."""

from __future__ import annotations

import json
import subprocess
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, folder: str | Path) -> None:
    """UTF-8 part files with headers."""
    df.write.mode("overwrite").csv(str(folder), header=True, quote='"', escape='"')


#: Rows of a result table that still go through the driver into one file.
SINGLE_FILE_ROWS = 1_000_000


def save_table(df: DataFrame, path: str | Path) -> Path:
    """A result table as one CSV file with a byte-order mark; a larger one (a row for each of very many raters) as part files in a folder."""
    frame = df.limit(SINGLE_FILE_ROWS + 1).toPandas()
    if len(frame) > SINGLE_FILE_ROWS:
        write_csv(df, Path(path).with_suffix(""))
        return Path(path).with_suffix("")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    frame.to_csv(path, index=False, encoding="utf-8-sig")
    return Path(path)


def write_jsonl(df: DataFrame, folder: str | Path) -> None:
    """JSON lines; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(str(folder))


def save_inference_input(df: DataFrame, folder: str | Path) -> tuple[str, str]:
    paths = f"{folder}/inference_csv", f"{folder}/inference_jsonl"
    write_csv(df, paths[0])
    write_jsonl(df, paths[1])
    return paths


def write_json(value, path: str | Path) -> Path:
    """Scalars as JSON; a one-row DataFrame becomes an object."""
    if isinstance(value, DataFrame):
        value = value.first().asDict(recursive=True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return Path(path)


def experiment_metadata(config: dict) -> dict:
    """When, from which commit and with which settings a run was made."""
    now = datetime.now(timezone.utc)
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, cwd=config.get("_root")).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        commit = "unknown"
    return {"experiment_id": f"run_{now:%Y%m%dT%H%M%SZ}", "timestamp": f"{now:%Y%m%dT%H%M%SZ}", "git_commit": commit, "config": {k: v for k, v in config.items() if not k.startswith("_")}}


def _markdown(df: DataFrame, rows: int) -> str:
    shown = df.limit(rows).toPandas()
    lines = ["| " + " | ".join(map(str, shown.columns)) + " |", "|" + "---|" * len(shown.columns)]
    lines += ["| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in shown.itertuples(index=False)]
    return "\n".join(lines)


def write_report(title: str, sections: list[tuple[str, DataFrame | str]], path: str | Path, rows: int = 40) -> Path:
    """A Markdown report of result tables (their first ``rows`` rows) and sentences."""
    text = f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{x if isinstance(x, str) else _markdown(x, rows)}" for name, x in sections) + "\n"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return Path(path)
