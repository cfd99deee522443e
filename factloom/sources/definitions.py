"""Universe definitions (YAML or JSON) and ticker lists.

A definition is a short settings file, so it is read and written on the driver.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from factloom.operators.universe import parse_ticker_lines, securities_frame
from factloom.schemas import SECURITY

SUFFIXES = (".yaml", ".json")


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", name)


def find_definition(name_or_path: str, folder: str = ".") -> Path:
    """An absolute path as it stands, else ``folder/name`` with YAML preferred over JSON."""
    given = Path(name_or_path)
    if given.is_absolute():
        candidates = [given] if given.suffix in SUFFIXES else []
    else:
        base = Path(folder)
        exact = [base / given] if given.suffix in SUFFIXES else []
        candidates = exact + [(base / given).with_suffix(s) for s in SUFFIXES]
    for path in candidates:
        if path.is_file():
            return path
    raise FileNotFoundError(f"no universe definition {name_or_path!r} in {folder!r}")


def load_universe(
    spark: SparkSession, name_or_path: str, folder: str = "."
) -> tuple[str, DataFrame]:
    """Name and securities of a definition."""
    path = find_definition(name_or_path, folder)
    try:
        text = path.read_text()
        data = yaml.safe_load(text) if path.suffix == ".yaml" else json.loads(text)
    except (yaml.YAMLError, json.JSONDecodeError) as error:
        raise ValueError(f"cannot read {path}: {error}") from error
    if not isinstance(data, dict):
        raise ValueError(f"{path}: the root must be a mapping")
    listed = data.get("securities") or []
    if not isinstance(listed, list):
        raise ValueError(f"{path}: securities must be a list")
    rows = [row for row in listed if isinstance(row, dict)]
    return data.get("name") or path.stem, securities_frame(spark, rows)


def save_universe(name: str, securities: DataFrame, path: str) -> None:
    """Write a definition sorted by ticker; the suffix picks the format."""
    target = Path(path)
    if target.suffix not in SUFFIXES:
        raise ValueError(f"unsupported suffix {target.suffix!r}; use one of {SUFFIXES}")
    optional = [f for f in SECURITY.fieldNames() if f not in ("ticker", "name", "exchange")]
    rows = []
    for row in securities.orderBy("ticker").toLocalIterator():
        values = row.asDict()
        rows.append({k: v for k, v in values.items() if k not in optional or v is not None})
    content = {"name": name, "securities": rows}
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.suffix == ".yaml":
        target.write_text(yaml.safe_dump(content, sort_keys=False, allow_unicode=True))
    else:
        target.write_text(json.dumps(content, indent=2))


def read_ticker_file(spark: SparkSession, path: str) -> DataFrame:
    """Ticker and company number from a tab-split file; the later of equal tickers wins."""
    from factloom.sources.jsonl import numbered_lines

    lines = numbered_lines(spark, path).withColumnRenamed("line_index", "position")
    return parse_ticker_lines(lines)
