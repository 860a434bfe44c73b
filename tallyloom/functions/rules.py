"""Rule tables as data: JSON files read once on the driver and compiled into expressions."""

from __future__ import annotations

import functools
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent.parent / "rules"


@functools.lru_cache(maxsize=None)
def load(name: str) -> dict:
    """A shipped rule file by name, or any JSON file by path."""
    path = Path(name) if name.endswith(".json") else HERE / f"{name}.json"
    return json.loads(path.read_text(encoding="utf-8"))


def phrase_table(spark: SparkSession, name: str = "content") -> DataFrame:
    """The phrases of a rule file as rows: label, kind (strong, weak, pair), phrase, ord."""
    rows = []
    for label, rule in load(name)["labels"].items():
        for kind in ("strong", "weak"):
            rows += [(label, kind, p, i) for i, p in enumerate(rule.get(kind, []))]
        rows += [(label, "pair", p, i) for i, pair in enumerate(rule.get("pairs", [])) for p in pair]
    return spark.createDataFrame(rows, "label string, kind string, phrase string, ord int")


def topic_table(spark: SparkSession, topics: dict | None = None) -> DataFrame:
    """Topic dimension: topic, label, layer, priority."""
    topics = topics or load("topics")
    order = topics["priority"]
    return spark.createDataFrame([(t["id"], t["label"], t["layer"], order.index(t["id"])) for t in topics["topics"]], "topic string, label string, layer string, priority int")
