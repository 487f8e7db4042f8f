"""Registered models: saved pipelines, their record and their stage."""

from __future__ import annotations

import time
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.learn import Trained, batch_score
from millrace.sources.storage import SharedFolder

STAGES = ("staging", "production", "archived")


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.files = SharedFolder(spark, root)

    def register(self, name: str, trained: Trained) -> dict[str, Any]:
        """Save the pipeline and list it under the next version of its name."""
        version = sum(r["name"] == name for r in self.models()) + 1
        model_id = f"{name}-{version}"
        record = {"model_id": model_id, "name": name, "version": version, "task": trained.task, "target": trained.target,
                  "features": trained.features, "classes": trained.classes, "metrics": trained.metrics,
                  "status": "staging", "created_at": time.time()}
        if not self.files.write(f"records/{model_id}.json", record, overwrite=False):
            raise ValueError(f"model {model_id!r} already exists")
        trained.model.write().overwrite().save(self.files.at(f"pipelines/{model_id}"))
        return record

    def models(self) -> list[dict[str, Any]]:
        return [self.files.read(f"records/{n}") for n in self.files.names("records") if n.endswith(".json")]

    def record(self, model_id: str) -> dict[str, Any]:
        return self.files.read(f"records/{model_id}.json")

    def promote(self, model_id: str, status: str) -> dict[str, Any]:
        """Change the stage; a new production model archives the previous one of its name."""
        if status not in STAGES:
            raise ValueError(f"status must be one of {STAGES}")
        record = self.record(model_id)
        if status == "production":
            for other in self.models():
                if other["name"] == record["name"] and other["status"] == "production":
                    self.files.write(f"records/{other['model_id']}.json", other | {"status": "archived"})
        self.files.write(f"records/{model_id}.json", record | {"status": status})
        return self.record(model_id)

    def score(self, model_id: str, df: DataFrame) -> DataFrame:
        record = self.record(model_id)
        model = PipelineModel.load(self.files.at(f"pipelines/{model_id}"))
        return batch_score(model, df, record["target"], record["classes"])
