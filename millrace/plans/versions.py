"""Published procedure versions, the active pointer and the run log, as files in a shared folder."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.procedure import Procedure, execution_order, run_procedure
from millrace.sources.snapshots import Snapshots
from millrace.sources.storage import SharedFolder


RUNNING = "RUNNING"


class StillRunning(RuntimeError):
    """Another run holds the idempotency key."""


class ProcedureStore:
    def __init__(self, spark: SparkSession, root: str):
        self.files = SharedFolder(spark, root)

    def _meta(self, procedure_id: str) -> str:
        return f"{procedure_id}/active.json"

    def _version(self, procedure_id: str, tag: str) -> str:
        return f"{procedure_id}/versions/{tag}.json"

    def publish(self, procedure: Procedure, change_log: str = "") -> dict[str, Any]:
        """Store an immutable version and make it active; a tag cannot be published twice."""
        execution_order(procedure.nodes)
        record = {"procedure_id": procedure.procedure_id, "version_tag": procedure.version,
                  "content_hash": procedure.content_hash(), "definition": procedure.to_dict(),
                  "change_log": change_log, "created_at": time.time()}
        if not self.files.write(self._version(procedure.procedure_id, procedure.version), record, overwrite=False):
            raise ValueError(f"version {procedure.version!r} of {procedure.procedure_id!r} already exists")
        self.activate(procedure.procedure_id, procedure.version)
        return record

    def activate(self, procedure_id: str, tag: str) -> None:
        if not self.files.exists(self._version(procedure_id, tag)):
            raise ValueError(f"version {tag!r} of {procedure_id!r} not found")
        self.files.write(self._meta(procedure_id), {"version_tag": tag})

    rollback = activate

    def versions(self, procedure_id: str) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names(f"{procedure_id}/versions") if n.endswith(".json")]

    def load(self, procedure_id: str, tag: str | None = None) -> Procedure:
        if tag is None:
            if not self.files.exists(self._meta(procedure_id)):
                raise ValueError(f"procedure {procedure_id!r} not found")
            tag = self.files.read(self._meta(procedure_id))["version_tag"]
        return Procedure.from_dict(self.files.read(self._version(procedure_id, tag))["definition"])

    def run(
        self,
        procedure_id: str,
        inputs: dict[str, DataFrame],
        params: dict[str, Any] | None = None,
        tag: str | None = None,
        dry_run: bool = False,
        key: str | None = None,
        force: bool = False,
        snapshots: Snapshots | None = None,
    ) -> dict[str, Any]:
        """Run a version and log the run; a repeated idempotency key returns the stored record.

        The key's slot is created exclusively before the run, so of two callers with one key and the same
        parameters one runs; the other gets the record, or an error while the first is still at it. A run
        that fails gives its slot back. ``force`` runs again and replaces the record.
        """
        asked = json.dumps([key, params or {}], sort_keys=True, default=str)
        slot = f"{procedure_id}/runs/{hashlib.sha256(asked.encode()).hexdigest()[:24]}.json"
        once = bool(key) and not dry_run
        if once and not force and not self.files.write(slot, {"status": RUNNING, "created_at": time.time()}, overwrite=False):
            stored = self.files.read(slot)
            if stored["status"] == RUNNING:
                raise StillRunning(f"a run of {procedure_id!r} with the key {key!r} has not ended")
            return stored
        try:
            procedure = self.load(procedure_id, tag)
            result = run_procedure(procedure, inputs, params, dry_run, snapshots)
        except Exception:
            if once and not force:
                self.files.delete(slot)
            raise
        record = {"procedure_id": procedure_id, "version_tag": procedure.version, "status": "SUCCESS",
                  "dry_run": dry_run, "rows_in": result.rows_in, "rows_out": result.rows_out,
                  "snapshot_id": result.commit.snapshot_id if result.commit else None,
                  "lineage": result.lineage, "created_at": time.time()}
        if once:
            self.files.write(slot, record)
        return record
