"""Release gate: judges evidence that is handed in, and never approves by itself."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Any

VERSION = "release-gate/1"
#: Sections of a manifest, and what each must show to be true.
CHECKS = {
    "regression_tests": ["passed", "reproducible", "revision_pinned"],
    "durable_storage": ["slotted_pages", "durable_indexes", "checksummed_frames"],
    "crash_recovery": ["fault_matrix_passed", "reopen_verified", "no_data_loss"],
    "backup_restore": ["checksums_verified", "restore_reopened", "restore_drill_passed"],
    "sql_mvcc": ["integrated", "snapshot_reads", "serializable_validation", "recovery_rules"],
    "identity_security": ["least_privilege", "rotation_tested", "external_identity_reviewed"],
    "operations": ["encryption_key_management", "durable_audit_retention", "consensus_transport", "observability"],
}


def evaluate_gate(manifest: dict[str, Any]) -> dict[str, Any]:
    """status, production_approved (always false), gate_version, checks, evidence_digest, checked_at_ns."""
    if not isinstance(manifest, dict):
        raise ValueError("a manifest must be an object")
    section = lambda name: manifest[name] if isinstance(manifest.get(name), dict) else {}
    checks = [{"name": n, "passed": all(section(n).get(k) is True for k in keys), "evidence": n, "reason": f"needs {', '.join(keys)}"} for n, keys in CHECKS.items()]
    checks.append({"name": "independent_release_review", "passed": manifest.get("independent_review") is True, "evidence": "independent_review", "reason": "needs a separate review"})
    report = {"status": "eligible_for_independent_production_review" if all(c["passed"] for c in checks) else "blocked", "production_approved": False, "gate_version": VERSION, "checks": checks, "checked_at_ns": int(manifest.get("checked_at_ns", time.time_ns()))}
    return report | {"evidence_digest": hashlib.sha256(json.dumps(report, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}


def load_manifest(path: str) -> dict[str, Any]:
    try:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
    except (OSError, ValueError) as e:
        raise ValueError("the manifest cannot be read") from e
    if not isinstance(told, dict):
        raise ValueError("a manifest must be an object")
    return told
