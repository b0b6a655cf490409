"""Command line: statements, scripts, a shell, compaction, backup, restore, the release gate and the service."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarry.auth import IdentityStore
from quarry.errors import QuarryError
from quarry.gate import evaluate_gate, load_manifest
from quarry.memory import HttpEmbedder, MemoryStore
from quarry.prompt import HttpPlanner, PromptSQLService
from quarry.service import MAX_BODY, PER_MINUTE, Service, make_server
from quarry.session import Session, format_rows, rows
from quarry.sources.backup import restore_backup
from quarry.statements import split_statements


def show(out: DataFrame | dict[str, Any], as_json: bool) -> str:
    found = rows(out) if isinstance(out, DataFrame) else out
    if as_json:
        return json.dumps(found, default=str)
    return format_rows(found) if isinstance(found, list) else json.dumps(found, default=str)


def shell(session: Session, as_json: bool) -> None:
    """Reads statements up to ``;``. ``.tables``, ``.schema [table]``, ``.help`` and ``.quit`` stand alone on a line."""
    text = ""
    for line in sys.stdin:
        word = line.strip()
        try:
            if not text and word.startswith("."):
                command, _, rest = word.partition(" ")
                if command == ".quit":
                    return
                if command == ".tables":
                    print("\n".join(session.tables()))
                elif command == ".schema":
                    catalog = session.catalog()["tables"]
                    print("\n".join(f"{n} ({', '.join(c['name'] + ' ' + c['type'] for c in t['columns'])})" for n, t in catalog.items() if not rest or n == rest.strip()))
                else:
                    print(".tables  .schema [table]  .help  .quit")
                continue
            text += line
            if word.endswith(";"):
                for statement in split_statements(text):
                    print(show(session.execute(statement), as_json))
                text = ""
        except QuarryError as e:
            print(f"error: {e}", file=sys.stderr)
            text = ""


def serve(session: Session, a: argparse.Namespace) -> None:
    """Runs the service until it is interrupted."""
    planner = HttpPlanner(a.planner_url, a.planner_model, os.environ.get("QUARRY_PLANNER_TOKEN")) if a.planner_url else None
    embedder = HttpEmbedder(a.embedder_url, a.embedder_model, os.environ.get("QUARRY_EMBEDDER_TOKEN")) if a.embedder_url else None
    identities = IdentityStore(a.identities) if a.identities else None
    told = Service(session, a.token, identities, PromptSQLService(session, planner), MemoryStore(session, embedder), a.audit_log, a.requests_per_minute, a.max_body)
    make_server(told, a.host, a.serve, a.tls_cert, a.tls_key).serve_forever()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("path", nargs="?", default=":memory:")
    p.add_argument("--sql")
    p.add_argument("--file")
    p.add_argument("--compact", action="store_true")
    p.add_argument("--backup")
    p.add_argument("--restore")
    p.add_argument("--restore-to")
    p.add_argument("--production-gate")
    p.add_argument("--serve", type=int, metavar="PORT")
    p.add_argument("--json", action="store_true")
    service = p.add_argument_group("service")
    service.add_argument("--host", default="127.0.0.1")
    service.add_argument("--token", default=os.environ.get("QUARRY_TOKEN"), help="bearer token of the one user; also from QUARRY_TOKEN")
    service.add_argument("--identities", help="ledger of users and their roles")
    service.add_argument("--tls-cert")
    service.add_argument("--tls-key")
    service.add_argument("--requests-per-minute", type=int, default=PER_MINUTE)
    service.add_argument("--max-body", type=int, default=MAX_BODY, help="bytes of a request")
    service.add_argument("--audit-log")
    service.add_argument("--planner-url", help="chat-completions endpoint that proposes SQL")
    service.add_argument("--planner-model", default="qwen3:1.7b")
    service.add_argument("--embedder-url", help="endpoint that gives embeddings of notes")
    service.add_argument("--embedder-model", default="bge-m3")
    a = p.parse_args(argv)
    try:
        if a.production_gate:
            report = evaluate_gate(load_manifest(a.production_gate))
            print(json.dumps(report, indent=None if a.json else 2))
            return 0 if report["status"] != "blocked" else 2
        spark = SparkSession.builder.appName("quarry").getOrCreate()
        if a.restore:
            if not a.restore_to:
                p.error("--restore needs --restore-to")
            print(json.dumps(restore_backup(spark, a.restore, a.restore_to)))
            return 0
        session = Session(spark, a.path)
        if a.sql or a.file:
            text = a.sql or open(a.file, encoding="utf-8").read()
            for statement in split_statements(text):
                print(show(session.execute(statement), a.json))
        if a.compact:
            print(json.dumps(session.compact()))
        if a.backup:
            print(json.dumps(session.backup(a.backup)))
        if a.serve is not None:
            serve(session, a)
        if not (a.sql or a.file or a.compact or a.backup):
            shell(session, a.json)
        return 0
    except (QuarryError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
