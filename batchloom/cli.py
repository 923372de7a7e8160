"""Operator commands over a job repository: ``python -m batchloom.cli [--root PATH] NOUN VERB ...``.

Prints one JSON object with ``version``, ``command`` and ``data`` or ``error``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from batchloom.functions.digest import instance_key
from batchloom.plans.ledger import MAX_PAGE_ROWS, cursor, open_cursor
from batchloom.plans.operations import COMMANDS
from batchloom.plans.store import Conflict, JobLauncher, JobRepository, Rejected, redacted

#: Exit codes.
SUCCESS, USAGE, CONFIGURATION, GUARD, NOT_FOUND, CONFLICT, UNKNOWN, UNAVAILABLE, CONFIRM, DEADLINE, OUTPUT, INTERNAL = *range(11), 70
MAX_BUNDLE_BYTES = 4 * 1024 * 1024
DEFAULTS = {"root": "batchloom-ledger", "page_size": "100"}


def resolve(options: dict, env: dict, file: dict) -> dict[str, tuple[str, str]]:
    """For each setting its value and source: option, environment, file, default, in this order."""
    out = {}
    for key, default in DEFAULTS.items():
        for source, values, name in (("option", options, key), ("env", env, f"BATCHLOOM_{key.upper()}"), ("file", file, key), ("default", DEFAULTS, key)):
            if values.get(name) is not None:
                out[key] = (str(values[name]), source)
                break
    return out


def _page(store: JobRepository, query: str, kind: str, filters: dict, size: int, after: str | None) -> dict:
    if not 1 <= size <= MAX_PAGE_ROWS:
        raise ValueError("a page has 1 to 500 rows")
    df = store.table(kind)
    for column, value in filters.items():
        df = df.filter(df[column] == value)
    if after:
        df = df.filter(df["id"] > open_cursor(after, query, filters, size)[0])
    rows = [redacted(r.asDict()) for r in df.orderBy("id").limit(size).collect()]
    return {"rows": rows, "next": cursor(query, filters, size, [rows[-1]["id"]]) if len(rows) == size else None}


def _jobs(name: str | None) -> dict:
    """The jobs that a module has under ``module:attribute``: by name, what runs one, given a launcher and parameters."""
    module, _, attribute = (name or "").partition(":")
    if not module or not attribute:
        raise ValueError("name the jobs with --jobs module:attribute")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as e:
        raise ValueError(str(e)) from None


_KINDS = {"string": str, "i64": int, "u64": int, "bool": lambda v: {"true": True, "false": False}[v]}


def _parameters(given: list[str]) -> dict:
    """``name=type:value`` each."""
    out = {}
    for one in given:
        name, equals, typed = one.partition("=")
        kind, colon, value = typed.partition(":")
        if not equals or not colon or kind not in _KINDS or name in out:
            raise ValueError("a parameter is given once, as name=type:value")
        try:
            out[name] = (kind, _KINDS[kind](value))
        except KeyError:
            raise ValueError(f"{name} is no {kind}") from None
    return out


def _launched(store: JobRepository, execution: str) -> tuple[str, dict]:
    """The job and parameters of an attempt's instance."""
    instance = store.get("instance", store.get("execution", execution)["instance_id"])
    return instance["job_name"], {k: tuple(v) for k, v in json.loads(instance["parameters"]).items()}


def run(argv: list[str], spark=None) -> tuple[int, dict]:
    parser = argparse.ArgumentParser(prog="batchloom", exit_on_error=False)
    parser.add_argument("words", nargs="+")
    for name in ("root", "config", "job", "instance", "execution", "operation-id", "actor", "digest", "cursor", "page-size", "expected", "minimum-age", "jobs"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--param", action="append", default=[])
    parser.add_argument("--confirm", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    try:
        args = parser.parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        return USAGE, {"error": str(e)}
    name = " ".join(args.words)
    known = {c[0]: c for c in COMMANDS}
    if name not in known:
        return USAGE, {"error": f"unknown command: {name}"}
    _, kind, dry, paged = known[name]
    if args.dry_run and not dry:
        return USAGE, {"error": f"{name} has no dry run"}
    try:
        file = json.load(open(args.config, encoding="utf-8")) if args.config else {}
        settings = resolve({"root": args.root, "page_size": args.page_size}, os.environ, file)
        size = int(settings["page_size"][0])
    except (OSError, ValueError) as e:
        return CONFIGURATION, {"error": str(e)}
    if name == "config show":
        return SUCCESS, {"data": {k: {"value": v, "source": s} for k, (v, s) in settings.items()}}
    if kind == "DESTRUCTIVE" and not (args.confirm or args.dry_run):
        return CONFIRM, {"error": f"{name} changes what can't be restored; repeat with --confirm"}
    if spark is None:
        from batchloom.session import local_session

        spark = local_session("2", 4)
    store = JobRepository(spark, settings["root"][0])
    page = lambda kind, **filters: _page(store, name, kind, {k: v for k, v in filters.items() if v is not None}, size, args.cursor)
    act = lambda action, target, **more: store.request(action, args.operation_id or "", target, **more)
    try:
        if name == "job list":
            data = {"rows": [r["job_name"] for r in store.table("instance").select("job_name").distinct().orderBy("job_name").limit(size).collect()]}
        elif name == "job show":
            data = {"definitions": sorted({e["definition"] for e in store.rows("execution") if e["job_name"] == args.job})}
        elif name == "instance list":
            data = page("instance", job_name=args.job)
        elif name == "instance show":
            data = redacted(store.get("instance", args.instance))
        elif name == "execution list":
            data = page("execution", instance_id=args.instance)
        elif name == "execution show":
            data = store.get("execution", args.execution)
        elif name in ("execution steps", "execution partitions", "execution history"):
            data = page("decision", execution_id=args.execution)
        elif name == "execution stop":
            data = act("STOP", args.execution)
        elif name == "execution abandon":
            data = act("ABANDON", args.execution)
        elif name == "execution recover":
            data = store.get("execution", args.execution) if args.dry_run else act("RECOVER", args.execution, expected=int(args.expected))
        elif name in ("launch", "execution restart"):
            job, parameters = (args.job, _parameters(args.param)) if name == "launch" else _launched(store, args.execution)
            known_jobs = _jobs(args.jobs)
            if job not in known_jobs:
                return NOT_FOUND, {"error": f"unknown job: {job}"}
            if args.dry_run:
                return SUCCESS, {"data": {"job": job, "instance": instance_key(job, parameters), "attempts": len(store.attempts(instance_key(job, parameters)))}}
            ended = known_jobs[job](JobLauncher(store), parameters)
            ended = ended[1] if isinstance(ended, tuple) else ended
            return {"UNKNOWN": UNKNOWN, "FAILED": INTERNAL}.get(ended["status"], SUCCESS), {"data": ended}
        elif name == "retention plan":
            digest, plan = store.purge_plan(args.job, int(args.minimum_age or 30 * 86400))
            data = {"digest": digest, "candidates": plan.count()}
        elif name == "retention apply":
            digest, plan = store.purge_plan(args.job, int(args.minimum_age or 30 * 86400))
            data = {"purged": plan.count() if args.dry_run else store.purge(args.job, int(args.minimum_age or 30 * 86400), args.digest)}
        elif name == "retention hold":
            data = act("HOLD", args.instance, actor=args.actor)
        elif name == "retention release":
            data = act("RELEASE", args.instance)
        elif name == "schema status":
            data = {"schema_version": 1, "tables": ["decision", "execution", "instance", "request"]}
        else:
            data = {kind: [redacted(r.asDict()) for r in store.table(kind).orderBy("id").limit(MAX_PAGE_ROWS).collect()] for kind in ("instance", "execution", "decision", "request")}
            if len(json.dumps(data)) > MAX_BUNDLE_BYTES:
                return OUTPUT, {"error": "the bundle is too large"}
    except Rejected as e:
        return (NOT_FOUND if e.code == "NOT_FOUND" else GUARD), {"error": e.code}
    except Conflict as e:
        return CONFLICT, {"error": str(e)}
    except (TypeError, ValueError) as e:
        return USAGE, {"error": str(e)}
    if isinstance(data, dict) and data.get("outcome") == "REJECTED":
        return (NOT_FOUND if data["result"] == "NOT_FOUND" else GUARD), {"error": data["result"]}
    return SUCCESS, {"data": data}


def main() -> None:
    code, out = run(sys.argv[1:])
    print(json.dumps({"version": 1, "command": " ".join(a for a in sys.argv[1:3] if not a.startswith("-"))} | out, default=str))
    sys.exit(code)


if __name__ == "__main__":
    main()
