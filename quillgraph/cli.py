"""Commands: enrich, cmif, reconcile, store, query, validate, network, review. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import csv
import io
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.appName("quillgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Usage(Exception):
    """Arguments that make no sense together, or files that aren't there."""


def _files(paths: list[str]) -> list[str]:
    lost = [p for p in paths if "://" not in p and not os.path.exists(p)]
    if lost:
        raise Usage(f"no such file: {', '.join(lost)}")
    return paths


def formatted(df: DataFrame, form: str) -> str:
    """A query's result: CSV with a header even if empty, a JSON list, or a padded table."""
    rows, names = [list(r) for r in df.collect()], df.columns
    if form == "json":
        return json.dumps([dict(zip(names, r, strict=True)) for r in rows], ensure_ascii=False, indent=1) + "\n"
    if form == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(names)
        writer.writerows([["" if v is None else v for v in r] for r in rows])
        return out.getvalue()
    if not rows:
        return "(no rows)\n"
    cells = [names, *[["" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells) + "\n"


def run_enrich(a: argparse.Namespace) -> int:
    from .operators.enrich import Options, enrich
    from .operators.reconcile import load_cache
    from .operators.recognise import Glossary

    _files(a.inputs)
    stems = [os.path.splitext(os.path.basename(p))[0] for p in a.inputs]
    if len(set(stems)) < len(stems):
        raise Usage("inputs have equal names")
    if not a.glossary:
        raise Usage("the glossary engine needs --glossary")
    with open(_files([a.glossary])[0], "rb") as file:
        content = file.read()
    name = os.path.basename(a.glossary)
    Glossary(content, name)
    options = Options(a.base_uri, a.reading, a.threshold, a.tei_base_url, a.source_url, load_cache(a.reconciliation) if a.reconciliation else None)
    rows = enrich(session(), a.inputs, lambda: Glossary(content, name), options).orderBy("path").collect()
    if failed := [r for r in rows if r["error"]]:  # all or nothing
        for r in failed:
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
        return 1
    os.makedirs(a.out_dir, exist_ok=True)
    for r in rows:
        stem = os.path.splitext(os.path.basename(r["path"]))[0]
        for ending, value in ((".enriched.xml", bytes(r["xml"])), (".ttl", r["turtle"].encode()), (".mentions.json", r["mentions"].encode() + b"\n")):
            with open(os.path.join(a.out_dir, stem + ending), "wb") as file:
                file.write(value)
        from .operators.preview import page

        with open(os.path.join(a.out_dir, stem + ".html"), "w", encoding="utf-8") as file:
            file.write(page(bytes(r["xml"]), r["mentions"].encode(), r["path"]))
        print(f"{r['path']}: {r['report']}")
    return 0


def run_store(a: argparse.Namespace) -> int:
    from .sources.store import append, scan_turtle, union_graph

    quads = scan_turtle(session(), _files(a.inputs))
    if a.db:
        before, after = append(session(), a.db, quads)
        print(f"{before} statements before, {after} after")
    else:
        print(f"{union_graph(quads).count()} statements")
    return 0


def run_query(a: argparse.Namespace) -> int:
    from .plans.sparql import SparqlError, query
    from .sources.store import open_store, scan_turtle

    if bool(a.db) == bool(a.graph):
        raise Usage("either --db or --graph")
    with open(_files([a.query])[0], encoding="utf-8") as file:
        text = file.read()
    bindings = {}
    for b in a.bind:
        name, sep, value = b.partition("=")
        if not sep:
            raise Usage(f"a binding is name=value: {b!r}")
        bindings[name.lstrip("?")] = value
    quads = open_store(session(), *_files([a.db])) if a.db else scan_turtle(session(), _files(a.graph))
    try:
        print(formatted(query(session(), quads, text, bindings), a.format), end="")
    except SparqlError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


def run_validate(a: argparse.Namespace) -> int:
    from .plans.shacl import validate
    from .sources.store import scan_turtle

    rows = validate(scan_turtle(session(), _files(a.graph)), a.profile).collect()
    for r in rows:
        print(f"{r['shape']}\t{r['focus']}\t{r['message']}")
    print("conforms" if not rows else f"{len(rows)} violations")
    return int(bool(rows))


def run_network(a: argparse.Namespace) -> int:
    from .operators.letters import network_files

    if not a.inputs and not a.graphs:
        raise Usage("letters or --graphs")
    out = network_files(session(), _files(a.inputs), _files(a.graphs))
    os.makedirs(a.out_dir, exist_ok=True)
    for name, text in out.items():
        with open(os.path.join(a.out_dir, name), "w", encoding="utf-8") as file:
            file.write(text)
    return 0


def run_cmif(a: argparse.Namespace) -> int:
    from .operators.cmif import CmifOptions, export, scan_descriptions
    from .operators.reconcile import load_cache

    if "{id}" not in a.url_pattern:
        raise Usage("the pattern of urls needs {id}")
    options = CmifOptions(a.url_pattern, a.cmif_url, a.title, a.publisher, a.licence, a.editor, a.editor_email)
    result = export(scan_descriptions(session(), _files(a.inputs), options, load_cache(a.reconciliation) if a.reconciliation else None), options)
    with open(a.out, "w", encoding="utf-8") as file:
        file.write(result.xml)
    for w in result.warnings:
        print(w, file=sys.stderr)
    print(f"{result.descriptions} of {result.letters} letters, {result.actions} actions, {result.with_ref} names with and {result.without_ref} without authority")
    return 0


def run_reconcile(a: argparse.Namespace) -> int:
    from .operators.reconcile import FileResolver, first_seen, load_cache, missing, save_cache, scan_register, update_cache

    _files(a.inputs)
    resolver = FileResolver(_files([a.links])[0]) if a.links else None
    if resolver is None and not a.offline:
        raise Usage("--links or --offline")
    cache = load_cache(a.cache) if os.path.exists(a.cache) else {"resolver": resolver.name if resolver else "none", "version": 1, "entries": {}}
    if resolver and cache["resolver"] != resolver.name:
        raise Usage(f"the cache is of resolver {cache['resolver']!r}")
    entities = first_seen(scan_register(session(), a.inputs))
    wanted = [(r["id"], r["kind"], r["label"]) for r in missing(entities, cache).orderBy("id").collect()]  # looked up one after the other
    if a.offline:
        print(f"{len(wanted)} ids are not in the cache")
        return 0
    update = update_cache(cache, wanted, resolver, save=lambda c: save_cache(a.cache, c))
    print(f"{update.status}: {update.resolved} resolved, {update.unresolved} unresolved, {len(update.failures)} failed, {len(update.skipped)} skipped")
    return {"ok": 0, "partial": 0, "interrupted": 130}.get(update.status, 1)


def run_review(a: argparse.Namespace) -> int:
    from .operators.review import ReviewError, apply

    paths = _files([a.mentions, a.graph, a.review])
    if os.path.realpath(a.output) in {os.path.realpath(p) for p in paths}:
        raise Usage("the output must be another file")
    contents = []
    for p in paths:
        with open(p, "rb") as file:
            contents.append(file.read())
    try:
        text, accepted, rejected = apply(*contents)
    except ReviewError as error:
        print(error, file=sys.stderr)
        return 2
    with open(a.output, "w", encoding="utf-8") as file:
        file.write(text)
    print(f"{accepted} accepted, {rejected} rejected")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: tuple) -> None:  # noqa: ANN001
        c = sub.add_parser(name)
        for names, options in arguments:
            c.add_argument(*names.split(), **options)
        c.set_defaults(run=run)

    many = ("inputs", {"nargs": "+"})
    cached = ("--reconciliation", {})
    command("enrich", run_enrich, many, ("--out-dir", {"required": True}), ("--glossary", {}), ("--base-uri", {"default": "https://example.org/letters/"}), ("--tei-base-url", {}), ("--source-url", {}), ("--threshold", {"type": float, "default": 0.85}), ("--reading", {"default": "edited", "choices": ["edited", "diplomatic"]}), cached)
    command("cmif", run_cmif, many, ("--out", {"required": True}), ("--url-pattern", {"required": True}), ("--cmif-url", {"default": "https://example.org/cmif.xml"}), ("--title", {}), ("--publisher", {}), ("--licence", {}), ("--editor", {"default": "unknown"}), ("--editor-email", {}), cached)
    command("reconcile", run_reconcile, many, ("--cache", {"required": True}), ("--links", {}), ("--offline", {"action": "store_true"}))
    command("store", run_store, many, ("--db", {}))
    command("query", run_query, ("query", {}), ("--db", {}), ("--graph", {"action": "append"}), ("--bind", {"action": "append", "default": []}), ("--format", {"default": "table", "choices": ["csv", "json", "table"]}))
    command("validate", run_validate, ("graph", {"nargs": "+"}), ("--profile", {"default": "source", "choices": ["source", "reviewed"]}))
    command("network", run_network, ("inputs", {"nargs": "*"}), ("--graphs", {"nargs": "*", "default": []}), ("--out-dir", {"required": True}))
    command("review", run_review, ("mentions", {}), ("graph", {}), ("review", {}), ("output", {}))
    return p


def main(arguments: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        return a.run(a)
    except Usage as error:
        print(error, file=sys.stderr)
        return 2
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2 if a.command in ("enrich", "cmif", "reconcile") else 1


if __name__ == "__main__":
    sys.exit(main())
