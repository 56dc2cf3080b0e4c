"""A thin command line over a snippet store: ``python -m sextant.cli --store FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import os
import sys

from sextant.errors import ErrorCode, StoreError

#: Exit codes: done, wrong use, not found, storage, anything else.
OK, USER_ERROR, NOT_FOUND, IO_ERROR, INTERNAL = range(5)
_CODES = {ErrorCode.NOT_FOUND: NOT_FOUND, ErrorCode.ALREADY_EXISTS: USER_ERROR, ErrorCode.INVALID_ARGUMENT: USER_ERROR, ErrorCode.STORE_NOT_OPEN: IO_ERROR}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sextant")
    p.add_argument("--store", default=os.path.expanduser("~/.sextant"), help="folder of the store")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("file", nargs="?")
    add.add_argument("-n", "--name")
    add.add_argument("-t", "--tag", action="append", default=[])
    add.add_argument("-l", "--lang", default="")
    add.add_argument("-d", "--desc", default="")
    add.add_argument("--stdin", action="store_true")
    for name in ("get", "edit", "rm", "tag"):
        c = sub.add_parser(name)
        c.add_argument("id_or_name")
        if name == "get":
            c.add_argument("--raw", action="store_true")
        if name == "rm":
            c.add_argument("-f", "--force", action="store_true")
        if name == "tag":
            c.add_argument("operations", nargs=argparse.REMAINDER)
    for name in ("list", "search"):
        c = sub.add_parser(name)
        if name == "search":
            c.add_argument("query", nargs="?", default="")
            c.add_argument("-n", "--max", type=int, default=20)
        c.add_argument("-t", "--tag")
        c.add_argument("-l", "--lang")
    return p


def _id(store, text: str) -> int:
    from sextant.operators import catalog

    row = catalog.resolve(store.table(), text).first()
    if row is None:
        raise StoreError(ErrorCode.NOT_FOUND, f"no snippet {text}")
    return row["id"]


def run(spark, argv: list[str], out=None, stdin=None) -> int:
    """Run one command; its exit code."""
    from sextant.operators import catalog
    from sextant.sources.files import read_files

    out, stdin = out or sys.stdout, stdin or sys.stdin
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return OK if not e.code else USER_ERROR
    say = lambda *x: print(*x, file=out)
    try:
        store = catalog.SnippetStore.open(spark, a.store)
        if a.command == "add":
            if a.stdin or not a.file:
                name, content = a.name, stdin.read()
            else:
                row = read_files(spark, a.file).first()
                name, content = a.name or row["name"], row["content"]
            if not name:
                raise StoreError(ErrorCode.INVALID_ARGUMENT, "a snippet from the input needs --name")
            say("Added snippet", store.add(content, name, a.tag, a.lang, a.desc))
        elif a.command == "get":
            found = catalog.by_id(store.table(), _id(store, a.id_or_name))
            out.write(found.first()["content"] if a.raw else catalog.rendered(found).first()["text"])
        elif a.command == "edit":
            say("Updated" if store.edit(_id(store, a.id_or_name), stdin.read()) else "No changes")
        elif a.command == "rm":
            id_ = _id(store, a.id_or_name)
            if not a.force and stdin.readline().strip().lower() not in ("y", "yes"):
                say("Left as it is")
                return OK
            store.remove(id_)
            say("Removed snippet", id_)
        elif a.command == "tag":
            id_ = _id(store, a.id_or_name)
            if any(op[:1] not in ("+", "-") or len(op) < 2 for op in a.operations):
                raise StoreError(ErrorCode.INVALID_ARGUMENT, "tags are given as +tag or -tag")
            if a.operations:
                store.commit(catalog.retag(store.table(), [id_], a.operations))
            say(", ".join(store.get(id_)["tags"]))
        elif a.command == "list":
            rows = store.table()
            rows = catalog.by_tag(rows, a.tag) if a.tag else rows
            rows = catalog.by_language(rows, a.lang) if a.lang else rows
            for r in catalog.listing(catalog.in_key_order(rows)).toLocalIterator():
                say(f"{r['id']:<6}{r['name']:<25}{r['language']:<12}{r['tags']:<30}{r['size']}")
        else:
            hits = catalog.search_filtered(store.table(), a.query, a.tag, a.lang, a.max)
            for r in hits.join(store.table().select("id", "name", "language"), "id").orderBy("score", "id", ascending=[False, True]).collect():  # at most --max rows
                say(f"{r['id']:<6}{r['name']:<25}{r['language']:<12}{r['score']:.1f}  {r['matched_text']!r}")
        return OK
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return _CODES.get(e.code, INTERNAL)
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return IO_ERROR
    except Exception as e:
        print(f"error: {e if a.verbose else str(e).splitlines()[0]}", file=sys.stderr)
        return IO_ERROR if "PATH_NOT_FOUND" in str(e) else INTERNAL


def main() -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sextant").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
