"""Command line: ``python -m cartograph index|find-scope|expand-folder|signatures|get-method-source``."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cartograph")
    commands = out.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build or refresh the index of folders")
    index.add_argument("--repo", default=".")
    index.add_argument("--force", action="store_true")
    index.add_argument("--status", action="store_true")
    find = commands.add_parser("find-scope", help="folders that fit a description best")
    find.add_argument("--query", required=True)
    find.add_argument("--must", action="append", default=[])
    find.add_argument("--repo", default=".")
    find.add_argument("--top", type=int)
    find.add_argument("--min-score", type=float, default=0.0)
    expand = commands.add_parser("expand-folder", help="members of a folder's files")
    expand.add_argument("folder")
    expand.add_argument("--pattern")
    listed = commands.add_parser("signatures", help="members of files, folders or globs")
    listed.add_argument("paths", nargs="+")
    source = commands.add_parser("get-method-source", help="source of a member")
    source.add_argument("file")
    source.add_argument("member")
    source.add_argument("--type")
    source.add_argument("--mode", default="signature_plus_body")
    return out


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .operators import extract, hints, search
    from .sources.git import worktree_root

    spark = SparkSession.builder.appName("cartograph").config("spark.ui.enabled", "false").getOrCreate()
    say = lambda text: print(f"[cartograph] {text}", file=sys.stderr)
    repo = getattr(options, "repo", ".")
    try:
        repo = worktree_root(repo)
    except RuntimeError:
        repo = os.path.abspath(repo)
    engine = Engine(spark, repo)
    if options.command == "index":
        if options.status:
            print(engine.status())
            return 0
        done = engine.index(options.force)
        say(f"{done['folders']} folders: {done['updated']} updated, {done['unchanged']} unchanged, {done['removed']} removed")
        return 0
    if options.command == "find-scope":
        if not options.query.strip():
            say("--query must not be blank")
            return 1
        rows = engine.find_scope(options.query, options.must, options.top, options.min_score)
        lines = [r[0] for r in search.ranked_lines(rows).collect()]
        if not lines:
            say("No results found.")
        print("\n".join(lines), end="\n" * bool(lines))
        return 0
    if options.command == "expand-folder":
        if not os.path.isdir(options.folder):
            say(f"no such folder: {options.folder}")
            return 1
        try:
            blocks = [r["block"] for r in extract.signature_blocks(engine.expand_folder(options.folder, options.pattern)).collect()]
        except ValueError as problem:
            say(str(problem))
            return 1
        print("\n\n".join(blocks) if blocks else hints.no_match_note(options.folder, options.pattern, engine.members([options.folder]).select("path").distinct().count()))
        return 0
    if options.command == "signatures":
        for line in extract.signature_lines(engine.signatures(options.paths)).toLocalIterator():
            print(line[0])
        for note in engine.notes:
            say(note)
        hint = engine.folder_hints(options.paths).first()
        if hint and hint["broad"]:
            say(f"{hint['n_files']} files: a narrower folder gives less output")
        if hint and hint["small"]:
            say(f"{hint['n_files']} files averaging {hint['mean_lines']} lines: reading them directly is as short")
        return 0
    if options.mode not in extract.MODES:
        say(f"--mode must be one of {', '.join(extract.MODES)}")
        return 1
    if not os.path.isfile(options.file):
        say(f"no such file: {options.file}")
        return 1
    rows = engine.get_method_source(options.file, options.member, options.type, options.mode)
    text = extract.to_json_array(rows)
    print(text)
    if text == "[]":
        near = engine.suggest(options.file, options.member)
        say(f"no member '{options.member}'" + (f"; near: {', '.join(near)}" if near else ""))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
