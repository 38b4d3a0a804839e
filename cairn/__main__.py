"""python -m cairn --db FOLDER COMMAND ...: the commands as JSON lines; exits with the outcome."""

from __future__ import annotations

import argparse
import os
import sys

#: The configuration that is read where none is named.
CONFIG = "cairn.toml"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("--db", default="index.db")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *, config: bool = False, fresh: bool = False, limit: int | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if config:
            c.add_argument("--config")
        if fresh:
            c.add_argument("--no-fresh", action="store_true")
            c.add_argument("--delta-limit", type=int)
        if limit is not None:
            c.add_argument("-n", "--limit", type=int, default=limit)
        return c

    c = command("index")
    c.add_argument("root")
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--exclude-prefix", action="append", default=[])
    c.add_argument("--no-default-excludes", action="store_true")
    c.add_argument("--skip-hidden", action="store_true")
    c.add_argument("--use-gitignore", action="store_true")
    command("hash").add_argument("--max-size", type=int, default=4 << 20)
    c = command("fulltext", config=True)
    c.add_argument("--max-size", type=int)
    c.add_argument("--ext", action="append", default=[])
    c.add_argument("--no-sniff", action="store_true")
    c = command("search", config=True, fresh=True, limit=10)
    c.add_argument("query")
    c.add_argument("--snippet-chars", type=int, default=160)
    c.add_argument("--no-db", action="store_true")
    c.add_argument("--ext", action="append", default=[])
    command("find", fresh=True, limit=20).add_argument("query")
    c = command("tag", config=True)
    c.add_argument("--no-read-magic", action="store_true")
    c.add_argument("--magic-max-size", type=int)
    c.add_argument("--no-read-embedded", action="store_true")
    c.add_argument("--embedded-max-size", type=int, default=64 << 20)
    c = command("tags", config=True, fresh=True, limit=20)
    c.add_argument("words", nargs="*")
    c.add_argument("--file")
    c = command("browse", fresh=True)
    c.add_argument("words", nargs="*")
    for flag in ("axes", "values", "label-terms"):
        c.add_argument(f"--{flag}", type=int)
    c.add_argument("-n", "--files", type=int)
    c = command("status")
    c.add_argument("--check-journal", action="store_true")
    c.add_argument("--journal-warn-hours", type=float, default=24)
    return p


def _config(name: str | None) -> str:
    """The text of the configuration: the one named, which must be there, or the one that lies here."""
    if name is None and not os.path.exists(CONFIG):
        return ""
    with open(name or CONFIG, encoding="utf-8") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)

    from pyspark.sql import SparkSession

    from cairn.engine import Answer, Engine
    from cairn.operators.fresh import DELTA_LIMIT
    from cairn.plans.policy import ExcludePolicy, TextPolicy, ignore_patterns, missing_prefixes
    from cairn.report import Outcome

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        e = Engine(spark, a.db)
        e.delta_limit = getattr(a, "delta_limit", None) or DELTA_LIMIT
        fresh = not getattr(a, "no_fresh", False)
        if a.command == "index":
            ignored = []
            if a.use_gitignore and os.path.exists(os.path.join(a.root, ".gitignore")):
                with open(os.path.join(a.root, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    ignored = ignore_patterns(f.read())
            out = e.index(a.root, ExcludePolicy.build(a.exclude, a.exclude_prefix, not a.no_default_excludes, ignored, a.skip_hidden))
            if absent := missing_prefixes(a.exclude_prefix):
                out.notice = f"no such directories, nothing is excluded by them: {', '.join(absent)}"
        elif a.command == "hash":
            out = e.hash(a.max_size)
        elif a.command == "fulltext":
            policy = TextPolicy.from_config(_config(a.config)).with_text(a.ext)
            out = e.fulltext(policy=policy, sniff=not a.no_sniff, **({"max_bytes": a.max_size} if a.max_size else {}))
        elif a.command == "search":
            policy = TextPolicy.from_config(_config(a.config)).with_text(a.ext)
            out = e.search_index(a.query, a.limit, a.snippet_chars) if a.no_db else e.search(a.query, a.limit, a.snippet_chars, fresh, policy)
        elif a.command == "find":
            out = e.find(a.query, a.limit, fresh)
        elif a.command == "tag":
            out = e.tag(_config(a.config), not a.no_read_magic, not a.no_read_embedded, a.embedded_max_size, a.magic_max_size)
        elif a.command == "tags":
            out = e.explain(a.file, _config(a.config) or None) if a.file else e.tags(a.words, a.limit, fresh)
        elif a.command == "browse":
            given = {"axes": a.axes, "values": a.values, "label_terms": a.label_terms, "preview": a.files}
            out = e.browse(a.words, fresh_answer=fresh, **{k: v for k, v in given.items() if v is not None})
        else:
            out = e.status(a.check_journal, a.journal_warn_hours)
    except (ValueError, KeyError, OSError, RuntimeError) as err:
        out = Answer(Outcome.UNUSABLE, notice=str(err))
    for line in out.lines(a.command):
        print(line)
    return int(out.outcome)


if __name__ == "__main__":
    sys.exit(main())
