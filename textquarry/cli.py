"""Command line of the search: python -m textquarry.cli -s TODO -e py,ts -l 3 src"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import grouped_digits, pad_start, token_estimate
from textquarry.plans.config import read_config, write_template
from textquarry.plans.globs import from_exclusion
from textquarry.plans.spec import NoCandidates, NoMatches, QuerySpec, split_csv
from textquarry.search import Search
from textquarry.sources.bundle import join_parts
from textquarry.sources.corpus import files_corpus, is_remote

VERSION = "0.1.0"


#: Commands that take what goes to the clipboard, by platform.
CLIPBOARD = {"darwin": ["pbcopy"], "win32": ["clip"]}
CLIPBOARD_ELSE = ["xclip", "-selection", "clipboard"]


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        """Usage errors are errors in the settings: 1, since 2 says that there are no candidates."""
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: error: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="textquarry", description="Select files by path and content and pack them, or the lines around matches.")
    p.add_argument("roots", nargs="*", help="folders to search (default: .)")
    p.add_argument("-s", "--strings", action="append", default=[], help="keep files with this string; repeatable")
    p.add_argument("-S", "--exclude-strings", action="append", default=[], help="drop files with this string; repeatable")
    p.add_argument("-e", "--extensions", action="append", default=[], help="comma-separated extensions")
    p.add_argument("-x", "--exclude-extensions", action="append", default=[], help="comma-separated extensions or globs to leave out")
    p.add_argument("-f", "--file", help="config file")
    p.add_argument("-l", "--lines", type=int, help="lines of context around matches")
    p.add_argument("-C", "--case-sensitive", action="store_true")
    p.add_argument("--include", action="append", default=[], help="comma-separated globs of paths to keep")
    p.add_argument("-i", "--ignore", action="append", default=[], help="comma-separated globs of paths to drop")
    p.add_argument("--preview", action="store_true", help="list the files only")
    p.add_argument("--stdout", action="store_true")
    p.add_argument("-o", "--output", help="file to write, or - for standard output")
    p.add_argument("-c", "--copy", action="store_true", help="also copy what is written to the clipboard")
    p.add_argument("--style", default="xml", help="xml, or markdown")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    return p


def spec_of(args: argparse.Namespace) -> QuerySpec:
    csv = lambda values: [x for v in values for x in split_csv(v)]
    config = read_config(args.file) if args.file else {"search": [], "extensions": [], "exclude": []}
    return QuerySpec(
        strings=(*config["search"], *args.strings), exclude_strings=tuple(args.exclude_strings), extensions=(*config["extensions"], *csv(args.extensions)),
        exclude=(*config["exclude"], *map(from_exclusion, csv(args.exclude_extensions))), include=tuple(csv(args.include)), ignore=tuple(csv(args.ignore)),
        lines=args.lines, case_sensitive=args.case_sensitive, style=args.style, roots=tuple(args.roots)).check()


class Written:
    """Parts of a bundle on their way to sinks, and the UTF-16 units that went by."""

    def __init__(self, parts: Iterable[str]):
        self.parts, self.chars = parts, 0

    def __iter__(self) -> Iterator[str]:
        for part in self.parts:
            self.chars += len(part.encode("utf-16-le", "surrogatepass")) // 2
            yield part


def copied(parts: Iterable[str], say) -> Iterator[str]:
    """parts, each also given to the platform's clipboard command. Without that command, or if it fails, only a message says so."""
    try:
        to = subprocess.Popen(CLIPBOARD.get(sys.platform, CLIPBOARD_ELSE), stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    except OSError:
        to = None
    fine = to is not None
    for part in parts:
        if fine:
            try:
                to.stdin.write(part.encode("utf-8", "replace"))
            except OSError:
                fine = False
        yield part
    if to is not None:
        try:
            to.stdin.close()
        except OSError:
            fine = False
        fine = to.wait() == 0 and fine
    say("Copied to the clipboard" if fine else "Nothing was copied: the clipboard command is missing or failed")


def write_file(search: Search, path: str) -> int:
    """The bundle as a file of the folders that are searched, written by the tasks; gives its UTF-16 units."""
    with tempfile.TemporaryDirectory(prefix=".bundle-", dir=os.path.dirname(os.path.abspath(path))) as parts:
        chars = search.write_bundle(parts)["chars"]
        join_parts(search.selected.sparkSession, parts, path)
    return chars


def report(search: Search, output: str, say, written: int | None = None) -> None:
    """written: characters of what went out; without output, those of all blocks count."""
    chars = F.col("total_chars") if written is None else F.lit(written).cast("long")
    t = search.totals().select("total_files", "total_matches", "total_windows", grouped_digits(token_estimate(chars)).alias("tokens"), grouped_digits(chars).alias("chars")).first()
    say(f"\nfiles packed: {t['total_files']}")
    if search.spec.context:
        say(f"matches: {t['total_matches']} in {t['total_windows']} windows of {search.spec.context} lines around each")
    say(f"size: {t['chars']} characters, about {t['tokens']} tokens\nwritten to: {output}")
    found = [r["ext"] for r in search.extensions().collect()]
    if found:
        say("\nextensions: " + ", ".join(found))
    top = search.top_files().select("rel", pad_start(grouped_digits(F.col("tokens")), 8).alias("tokens")).collect()
    if top:
        say("\nlargest files, by tokens:")
        for r in top:
            say(f"  {r['tokens']}  {r['rel']}")


def init(name: str | None) -> int:
    """Writes a config file; asks before a folder is made for it."""
    path = name or "search-config.ini"
    path += "" if os.path.splitext(path)[1] else ".ini"
    folder = os.path.dirname(path)
    try:
        create = False
        if folder and not os.path.exists(folder) and not os.path.exists(path):
            try:
                create = input(f"{folder} does not exist. Make it? (y/n) ").strip().lower() in ("y", "yes")
            except EOFError:
                create = False
        print(f"Created {write_template(path, create)}")
        return 0
    except OSError as e:
        print(e, file=sys.stderr)
        return 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 well, 1 usage, settings or template, 2 no candidates, 3 no matches."""
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["init"]:
        return init(argv[1] if len(argv) > 1 else None)
    try:
        args = parser().parse_intermixed_args(argv)
    except SystemExit as e:
        return e.code or 0
    try:
        spec = spec_of(args)
    except (OSError, ValueError) as e:
        print(f"Error in settings: {e}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("textquarry").getOrCreate()
    to_stdout = args.stdout or args.output == "-"
    say = (lambda m: print(m, file=sys.stderr)) if to_stdout else print
    search = Search(files_corpus(spark, spec, pushdown=True), spec)  # each of its queries has the corpus once
    try:
        search.require()
    except (NoCandidates, NoMatches) as e:
        print(e, file=sys.stderr)
        return e.exit_code
    if args.preview:
        print("Matched files:")
        n = 0
        for n, r in enumerate(search.preview().toLocalIterator(prefetchPartitions=True), 1):  # noqa: B007
            print(os.path.abspath(r["rel"]))
        print(f"\nTotal: {n} file(s).")
        return 0
    written = None
    if to_stdout or args.output:
        for r in search.unreadable().toLocalIterator():
            print(f"Warning: {r['rel']} could not be read: {r['error']}", file=sys.stderr)
        if to_stdout or args.copy or any(map(is_remote, spec.roots)):
            stream = Written(search.bundle())
            parts = copied(stream, say) if args.copy and not to_stdout else stream
            if to_stdout:
                sys.stdout.writelines(parts)
            else:
                with open(args.output, "w", encoding="utf-8", newline="") as f:
                    f.writelines(parts)
            written = stream.chars
        else:
            written = write_file(search, args.output)
    report(search, "-" if to_stdout else args.output or "none", say, written)
    return 0


if __name__ == "__main__":
    sys.exit(main())
