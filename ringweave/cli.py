"""python -m ringweave run CONFIG [--module NAME]... [--input FILE] [--checkpoint FOLDER] [seed words]; checkpoint FOLDER; progress FOLDER."""

from __future__ import annotations

import argparse
import importlib
import sys

from .config import loaded
from .config import run as run_config
from .operators.loops import Checkpoint
from .sources.lines import source_of

#: Exit codes of a run that stopped at a forced checkpoint, and of one that had finished before.
STOPPED, FINISHED = 0x10, 0x11


def main(argv: list[str] | None = None, out=None, stdin=None) -> int:
    out = out or sys.stdout
    parser = argparse.ArgumentParser(prog="ringweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a configured plan over the seed, a file's lines or standard input")
    run.add_argument("config")
    run.add_argument("--module", action="append", default=[], help="Python module that registers the jobs")
    run.add_argument("--input", help="text file of input lines")
    run.add_argument("--type", default="str", choices=["str", "int", "float"], help="what a line is read as")
    run.add_argument("-c", "--checkpoint", help="folder from which a run goes on, in a folder that exists")
    run.add_argument("--stop-after", type=int, help="steps after which the run stops at its checkpoint")
    run.add_argument("--stats", action="store_true", help="print the run's figures to standard error")
    run.add_argument("seed", nargs="*")
    for name, text in (("checkpoint", "show what a checkpoint folder holds"), ("progress", "print the time of a checkpoint's last step in ms since 1970, or -1")):
        commands.add_parser(name, help=text).add_argument("folder")
    given, more = parser.parse_known_args(argv)
    if given.command == "run" and not any(x.startswith("-") for x in more):
        given.seed += more  # seed words behind options
    elif more:
        parser.error(f"unrecognized arguments: {' '.join(more)}")

    from .builder import active
    from .stats import measured

    spark = active()
    if given.command != "run":
        state = Checkpoint(given.folder.rstrip("/"), "")
        print(state.info(spark) if given.command == "checkpoint" else state.modified(spark), file=out)
        return 0
    for name in given.module:
        importlib.import_module(name)
    kind = {"str": str, "int": int, "float": float}[given.type]
    if given.input and not given.seed:
        from pyspark.sql import functions as F

        from .sources.lines import read_lines

        source = read_lines(spark, given.input, {"str": "string", "int": "int", "float": "double"}[given.type]).where(F.col("value").isNotNull())
    else:
        source = [kind(x) for x in source_of(spark, seed=given.seed, stream=stdin or sys.stdin)]
    with measured(spark) as figures:
        try:
            run_config(loaded(given.config), source, spark=spark, handle=lambda item: print(item, file=out), checkpoint=given.checkpoint, stop_after=given.stop_after)
        except Checkpoint.Stopped as e:
            print(f"stopped {e}", file=sys.stderr)
            return STOPPED
        except Checkpoint.Finished as e:
            print(e, file=sys.stderr)
            return FINISHED
    if given.stats:
        print(figures, file=sys.stderr)
    return 0
