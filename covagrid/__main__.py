"""The command line: python -m covagrid plp|histo FILE [options]."""

from __future__ import annotations

import argparse
import sys

from covagrid.errors import PileupError
from covagrid.operators.outputs import Histogram, Pileup
from covagrid.params import BY_REFERENCE, COVERED, EVERYTHING, PileupParams, parse_flags


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="covagrid", description="A row for each reference coordinate of sorted alignments.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, said in (("plp", "bases and qualities as text"), ("histo", "counts of bases and indels")):
        one = commands.add_parser(name, help=said)
        one.add_argument("file", help="SAM or BAM; - is the standard input (SAM)")
        one.add_argument("-r", "--regions", help="NAME[:START[-END]], split by commas")
        one.add_argument("-o", "--output", help="folder of ordered part files, replaced if there; the standard output if not given")
        one.add_argument("-a", dest="by_reference", action="store_true", help="all coordinates of intervals with reads")
        one.add_argument("--aa", dest="everything", action="store_true", help="all coordinates")
        one.add_argument("-t", "--threads", type=int, default=3, help="threads where Spark runs locally")
        one.add_argument("-c", "--bin-width", type=int, default=1000, help="coordinates that a group of reads spans")
        one.add_argument("-f", "--fasta", help="reference sequences")
        one.add_argument("-d", "--max-depth", type=int, default=8000, help="reads in view at most; 0: no cap")
        one.add_argument("-x", "--ignore-overlaps", action="store_true", help="don't merge the qualities of overlapping mates")
        one.add_argument("-A", "--count-orphans", action="store_true", help="also paired reads that aren't in a proper pair")
        one.add_argument("--rf", type=parse_flags, default=0, metavar="FLAGS", help="only reads with any of these")
        one.add_argument("--ff", type=parse_flags, default=PileupParams().exclude_flags, metavar="FLAGS", help="no reads with any of these")
        one.add_argument("-q", "--min-mapping-quality", type=int, default=0)
        one.add_argument("-Q", "--min-base-quality", type=int, default=13)
        one.add_argument("-B", "--no-baq", action="store_true", help="don't use base alignment qualities")
        one.add_argument("-E", "--redo-baq", action="store_true", help="compute them anew")
    return top


def params_of(args: argparse.Namespace) -> PileupParams:
    return PileupParams(
        args.regions, EVERYTHING if args.everything else BY_REFERENCE if args.by_reference else COVERED, args.max_depth, args.ignore_overlaps, args.count_orphans, args.rf, args.ff, args.min_mapping_quality, args.min_base_quality,
        args.no_baq, args.redo_baq, bin_width=args.bin_width,
    )


def main(argv: list[str] | None = None) -> int:
    """0, also when the reader of the output goes away; 1 for bad arguments and errors; 130 when interrupted."""
    try:
        args = parser().parse_args(argv)
        params = params_of(args)
    except SystemExit as e:
        return 1 if e.code else 0
    except PileupError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from covagrid.plans.engine import PileupEngine
    from covagrid.shipping import ship

    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.threads}]").appName("covagrid").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        path = args.file
        if path == "-":
            path = _spooled()
        output = Pileup() if args.command == "plp" else Histogram(params.strict)
        query = PileupEngine(ship(spark), params, args.fasta).submit(path)
        if args.output:
            query.write(args.output, output)
        else:
            for row in query.text(output).toLocalIterator():
                print(row.value)
            sys.stdout.flush()
    except BrokenPipeError:
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def _spooled() -> str:
    """The standard input as a file: a plan may read its source more than once."""
    import shutil
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".sam", delete=False) as target:
        shutil.copyfileobj(sys.stdin.buffer, target)
    return target.name


if __name__ == "__main__":
    sys.exit(main())
