"""Commands: direct (changes from recordings), edit (a plan from changes) and urls (a list of what to fetch)."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, arguments: Callable[[argparse.ArgumentParser], None]) -> Callable:
    """Registers a command; `arguments` declares what it takes."""

    def register(run: Callable) -> Callable:
        COMMANDS[name] = (arguments, run)
        return run

    return register


def _direct_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("src", help="PCM files, or subtitle files for tfidf")
    p.add_argument("dst", help="folder for the edit lists")
    p.add_argument("method", choices=["spectrogram", "tfidf"])
    p.add_argument("--corpus", help="Parquet table with a column text, for tfidf")
    p.add_argument("--ratio", type=float, default=1.0)


@command("direct", _direct_arguments)
def direct(spark: SparkSession, args: argparse.Namespace) -> None:
    """Analyses every recording and writes an edit list for each."""
    from timeweave.plans import methods
    from timeweave.sources import config, recordings, subtitles

    if args.method == "spectrogram":
        blocks = recordings.read_pcm(spark, args.src, mono=True).withColumnRenamed("path", "rec")
        chosen, source = methods.prepare("spectrogram", th_ratio=args.ratio), blocks
    else:
        source = subtitles.read_subtitles(spark, args.src).withColumnRenamed("path", "rec")
        chosen = methods.prepare("tfidf", corpus=spark.read.parquet(args.corpus), sent_th_ratio=args.ratio)
    config.edit_list(methods.direct([(chosen, source)])).write.mode("overwrite").json(args.dst)


def _edit_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("packets", help="Parquet table of rec, pts")
    p.add_argument("config", help="JSON files with timeline-changes")
    p.add_argument("dst")


@command("edit", _edit_arguments)
def edit(spark: SparkSession, args: argparse.Namespace) -> None:
    """Applies the changes of a configuration to every recording of a packet table."""
    from timeweave.plans import methods
    from timeweave.sources import config

    given = config.timeline_changes(spark.read.text(args.config, wholetext=True).select(F.lit(0).alias("id"), F.col("value").alias("json")))
    packets = spark.read.parquet(args.packets)
    changes = packets.select("rec").distinct().crossJoin(F.broadcast(given.drop("id")))
    methods.edit(packets, changes).write.mode("overwrite").parquet(args.dst)


def _urls_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("src")
    p.add_argument("dst")
    p.add_argument("--infos", required=True, help="JSON lines of what is known of the recordings")
    p.add_argument("--language", default="none")


@command("urls", _urls_arguments)
def urls(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes the recordings of a URL list that have subtitles in a language."""
    from timeweave.sources import urls as source

    wanted = source.read_urls(spark, args.src)
    infos = spark.read.schema(source.INFO).json(args.infos)
    known = infos.join(wanted, infos["webpage_url"] == wanted["url"], "left_semi")
    source.write_urls(source.valid_urls(known, args.language), args.dst)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="timeweave")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, run) in COMMANDS.items():
        arguments(sub.add_parser(name, help=run.__doc__))
    args = parser.parse_args(argv)
    COMMANDS[args.command][1](SparkSession.builder.appName("timeweave").getOrCreate(), args)


if __name__ == "__main__":
    main()
