"""Options of an analysis, from the command line and an ini file, and a runner for processors."""

from __future__ import annotations

import argparse
import configparser
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from ..operators import blocks
from ..operators.results import merge
from ..sources import tables
from .processor import Processor, analyse

LEVELS = {"quiet": "ERROR", "verbose": "INFO", "debug": "DEBUG"}


class Configuration:
    """Override ``add_options`` and ``new_processor``; ``values`` holds what was given, the command line
    before the file before the defaults."""

    #: read if it is there and no other file is named
    file = "analysis.ini"

    def __init__(self):
        self.values: dict[str, str] = {}

    def add_options(self, add: Callable[..., None]) -> None:
        """``add(name, default, help)`` for each option of its own."""

    def read_arguments(self) -> None:
        """Called once ``values`` are there."""

    def new_processor(self) -> Processor:
        raise NotImplementedError

    def parse(self, argv: Sequence[str]) -> argparse.Namespace:
        parser, defaults = argparse.ArgumentParser(), {}

        def add(name: str, default: str | None = None, help: str = "") -> None:  # noqa: A002
            defaults[name] = default
            parser.add_argument(f"--{name}", help=help)

        parser.add_argument("inputs", nargs="*")
        parser.add_argument("-c", "--config", help="ini file; its section is [analysis]")
        parser.add_argument("-o", "--output", help="folder for kept events")
        parser.add_argument("-r", "--results", help="folder for results")
        parser.add_argument("-n", "--number", type=int, help="stop after so many events, in their order")
        parser.add_argument("--order", help="columns by which events are in order, with commas")
        parser.add_argument("--per", help="merge results of blocks by this column")
        parser.add_argument("--split-per", help="one folder of kept events for each value of this column")
        level = parser.add_mutually_exclusive_group()
        for name in LEVELS:
            level.add_argument(f"--{name}", action="store_true")
        self.add_options(add)
        given = parser.parse_args(argv)
        ini = configparser.ConfigParser()
        if not ini.read(given.config or self.file) and given.config:
            raise FileNotFoundError(given.config)
        own = dict(ini["analysis"]) if ini.has_section("analysis") else {}
        unknown = own.keys() - {n.lower() for n in defaults} - vars(given).keys()
        if unknown:
            raise ValueError(f"no such options: {sorted(unknown)}")
        for name, default in defaults.items():
            said = getattr(given, name.replace("-", "_"))
            self.values[name] = own.get(name.lower(), default) if said is None else said
        for name in ("output", "results", "per", "split_per", "order"):
            if getattr(given, name) is None:
                setattr(given, name, own.get(name))
        self.read_arguments()
        return given


def run(configuration: Configuration, argv: Sequence[str], spark: SparkSession, read: Callable | None = None):
    """Runs a configuration's processor over the inputs (Parquet, or what ``read(spark, paths)`` gives) and
    writes what was asked for."""
    given = configuration.parse(argv)
    for name, level in LEVELS.items():
        if getattr(given, name):
            spark.sparkContext.setLogLevel(level)
    if not given.inputs:
        raise ValueError("no inputs")
    events = (read or tables.read_events)(spark, given.inputs)
    if given.number is not None:
        events = events.orderBy(*(given.order or "").split(",")).limit(given.number) if given.order else events.limit(given.number)
    done = analyse(configuration.new_processor(), events, keys=[given.per] if given.per else [])
    if given.output:
        if done.skim is None:
            raise ValueError("this analysis keeps no events")
        if given.split_per:
            blocks.split_per(done.skim, given.split_per, given.output)
        else:
            tables.write_events(done.skim, given.output)
    if given.results:
        tables.write_results(merge(done.results, keys=[given.per]) if given.per else done.results, given.results)
    return done
