"""Command line of a model: ``run(model, argv)``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from .model import Model
from .plans.world import StepLog, World


def parser(name: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(name)
    p.add_argument("-i", "--in", dest="input", help="state to start from (.json, .xml or a directory)")
    p.add_argument("-s", "--steps", type=int, default=1, help="steps to run; 0: until an exit condition")
    p.add_argument("-r", "--random", type=int, default=0, help="seed")
    p.add_argument("--out-step", help="step log (.json or .xml)")
    p.add_argument("--out-exit", help="exit log (.json or .xml)")
    p.add_argument("--out-log", help="both logs in one file")
    p.add_argument("--out", help="state at the end (.json, .xml or a directory)")
    p.add_argument("--truncate", action="store_true", help="overwrite logs that exist")
    p.add_argument("-t", "--timing", action="store_true", help="print seconds")
    p.add_argument("-c", "--console", action="store_true", help="taken, without effect: no window is ever opened")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def run(model: Model, argv: Sequence[str] | None = None, spark: SparkSession | None = None, prepare: Callable[[World], None] | None = None, step_log: StepLog | None = None, exit_log: StepLog | None = None) -> World:
    import os

    from .errors import StateIOError
    from .sources.state import export_log, export_state, import_state

    args = parser(model.name).parse_args(sys.argv[1:] if argv is None else argv)
    for path in (args.out_step, args.out_exit, args.out_log):
        if path and os.path.exists(path) and not args.truncate:
            raise StateIOError(f"{path} exists; --truncate overwrites it")
    world = World(spark or SparkSession.builder.getOrCreate(), model, args.random)
    if args.input:
        import_state(world, args.input)
        world.step_count = 0
    if prepare:
        prepare(world)
    world.simulate(args.steps, step_log or StepLog(), exit_log or StepLog())
    if args.out_step:
        export_log(world, args.out_step, exit_=False)
    if args.out_exit:
        export_log(world, args.out_exit, steps=False)
    if args.out_log:
        export_log(world, args.out_log)
    if args.out:
        export_state(world, args.out)
    if args.timing or args.verbose:
        for name, seconds in world.times.items():
            if args.verbose or name == "simulation":
                print(f"{name}: {seconds:.3f} s")
    if not args.quiet:
        print(f"{model.name}: {world.step_count} steps")
    return world
