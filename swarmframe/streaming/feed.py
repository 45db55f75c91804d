"""Births from a stream: each micro-batch is one step of a world."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import population as P
from ..plans.world import World
from ..sources.state import export_state, import_state


def saved_batches(world: World, folder: str) -> dict[int, str]:
    """Batches whose state is whole in the folder, by number."""
    path = world.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(world.spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return {int(n[5:]): f"{folder}/state-{n[5:]}" for n in names if n.startswith("done-")}


def feed_births(stream: DataFrame, world: World, agent: str, order: str, state: str | None = None, after: Callable[[World], None] | None = None, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Rows of the stream (columns are variables) join the population with fresh ids, then the world steps.

    ``order`` is a distinct long column of the stream, in whose order ids are
    given. With ``checkpoint``, the world's state is stored beside the stream's
    own progress after each batch: a new run on a new world goes on from there,
    and a batch that is replayed is ignored.
    """
    folder = f"{checkpoint}/world" if checkpoint else ""
    stored = saved_batches(world, folder) if checkpoint else {}
    seen = max(stored, default=-1)
    if stored:
        import_state(world, stored[seen])

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal seen
        if number <= seen:
            return
        spec = world.model.agents[agent]
        key = (agent, state or spec.first_state)
        fresh = P.number_rows(rows, order, world.fresh_id(agent))
        made = fresh.select(P.ID, *[(v.literal() if v.name not in rows.columns else fresh[v.name].cast(v.spark_type)).alias(v.name) for v in spec.variables.values()])
        world.populations[key] = P.move(made, world.populations[key])
        world.step()
        if checkpoint:  # the mark is made last: a state without it is not whole
            export_state(world, f"{folder}/state-{number}")
            world.spark.range(1).write.mode("overwrite").parquet(f"{folder}/done-{number}")
            for old, path in saved_batches(world, folder).items():
                if old < number - 1:
                    world._delete(f"{folder}/done-{old}")
                    world._delete(path)
        seen = number
        if after:
            after(world)

    world._host_born.add(agent)
    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
