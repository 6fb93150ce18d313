"""Replicated operation logs: version vectors, incremental export, dependencies that wait, checkout, undo; batch and stream alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_STEPS = 1000


def changes(events: DataFrame, peer: str, order: str) -> DataFrame:
    """Events as changes: counter is each peer's own number from 0."""
    w = Window.partitionBy(peer).orderBy(order)
    return events.withColumn("counter", (F.row_number().over(w) - 1).cast("long")).withColumnRenamed(peer, "peer")


def version_vector(log: DataFrame) -> DataFrame:
    """(peer, counter): the greatest counter of each peer."""
    return log.groupBy("peer").agg(F.max("counter").alias("counter"))


def updates_since(log: DataFrame, vector: DataFrame) -> DataFrame:
    """Changes that a replica with this vector lacks; peers it does not know are new from 0."""
    return log.join(vector.select("peer", F.col("counter").alias("known")), "peer", "left").where(F.col("counter") > F.coalesce("known", F.lit(-1))).drop("known")


def checkout(log: DataFrame, vector: DataFrame) -> DataFrame:
    """The log as it was at a version: what lies at or below its vector."""
    return log.join(vector.select("peer", F.col("counter").alias("upto")), "peer").where("counter <= upto").drop("upto")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both logs; a change they share counts once, so merging is idempotent and the order of arguments does not matter."""
    return a.unionByName(b).dropDuplicates(["peer", "counter"])


def importable(log: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, pending): of the incoming changes those that follow a peer's known ones without a gap, and those that wait."""
    known = version_vector(log).withColumnRenamed("counter", "known")
    fresh = incoming.dropDuplicates(["peer", "counter"]).join(known, "peer", "left").withColumn("known", F.coalesce("known", F.lit(-1))).where("counter > known")
    place = F.row_number().over(Window.partitionBy("peer").orderBy("counter"))
    judged = fresh.withColumn("ready", F.col("counter") == F.col("known") + place)
    return judged.where("ready").drop("ready", "known"), judged.where("not ready").drop("ready", "known")


def undo_stack(log: DataFrame, peer: int, most: int = MOST_STEPS) -> DataFrame:
    """The last steps of a peer's own that can still be undone, latest first."""
    return log.where(F.col("peer") == peer).orderBy(F.desc("counter")).limit(most)


def undo_redo(actions: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(peer, seq, step, can_undo, can_redo): which step each of a peer's own actions (peer, seq, kind) does, undoes or redoes.

    kind is edit, undo or redo. A new edit clears what could be redone; of more than `most` steps the oldest are forgotten; an
    undo or redo with nothing left has no step. Of a peer no more than `most` steps are held, however many actions it has.
    """
    from ..operators.sequence import fold_rows

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        done, undone = [], []
        for seq, kind in rows:
            step = None
            if kind == "edit":
                step = seq
                done.append(seq)
                del done[: max(0, len(done) - max(most, 1))], undone[:]
            elif kind == "undo" and done:
                step = done.pop()
                undone.append(step)
            elif kind == "redo" and undone:
                step = undone.pop()
                done.append(step)
            yield seq, step, len(done), len(undone)

    return fold_rows(actions, "peer", "seq", ["kind"], run, "seq long, step long, can_undo long, can_redo long")


STATE = "next long, waiting array<long>, poisoned boolean"
OUTPUT = "peer long, counter long, status string"


def deliver(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A peer's changes in whatever order: each is applied once all before it are, repeats are ignored, a negative counter poisons the peer."""
    next_, waiting, poisoned = state.get if state.exists else (0, [], False)
    held = set(waiting)
    rows: list[tuple[int, int, str]] = []
    for batch in batches:
        for counter in batch["counter"].tolist():
            if poisoned or counter < 0:
                poisoned = True
                rows.append((key[0], counter, "refused"))
            elif counter < next_ or counter in held:
                rows.append((key[0], counter, "repeated"))
            else:
                held.add(counter)
                if counter > next_:
                    rows.append((key[0], counter, "pending"))
                while next_ in held:
                    held.remove(next_)
                    rows.append((key[0], next_, "applied"))
                    next_ += 1
    state.update((next_, sorted(held), poisoned))
    yield pd.DataFrame(rows, columns=["peer", "counter", "status"])


def delivered(stream: DataFrame) -> DataFrame:
    """deliver() over a stream of (peer, counter), with its state kept by peer."""
    return stream.select("peer", "counter").groupBy("peer").applyInPandasWithState(deliver, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


TURN = "conv_id long, turn long, accepted boolean, reason string"
SESSION = "opened boolean, last long, role string"


def session_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session accepts turns in order; the first must be a system's or user's, and no role speaks twice in a row."""
    opened, last, role = state.get if state.exists else (False, -1, "")
    rows = []
    turns = pd.concat(list(batches)).sort_values("turn", kind="stable")
    for turn, who in zip(turns["turn"].tolist(), turns["role"].tolist(), strict=True):
        reason = "not opened" if not opened and who == "assistant" else "out of order" if turn <= last else "twice in a row" if who == role else None
        if reason is None:
            opened, last, role = True, turn, who
        rows.append((key[0], turn, reason is None, reason))
    state.update((opened, last, role))
    yield pd.DataFrame(rows, columns=["conv_id", "turn", "accepted", "reason"])


def sessions(stream: DataFrame) -> DataFrame:
    return stream.select("conv_id", "turn", "role").groupBy("conv_id").applyInPandasWithState(session_step, TURN, SESSION, "append", GroupStateTimeout.NoTimeout)


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply): each request with the first answer after it before the next request; null without one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    follow = messages.withColumns({"next_role": F.lead("role").over(w), "next_turn": F.lead("turn").over(w)})
    return follow.where("role = 'user'").select("conv_id", "turn", F.when(F.col("next_role") == "assistant", F.col("next_turn")).alias("reply"))
