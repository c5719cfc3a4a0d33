"""Chat formatting: the cheapest repair of each conversation's roles, by dynamic programming over a turn automaton.

Legal conversations are an optional system turn, then user and assistant in turn, beginning with user. Each turn is kept,
relabelled, merged into the turn before it, or preceded by empty turns; ``KEEP`` to ``INSERT`` are the costs. The least
cost from one automaton state to another is a small min-plus matrix, and such matrices can be multiplied in any grouping:
all turns are cut into ranges of about equal rows, and in each range a conversation into chunks of at most ``CHUNK``
rows, whatever their turn numbers, so neither a long conversation nor equal turn numbers or rows meet in one task. The
chunks' matrices are made in separate tasks, chained (a 4 x 4 matrix a chunk), and give each chunk the states it begins
and ends with; then each chunk finds its own path.
The repaired turns are rendered piece by piece: a conversation's pieces, in order, are its text.

Defined cases: roles are compared trimmed and in lower case; null and unknown roles may take any role at ``UNKNOWN``;
null text renders as empty; turns of one number are ordered by role and the SHA-256 of their text (ranges are cut by it,
so it has to be short); null turn numbers come first; rows without a conversation id form one conversation; repeated rows are turns of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import Stash, partitions, parts, runs, table

ROLES = ("system", "user", "assistant")
#: Costs of what a repair may do to a turn; merging a turn of another role costs both.
KEEP, MERGE, RELABEL, UNKNOWN, INSERT = 0, 2, 3, 1, 4
#: Rows of a chunk, at most.
CHUNK = 4096
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
START = 0  # states: 0 before any turn, then 1 + the place of the last turn's role in ROLES
_FAR = 1 << 40
#: Which roles may follow each state.
_NEXT = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user",)}


def _ways(state: int, role: int) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(cost, next state, action, inserted roles) of a turn of ROLES[role], or of an unknown role (3), in a state."""
    label = lambda q: KEEP if q == role else (UNKNOWN if role == 3 else RELABEL) + (q == 0)  # noqa: E731  a turn made system costs one more
    named = lambda q: "keep" if q == role else "relabel"
    out = []
    if state != START:
        q = state - 1
        out.append((MERGE + label(q), state, "merge" if q == role else "merge_relabel", ()))
    for q, name in enumerate(ROLES):
        if name in _NEXT[state]:
            out.append((label(q), q + 1, named(q), ()))
        else:
            for between in _NEXT[state]:
                if name in _NEXT[ROLES.index(between) + 1]:
                    out.append((INSERT + label(q), q + 1, named(q), (between,)))
    return out


#: For each role and pair of states the cheapest way, the first of equals.
BEST: list[dict[tuple[int, int], tuple[int, str, tuple[str, ...]]]] = []
for _role in range(4):
    _own: dict[tuple[int, int], tuple[int, str, tuple[str, ...]]] = {}
    for _state in range(4):
        for _cost, _to, _action, _inserted in _ways(_state, _role):
            if (_state, _to) not in _own or _cost < _own[_state, _to][0]:
                _own[_state, _to] = (_cost, _action, _inserted)
    BEST.append(_own)
COSTS = np.full((4, 4, 4), _FAR, np.int64)
for _role, _own in enumerate(BEST):
    for (_a, _b), _way in _own.items():
        COSTS[_role, _a, _b] = _way[0]


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 3


def matrix(roles: list[int]) -> np.ndarray:
    """Least costs between all states over a run of turns."""
    out = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(out, 0)
    for role in roles:
        out = np.minimum((out[:, :, None] + COSTS[role][None]).min(1), _FAR)
    return out


def path(roles: list[int], entry: int, leave: int) -> list[int]:
    """The states after each turn of a cheapest way from ``entry`` to ``leave``; of equals the smallest state."""
    front = [np.full(4, _FAR, np.int64)]
    front[0][entry] = 0
    for role in roles:
        front.append(np.minimum((front[-1][:, None] + COSTS[role]).min(0), _FAR))
    states = [leave]
    for t in range(len(roles) - 1, 0, -1):
        states.append(int(np.argmin(front[t] + COSTS[roles[t]][:, states[-1]])))
    return states[::-1] if roles else []


def chain(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states that each chunk begins and ends with on a cheapest way from START."""
    front = [np.array([0, _FAR, _FAR, _FAR])]
    for m in matrices:
        front.append(np.minimum((front[-1][:, None] + m).min(0), _FAR))
    states = [int(np.argmin(front[-1]))]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(int(np.argmin(front[k] + matrices[k][:, states[-1]])))
    states.reverse()
    return list(zip(states[:-1], states[1:], strict=True))


def _numbered(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (name first) with their chunk of ``size`` rows, ascending over tasks too, and their place in it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        last, seen = None, 0
        for batch in parts(batches):
            chunks, places = [], []
            for name in batch.column(0).to_pylist():
                seen = seen + 1 if name == last else 0
                last = name
                chunks.append(first + seen // size)
                places.append(seen % size)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(places, pa.int64()), *batch.columns], ["chunk", "place", *batch.schema.names])

    return number


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, chunks, costs = [], [], []
    for rows in runs(batches, 2):
        names.append(rows[0][0])
        chunks.append(rows[0][1])
        costs.append(matrix([role_of(r[2]) for r in rows]).ravel().tolist())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(chunks, pa.int64()), pa.array(costs, pa.list_(pa.int64()))], ["name", "chunk", "costs"])


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("chunk")
    ends = chain([np.array(c, np.int64).reshape(4, 4) for c in frame["costs"]])
    last = frame["chunk"].max()
    return pd.DataFrame({"name": frame["name"], "chunk": frame["chunk"], "entry": [a for a, _ in ends], "leave": [b for _, b in ends], "final": [c == last for c in frame["chunk"]]})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ["conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "piece"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    out: list[tuple] = []

    def closed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], columns)
        out.clear()
        return made

    for rows in runs(batches, 2):
        entry, leave, final = rows[0][5:8]
        roles = [role_of(r[3]) for r in rows]
        state = entry
        for i, (row, role, to) in enumerate(zip(rows, roles, path(roles, entry, leave), strict=True)):
            cost, action, inserted = BEST[role][state, to]
            text = row[4]
            if action.startswith("merge"):
                piece = "\n" + text
            else:
                piece = (CLOSE + "\n" if state != START else "") + "".join(OPEN.format(x) + CLOSE + "\n" for x in inserted) + OPEN.format(ROLES[to - 1]) + text
            if final and i == len(rows) - 1:
                piece += CLOSE
            out.append((int(row[0]) if row[0] else None, row[2], row[3], ROLES[to - 1], action, ",".join(inserted), cost, piece))
            state = to
        if len(out) >= 4096:
            yield closed()
    yield closed()


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted (roles of empty turns before it), cost, piece of every turn."""
    stash = Stash(turns.sparkSession)
    name = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    own = turns.select(name.alias("name"), turn.alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # written with their numbers, which are then the same whenever a task runs again; they tell repeated rows apart
    own = stash.put(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    place = (F.col("name"), F.col("turn"), F.col("role"), F.unhex(F.sha2("text", 256)), F.col("row"))
    ranged = own.repartitionByRange(partitions(turns.sparkSession), *place).sortWithinPartitions(*place).drop("row")
    own = stash.put(ranged.mapInArrow(_numbered(CHUNK), "chunk long, place long, name string, turn long, role string, text string"), "numbered")
    stash.drop("rows")
    order = ("name", "chunk", "place")
    costs = own.select(*order, "role").repartition("name", "chunk").sortWithinPartitions(*order).select("name", "chunk", "role").mapInArrow(_matrices, "name string, chunk long, costs array<long>")
    costs = stash.put(costs.withColumn("chunks", F.count("*").over(Window.partitionBy("name"))), "matrices")
    row = F.slice("costs", 1, 4)
    single = costs.where("chunks = 1").select("name", "chunk", F.lit(START).cast("long").alias("entry"), (F.array_position(row, F.array_min(row)) - 1).alias("leave"), F.lit(True).alias("final"))
    several = costs.where("chunks > 1").drop("chunks").groupBy("name").applyInPandas(_chained, "name string, chunk long, entry long, leave long, final boolean")
    ends = single.unionByName(several)
    # dealt after the join: a broadcast or a split of skewed partitions would leave a chunk's turns in several tasks
    joined = own.join(ends, ["name", "chunk"]).repartition("name", "chunk").sortWithinPartitions(*order).select("name", "chunk", "turn", "role", "text", "entry", "leave", "final")
    return joined.mapInArrow(_repaired, "conv_id long, turn long, role string, new_role string, action string, inserted string, cost long, piece string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
