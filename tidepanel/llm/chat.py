"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans, every window retains the system turn
and repeats a limited history, and only targets that no earlier window had are left to the loss.

Running token sums come from range partitions, so a conversation may hold any share of the rows. It is cut into stretches of a
fixed number of tokens by those sums; a stretch is worked on in one task, with the turns shortly before it sent along as history.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import bpe, frames

HEAD, MARK, END = "### ", ": ", "</turn>\n"
#: What stands for a control string inside a text or a role; none of them can occur in an escaped text.
ESCAPES = [("\\", "\\\\"), ("</turn>", "\\e"), ("### ", "\\h")]
SYSTEM, TARGET = "system", "assistant"


@dataclass(frozen=True)
class Budget:
    """Sizes in tokens."""

    window: int = 2048        #: of a window, everything included
    history: int = 512        #: of repeated turns, at most
    markup: int = 6           #: that a turn takes besides its text
    stretch: int = 1 << 20    #: of a conversation that one task works on


def escaped(text: str) -> str:
    for plain, code in ESCAPES:
        text = text.replace(plain, code)
    return text


def unescaped(text: str) -> str:
    # Backslashes come in pairs except in a code, so pairs are cut out first.
    return "\\".join(part.replace("\\e", "</turn>").replace("\\h", "### ") for part in text.split("\\\\"))


def block(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its text begins."""
    head = HEAD + escaped(role).replace(":", "\\c") + MARK
    return head + escaped(text) + END, len(head)


def blocks(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window: roles and texts as they were."""
    out = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece[len(HEAD):].partition(MARK)
        out.append((_role(role), unescaped(text)))
    return out


def _role(text: str) -> str:
    return "\\".join(part.replace("\\c", ":").replace("\\e", "</turn>").replace("\\h", "### ") for part in text.split("\\\\"))


def spans(ends: list[int], system: tuple[int, int] | None, first: int, budget: Budget) -> Iterator[tuple[int, int, int, bool]]:
    """(history from, new from, new to, system turn in front) of each window over turns whose token sums end at ``ends``.

    ``ends`` has one entry more than there are turns, the sum before the first. Turns before ``first`` are history only.
    ``system`` is the place of the system turn among them (negative: further back) and its tokens.
    """
    n, new = len(ends) - 1, first
    while new < n:
        low = max(bisect_left(ends, ends[new] - budget.history), 0)        # history: whole turns within its limit
        while True:
            front = system is not None and system[0] < low
            room = budget.window - (system[1] if front else 0)
            end = bisect_right(ends, ends[low] + room) - 1
            if end > new or low >= new:
                break
            low += 1                                                       # the oldest history gives way to the next turn
        end = max(end, new + 1)                                            # a turn over the budget is a window by itself
        yield low, new, min(end, n), front
        new = min(end, n)


def tokens(turns: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Adds ``n_tokens`` of ``text`` under a byte-level vocabulary to ``conv_id``, ``turn``, ``role`` and ``text``."""
    keep = ["conv_id", "turn", "role", "text"]
    return bpe.encode(turns.select(*keep), ranks, pattern, keep, with_ids=False).select(*keep, "n_tokens")


OUT = "conv_id long, stretch long, number long, text string, n_turns long, n_repeated long, loss array<struct<start:long,end:long>>, n_tokens long"


def windows(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """A row per window: ``conv_id``, ``stretch`` and ``number`` (its order), ``text`` in the template, ``n_turns`` in it, ``n_repeated`` (of
    these, in front: the system turn and history that an earlier window had), ``loss`` (where the texts of new assistant turns are,
    in code points, end exclusive) and ``n_tokens``.

    ``turns`` has conv_id, turn, role, text and n_tokens (null: 0); other columns are not read. Turns are ordered by turn, equal or
    null ones (first) by role and text; repeated rows are turns of their own. Null role and null text are empty. A null conv_id
    is a conversation. A window keeps to the budget unless one turn with the system turn exceeds it: that turn then has a
    window without history, whole. Only the first system turn is retained; windows before it do without. A stretch begins a new
    window. Every turn is new in one window; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                        (F.coalesce(F.col("n_tokens"), F.lit(0)) + budget.markup).cast("long").alias("cost"))
    rows = frames.materialise(frames.numbered(rows, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], "cost"))
    c = F.col
    own = rows.withColumn("stretch", F.floor(c("before") / budget.stretch).cast("long")).withColumn("kind", F.lit(2))
    # Turns that end shortly before the next stretch are its history.
    near = own.where(c("before") + c("cost") > (c("stretch") + 1) * budget.stretch - budget.history)
    near = near.withColumn("stretch", c("stretch") + 1).withColumn("kind", F.lit(1))
    first = rows.where(c("role") == SYSTEM).groupBy("conv_id").agg(F.min("position").alias("position"))
    system = rows.alias("r").join(first.alias("f"), c("r.conv_id").eqNullSafe(c("f.conv_id")) & (c("r.position") == c("f.position"))).select("r.*")
    held = own.groupBy("conv_id", "stretch").agg(F.lit(0).alias("kind"))
    system = system.alias("s").join(held.alias("h"), c("s.conv_id").eqNullSafe(c("h.conv_id"))).select("s.*", "h.stretch", "h.kind")
    columns = ["conv_id", "stretch", "kind", "position", "role", "text", "cost"]
    together = own.select(*columns).unionByName(near.select(*columns)).unionByName(system.select(*columns))
    keys = ["conv_id", "stretch", "kind", "position"]
    schema = StructType.fromDDL(OUT)
    arrow = to_arrow_schema(schema)

    def work(key: tuple, group: list[tuple], out: list[tuple]) -> None:
        head = next((g for g in group if g[0] == 0), None)
        body = [g for g in group if g[0]]
        n_old = sum(g[0] == 1 for g in body)
        if n_old == len(body):
            return
        ends = [0]
        for g in body:
            ends.append(ends[-1] + g[4])
        place = None if head is None else (head[1] - body[0][1], head[4])
        for number, (low, new, end, front) in enumerate(spans(ends, place, n_old, budget)):
            taken = ([head] if front else []) + body[low:end]
            repeated, text, at, loss = len(taken) - (end - new), [], 0, []
            for k, (_, _, role, said, _) in enumerate(taken):
                made, begin = block(role, said)
                if k >= repeated and role == TARGET:
                    loss.append({"start": at + begin, "end": at + len(made) - len(END)})
                text.append(made)
                at += len(made)
            out.append((*key, number, "".join(text), len(taken), repeated, loss, sum(g[4] for g in taken)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out, size = None, [], [], 0
        for batch in batches:
            for conv, stretch, *rest in zip(*[batch.column(k).to_pylist() for k in range(len(columns))], strict=True):
                if key != (conv, stretch):
                    if group:
                        work(key, group, out)
                    key, group = (conv, stretch), []
                group.append(tuple(rest))
                size += len(rest[3])
                if size > 1 << 23 and out:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, o, strict=True)) for o in out], schema=arrow)
                    out, size = [], 0
        if group:
            work(key, group, out)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, o, strict=True)) for o in out], schema=arrow)

    return together.repartition("conv_id", "stretch").sortWithinPartitions(*keys).mapInArrow(run, schema)


def read_back(made: DataFrame) -> DataFrame:
    """Per window what its text and its mask say: ``turns`` (role, newline, text, newline of each new turn), ``n_new``, ``learned`` (the
    texts under the mask) and ``n_chars``."""
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        cells = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "n_repeated", "loss")]
        out = {"turns": [], "n_new": [], "learned": [], "n_chars": []}
        for text, repeated, loss in zip(*cells, strict=True):
            new = blocks(text)[repeated:]
            out["turns"].append("".join(f"{r}\n{t}\n" for r, t in new))
            out["n_new"].append(len(new))
            out["learned"].append("".join(unescaped(text[s["start"]:s["end"]]) for s in loss))
            out["n_chars"].append(len(text))
        return out

    return frames.map_rows(made, ["conv_id", "stretch", "number"], "turns string, n_new long, learned string, n_chars long", work)


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    A digest runs over its conversation from the first window to the last, so this step streams a conversation's windows through
    one task; it holds two digests and one batch, whatever the length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    arrow = to_arrow_schema(schema)
    columns = ["conv_id", "turns", "n_new", "learned", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = (), None, []

        def result() -> tuple:
            return (*last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            for conv, turns, n_new, learned, n_chars in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True):
                if last != (conv,):
                    if state:
                        done.append(result())
                    last, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n_new
                state[1].update(turns.encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += n_chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(result(), strict=True), arrow, strict=True)], schema=arrow)

    return read.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "number").mapInArrow(run, schema)
