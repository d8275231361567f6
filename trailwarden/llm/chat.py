"""Chat formatting with a black-box template.

A template is a function ``render(turns) -> str`` over ``(role, text)`` pairs and
nothing else is known about it.  Successive turn prefixes are rendered and each
output is compared with the one before: the part that is new is the turn's
span.  An output that does not begin with the previous one means that the
template rewrites history; such a conversation is flagged and gets no spans.
Where the text lies inside its span is found the same way, by rendering the last
turn with two different one-character probes in place of its text.

Turns are sorted and streamed, prefixes are rendered in blocks of ``block`` turns,
and each block begins with the ``context`` turns before it (what a template may
look back at).  The first block of every conversation is rendered from its true
start, and every block's end is rendered again with twice the context; a
difference counts as rewritten history, too.  Templates that change only in longer
conversations are found by rendering the whole prefix after 2, 4, 8 ... blocks and
at the end, which must equal the segments so far; a change at a length between
these that is gone at the next of them is not seen.  For that a task keeps the
turns of the conversation it is at; output is one row per turn.  The flag of a
conversation reaches all of its turns by a join after the pass.

Control strings inside texts are escaped reversibly: an escape character is
inserted after the first character of each, and before each escape character.

Defined results: a null text or role is empty, a null ``turn`` sorts first,
rows with equal ``turn`` are ordered by role and text and kept each, a null
``conv_id`` is one conversation of its own, an empty table gives no rows, other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE = "␛"
PROBES = ("", "")
BLOCK = 32
CONTEXT = 1

Turn = tuple[str, str]


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    for mark in (START, END):
        text = text.replace(mark, mark[0] + ESCAPE + mark[1:])
    return text


def unescape(text: str) -> str:
    for mark in (START, END):
        # an odd run of escape characters after "<" ends in one that was inserted
        text = _drop_inserted(text, mark)
    return text.replace(ESCAPE + ESCAPE, ESCAPE)


def _drop_inserted(text: str, mark: str) -> str:
    return text.replace(mark[0] + ESCAPE + mark[1:], mark)


def chatml(turns: list[Turn]) -> str:
    """The default template: role line, text and end mark of each turn."""
    return "".join(f"{START}{escape(role)}\n{escape(text)}{END}\n" for role, text in turns)


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def turn_spans(render: Callable[[list[Turn]], str], context: list[Turn], turns: list[Turn]) -> list[tuple[str, int, int]] | None:
    """For each turn after ``context``: its rendered segment and where its text lies in it; None if history changes."""
    seen = list(context)
    before = render(seen)
    found = []
    for role, text in turns:
        now = render([*seen, (role, text)])
        if not now.startswith(before):
            return None
        one, two = (render([*seen, (role, p)]) for p in PROBES)
        if not (one.startswith(before) and two.startswith(before)):
            return None
        head = common_prefix(one, two)
        tail = len(one) - head - 1
        found.append((now[len(before):], head - len(before), len(now) - tail - len(before)))
        seen.append((role, text))
        before = now
    return found


def format_turns(rows: DataFrame, render: Callable[[list[Turn]], str] = chatml, context: int = CONTEXT,
                 block: int = BLOCK, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, position, role, segment, text_start, text_end, in_loss, rewrites``, one row per turn.

    Concatenating a conversation's segments by ``position`` gives its formatted
    text.  ``text_start``/``text_end`` are character offsets in the segment (null
    where history is rewritten), ``in_loss`` marks the turns whose text is
    learned.
    """
    chosen = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    names = ("conv_id", "position", "role", "segment", "text_start", "text_end", "in_loss", "rewrites")

    def fresh(conv):
        return {"conv": conv, "position": 0, "before": [], "deep": [], "bad": False,
                "turns": [], "read": hashlib.sha256(), "checked": 0}

    def rows_of(out):
        return pa.RecordBatch.from_arrays([
            pa.array(out["conv_id"], pa.int64()), pa.array(out["position"], pa.int64()),
            pa.array(out["role"], pa.string()), pa.array(out["segment"], pa.string()),
            pa.array(out["text_start"], pa.int64()), pa.array(out["text_end"], pa.int64()),
            pa.array(out["in_loss"], pa.bool_()), pa.array(out["rewrites"], pa.bool_())], list(out))

    def end(state, out):
        """A row without position where the whole conversation reads otherwise than its segments."""
        if not state["bad"] and state["position"] > state["checked"] and _changed(render, state):
            for k in names:
                out[k].append({"conv_id": state["conv"][0], "rewrites": True}.get(k))

    def run(batches):
        state = fresh(())
        for batch in batches:
            out = {k: [] for k in names}
            ids = batch.column("conv_id").to_pylist()
            turns = list(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()))
            at = 0
            while at < len(ids):
                if state["conv"] != (ids[at],):
                    end(state, out)
                    state = fresh((ids[at],))
                stop = at
                while stop < len(ids) and stop - at < block and ids[stop] == ids[at]:
                    stop += 1
                _block(render, context, state, turns[at:stop], ids[at], loss_role, out)
                at = stop
            yield rows_of(out)
        out = {k: [] for k in names}
        end(state, out)
        yield rows_of(out)

    passed = staged(placed.mapInArrow(
        run, "conv_id long, position long, role string, segment string, text_start long, text_end long, "
             "in_loss boolean, rewrites boolean"), "chat-turns")
    turns = passed.where("position is not null")
    changed = passed.where("rewrites").select(F.col("conv_id").alias("_conv"), F.lit(True).alias("_changed")).distinct()
    if changed.isEmpty():
        return turns
    joined = turns.join(changed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    kept = F.col("_changed").isNull()
    return joined.select("conv_id", "position", "role", "segment", F.when(kept, F.col("text_start")).alias("text_start"),
                         F.when(kept, F.col("text_end")).alias("text_end"), (F.col("in_loss") & kept).alias("in_loss"),
                         (~kept).alias("rewrites"))


def _changed(render, state) -> bool:
    return hashlib.sha256(render(state["turns"]).encode()).digest() != state["read"].digest()


def _block(render, context, state, turns, conv_id, loss_role, out) -> None:
    start = state["before"][-context:] if context else []
    spans = turn_spans(render, start, turns)
    if spans is not None and state["position"] > context:
        # the same block seen from further back must read the same
        deep = state["deep"][-2 * context:] if context else []
        whole, base = render([*deep, *turns]), render(deep)
        if not whole.startswith(base) or whole[len(base):] != "".join(s for s, _, _ in spans):
            spans = None
    state["bad"] |= spans is None
    if not state["bad"]:
        state["turns"] += turns
        state["read"].update("".join(s for s, _, _ in spans).encode())
        if not state["position"]:
            state["checked"] = len(turns)  # rendered from the start
        elif state["position"] + len(turns) >= 2 * state["checked"]:
            state["checked"] = state["position"] + len(turns)
            state["bad"] = _changed(render, state)
    if state["bad"]:
        state["turns"] = []
    for i, (role, text) in enumerate(turns):
        segment, first, last = spans[i] if spans is not None else (render([(role, text)]), None, None)
        out["conv_id"].append(conv_id)
        out["position"].append(state["position"] + i)
        out["role"].append(role)
        out["segment"].append(segment)
        out["text_start"].append(first)
        out["text_end"].append(last)
        out["in_loss"].append(spans is not None and role == loss_role)
        out["rewrites"].append(state["bad"])
    state["position"] += len(turns)
    state["before"] = [*state["before"], *turns][-max(1, context):]
    state["deep"] = [*state["deep"], *turns][-max(1, 2 * context):]


def digests(formatted: DataFrame) -> DataFrame:
    """Contract form, streamed over the formatted segments in order."""
    placed = formatted.select("conv_id", "position", "role", "segment", "text_start", "text_end", "in_loss").repartition(
        "conv_id").sortWithinPartitions("conv_id", "position")

    def fresh(conv):
        return {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0}

    def flush(s):
        return (s["conv"][0], s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows_of(done):
        columns = list(zip(*done)) if done else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches):
        s = None
        for batch in batches:
            done = []
            for conv, _, role, segment, first, last, in_loss in zip(*(c.to_pylist() for c in batch.columns)):
                if s is None or s["conv"] != (conv,):
                    if s is not None:
                        done.append(flush(s))
                    s = fresh((conv,))
                s["n"] += 1
                s["chars"] += len(segment)
                if first is None:
                    continue
                text = unescape(segment[first:last])
                s["turns"].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    s["loss"].update(text.encode())
                    s["loss_n"] += len(text)
            yield rows_of(done)
        if s is not None:
            yield rows_of([flush(s)])

    return placed.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long")
