"""Chat formatting by incremental black-box rendering.

A template is any callable that renders a list of (role, text) turns to a string. For each conversation the prefixes of
its turns are rendered one after another. Where each output starts with the one before, what was added is the span of
that turn; where it doesn't, the template rewrites history, the conversation is marked so and gets no loss mask.
Inside a span, the text's place is found by rendering the same prefix with two one-character probes as its last text:
the first difference is where the text begins, and what follows the probe is the turn's closing.

The loss mask covers the texts of the roles in `loss_roles`, without markers, as code point ranges of the output.

Rows are dealt by conversation and sorted by turn; a task holds one conversation at a time, as a template must see it
whole. Turns with equal numbers are ordered by role, then text. Null text or role is empty; rows with a null
conversation id form a conversation of their own; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixgrid.llm.session import prepare

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Breaks every `<|` by a backslash, and doubles backslashes: no control string is left, and unescape() undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def chatml(turns: Turns) -> str:
    """`<|im_start|>role`, a line break, the text, `<|im_end|>`, a line break; for each turn. Role and text are escaped."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


def parse_chatml(formatted: str) -> Turns:
    """The turns that chatml() rendered."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _text_place(render: Template, turns: Turns, before: str, whole: str) -> tuple[int, int] | None:
    """Where the last turn's text lies in `whole`; None if the template changes more than that place."""
    role = turns[-1][0]
    a, b = (render([*turns[:-1], (role, probe)]) for probe in "AB")
    at = next((i for i in range(len(before), min(len(a), len(b))) if a[i] != b[i]), None)
    if at is None or a[at + 1 :] != b[at + 1 :]:
        return None
    stop = len(whole) - (len(a) - at - 1)
    return (at, stop) if at <= stop and whole.startswith(a[:at]) and whole[stop:] == a[at + 1 :] else None


def render_spans(render: Template, turns: Turns, loss_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Output, span of each turn, loss ranges, whether the template rewrites history."""
    before, spans, loss = "", [], []
    for n in range(1, len(turns) + 1):
        whole = render(turns[:n])
        if not whole.startswith(before):
            return render(turns), [], [], True
        spans.append((len(before), len(whole)))
        if turns[n - 1][0] in loss_roles:
            place = _text_place(render, turns[:n], before, whole)
            if place is None:
                return render(turns), [], [], True
            loss.append(place)
        before = whole
    return before, spans, loss, False


SCHEMA = "conv_id {kind}, n_turns long, formatted string, spans array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>, rewrites_history boolean"


def format_conversations(rows: DataFrame, render: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, n_turns, formatted, spans, loss, rewrites_history."""
    prepare(rows.sparkSession)
    kind = rows.schema[conv_col].dataType.simpleString()
    wanted = frozenset(loss_roles)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, started, out, held = None, [], False, [], 0

        def close() -> None:
            nonlocal held
            text, spans, loss, rewrites = render_spans(render, turns, wanted)
            out.append((key, len(turns), text, [{"start": a, "end": b} for a, b in spans], [{"start": a, "end": b} for a, b in loss], rewrites))
            held += len(text)

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            cols = list(zip(*out, strict=True))
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], span), pa.array(cols[4], span), pa.array(cols[5], pa.bool_())], ["conv_id", "n_turns", "formatted", "spans", "loss", "rewrites_history"])

        kind_type = pa.null()
        for b in batches:
            kind_type = b.schema.field(0).type
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if started and conv != key:
                    close()
                    turns = []
                    if held >= 4 << 20 or len(out) >= 1_000:
                        yield flush()
                key, started = conv, True
                turns.append((role or "", text or ""))
        if started:
            close()
            yield flush()

    dealt = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, SCHEMA.format(kind=kind)).withColumnRenamed("conv_id", conv_col)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the output: SHA-256 of the turns and of the text under the loss mask."""
    import hashlib

    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse_chatml(text)
                under = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                got.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            cols = list(zip(*got, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)), b.column(3)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])

    rows = formatted.select(F.col(conv_col).alias("conv_id"), "formatted", "loss", "rewrites_history")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean").withColumnRenamed("conv_id", conv_col)
