"""Chat formatting by rendering turn prefixes of a black-box template (operator 1)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: render(turns, generation_prompt) -> text; a turn is (role, text). Nothing else is known about a template.
Template = Callable[[list[tuple[str, str]], bool], str]

#: A character that no template's own marks begin with.
PROBE = "\x02"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` remains: a backslash goes between, one more where the text has some already."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def chatml(turns: list[tuple[str, str]], generation_prompt: bool = False) -> str:
    """Turns between ``<|im_start|>role`` and ``<|im_end|>``; roles and texts are escaped."""
    out = "".join(f"<|im_start|>{escape(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)
    return out + "<|im_start|>assistant\n" * generation_prompt


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by bisection over slices."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def spans(turns: list[tuple[str, str]], render: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """The whole text, (start, end, content start, content end) of each turn, and the first turn whose rendering changes what came before (-1: none).

    Prefix k is rendered and compared with prefix k - 1: where the shorter is a prefix of the longer, the turn is what was
    added. The content is found by two more renderings of the turn, with no text and with a probe character: what they
    share at their beginning is the turn's header, what follows it in the empty one its trailer. A turn whose own rendering
    lacks these (a template that trims or moves text) counts as content in whole. A template that rewrites history gets
    no spans from that turn on.
    """
    before, out = render([], False), []
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1], False)
        if not now.startswith(before):
            return render(turns, False), out, k
        empty = render([*turns[:k], (role, "")], False)
        head = _common(empty, render([*turns[:k], (role, PROBE)], False))
        tail = len(empty) - head
        if head < len(before) or len(now) < len(empty) or not now.startswith(empty[:head]) or not now.endswith(empty[head:]):
            head, tail = len(before), 0
        out.append((len(before), len(now), head, len(now) - tail))
        before = now
    return before, out, -1


def _batches(render: Template):
    schema = pa.schema([("conv_id", pa.int64()), ("roles", pa.list_(pa.string())), ("formatted", pa.string()), ("starts", pa.list_(pa.int64())),
                        ("ends", pa.list_(pa.int64())), ("content_starts", pa.list_(pa.int64())), ("content_ends", pa.list_(pa.int64())), ("rewritten_at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [(x["role"], x["text"]) for x in turns]
                text, found, at = spans(turns, render)
                s = list(zip(*found)) or [(), (), (), ()]
                rows.append((conv, [r for r, _ in turns], text, *map(list, s), at))
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def format_conversations(turns: DataFrame, render: Template = chatml) -> DataFrame:
    """(conv_id, roles, formatted, starts, ends, content_starts, content_ends, rewritten_at), a row per conversation; positions in code points.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by (turn, role, text), so ties and repeated rows have a
    fixed order; repeated rows are kept. Null text or role: empty. Null turn: first. Null conv_id: one conversation.
    rewritten_at is the first turn at which the template changes what it gave before, else -1; turns from there on have
    no positions. A conversation is one row from here on, and n renderings of it take n times its length: its turns are the
    unit of work. Empty table: empty result. Other columns are ignored.
    """
    one = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    return whole.mapInArrow(
        _batches(render), "conv_id long, roles array<string>, formatted string, starts array<long>, ends array<long>, content_starts array<long>, content_ends array<long>, rewritten_at int")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_at"]
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            said, loss, text = hashlib.sha256(), [], x["formatted"]
            for s, c, e in zip(x["starts"], x["content_starts"], x["content_ends"]):
                role = unescape(text[s:c].removeprefix("<|im_start|>").removesuffix("\n"))
                content = unescape(text[c:e])
                said.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    loss.append(content)
            joined = "".join(loss)
            rows.append((x["conv_id"], len(x["starts"]), said.hexdigest(), len(joined), hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest(), len(text), x["rewritten_at"]))
        columns = list(zip(*rows)) or [[] for _ in names]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of a chatml output, parsed from its text and spans alone."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at int")
