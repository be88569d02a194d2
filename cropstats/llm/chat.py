"""Chat formatting with the spans of every turn, whatever the template does inside.

Incremental black-box rendering: a template is a function from a list of turns
to a text. The prefixes of a conversation are rendered one after the other and
consecutive outputs compared: where one continues the other, what was added is
the new turn's span; where it does not, the template rewrites history, and the
number of the turn that made it do so is reported. Where a turn's own text
stands is found by rendering it again with two different single characters in
its place: the outputs differ from the text's start to its end. If history is
rewritten, texts are located the same way in the rendering of the whole
conversation, and turns have no spans.

Texts are escaped before rendering: a backslash is doubled, and one is put
after the first character of each control string, so no text can hold a mark and
:func:`unescaped` gives the text back. ``parsed`` reads turns from the output alone.

A template with ``context=0`` renders a turn alike whatever stands before it;
:func:`formatted` then deals a conversation's turns over tasks in segments of
its turn numbers, and renders bounded parts, whose texts put together are the
conversation's. With ``context=None`` a conversation is one part, and rendering
its prefixes takes time quadratic in its length.

Defined cases: turns stand in the order of ``turn`` (null first), then role and
text, so repeated turns stay, side by side; a null text or role counts as empty,
a null ``conv_id`` is a conversation of its own; empty texts have empty spans; a
text that the template leaves out, repeats or changes has no span, and so is not
under the loss mask; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropstats.llm import batches, scratch

Turns = list[tuple[str, str]]
# Control strings of public chat formats.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters that stand for a text while it is located.
PROBES = ("\ue000", "\ue001")
#: Turn numbers in a segment, and turns and characters in a part of templates without context.
SEGMENT, PART_TURNS, PART_CHARS = 256, 32, 1 << 20


@dataclass(frozen=True)
class Template:
    """``render`` gets (role, escaped text) pairs; ``context`` is how many turns before a turn it looks at (0, or None: all)."""

    render: Callable[[Turns], str]
    control: tuple[str, ...] = CONTROL
    context: int | None = None


@dataclass(frozen=True)
class Rendering:
    text: str
    spans: list[tuple[int, int] | None]
    bodies: list[tuple[int, int] | None]
    #: The first turn that changed the rendering of those before it.
    rewritten: int | None


def _between_marks(turns: Turns) -> str:
    return "".join([f"<|im_start|>{line(role)}\n{text}<|im_end|>\n" for role, text in turns])


def _instructions(turns: Turns) -> str:
    """Instructions and answers; a system turn stands inside the next user turn."""
    out, system = [], ""
    for role, text in turns:
        if role == "system":
            system = f"<<SYS>>\n{text}\n<</SYS>>\n\n"
        elif role == "assistant":
            out.append(f" {text} </s>")
        else:
            out.append(f"<s>[INST] {system}{text} [/INST]")
            system = ""
    return "".join(out)


def _system_last(turns: Turns) -> str:
    """Like instructions, but the system turn stands in the last user turn, so each new one moves it."""
    system = "".join(f"{text}\n\n" for role, text in turns if role == "system")
    rest = [t for t in turns if t[0] != "system"]
    last = max((i for i, t in enumerate(rest) if t[0] != "assistant"), default=-1)
    return "".join(f" {text}</s>" if role == "assistant" else f"<s>[INST] {system if i == last else ''}{text}[/INST]" for i, (role, text) in enumerate(rest))


def line(role: str) -> str:
    """A role on one line; :func:`unlined` gives it back."""
    return role.replace("\n", "\\n")


def unlined(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


MARKED = Template(_between_marks, context=0)
INSTRUCTIONS = Template(_instructions)
SYSTEM_LAST = Template(_system_last)


def escaper(control: tuple[str, ...]) -> Callable[[str], str]:
    """Doubles backslashes and breaks every control string after its first character."""
    assert all(len(c) > 1 and "\\" not in c and c[1] != "n" for c in control)
    starts = re.compile("(?=" + "|".join(map(re.escape, control)) + ")(.)", re.DOTALL)
    return lambda text: starts.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _body(render: Callable[[Turns], str], turns: Turns, i: int, out: str) -> tuple[int, int] | None:
    """Where the text of turn ``i`` stands in ``out``, the rendering of ``turns``."""
    role, text = turns[i]
    one, two = (render([*turns[:i], (role, p), *turns[i + 1:]]) for p in PROBES)
    if len(one) != len(two) or len(one) + len(text) != len(out) + 1:
        return None
    start = _common(one, two)
    if start == len(one) or one[start] != PROBES[0] or one[start + 1:] != two[start + 1:]:
        return None
    end = start + len(text)
    return (start, end) if out[start:end] == text and out[:start] == one[:start] and out[end:] == one[start + 1:] else None


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def located(render: Callable[[Turns], str], turns: Turns, wanted: Callable[[str], bool] = lambda role: True) -> Rendering:
    """The rendering of ``turns`` with each turn's span and, of wanted roles, the place of its text."""
    out, spans, bodies = "", [], []
    for i, (role, _) in enumerate(turns):
        longer = render(turns[:i + 1])
        if not longer.startswith(out):
            out = render(turns)
            return Rendering(out, [None] * len(turns), [_body(render, turns, j, out) if wanted(r) else None for j, (r, _) in enumerate(turns)], i)
        spans.append((len(out), len(longer)))
        bodies.append(_body(render, turns[:i + 1], i, longer) if wanted(role) else None)
        out = longer
    return Rendering(out, spans, bodies, None)


SPANS = "array<struct<start:long,end:long>>"
SCHEMA = f"conv_id long, segment long, part long, formatted string, turns {SPANS}, loss {SPANS}, rewritten long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
                    *[(n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for n in ("turns", "loss")], ("rewritten", pa.int64())])


def formatted(turns: DataFrame, template: Template = MARKED, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id``, ``segment``, ``part``, ``formatted`` text, spans of its ``turns`` and of the ``loss`` mask, ``rewritten``.

    Spans count code points of the part's text. Parts of a conversation follow
    one another by segment (null first) and part.
    """
    whole = template.context is None

    def rendered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = escaper(template.control)
        key, part, held, chars, rows, size = None, 0, [], 0, [], 0

        def row() -> tuple:
            made = located(template.render, held, lambda role: role in trained)
            spans = [[{"start": s[0], "end": s[1]} for s in found if s] for found in (made.spans, made.bodies)]
            return (*key, part, made.text, *spans, made.rewritten)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for given in parts:
            keys = zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True)
            for now, role, text in zip(keys, batches.strings(given, "role"), batches.strings(given, "text"), strict=True):
                if held and (now != key or (not whole and (len(held) == PART_TURNS or chars >= PART_CHARS))):
                    rows.append(row())
                    size += len(rows[-1][3])
                    part = part + 1 if now == key else 0
                    held, chars = [], 0
                    if size >= batches.PIECE_BYTES:
                        yield batch()
                        rows, size = [], 0
                key = now
                held.append((escape(role), escape(text)))
                chars += len(text)
        if held:
            rows.append(row())
        if rows:
            yield batch()

    segment = F.lit(0).cast("long") if whole else F.floor(F.col("turn").cast("double") / SEGMENT).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), segment.alias("segment"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")
    return batches.mapped(dealt.select("conv_id", "segment", "role", "text"), rendered, SCHEMA)


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """The turns of a text in the format of ``MARKED``."""
    for turn in text.split("<|im_start|>")[1:]:
        role, _, body = turn.removesuffix("<|im_end|>\n").partition("\n")
        yield unlined(role), unescaped(body)


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation of formatted ``parts``, read back from text and mask.

    A digest over a whole conversation has to take its parts in order, so they
    pass through one task, one part at a time; the state is two hashes.
    """

    def read(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []

        def closed() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for part in given:
            for conv, text, loss in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if state is not None and conv != key:
                    rows.append(closed())
                    state = None
                    if len(rows) == 10_000:
                        yield batch()
                        rows = []
                key, state = conv, state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parsed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescaped(text[span["start"]:span["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
        if state is not None:
            rows.append(closed())
        if rows:
            yield batch()

    ordered = parts.select("conv_id", "segment", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")
    return batches.mapped(ordered.select("conv_id", "formatted", "loss"), read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def written(parts: DataFrame) -> DataFrame:
    """``parts`` as Parquet in the shared folder, read back."""
    return scratch.stored(parts, "chat")
