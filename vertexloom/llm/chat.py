"""Chat formatting by incremental black-box rendering.

A renderer is any function from a list of (role, text) to a string. Spans are found without knowing
its template: the renderings of successive turn prefixes are compared, what is new belongs to the
new turn, and the same rendering with a probe instead of the text tells the text from its frame. A
renderer whose output for more turns doesn't start with its output for fewer rewrites history; this
is detected, and its spans are then located in the complete output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Renderer = Callable[[list[Turn]], str]

# Strings that steer a chat model and that no text may put into the output.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>"]
_CONTROL = re.compile("|".join(f"(?={re.escape(c)})" for c in CONTROL))
_FIRST = {c[0] for c in CONTROL}
OPEN, CLOSE, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Renderings of prefixes restart from an anchor after this many turns; the splices are checked.
ANCHOR = 16
PROBE = "\x02\x03"


def escape(text: str) -> str:
    """Double backslashes, and put one behind the first character of every control string; overlaps included."""
    out, at = [], 0
    text = text.replace("\\", "\\\\")
    if not any(c in text for c in _FIRST):
        return text
    for m in _CONTROL.finditer(text):
        out += [text[at : m.start() + 1], "\\"]
        at = m.start() + 1
    return "".join([*out, text[at:]])


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(turns: list[Turn]) -> str:
    """The default template: every turn is marked, and its role and text are escaped."""
    return "".join(f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """Read the default template's output back. Escaped texts hold no control string, so marks are unambiguous."""
    out = []
    for piece in formatted.split(OPEN)[1:]:
        role, text = piece.split(CLOSE, 1)
        out.append((unescape(role), unescape(text.removesuffix(END))))
    return out


def spans(turns: list[Turn], renderer: Renderer = render, anchor: int = ANCHOR) -> tuple[str, list[tuple[int, int]], bool]:
    """The complete rendering, each turn's text span in it (start, end), and whether history is rewritten.

    Prefixes are rendered from the last turn of the ``anchor`` turns before, so a long conversation
    costs time in proportion to its length. What the pieces add up to must equal the complete rendering
    of the first anchor, 2 anchor, 4 anchor, ... turns and of all turns; else complete prefixes are
    used throughout. A turn whose text can't be located has the span (-1, -1).
    """
    whole = renderer(turns)
    lo, before, pieces, size, shift, check, found = 0, "", [], 0, 0, anchor, []
    for i, (role, _) in enumerate(turns):
        if i and i % anchor == 0:
            if i == check:
                check *= 2
                if renderer(turns[:i]) != "".join(pieces):
                    return spans(turns, renderer, len(turns) + 1)
            lo = i - 1
            before = renderer(turns[lo:i])
            shift = size - len(before)
        now = renderer(turns[lo : i + 1])
        if not now.startswith(before):
            return _in_whole(turns, renderer, whole) if anchor > len(turns) else spans(turns, renderer, len(turns) + 1)
        probed = renderer([*turns[lo:i], (role, PROBE)])
        head = probed.find(PROBE, len(before))
        tail = len(probed) - head - len(PROBE)
        ok = head >= 0 and head + tail <= len(now) and now[:head] == probed[:head] and now[len(now) - tail :] == probed[head + len(PROBE) :]
        found.append((shift + head, shift + len(now) - tail) if ok else (-1, -1))
        pieces.append(now[len(before) :])
        size += len(pieces[-1])
        before = now
    if "".join(pieces) != whole:
        return _in_whole(turns, renderer, whole) if anchor > len(turns) else spans(turns, renderer, len(turns) + 1)
    return whole, found, False


def _in_whole(turns: list[Turn], renderer: Renderer, whole: str) -> tuple[str, list[tuple[int, int]], bool]:
    """Spans in the complete output of a renderer that rewrites history: one probe rendering for each turn."""
    found = []
    for i, (role, _) in enumerate(turns):
        probed = renderer([*turns[:i], (role, PROBE), *turns[i + 1 :]])
        head = probed.find(PROBE)
        tail = len(probed) - head - len(PROBE)
        ok = head >= 0 and whole[:head] == probed[:head] and head + tail <= len(whole) and whole[len(whole) - tail :] == probed[head + len(PROBE) :]
        found.append((head, len(whole) - tail) if ok else (-1, -1))
    return whole, found, True


SCHEMA = "formatted string, starts array<long>, ends array<long>, loss array<boolean>, n_turns long, rewrites_history boolean"


def format_conversations(turns: DataFrame, renderer: Renderer = render, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, the text span of each turn, which spans bear loss.

    Rows are ordered by turn (nulls first), equal turns by role and text; repeated rows are turns of
    their own. Null role or text: empty. A row with a null conv_id belongs to no other row: it is a
    conversation of one turn, with a null conv_id. Empty input: no rows.
    """
    rows = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_alone")
    by = turns.groupBy("conv_id", alone).agg(F.array_sort(F.collect_list(rows)).alias("_t")).select("conv_id", F.col("_t.role").alias("roles"), F.col("_t.text").alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for roles, texts in zip(pdf["roles"], pdf["texts"]):
                whole, at, rewrites = spans(list(zip(roles, texts)), renderer)
                out.append((whole, [s for s, _ in at], [e for _, e in at], [r in learn_from for r in roles], len(at), rewrites))
            made = pd.DataFrame(out, columns=["formatted", "starts", "ends", "loss", "n_turns", "rewrites_history"])
            yield pd.concat([pdf[["conv_id"]].reset_index(drop=True), made], axis=1)

    return by.mapInPandas(run, f"conv_id {dict(turns.dtypes)['conv_id']}, {SCHEMA}")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output alone: turns parsed from it, and the text under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in batches:
            out = []
            for text, starts, ends, loss in zip(pdf["formatted"], pdf["starts"], pdf["ends"], pdf["loss"]):
                turns = parse(text)
                learned = "".join(unescape(text[s:e]) for s, e, on in zip(starts, ends, loss) if on)
                out.append((len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), hexed(learned), len(text)))
            made = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([pdf[["conv_id", "rewrites_history"]].reset_index(drop=True), made], axis=1)

    return formatted.mapInPandas(run, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
