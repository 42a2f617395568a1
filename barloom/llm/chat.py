"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. ``spans`` renders the successive prefixes
of a conversation and compares each output with the one before: where the earlier output is a prefix of the later, the
new turn's span is what was added; where it isn't, the template has rewritten history and the conversation is marked.
No knowledge of the template's marks is needed to find the spans.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
FORMATTED = "conv_id long, formatted string, turns array<struct<role:string,begin:long,end:long,text_begin:long,text_end:long>>, rewrites_history boolean"


def escape(text: str) -> str:
    """Reversible: no control string is left in the result."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def head(role: str) -> str:
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"


def chatml(turns: list[tuple[str, str]]) -> str:
    """The default template: each turn between its marks, control strings inside escaped."""
    return "".join(f"{head(role)}{escape(text)}{END}\n" for role, text in turns)


chatml.turn_local = True


def apart(template, turn, following) -> bool:
    """Whether two turns render side by side as they do alone."""
    return template([turn, following]) == template([turn]) + template([following])


def spans(turns, template=chatml, window: int = 256, believe: bool = True):
    """(output, [(begin, end) of each turn], [(begin, end) of each turn's text or None], whether history was rewritten) by rendering successive prefixes.

    A template marked ``turn_local`` (a turn's rendering depends on no other turn) is rendered over prefixes of
    ``window`` turns at most, so that a conversation of n turns costs n renderings of bounded length; at each cut the
    two turns beside it are rendered together and apart, and a template whose output differs there is taken for one
    without the mark. Others are rendered over whole prefixes. Where history was rewritten, spans are the last output's differences and may overlap,
    and texts are looked for in renderings of the whole conversation. A text's span is found by rendering its turn with
    two other texts that differ in their first and last characters: what their outputs have alike at both ends frames
    the text. It is None where the real output has another frame (a template that counts characters, or leaves the turn out).
    """
    local = believe and getattr(template, "turn_local", False)
    out, done, base, at, found, texts, rewritten, known = "", [], [], 0, [], [], False, {}
    for role, text in turns:
        if len(done) >= window and local:
            if not apart(template, done[-1], (role, text)):
                return spans(turns, template, window, believe=False)
            base.append(out)
            at += len(out)
            out, done = "", []
        new = template([*done, (role, text)])
        if new.startswith(out):
            begin = len(out)
        else:
            rewritten = True
            begin = next((i for i, (x, y) in enumerate(zip(out, new, strict=False)) if x != y), min(len(out), len(new)))
        found.append((at + begin, at + len(new)))
        if local:
            if role not in known:
                known[role] = frame(template, [], role, [])
            got = framed(new[begin:], known[role])
            texts.append(got and (at + begin + got[0], at + begin + got[1]))
        elif not rewritten:
            texts.append(framed(new, frame(template, done, role, [])))
        done.append((role, text))
        out = new
    if rewritten and not local:
        texts = [framed(out, frame(template, done[:i], role, done[i + 1 :])) for i, (role, _) in enumerate(turns)]
    return "".join([*base, out]), found, texts, rewritten


def frame(template, before, role, after):
    """What a turn's text stands between in the output: the alike ends of two renderings with different texts."""
    one, two = (template([*before, (role, t), *after]) for t in ("ABCA", "DBCD"))
    head = next((i for i, (x, y) in enumerate(zip(one, two, strict=False)) if x != y), None)
    if head is None:
        return None
    tail = next(i for i, (x, y) in enumerate(zip(reversed(one), reversed(two), strict=False)) if x != y)
    return one[:head], one[len(one) - tail :]


def framed(out: str, ends):
    """The span of ``out`` between its ends, or None if it has others."""
    if ends is None or len(out) < len(ends[0]) + len(ends[1]) or not (out.startswith(ends[0]) and out.endswith(ends[1])):
        return None
    return len(ends[0]), len(out) - len(ends[1])


def _conversations(batches):
    """(conv_id, turns) from rows that come sorted; a conversation may go over many batches."""
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    single = itertools.count(1)  # a row without conv_id is a conversation of its own
    for (conv, _), group in itertools.groupby(rows, key=lambda r: (r[0], next(single) if r[0] is None else 0)):
        yield conv, [(r[1] or "", r[2] or "") for r in group]


def format_chats(conversations: DataFrame, template=chatml, window: int = 256) -> DataFrame:
    """Format ``conversations`` (conv_id, turn, role, text): a row per conversation, with each turn's span.

    Columns: conv_id, formatted, turns (role, begin, end, text_begin, text_end: code points in ``formatted``),
    rewrites_history. Turns go by turn, then role and text (ties and repeats stay, nulls first); null role or text:
    empty; a row without conv_id is a conversation of its own. Text spans are found by rendering (see ``spans``), null
    where they can't be. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for conv, turns in _conversations(batches):
            out, found, texts, rewritten = spans(turns, template, window)
            rows = [{"role": role, "begin": b, "end": e, "text_begin": t and t[0], "text_end": t and t[1]} for (role, _), (b, e), t in zip(turns, found, texts, strict=True)]
            t = pa.struct([("role", pa.string()), *((k, pa.int64()) for k in ("begin", "end", "text_begin", "text_end"))])
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([out], pa.string()), pa.array([rows], pa.list_(t)), pa.array([rewritten])], names=["conv_id", "formatted", "turns", "rewrites_history"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    rows = rows.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def digest(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """What a reader of the formatted strings gets back: digests of the turns and of the text under the loss mask."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, out, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                whole, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for m in TURN.finditer(out):
                    n += 1
                    whole.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for t in turns:
                    if t["role"] == learn and t["text_begin"] is not None:
                        text = unescape(out[t["text_begin"] : t["text_end"]])
                        chars += len(text)
                        loss.update(text.encode())
                rows.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), len(out)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "turns").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
