"""Chat formatting with loss masks, found by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is known of its inside: successive
prefixes of a conversation are rendered, and what the output of one prefix adds to that of the one before is the span
of the new turn. Where an output doesn't begin with the one before, the template has rewritten history; such
conversations are flagged, and the turns' spans start where the two outputs part. Within its span a text is found by
rendering the turn twice more with two probes that share no character at either end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready_for_python

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

START, END = "<|im_start|>", "<|im_end|>"
PROBES = ("0a0", "1b1")
SCHEMA = "conv_id long, formatted string, rewrites_history boolean, spans array<struct<turn:int,role:string,start:int,end:int,text_start:int,text_end:int>>"


def escaped(text: str) -> str:
    """No control string is left: a backslash is doubled, and one parts `<` from `|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def chatml(turns: Turns) -> str:
    return "".join([f"{START}{escaped_role(role)}\n{escaped(text)}{END}\n" for role, text in turns])


TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def read_back(formatted: str) -> Turns:
    """The turns of a text that `chatml` made."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped_role(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def located(turns: Turns, template: Template) -> tuple[str, bool, list[dict]]:
    """The whole output, whether history was rewritten, and each turn's span and text span in its own prefix's output."""
    before, rewrites, spans = template([]), False, []
    for k, (role, text) in enumerate(turns):
        now = template([*turns[:k], (role, text)])
        start = common_prefix(before, now)
        rewrites |= start < len(before)
        one, two = (template([*turns[:k], (role, p)]) for p in PROBES)
        head = common_prefix(one, two)
        foot = common_prefix(one[head:][::-1], two[head:][::-1])
        spans.append({"turn": k, "role": role, "start": start, "end": len(now), "text_start": head, "text_end": max(head, len(now) - foot)})
        before = now
    return before, rewrites, spans


def formatted(df: DataFrame, template: Template = chatml) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, formatted, rewrites_history, spans), a row for each conversation.

    Turns stand in the order of turn (null first), then role and text, so ties have one order and repeated rows are
    repeated turns. A null role or text is empty; the rows of a null conv_id are one conversation. Further columns
    don't take part. An empty frame gives an empty frame. A conversation must fit into a task, as its output does.
    """
    ready_for_python(df.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [located([(t["role"], t["text"]) for t in turns], template) for turns in frame["turns"]]
            yield pd.DataFrame({"conv_id": frame["conv_id"].astype("Int64"), "formatted": [x for x, _, _ in out], "rewrites_history": [x for _, x, _ in out], "spans": [x for _, _, x in out]})

    return talks.mapInPandas(batches, SCHEMA)


def digests(df: DataFrame) -> DataFrame:
    """What `formatted` with `chatml` holds, read back from its output: counts and digests of turns and loss mask.

    n_turns and turns_sha256 come from parsing the output, loss_chars and loss_sha256 from the spans of assistant
    texts in it. Cases as in `formatted`.
    """
    texts = formatted(df)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for frame in frames:
            turns = [read_back(x) for x in frame["formatted"]]
            loss = ["".join([unescaped(x[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant"]) for x, spans in zip(frame["formatted"], frame["spans"], strict=True)]
            yield pd.DataFrame(
                {
                    "conv_id": frame["conv_id"].astype("Int64"),
                    "n_turns": [len(x) for x in turns],
                    "turns_sha256": [sha("".join([f"{role}\n{text}\n" for role, text in x])) for x in turns],
                    "loss_chars": [len(x) for x in loss],
                    "loss_sha256": [sha(x) for x in loss],
                    "formatted_chars": [len(x) for x in frame["formatted"]],
                }
            )

    return texts.mapInPandas(batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
