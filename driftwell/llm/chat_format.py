r"""Chat formatting with typed content parts.

A turn is a role and a list of parts: text, image, audio or document. A visitor walks the
parts in order; text is copied with control strings escaped, any other part leaves a
placeholder, an attachment reference and the number of tokens that the placeholder stands
for. Turns are formatted one row at a time, so a conversation of any length needs no task
of its own; the formatted conversation is its segments in turn order.

Escaping puts one backslash after the first character of each control string found in a
text (``</s>`` becomes ``<\/s>``) and one more where backslashes stand there already; taking
one away restores the text. The template itself is then the only source of control strings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
RESTS = r"(s>|/s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]{1,40}\|>)"
ESCAPE, UNESCAPE = re.compile(r"([<\[])(\\*)" + RESTS), re.compile(r"([<\[])\\(\\*)" + RESTS)
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<position:int,kind:string,ref:string,tokens:long>>"
SEGMENT = f"conv_id long, turn long, segment string, loss_start int, loss_end int, attachments {ATTACHMENTS}, expanded_tokens long"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


@dataclass(frozen=True)
class Rates:
    """What a placeholder expands to, in tokens."""

    patch: int = 14
    audio_per_second: float = 25.0
    per_page: int = 512


@dataclass
class PartVisitor:
    """Flattens the parts of one turn; unknown kinds count as text, missing sizes as the least the kind can be."""

    rates: Rates = field(default_factory=Rates)
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda k: max(1, math.ceil((_number(part.get(k)) or 1) / self.rates.patch))
        self._attach("image", part, side("width") * side("height"))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((_number(part.get("seconds")) or 0) * self.rates.audio_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, int(_number(part.get("pages")) or 1)) * self.rates.per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"position": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": int(tokens)})
        self.out.append(f"<|{kind}|>")


def _number(x):
    return None if x is None or x != x else x


def format_turn(role: str | None, parts, rates: Rates | None = None) -> tuple[str, int, int, list[dict]]:
    """The segment of one turn, the span of its text under the loss mask (empty unless the role is assistant) and its attachments."""
    v = PartVisitor(rates or Rates())
    for p in parts if parts is not None else ():
        if p is not None:
            v.visit(p)
    head, body = f"{TURN}{escape_role(role or '')}\n", "".join(v.out)
    end = len(head) + len(body) if role == "assistant" else len(head)
    return f"{head}{body}{END}\n", len(head), end, v.attachments


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders of attachments stay as they are."""
    if not (segment.startswith(TURN) and segment.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(TURN) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def split_segments(formatted: str) -> list[str]:
    """The segments of a whole formatted conversation."""
    return [TURN + x for x in formatted.split(TURN)[1:]]


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> a row for each turn: segment, loss span in it, attachments, expanded tokens.

    Null roles and texts count as empty, a null or empty list of parts as no content.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [format_turn(r, p) for r, p in zip(f["role"], f["parts"], strict=True)]
            g = pd.DataFrame(rows, columns=["segment", "loss_start", "loss_end", "attachments"])
            g.insert(0, "turn", f["turn"].astype("Int64").to_numpy())
            g.insert(0, "conv_id", f["conv_id"].astype("Int64").to_numpy())
            g["conv_id"], g["turn"] = g["conv_id"].astype("Int64"), g["turn"].astype("Int64")
            g["expanded_tokens"] = [sum(a["tokens"] for a in x) for x in g["attachments"]]
            yield g

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "parts").mapInPandas(run, SEGMENT)


def text_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> turns of one text part each."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return df.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams sorted segments; holds one batch and the running state of one conversation."""
    here, state, done = object(), None, []

    def close() -> None:
        if state is not None:
            done.append((here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for f in frames:
        for conv, seg, a, b in zip(f["conv_id"].astype(object), f["segment"], f["loss_start"], f["loss_end"], strict=True):
            conv = None if conv is None or conv != conv else int(conv)
            if state is None or conv != here:
                close()
                here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_segment(seg)
            loss = unescape(seg[a:b])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(seg)
        yield _digest_rows(done)
        done = []
    close()
    yield _digest_rows(done)


def _digest_rows(rows: list) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return f.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})


def read_back(segments: DataFrame) -> DataFrame:
    """A row for each conversation, from its formatted segments.

    SHA-256 of a whole conversation is serial, so its segments pass one task in turn
    order, as a stream: that task holds a batch of them, never the conversation. Turns
    with equal numbers follow each other by segment, repeated rows each count as a turn, null
    conversation ids are one conversation. No segments give no rows; other columns are not read.
    """
    order = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return order.select("conv_id", "segment", "loss_start", "loss_end").mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """A row for each conversation and one for the probe, which is all that an empty table gives; other columns than conv_id, turn, role and text are not read."""
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for t, r in ((0, "user"), (1, "assistant"))))).alias("x")).select("x.*")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(text_turns(rows.unionByName(probe))))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]{1,40}\|>)', '\1\\\2\3', 'g') AS esc FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>') + length(role) + 1 + length(esc) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
