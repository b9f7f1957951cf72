"""Chat formatting of typed content parts.

A message is a list of parts (text, image, audio, document). A visitor flattens the parts in order:
adjacent texts are joined and escaped, every other part becomes a placeholder with an attachment
reference and the number of tokens it expands to. Turns are marked as

    <|im_start|>ROLE newline BODY <|im_end|> newline

and every `<`, backslashes, `|` inside a text gets one more backslash, so that no text holds a control
string and the text can be restored exactly.

Conversations are dealt by id and sorted by turn, and formatted as a stream: a conversation longer than
PART_CHARS comes out as several numbered parts, cut between turns, so no task holds one whole.

Cases: null text is empty; a null role is the empty role; equal turn numbers are ordered by role, then
text; repeated rows are repeated turns; rows with a null conv_id form one conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
PART_CHARS = 4_000_000
PARTS_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = (
    "conv_id long, part long, formatted string, loss array<struct<start:long,stop:long>>, "
    "attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, expanded_tokens long"
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_parts long, n_attachments long, n_placeholders long, expanded_tokens long"
)
READ = ("conv_id", "formatted", "loss", "attachments", "expanded_tokens")
PLACEHOLDERS = re.compile(r"<\|(?:image|audio|document)\|>")
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens the parts of one message; `patch`, `audio_rate` and `page_tokens` set the expanded sizes."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.pending: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or self.patch) / self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"content part of unknown type {part.get('type')!r}")

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _flush(self) -> None:
        if self.pending:
            self._put(escape("".join(self.pending)))
            self.pending = []

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._flush()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._put(f"<|{kind}|>")

    def body(self) -> str:
        self._flush()
        return "".join(self.out)


def _null(value) -> bool:
    return value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value))


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, part, out, loss, attached, size, tokens = None, 0, [], [], [], 0, 0
    started, rows = False, []

    def close():
        rows.append((key, part, "".join(out), list(loss), list(attached), tokens))

    for batch in batches:
        for conv, role, parts in zip(batch["conv_id"], batch["role"], batch["parts"], strict=True):
            conv = None if _null(conv) else int(conv)
            if started and (conv != key or size >= PART_CHARS):
                close()
                part = part + 1 if conv == key else 0
                out, loss, attached, size, tokens = [], [], [], 0, 0
            key, started = conv, True
            visitor = PartVisitor()
            for x in parts:
                visitor.visit(x if isinstance(x, dict) else x.asDict())
            role = "" if _null(role) else role
            head, body = f"{START}{escape_role(role)}\n", visitor.body()
            if role == "assistant":
                loss.append({"start": size + len(head), "stop": size + len(head) + len(body)})
            attached += [a | {"at": a["at"] + size + len(head)} for a in visitor.attachments]
            tokens += sum(a["tokens"] for a in visitor.attachments)
            turn = f"{head}{body}{END}\n"
            out.append(turn)
            size += len(turn)
        if rows:
            yield _frame(rows, FORMATTED)
            rows.clear()
    if started:
        close()
        yield _frame(rows, FORMATTED)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", schema)).split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parses formatted conversations turn by turn; digests run on across the parts of a conversation."""
    key, state, started, rows = None, None, False, []

    def close():
        turns, loss = state["turns"], state["loss"]
        rows.append((key, state["n"], turns.hexdigest(), state["loss_n"], loss.hexdigest(), state["chars"], state["parts"], state["attached"], state["placeholders"], state["tokens"]))

    for batch in batches:
        for conv, formatted, spans, attached, tokens in zip(*(batch[c] for c in READ), strict=True):
            conv = None if _null(conv) else int(conv)
            if not started or conv != key:
                if started:
                    close()
                key, started = conv, True
                state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0, "parts": 0, "attached": 0, "placeholders": 0, "tokens": 0}
            state["chars"] += len(formatted)
            state["parts"] += 1
            if any(not formatted.startswith(f"<|{a['kind']}|>", a["at"]) for a in attached):
                raise ValueError(f"conversation {conv}: an attachment's place does not hold its placeholder")
            state["attached"] += len(attached)
            state["tokens"] += int(tokens)
            at = 0
            while at < len(formatted):
                line = formatted.index("\n", at)
                stop = formatted.index(END, line + 1)
                role, body = unescape_role(formatted[at + len(START) : line]), formatted[line + 1 : stop]
                text = unescape(body)
                state["placeholders"] += len(PLACEHOLDERS.findall(body))
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["n"] += 1
                at = stop + len(END) + 1
            for span in spans:
                text = unescape(formatted[span["start"] : span["stop"]])
                state["loss"].update(text.encode("utf-8", "surrogatepass"))
                state["loss_n"] += len(text)
        if rows:
            yield _frame(rows, DIGEST)
            rows.clear()
    if started:
        close()
        yield _frame(rows, DIGEST)


def format_conversations(messages: DataFrame) -> DataFrame:
    """Formatted conversations of messages(conv_id, turn, role, text[, parts]).

    `parts` (PARTS_TYPE; a column of that name and another type is ignored), where not null, replaces the text. Returns conv_id, part, formatted,
    loss (character ranges of assistant bodies), attachments and expanded_tokens; the rows of one
    conversation are adjacent and in order inside a partition.
    """
    plain = F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    ).cast(PARTS_TYPE)
    parts = F.coalesce(F.col("parts").cast(PARTS_TYPE), plain) if dict(messages.dtypes).get("parts", "").startswith("array<struct") else plain
    return (
        small_batches(messages).select("conv_id", "turn", "role", "text", parts.alias("parts"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "parts")
        .mapInPandas(_format, FORMATTED)
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from format_conversations' output: counts and digests. Placeholders are counted in the
    text, attachments and their expanded tokens come from the references; every reference must point at its placeholder."""
    return formatted.select(*READ).mapInPandas(_read, DIGEST)
