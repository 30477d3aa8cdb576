"""Chat formatting: a finite-state machine over roles and segments with loss flags.

A conversation is read in the order of its turns and never gathered: rows are dealt by
conversation, sorted, and formatted one by one while the machine's state is carried along, so a
conversation with most of all rows needs no more memory than a short one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: text around each role's turn and whether the turn's text is trained on.
#: ``other`` serves every role that is not listed, with the role's name put in.
TEMPLATE = {
    "system": {"before": "### System: ", "after": "</turn>\n", "loss": False},
    "user": {"before": "### User: ", "after": "</turn>\n", "loss": False},
    "assistant": {"before": "### Assistant: ", "after": "</turn>\n", "loss": True},
    "other": {"before": "### @{role}: ", "after": "</turn>\n", "loss": False},
}
#: Which role may follow which state; the state after a turn is its role.
TRANSITIONS = {
    "start": {"system", "user"},
    "system": {"user"},
    "user": {"assistant"},
    "assistant": {"user"},
}
SEGMENT = ("conv_id long, seq long, turn long, role string, part string, content string, "
           "loss boolean, state string, valid boolean")
#: Characters by which control strings begin; each is written with a backslash before it.
CONTROL = re.compile(r"([\\#<:])")
_TEXT_CONTROL = re.compile(r"([\\#<])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No unescaped ``#`` or ``<`` remains, so a text can never look like a turn mark."""
    return _TEXT_CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _shape(role: str | None) -> tuple[str, str, bool]:
    known = role if role in TEMPLATE and role != "other" else "other"
    t = TEMPLATE[known]
    before = t["before"] if known != "other" else t["before"].replace(
        "{role}", CONTROL.sub(r"\\\1", role or ""))
    return before, t["after"], t["loss"]


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order; ties of ``turn`` go by role, then text."""
    return (turns.select(F.col("conv_id").cast("long").alias("conv_id"),
                         F.col("turn").cast("long").alias("turn"), "role",
                         F.coalesce("text", F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state, valid, seq = object(), "start", True, 0
    for batch in batches:
        out = []
        for conv_id, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"],
                                             batch["text"]):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            role = None if pd.isna(role) else role
            if conv_id != conv:
                conv, state, valid, seq = conv_id, "start", True, 0
            valid = valid and role in TRANSITIONS.get(state, ())
            state = role if role in TRANSITIONS else state
            before, after, loss = _shape(role)
            turn = None if pd.isna(turn) else int(turn)
            for part, content, flag in (("before", before, False), ("text", escape(text), loss),
                                        ("after", after, False)):
                out.append((conv_id, seq, turn, role, part, content, flag, state, valid))
                seq += 1
        yield pd.DataFrame(out, columns=["conv_id", "seq", "turn", "role", "part", "content",
                                         "loss", "state", "valid"]).astype(
            {"conv_id": "Int64", "turn": "Int64"})


def segments(turns: DataFrame) -> DataFrame:
    """Text segments in order: joined by ``seq`` they are the formatted conversation, and the
    segments with ``loss`` are what is trained on. ``valid`` stays true as long as the turns so
    far are accepted by the machine; turns after a fault are formatted all the same.

    Null text is empty; a null or unknown role is formatted under ``other`` and is never valid;
    rows with null conv_id make up one conversation; repeated rows are turns of their own; turns
    without a number come first; other columns are ignored.
    """
    return _ordered(turns).mapInPandas(_format, SEGMENT)


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of what the formatted text says. Only ``content`` and ``loss`` are looked at: the
    role is parsed from the mark, texts are unescaped."""
    roles = {t["before"]: r for r, t in TEMPLATE.items() if r != "other"}
    lead, tail = TEMPLATE["other"]["before"].split("{role}")
    conv, now = object(), None

    def row(c, s):
        return (c, s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(),
                s["chars"], s["valid"])

    for batch in batches:
        out = []
        for conv_id, content, loss, valid in zip(batch["conv_id"], batch["content"],
                                                 batch["loss"], batch["valid"]):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if conv_id != conv or now is None:
                if now is not None:
                    out.append(row(conv, now))
                conv = conv_id
                now = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(),
                       "loss_chars": 0, "chars": 0, "valid": True}
            now["chars"] += len(content)
            now["valid"] = bool(valid)
            if content.startswith("###"):
                role = roles.get(content)
                if role is None:
                    role = unescape(content[len(lead):-len(tail)])
                now["turns"] += 1
                now["all"].update(f"{role}\n".encode())
            elif content.startswith("</turn>"):
                now["all"].update(b"\n")
            else:
                text = unescape(content)
                now["all"].update(text.encode())
                if loss:
                    now["loss_chars"] += len(text)
                    now["loss"].update(text.encode())
        yield pd.DataFrame(out, columns=_DIGEST_COLUMNS).astype({"conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([row(conv, now)], columns=_DIGEST_COLUMNS).astype({"conv_id": "Int64"})


_DIGEST_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                   "formatted_chars", "valid"]
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
          "loss_sha256 string, formatted_chars long, valid boolean")


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments in their order."""
    formatted = segments(turns).select("conv_id", "seq", "content", "loss", "valid")
    in_order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return in_order.mapInPandas(_read_back, DIGEST)
