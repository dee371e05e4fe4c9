"""Chat formatting: a finite-state machine over roles, and a declarative template that can be read back.

A template says how a role's turn begins, how turns end, which roles are trained on and which role may follow
which. Turns become segments (header, body, end), each with a loss flag. Control strings inside texts and role
names get an escape character in front, so the output can be read back to the very turns it was made from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``header`` holds {role}; ``follows`` maps a state (a role, or "" at the start) to the roles that may come next."""

    header: str = "### {role}: "
    end: str = " </turn>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("###", "</turn>")
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant",)

    def guard(self, text: str) -> str:
        """Puts the escape before itself and before each control string."""
        return re.sub("|".join(map(re.escape, (self.escape, *self.controls))), lambda m: self.escape + m[0], text)

    def plain(self, text: str) -> str:
        """Undoes :meth:`guard`."""
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def role_name(self, role: str) -> str:
        """The role as a header shows it: guarded, and with its colons guarded too, so that the header's end is plain."""
        return self.guard(role).replace(":", self.escape + ":")

    def turn_pattern(self) -> re.Pattern:
        before, after = map(re.escape, self.header.split("{role}"))
        e = re.escape(self.escape)
        end = re.escape(self.end)
        return re.compile(f"{before}((?:{e}.|[^:{e}])*+){after}((?:{e}.|(?!{end})[^{e}])*+){end}", re.DOTALL)


SEGMENTS = "conv_id long, segment long, turn long, kind string, role string, text string, loss boolean, valid boolean"


def _format(template: Template):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, valid, n, segment = object(), "", True, 0, 0
        for frame in frames:
            rows = []
            for c, role, text in zip(frame["conv_id"].astype(object), frame["role"], frame["text"], strict=True):
                c = None if pd.isna(c) else int(c)
                role, text = role or "", text or ""
                if c != conv:
                    conv, state, valid, n, segment = c, "", True, 0, 0
                valid = valid and role in template.follows.get(state, ())
                loss = role in template.loss_roles
                for kind, part, lost in (("header", template.header.replace("{role}", template.role_name(role)), False), ("body", template.guard(text), loss), ("end", template.end, False)):
                    rows.append((c, segment, n, kind, role, part, lost, valid))
                    segment += 1
                state, n = role, n + 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SEGMENTS.split(", ")]).astype({"conv_id": "Int64"})

    return run


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of formatted text with loss flags: one conversation's texts, joined by ``segment``, are its output.

    Takes (conv_id, turn, role, text). Turns go by ``turn``, a null one first; ties go by role and text, and rows that
    repeat stay. A null text or role counts as empty, a null conv_id is a conversation of its own, an unknown role is
    formatted but never valid. ``valid`` says whether the turns so far follow the state machine. A task streams the
    turns of its conversations and holds one at a time, so neither long texts nor long conversations gather. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(_format(template or Template()), SEGMENTS)


def _read(template: Template):
    pattern = template.turn_pattern()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, text, spans, valid = object(), "", [], True
        n = chars = lost = 0
        turns = loss = None

        def row():
            if text:
                raise ValueError(f"conversation {conv} can't be read back at {text[:80]!r}")
            return (conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars, valid and role in template.accepts)

        role = ""
        for frame in frames:
            out = []
            for c, part, flag, ok in zip(frame["conv_id"].astype(object), frame["text"], frame["loss"], frame["valid"], strict=True):
                c = None if pd.isna(c) else int(c)
                if c != conv:
                    if turns is not None:
                        out.append(row())
                    conv, text, spans, n, chars, lost = c, "", [], 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if flag:
                    spans.append((len(text), len(text) + len(part)))
                text, chars, valid = text + part, chars + len(part), ok
                if not text.endswith(template.end):
                    continue
                while m := pattern.match(text):
                    role, said = template.plain(m[1]), template.plain(m[2])
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    for a, b in [x for x in spans if x[1] <= m.end()]:
                        masked = template.plain(text[a:b])
                        loss.update(masked.encode("utf-8", "surrogatepass"))
                        lost += len(masked)
                    spans = [(a - m.end(), b - m.end()) for a, b in spans if b > m.end()]
                    n, text = n + 1, text[m.end() :]
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]).astype({"conv_id": "Int64"})
        if turns is not None:
            yield pd.DataFrame([row()], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]).astype({"conv_id": "Int64"})

    return run


def read_back(segments: DataFrame, template: Template | None = None, arranged: bool = False) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from formatted segments alone.

    One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (the turns
    follow the state machine and end in an accepting role). Text that isn't what a template writes raises an error.
    ``arranged`` says that each conversation lies in one partition, in order, as :func:`format_conversations` returns
    it; then nothing is shuffled again. Segments read back from files aren't arranged. An empty table gives no rows.
    """
    rows = segments.select("conv_id", "segment", "text", "loss", "valid")
    if not arranged:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInPandas(_read(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
