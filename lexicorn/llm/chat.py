"""Operator 3: chat formatting by a declarative template (DataFrame functions only).

A finite-state machine over roles validates the turn order; a template turns each turn
into segments (header, content, end mark), each with a loss flag. Control strings inside
texts are escaped reversibly: the escape character first, then every control string, each
by the escape character and a letter of its own, so that no control string is left and
`parse` gives back the exact texts.

Defined cases: turns are ordered by (turn, role, text), so ties and repeated rows have one
order; null text or role = empty; a null conversation id is one conversation; a wrong turn
order is reported (``valid``, ``first_error``), the conversation is still formatted; an
empty table gives an empty result; other input columns are ignored. One conversation is
one string, so its turns meet in one task: that is the operator's unit of output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Turn = ``open`` role ``sep`` text ``close``; ``transitions`` is the role automaton."""

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    controls: tuple[str, ...] = ("### ", "</turn>")
    escape: str = "\\"
    names: dict[str, str] = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})


DEFAULT = Template()
_INVALID = "invalid"


def _codes(t: Template, extra: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(control string, its replacement); letters b.. so that none is part of a control string."""
    return [(c, t.escape + chr(ord("b") + k)) for k, c in enumerate((t.escape, *t.controls, *extra))]


def escape(c: Column, t: Template, extra: tuple[str, ...] = ()) -> Column:
    for plain, code in _codes(t, extra):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, t: Template, extra: tuple[str, ...] = ()) -> Column:
    for plain, code in reversed(_codes(t, extra)):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _other(t: Template) -> str:
    """Marks a role without a display name, so that it can't be taken for one that has."""
    return t.escape + "a"


def _lookup(c: Column, pairs: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), other)


def _run(turns: Column, t: Template) -> Column:
    """Fold the automaton over the roles: struct (state, at, first_error)."""
    moves = {f"{s}\n{r}": to for (s, r), to in t.transitions.items()}
    zero = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"),
                    F.lit(None).cast("int").alias("first_error"))

    def step(acc: Column, x: Column) -> Column:
        to = _lookup(F.concat(acc["state"], F.lit("\n"), x["role"]), moves, F.lit(_INVALID))
        return F.struct(to.alias("state"), (acc["at"] + 1).alias("at"),
                        F.when(acc["first_error"].isNull() & (to == _INVALID), acc["at"])
                        .otherwise(acc["first_error"]).alias("first_error"))
    return F.aggregate(turns, zero, step)


def format_conversations(df: DataFrame, template: Template = DEFAULT, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``conv_id, n_turns, valid, first_error, formatted`` and ``segments``,
    an array of (text, loss) whose texts concatenate to ``formatted``."""
    t = template
    turns = (df.select(df[conv].alias("conv_id"), F.struct(
                df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"),
                F.coalesce(df[text], F.lit("")).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))

    def seg(c: Column, loss: Column) -> Column:
        return F.struct(c.alias("text"), loss.alias("loss"))

    def parts(x: Column) -> Column:
        name = _lookup(x["role"], t.names,
                       F.concat(F.lit(_other(t)), escape(x["role"], t, (t.sep,))))
        return F.array(
            seg(F.concat(F.lit(t.open), name, F.lit(t.sep)), F.lit(False)),
            seg(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
            seg(F.lit(t.close), F.lit(False)))

    return (turns.withColumn("_fsm", _run(F.col("turns"), t))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    (F.col("_fsm.first_error").isNull()
                     & F.col("_fsm.state").isin(*t.accept)).alias("valid"),
                    F.col("_fsm.first_error").alias("first_error"),
                    F.flatten(F.transform("turns", parts)).alias("segments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def parse(formatted: str | Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    t = template
    back = {v: k for k, v in t.names.items()}
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.split(c, re.escape(t.close), -1)

    def turn(p: Column) -> Column:
        at = F.locate(t.sep, p, len(t.open) + 1)
        name = F.substring(p, F.lit(len(t.open) + 1), at - len(t.open) - 1)
        other = unescape(F.substr(name, F.lit(len(_other(t)) + 1)), t, (t.sep,))
        return F.struct(_lookup(name, back, other).alias("role"),
                        unescape(F.substr(p, at + len(t.sep)), t).alias("text"))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(segments: str, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, in order, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"], template)), "")
