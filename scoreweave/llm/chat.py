"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template turns each
turn into text segments that say whether the loss counts them.

Segments are made row by row, without a shuffle. The machine needs roles only: turns are numbered by ranges, so that
a conversation may be of any length; each block of turns becomes one function from state to state, and functions are
put together level by level. Column functions only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import filled, let
from scoreweave.operators.spread import ranked

#: Turns that one function of the first level covers, and functions that one of a further level does.
BLOCK = 4096


@dataclass(frozen=True)
class Template:
    """How turns are marked, which may follow which, and whose text is trained on.

    Control strings (``turn_start``, ``turn_end``) begin with ``opening``, two different characters. A turn is
    ``turn_start role newline text turn_end``. ``moves`` maps (state, role) to the next state; what it lacks is out of
    order. A conversation is complete if it ends in one of the states ``final``.
    """

    opening: str = "<|"
    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>\n"
    start: str = "start"
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if len(set(self.opening)) != 2 or len(self.opening) != 2 or "\\" in self.opening or "\n" in self.opening:
            raise ValueError("opening takes two different characters, neither a backslash nor a line end")
        for control in (self.turn_start, self.turn_end):
            if not control.startswith(self.opening) or control.count(self.opening) > 1 or control[-1] in self.opening[0] + "\\":
                raise ValueError(f"{control!r} must hold opening once, at its start, and not end with its first character")
        if self.turn_start == self.turn_end or self.turn_end.startswith(self.turn_start):
            raise ValueError("turn_start and turn_end must be told apart")


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def escape(text: Column, template: Template) -> Column:
    """``text`` without the opening of control strings: a backslash goes between its characters, after any there."""
    a, b = template.opening
    return F.regexp_replace(text, rf"{_quoted(a)}(\\*){_quoted(b)}", re.sub(r"([\\$])", r"\\\1", a) + r"\\$1" + re.sub(r"([\\$])", r"\\\1", b))


def unescape(text: Column, template: Template) -> Column:
    """What ``escape`` was given."""
    a, b = template.opening
    return F.regexp_replace(text, rf"{_quoted(a)}\\(\\*){_quoted(b)}", re.sub(r"([\\$])", r"\\\1", a) + "$1" + re.sub(r"([\\$])", r"\\\1", b))


def _role_out(role: Column, template: Template) -> Column:
    """A role on one line."""
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))
    return escape(one_line, template)


def _role_in(role: Column, template: Template) -> Column:
    return F.replace(F.replace(unescape(role, template), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def turn_segments(role: Column, text: Column, template: Template) -> Column:
    """The segments ``(text, loss)`` of one turn: its head, its text, its end. Null roles and texts are empty."""
    role, text = filled(role), filled(text)

    def segment(part: Column, loss: Column) -> Column:
        return F.struct(part.alias("text"), loss.alias("loss"))

    trained = role.isin(*template.trained) if template.trained else F.lit(False)
    return F.array(
        segment(F.concat(F.lit(template.turn_start), _role_out(role, template), F.lit("\n")), F.lit(False)),
        segment(escape(text, template), trained),
        segment(F.lit(template.turn_end), F.lit(False)),
    )


def formatted(segments: Column) -> Column:
    """The text of segments, one after another."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template | None = None) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    template = template or Template()
    end = len(template.turn_end)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = let(F.length(role), lambda n: F.substring(part, n + 2, F.length(part) - n - 1 - end))
        return F.struct(_role_in(role, template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(F.filter(F.split(text, _quoted(template.turn_start)), lambda p, i: i > 0), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text that the loss counts, in order, as it was before escaping."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def _key(conv_id: str) -> Column:
    """Rows without a conversation id make one conversation."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def turn_order(
    conversations: DataFrame, template: Template | None = None,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
) -> DataFrame:
    """One row per conversation: key, n_turns, bad_turn (place from 0 of its first turn out of order, else null),
    state (after the last turn, null if one was out of order), valid (no turn out of order), complete (and ended in a
    final state).

    Turns stand by number, null first, equal numbers by role. Unknown and null roles are out of order. An empty table
    gives no rows.
    """
    template = template or Template()
    states = list(dict.fromkeys([template.start, *(s for s, _ in template.moves), *template.moves.values()]))
    roles = list(dict.fromkeys(r for _, r in template.moves))
    steps = [[states.index(template.moves[s, r]) if (s, r) in template.moves else -1 for s in states] for r in roles]
    table = F.array(*[F.array(*[F.lit(x) for x in step]) for step in [*steps, [-1] * len(states)]])
    number = reduce(lambda rest, k: F.when(F.col("role") == roles[k], k).otherwise(rest), range(len(roles)), F.lit(len(roles)))

    rows = conversations.select(_key(conv_id).alias("key"), F.col(turn).alias("turn"), F.col(role).alias("role"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    placed = ranked(rows, ["key"], order, "place").select("key", (F.col("place") - 1).alias("place"), number.alias("role"))

    def from_each_state(parts: Column, after) -> Column:
        """Where the parts lead from each state, and the place of the first turn out of order on the way."""

        def run(state: int) -> Column:
            begin = F.struct(F.lit(state).alias("state"), F.lit(None).cast("long").alias("bad"))
            return F.aggregate(parts, begin, lambda a, part: F.when(a["bad"].isNotNull(), a).otherwise(after(a, part)))

        return F.array(*[run(k) for k in range(len(states))])

    def one_turn(a: Column, part: Column) -> Column:
        moved = F.get(F.get(table, part["role"]), a["state"])
        return F.struct(moved.alias("state"), F.when(moved < 0, part["place"]).alias("bad"))

    def of_parts(name: str) -> Column:
        return F.sort_array(F.collect_list(F.struct("place", name)))

    blocks = placed.groupBy("key", F.expr(f"place div {BLOCK}").alias("block"))
    whole = blocks.agg(of_parts("role").alias("parts")).select(
        "key", F.col("block").alias("place"), F.size("parts").cast("long").alias("n_turns"), from_each_state(F.col("parts"), one_turn).alias("step")
    )
    # Three levels: a conversation of 2 ** 36 turns has no more than 4,096 functions in one row.
    for last in (False, True):
        keys = ["key"] if last else ["key", F.expr(f"place div {BLOCK}").alias("block")]
        whole = whole.groupBy(*keys).agg(of_parts("step").alias("parts"), F.sum("n_turns").alias("n_turns")).select(
            "key", *([] if last else [F.col("block").alias("place")]), "n_turns",
            from_each_state(F.col("parts"), lambda a, part: F.get(part["step"], a["state"])).alias("step"),
        )
    end, names = F.get("step", F.lit(states.index(template.start))), F.array(*[F.lit(s) for s in states])
    valid = end["bad"].isNull()
    state = F.when(valid, F.get(names, end["state"]))
    complete = valid & state.isin(*template.final) if template.final else F.lit(False)
    return whole.select("key", "n_turns", end["bad"].alias("bad_turn"), state.alias("state"), valid.alias("valid"), F.coalesce(complete, F.lit(False)).alias("complete"))


def segments(
    conversations: DataFrame, template: Template | None = None,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per segment: conv_id, turn, segment (0 head, 1 text, 2 end), text, loss. No shuffle; a conversation's
    segments in order of turn and segment are its formatted text. Repeated rows give their segments again."""
    parts = turn_segments(F.col(role), F.col(text), template or Template())
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.posexplode(parts).alias("segment", "part"))
    return rows.select("conv_id", "turn", "segment", "part.text", "part.loss")


def format_conversations(
    conversations: DataFrame, template: Template | None = None,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (array of text, loss), valid, complete, bad_turn, state.

    A conversation is one example for training, so its segments meet in one row; ``segments`` has them apart. Turns
    stand by number, null first, equal numbers by role and text. Null texts and roles are empty; conversations out of
    order are formatted too and say so in ``valid``. Rows without an id make one conversation with a null id. Other
    columns are left out; an empty table gives no rows.
    """
    template = template or Template()
    order = turn_order(conversations, template, conv_id, turn, role)
    rows = conversations.select(
        _key(conv_id).alias("key"), F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("row"),
    )
    grouped = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("row")).alias("rows"))
    parts = F.flatten(F.transform("rows", lambda r: turn_segments(r["role"], r["text"], template)))
    out = grouped.select("key", "conv_id", parts.alias("segments")).join(order, "key")
    return out.select("conv_id", "n_turns", "segments", "valid", "complete", "bad_turn", "state")
