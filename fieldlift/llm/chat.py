"""Chat formatting with DataFrame functions only.

A declarative template gives each role a title and says whether its text is trained on. A finite-state machine over the
roles validates the turn order. A conversation becomes segments (text, loss flag): a turn's header, its text with
control strings escaped, and the turn end. Escapes leave no control string in a text, so the output can be parsed back.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple[str, ...] = ("assistant",)
    mark: str = "### "
    after_title: str = ": "
    end: str = "</turn>\n"
    #: State and role to the next state; other moves are errors.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )
    final: tuple[str, ...] = ("assistant",)

    def escapes(self) -> list[tuple[str, str]]:
        """Control string and its escape. The backslash is first here, and last when undone."""
        return [("\\", "\\b"), (self.mark.strip(), "\\h"), (self.end.strip(), "\\e")]


def escape(text: Column, template: Template, *more: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [*template.escapes(), *more], text)


def unescape(text: Column, template: Template, *more: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), [*more, *template.escapes()[::-1]], text)


#: Roles without a title are written as an at sign and the escaped role.
_COLON = (":", "\\c")


def header(role: Column, template: Template) -> Column:
    named = reduce(lambda c, p: c.when(role == p[0], F.lit(p[1])), template.titles.items(), F.when(F.lit(False), F.lit("")))
    return F.concat(F.lit(template.mark), named.otherwise(F.concat(F.lit("@"), escape(role, template, _COLON))), F.lit(template.after_title))


def format_conversations(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, segments, formatted, valid, state, n_turns``.

    Rows are ordered by turn, then role and text; a null turn comes first. Null roles and texts count as empty. Repeated
    rows are turns of their own. Nothing tells which rows without an id belong together: each is a conversation of its
    own, with a null id, so they gather in no task. Turn orders that the machine refuses are
    formatted all the same with ``valid`` false and the state ``error``. An empty table gives no row; texts of any length are
    formatted whole; other columns aren't read.
    """
    t = template or Template()
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    whole = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, r), to in t.moves.items() for x in (f"{state}>{r}", to)])
    state = F.aggregate(F.transform("turns", lambda x: x["role"]), F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), r)), F.lit("error")))

    def pieces(x: Column) -> Column:
        part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(part(header(x["role"], t), no), part(escape(x["text"], t), x["role"].isin(*t.trained)), part(F.lit(t.end), no))

    segments = F.flatten(F.transform("turns", pieces))
    out = whole.select("conv_id", segments.alias("segments"), state.alias("state"), F.size("turns").cast("long").alias("n_turns"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("state").isin(*t.final).alias("valid"), "state", "n_turns")


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (array of role and text) of a formatted conversation."""
    t = template or Template()
    chunks = F.split(formatted, "\\Q" + t.end + "\\E", -1)
    chunks = F.slice(chunks, F.lit(1), F.size(chunks) - 1)

    def turn(chunk: Column) -> Column:
        at = F.locate(t.after_title, chunk)
        title = F.substring(chunk, F.lit(len(t.mark) + 1), at - len(t.mark) - 1)
        named = reduce(lambda c, p: c.when(title == p[1], F.lit(p[0])), t.titles.items(), F.when(F.lit(False), F.lit("")))
        role = named.otherwise(unescape(F.substring(title, F.lit(2), F.char_length(title)), t, _COLON))
        return F.struct(role.alias("role"), unescape(F.substring(chunk, at + len(t.after_title), F.char_length(chunk)), t).alias("text"))

    return F.transform(chunks, turn)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the output holds, read back from it: turns, their digest, and the unescaped text under the loss mask."""
    t = template or Template()
    turns = formatted.select("conv_id", "formatted", "valid", "state", read_back(F.col("formatted"), t).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "").alias("loss"))
    every = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
