"""Chat formatting: a finite-state machine over roles, segments with loss flags, reversible escapes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an escape stands for. Every escape starts with a backslash, so no text keeps a character that a mark starts with.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
ROLE_ESCAPES = (*ESCAPES, ("|", "\\3"))


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles whose text is trained on, and the turn orders that are allowed."""

    start: tuple[str, str] = ("<|", "|>\n")
    end: str = "<|end|>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })
    accepting: frozenset[str] = frozenset({"assistant"})


def escape(c: Column, table=ESCAPES) -> Column:
    for raw, code in table:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """Undo every escape; the backslash comes last, as no other escape gives one."""
    for raw, code in reversed(ROLE_ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _part(t: Template, turn: Column) -> Column:
    """The three segments of a turn."""
    def seg(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    return F.array(
        seg(F.concat(F.lit(t.start[0]), escape(turn["role"], ROLE_ESCAPES), F.lit(t.start[1])), no),
        seg(escape(turn["text"]), turn["role"].isin(*t.loss)),
        seg(F.lit(t.end), no))


def format_chats(turns: DataFrame, template: Template = Template(), chunk: int = 64) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>, state, valid), a row a conversation.

    Turns are ordered by turn, then role and text, so repeated turns have a fixed place; null roles and texts are empty, null
    turns come first, and a null conv_id is a conversation of its own. Any role is formatted; an order outside the
    transitions only makes `valid` false. Turns are first gathered in chunks of `chunk` turn numbers, so the sort of a long
    conversation is spread; its row is as long as it is, as the output is one string."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = rows.groupBy("conv_id", F.floor(F.col("turn") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "turns"))).alias("chunks"))
    whole = whole.select("conv_id", F.flatten(F.transform("chunks", lambda c: c["turns"])).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (a, b), c in sorted(template.transitions.items()) for x in (f"{a} {b}", c)])
    out = whole.select("conv_id", F.flatten(F.transform("turns", lambda x: _part(template, x))).alias("segments"),
        F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(" "), x["role"])), F.lit("error"))).alias("state"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*template.accepting).alias("valid"))


def parse_chats(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> back out of a formatted conversation."""
    pieces = F.split(formatted, template.end.replace("|", "\\|"))
    a, b = template.start

    def turn(p: Column) -> Column:
        at = F.instr(p, b)
        return F.struct(unescape(F.substring(p, F.lit(len(a) + 1), at - len(a) - 1)).alias("role"), unescape(F.substring(p, at + len(b), F.length(p))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """The contract's columns, read back from the formatted output."""
    read = chats.select("conv_id", "formatted", parse_chats(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("trained"), "state", "valid")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
