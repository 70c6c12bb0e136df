r"""Chat formatting.

A declarative template names the marks around a turn, the moves of a finite-state machine over roles, and the states that
carry loss. The machine runs over the ordered turns: each move enters the state of the turn's role, says whether the move
is legal, and emits that state's text segments with their loss flags. Joined, the segments are the formatted string. Inside
texts and roles ``&`` and the first character of the closing mark become entities (``<`` is ``&lt;``, others ``&#N;``),
inside roles also the first character of the mark after it, so neither can hold a mark; undone in reverse they give the text back.

Only DataFrame functions are used; one group-by moves each turn once. A conversation is one output record, so its turns
meet in one row by definition; different conversations never do.

Defined results: null text or role counts as empty; turns of equal number are ordered by role and text, repeated rows all
stay; rows with null conv_id form one conversation; null turn comes first; an empty table gives an empty result. A conversation
with an illegal move or an end outside the final states has valid = false and is formatted all the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``open_before`` role ``open_after`` text ``close``."""

    open_before: str = '<turn role="'
    open_after: str = '">'
    close: str = "</turn>\n"
    #: States whose text carries loss.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Legal moves of the role machine.
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not self.close or not self.open_after or re.search("[A-Za-z0-9&#;]", self.close[0] + self.open_after[0]):
            raise ValueError("the marks after a role and after a text start with a character that no entity holds: no letter, digit, &, # or ;")


CHATML = Template(open_before="<|im_start|>", open_after="\n", close="<|im_end|>\n")


def _entities(*first: str) -> list[tuple[str, str]]:
    """Characters and their entities, & first."""
    return [("&", "&amp;"), *((c, "&lt;" if c == "<" else f"&#{ord(c)};") for c in dict.fromkeys(first))]


def _escape(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for c, e in pairs:
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def _unescape(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return _escape(text, [(e, c) for c, e in reversed(pairs)])


def unescape(text: Column, template: Template = Template()) -> Column:
    """A text segment as it was."""
    return _unescape(text, _entities(template.close[0]))


def _run(turns: Column, template: Template) -> Column:
    """The machine over ordered turns: for each, the state entered, whether the move was legal, and the segments emitted.

    A state is named by its role, so the state before a turn is the role of the turn before it."""
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    text_pairs, role_pairs = _entities(template.close[0]), _entities(template.close[0], template.open_after[0])

    def move(turn: Column, i: Column) -> Column:
        state = F.when(i == 0, F.lit("start")).otherwise(F.get(turns, i - 1)["role"])
        legal = F.lit(False)
        for source, targets in template.moves.items():
            legal = legal | ((state == source) & turn["role"].isin(*targets))
        if "start" not in {t for targets in template.moves.values() for t in targets}:
            legal = legal & ((i == 0) | (state != "start"))  # a role of that name is not the first state
        emitted = F.array(
            segment(F.concat(F.lit(template.open_before), _escape(turn["role"], role_pairs), F.lit(template.open_after)), F.lit(False)),
            segment(_escape(turn["text"], text_pairs), turn["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        )
        return F.struct(turn["role"].alias("state"), legal.alias("legal"), emitted.alias("emitted"))

    return F.transform(turns, move)


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation: conv_id, valid, segments (array of text and loss), formatted."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    ran = rows.select("conv_id", _run(F.col("turns"), template).alias("ran"))
    out = ran.select(
        "conv_id",
        (F.forall("ran", lambda m: m["legal"]) & F.get("ran", F.size("ran") - 1)["state"].isin(*template.final)).alias("valid"),
        F.flatten(F.transform("ran", lambda m: m["emitted"])).alias("segments"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) read back from a formatted string."""
    # an escaped role holds no first character of the mark after it, an escaped text none of the closing mark
    quoted = lambda t: re.sub(r"([^A-Za-z0-9\s])", r"\\\1", t)
    role, text = quoted(template.open_after[0] + template.close[0]), quoted(template.close[0])
    whole = f"{quoted(template.open_before)}([^{role}]*){quoted(template.open_after)}([^{text}]*){quoted(template.close)}"
    text_pairs, role_pairs = _entities(template.close[0]), _entities(template.close[0], template.open_after[0])
    found = lambda i: F.regexp_extract_all(formatted, F.lit(whole), F.lit(i))
    return F.zip_with(
        found(1), found(2), lambda r, t: F.struct(_unescape(r, role_pairs).alias("role"), _unescape(t, text_pairs).alias("text"))
    )


def digest(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The operator's contract, from the formatted strings and segments of all conversations and of conversation -7."""
    spark = conversations.sparkSession
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    out = format_chats(own.unionByName(extra), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    rows = out.select("conv_id", "valid", "formatted", parse_chats(F.col("formatted"), template).alias("turns"), loss.alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
