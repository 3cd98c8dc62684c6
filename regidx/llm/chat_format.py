"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regidx.llm.common import let, replaced

ESCAPE = "\\"
CODES = "123456789abcdefghijklmnopqrstuvwxyz"
BAD = "bad"


@dataclass(frozen=True)
class ChatTemplate:
    """What is written around a turn, what is escaped inside it, which roles are trained on, which order is valid.

    A turn is written ``turn role body text end``. ``control`` lists every string that
    means something to the template or to a tokenizer; inside roles and texts it is written
    as the escape character and a code, and the escape character itself as escape and 0.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    control: tuple[str, ...] = (
        "<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>",
    )
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def escape(self, text: Column) -> Column:
        steps = [(ESCAPE, ESCAPE + "0"), *((c, ESCAPE + code) for c, code in zip(self.control, CODES, strict=False))]
        return reduce(lambda t, step: F.replace(t, F.lit(step[0]), F.lit(step[1])), steps, text)

    def unescape(self, text: Column) -> Column:
        steps = [*((ESCAPE + code, c) for c, code in zip(self.control, CODES, strict=False)), (ESCAPE + "0", ESCAPE)]
        return reduce(lambda t, step: F.replace(t, F.lit(step[0]), F.lit(step[1])), steps, text)

    def states(self) -> list[str]:
        named = {self.start, *self.accept, *(s for s, _ in self.moves), *self.moves.values()}
        return [self.start, *sorted(named - {self.start}), BAD]

    def roles(self) -> list[str]:
        return sorted({role for _, role in self.moves})

    def move_table(self) -> list[int]:
        """State after (state, role), flattened; role 0 is any role the machine does not know."""
        states = self.states()
        return [
            states.index(self.moves.get((state, role), BAD)) for state in states for role in [None, *self.roles()]
        ]


def format_chats(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    span: int = 64,
) -> DataFrame:
    """One row per conversation: conv, n_turns, valid, formatted, segments.

    ``segments`` is array<struct<text, loss>> whose texts joined give ``formatted``; ``loss``
    is true for the text of a trained role alone. ``valid`` tells whether the roles lead the
    machine from its start to an accepting state.

    Order: by turn, then role, then text, null first; repeated rows are repeated turns.
    Null role or text: empty (a null role is an unknown one). Null conversation ids form one
    conversation. Other columns are ignored; an empty table gives an empty result.

    Turns are first folded per ``span`` consecutive turn numbers: into text, segments and the
    machine's map from state to state. Only these parts meet per conversation, so that a
    conversation with a large share of all turns is folded by many tasks.
    """
    template = template or ChatTemplate()
    states, roles = template.states(), template.roles()
    table = F.array(*[F.lit(s) for s in template.move_table()])
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.floor(F.col(turn) / span).alias("_part"),
        F.struct(
            F.col(turn).alias("turn"),
            F.col(role).alias("role"),
            F.col(text).alias("text"),
        ).alias("_turn"),
    )
    parts = rows.groupBy("_conv", "_part").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    step = len(roles) + 1

    def moved(vector: Column, item: Column) -> Column:
        known = F.coalesce(F.array_position(F.array(*map(F.lit, roles)), item["role"]), F.lit(0)).cast("int")
        return F.transform(vector, lambda s: table[s * step + known])

    def segments(item: Column) -> Column:
        head = F.concat(F.lit(template.turn), template.escape(F.coalesce(item["role"], F.lit(""))), F.lit(template.body))
        body = template.escape(F.coalesce(item["text"], F.lit("")))
        trained = F.coalesce(item["role"].isin(*template.trained), F.lit(False))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(body.alias("text"), trained.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    folded = parts.select(
        "_conv",
        F.struct(
            F.col("_part").alias("part"),
            F.size("_turns").cast("long").alias("n"),
            F.aggregate("_turns", F.array(*[F.lit(i) for i in range(len(states))]), moved).alias("moves"),
            F.flatten(F.transform("_turns", segments)).alias("segments"),
        ).alias("_p"),
    )
    whole = folded.groupBy("_conv").agg(F.array_sort(F.collect_list("_p")).alias("_parts"))
    last = F.aggregate("_parts", F.lit(0), lambda state, part: part["moves"][state])
    accepted = [states.index(s) for s in template.accept]
    return whole.select(
        F.col("_conv").alias(conv),
        F.aggregate("_parts", F.lit(0).cast("long"), lambda n, part: n + part["n"]).alias("n_turns"),
        last.isin(*accepted).alias("valid"),
        F.flatten(F.transform("_parts", lambda part: part["segments"])).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    template = template or ChatTemplate()
    pieces = F.split(formatted, F.lit(f"\\Q{template.end}\\E"), -1)

    def parsed(piece: Column) -> Column:
        return let(
            F.split(F.substr(piece, F.lit(len(template.turn) + 1)), F.lit(f"\\Q{template.body}\\E"), 2),
            lambda halves: F.struct(template.unescape(halves[0]).alias("role"), template.unescape(halves[1]).alias("text")),
        )

    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), parsed))


def digest(chats: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id") -> DataFrame:
    """Digest columns, every one read back from ``formatted`` and ``segments``."""
    template = template or ChatTemplate()
    chats = replaced(chats, "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    read = chats.withColumns(
        {
            "_turns": read_turns(F.col("formatted"), template),
            "_loss": F.array_join(
                F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), ""
            ),
        }
    )
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
