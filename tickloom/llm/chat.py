"""Chat formatting with a finite-state machine over roles, in DataFrame functions alone.

A declarative :class:`Template` says how each role's turn is written and whether its text counts for the loss.
The machine walks the roles of a conversation in turn order and reports whether the order is valid and where it
first breaks; an invalid conversation is formatted all the same. The output is a list of segments with a loss flag
each, and their concatenation. Control strings inside texts are escaped, so the output can be read back.

A conversation is one record: its digest runs over it as a whole, so all its turns meet in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"


@dataclass(frozen=True)
class Turn:
    """How a role is written: what opens and closes its text, and whether the text is trained on."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, the form for any other role (its name goes between ``other.opens`` and ``name_end``), the machine."""

    roles: dict[str, Turn]
    other: Turn
    name_end: str
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        lead = {c[0] for c in self.controls}
        inner = "".join(c[1:] for c in self.controls)
        if lead & set(inner) or ESCAPE in inner or ESCAPE in lead or lead & set(self.codes):
            raise ValueError("a control string's first character may stand nowhere else in a control string or code")
        opens = [t.opens for t in self.roles.values()] + [self.other.opens]
        if len(set(opens)) < len(opens):
            raise ValueError("every role needs an opening of its own")

    @property
    def controls(self) -> list[str]:
        every = [s for t in [*self.roles.values(), self.other] for s in (t.opens, t.closes)] + [self.name_end]
        return sorted(set(every), key=lambda c: (-len(c), c))

    @property
    def codes(self) -> str:
        return "abcdefghijklmnopqrstuvwxyz"[: len(self.controls)]

    def escape(self, text: Column) -> Column:
        """Every control string becomes the escape and its code; the escape itself becomes escape and 0."""
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
        pairs = zip(self.controls, self.codes, strict=True)
        return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(ESCAPE + p[1])), pairs, text)

    def unescape(self, text: Column) -> Column:
        pairs = zip(self.controls, self.codes, strict=True)
        text = reduce(lambda t, p: F.replace(t, F.lit(ESCAPE + p[1]), F.lit(p[0])), pairs, text)
        return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


INSTRUCT = Template(
    roles={
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=Turn("[ROLE]", "[/ROLE]"),
    name_end="[:]",
    moves={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def _segments(turn: Column, template: Template) -> Column:
    """Opening, escaped text and closing of one turn."""

    def written(head: Column, form: Turn) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        return F.array(part(head, False), part(template.escape(turn["text"]), form.loss), part(F.lit(form.closes), False))

    named = F.concat(F.lit(template.other.opens), template.escape(turn["role"]), F.lit(template.name_end))
    rows = written(named, template.other)
    for role, form in template.roles.items():
        rows = F.when(turn["role"] == role, written(F.lit(form.opens), form)).otherwise(rows)
    return rows


def _first_break(turns: Column, template: Template) -> Column:
    """Position (from 1) of the first turn the machine refuses; 0 if it takes all."""
    moves = F.create_map(*[F.lit(f"{a}>{b}") if i == 0 else F.lit(True) for a, to in template.moves.items() for b in to for i in (0, 1)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(0).alias("broken"))

    def step(at: Column, turn: Column) -> Column:
        n = at["n"] + 1
        fits = F.coalesce(moves[F.concat(at["state"], F.lit(">"), turn["role"])], F.lit(False))
        broken = F.when((at["broken"] == 0) & ~fits, n).otherwise(at["broken"])
        return F.struct(turn["role"].alias("state"), n.alias("n"), broken.alias("broken"))

    return F.aggregate(turns, begin, step, lambda at: at["broken"])


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per conversation.

    ``conv_id, n_turns, first_break`` (0: valid order), ``segments`` (text and loss flag), ``formatted``. Rows go by
    turn, null turns last; ties and repeated rows by role, then text, each kept. A null text or role is empty; rows
    with a null ``conv_id`` form one conversation; an empty table gives no rows.
    """
    filled = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").isNull().alias("unplaced"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    grouped = filled.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    made = grouped.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        _first_break(F.col("rows"), template).alias("first_break"),
        F.flatten(F.transform("rows", lambda t: _segments(t, template))).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``, unescaped."""
    opens = [(role, form) for role, form in template.roles.items()] + [(None, template.other)]
    starts = "|".join(re.escape(form.opens) for _, form in opens)
    pieces = F.split(formatted, f"(?={starts})")

    def body(piece: Column, head: Column, form: Turn) -> Column:
        return F.substring(piece, head + 1, F.length(piece) - head - len(form.closes))

    def read(piece: Column) -> Column:
        name = F.substring_index(piece, template.name_end, 1)
        skipped = F.length(name) + len(template.name_end)
        name = template.unescape(F.substring(name, F.lit(len(template.other.opens) + 1), F.length(name)))
        row = F.struct(name.alias("role"), template.unescape(body(piece, skipped, template.other)).alias("text"))
        for role, form in template.roles.items():
            own = F.struct(F.lit(role).alias("role"), template.unescape(body(piece, F.lit(len(form.opens)), form)).alias("text"))
            row = F.when(F.startswith(piece, F.lit(form.opens)), own).otherwise(row)
        return row

    return F.transform(pieces, read)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    masked = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    return F.array_join(masked, "")


def digests(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the output says when read back: turns and loss text as digests, and lengths in code points."""
    turns = F.transform(read_turns(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        "conv_id",
        "n_turns",
        "first_break",
        F.array_join(turns, "").alias("turns"),
        loss_text(F.col("segments"), template).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("first_break").cast("long").alias("first_break"),
    )


def _sql_escaped(expr: str) -> str:
    expr = f"replace({expr}, '{ESCAPE}', '{ESCAPE}0')"
    for control, code in zip(INSTRUCT.controls, INSTRUCT.codes, strict=True):
        expr = f"replace({expr}, '{control}', '{ESCAPE}{code}')"
    return expr


def _sql_around() -> str:
    cases = " ".join(f"WHEN '{r}' THEN {len(t.opens) + len(t.closes)}" for r, t in INSTRUCT.roles.items())
    other = len(INSTRUCT.other.opens) + len(INSTRUCT.name_end) + len(INSTRUCT.other.closes)
    return f"CASE role {cases} ELSE {other} + length({_sql_escaped('role')}) END"


def _sql_fits() -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, to in INSTRUCT.moves.items() for b in to)
    return f"(coalesce(lag(role) OVER w, '{INSTRUCT.start}'), role) IN ({pairs})"


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
walked AS (
  SELECT *, row_number() OVER w AS n, {_sql_fits()} AS fits FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_sql_escaped("text")}) + {_sql_around()}) AS chars, coalesce(min(n) FILTER (NOT fits), 0) AS first_break
  FROM walked GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(first_break AS BIGINT) AS first_break FROM joined
"""
