"""Chat formatting by a finite-state machine over roles, with DataFrame functions only.

A template names for each role its marker and whether its text is trained on, and the machine's moves: which
role may follow in which state. Turns are folded in order through the machine, which gives the verdict on the
turn order; each turn is emitted as segments (marker, text, marker), each with its loss flag.

Control strings inside a text are escaped by one backslash after their first sign; control strings that carry
such backslashes already get one more, so unescaping is exact. A role that the template does not know is written
out, escaped, in a ROLE segment before its text.

Cases: null texts count as empty, null roles as ''; turns are sorted by turn (null last), then role and text, so
ties and repeated rows have a fixed order; rows with a null conv_id form one conversation; an empty table gives
an empty result. A conversation is one output string, so it is gathered in one task by its nature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([\[<])(\\*)(/?(?:INST|SYS|TOOL|ROLE|TURN)\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?(?:INST|SYS|TOOL|ROLE|TURN)\]|/?s>)"
TURN = r"(?s)(?:\[ROLE\](.*?)\[/ROLE\])?(?:\[(INST|SYS|TOOL|TURN)\]|<(s)>)(.*?)(?:\[/(?:INST|SYS|TOOL|TURN)\]|</s>)"


@dataclass(frozen=True)
class Template:
    """markers: (opening, closing) by role; trained: roles under the loss mask; moves: (state, role, next state)."""

    markers: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "tool": ("[TOOL]", "[/TOOL]"), "assistant": ("<s>", "</s>")}
    )
    other: tuple[str, str] = ("[TURN]", "[/TURN]")
    named: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"),
        ("start", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
        ("answered", "tool", "called"),
        ("called", "tool", "called"),
        ("called", "assistant", "answered"),
    )


LLAMA_LIKE = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_conversations(rows: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, bad_turn (place of the first turn out of order, from 0), segments, formatted."""
    t = template
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    moves = _table({f"{state}|{role}": to for state, role, to in t.moves})
    opening, closing = _table({r: m[0] for r, m in t.markers.items()}), _table({r: m[1] for r, m in t.markers.items()})

    def move(acc: Column, x: Column) -> Column:
        to = F.element_at(moves, F.concat(acc["state"], F.lit("|"), x["role"]))
        ok = (acc["bad"] < 0) & to.isNotNull()
        return F.struct(F.when(ok, to).otherwise(acc["state"]).alias("state"), F.when(ok | (acc["bad"] >= 0), acc["bad"]).otherwise(acc["n"]).alias("bad"), (acc["n"] + 1).alias("n"))

    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def emit(x: Column) -> Column:
        known = x["role"].isin(list(t.markers))
        plain = F.array(seg(F.coalesce(opening[x["role"]], F.lit(t.other[0])), no), seg(escape(x["text"]), x["role"].isin(list(t.trained))), seg(F.coalesce(closing[x["role"]], F.lit(t.other[1])), no))
        named = F.array(seg(F.lit(t.named[0]), no), seg(escape(x["role"]), no), seg(F.lit(t.named[1]), no))
        return F.when(known, plain).otherwise(F.concat(named, plain))

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("n"))
    run = gathered.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", begin, move).alias("end"), F.flatten(F.transform("turns", emit)).alias("segments"))
    valid = (F.col("end.bad") < 0) & F.col("end.state").isin(list(t.final))
    return run.select("conv_id", "n_turns", valid.alias("valid"), F.when(F.col("end.bad") >= 0, F.col("end.bad")).alias("bad_turn"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    kinds = _table({m[0].strip("[]<>"): r for r, m in template.markers.items()})
    named, kind, sign, body = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)) for k in (1, 2, 3, 4))
    role = lambda x: F.coalesce(kinds[F.concat(x["1"], x["2"])], unescape(x["0"]))
    return F.transform(F.arrays_zip(named, kind, sign, body), lambda x: F.struct(role(x).alias("role"), unescape(x["3"]).alias("text")))


def read_loss(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
