"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns are ordered by turn, then role and text.  The template gives each role a prefix and
a suffix; text is escaped so that it holds no control string: `&`, `<` and `[` become entities, which is
undone by the reverse replacements.  The output is a list of segments (text, loss), whose texts in order
are the formatted conversation; only the assistant's escaped text is under the loss.  The machine's
transition table says which orders of turns are valid.

A long conversation is formatted in chunks of turns that are joined last, so that rows of one conversation
spread over tasks; a chunk carries the machine's state function, and functions compose.  A null role, turn
or text is an empty one (turn: first); null conversation ids form one conversation.  Repeated turns stay, next to
each other; turns of one number are a tie that role and text decide, and lie in one chunk.  A text of any length
is one segment; an empty table gives no conversations, and other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: role -> (prefix, suffix, loss); `{role}` in a prefix is the escaped role, for roles not named here.
TEMPLATE = {
    "system": ("<s>[SYS] ", " [/SYS]", False),
    "user": ("<s>[INST] ", " [/INST]", False),
    "assistant": ("<s>[ANS] ", " [/ANS]</s>", True),
    None: ("<s>[TURN {role}] ", " [/TURN]", False),
}
#: States: 0 start, 1 after the system's turn, 2 after a user's, 3 after an assistant's, 4 invalid.
STATES = 5
TRANSITIONS = {("system", 0): 1, ("user", 0): 2, ("user", 1): 2, ("assistant", 2): 3, ("user", 3): 2}
ACCEPTING = (3,)
CHUNK = 64


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


def unescaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&#91;', '['), '&lt;', '<'), '&amp;', '&')"


def _by_role(value: dict, default: str, role: str) -> str:
    return "CASE " + " ".join(f"WHEN {role} = '{r}' THEN {v}" for r, v in value.items()) + f" ELSE {default} END"


def chat_format(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, formatted, segments, valid) per conversation."""
    named = {r: t for r, t in template.items() if r is not None}
    q = lambda s: "'" + s.replace("'", "\\'") + "'"
    before, after = template[None][0].split("{role}")
    prefix = _by_role({r: q(t[0]) for r, t in named.items()}, f"concat({q(before)}, {escaped('x.role')}, {q(after)})", "x.role")
    suffix = _by_role({r: q(t[1]) for r, t in named.items()}, q(template[None][1]), "x.role")
    loss = _by_role({r: str(t[2]).lower() for r, t in named.items()}, str(template[None][2]).lower(), "x.role")
    move = lambda s: "CASE " + " ".join(f"WHEN x.role = '{r}' AND {s} = {a} THEN {b}" for (r, a), b in TRANSITIONS.items()) + f" ELSE {STATES - 1} END"
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("chunk", F.expr(f"floor(coalesce(turn, -1) / {CHUNK})"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    chunks = chunks.select(
        "conv_id",
        "chunk",
        F.expr("size(t)").alias("n"),
        F.expr(f"flatten(transform(t, x -> array(struct({prefix} AS text, false AS loss), struct({escaped('x.text')} AS text, {loss} AS loss), struct({suffix} AS text, false AS loss))))").alias("segments"),
        F.expr(f"transform(sequence(0, {STATES - 1}), s -> aggregate(t, s, (a, x) -> {move('a')}))").alias("step"),
    )
    whole = chunks.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("chunk", "segments", "step"))).alias("c"))
    accepts = ", ".join(map(str, ACCEPTING))
    out = whole.select("conv_id", "n_turns", F.expr("flatten(transform(c, x -> x.segments))").alias("segments"), F.expr(f"aggregate(c, 0, (s, x) -> x.step[s]) IN ({accepts})").alias("valid"))
    return out.select("conv_id", "n_turns", F.expr("array_join(transform(segments, x -> x.text), '')").alias("formatted"), "segments", "valid")


def turns_read_back(formatted: str, template: dict = TEMPLATE) -> str:
    """SQL for the list of (role, text) that a formatted conversation holds."""
    escape = lambda s: "".join("\\\\" + c if c in "[]()<>/.|*+?{}" else c for c in s)
    named = {r: t for r, t in template.items() if r is not None}
    before, after = template[None][0].split("{role}")
    heads = "|".join([*(escape(t[0]) for t in named.values()), f"{escape(before)}[^<\\\\[]*?{escape(after)}"])
    tails = "|".join(dict.fromkeys(escape(t[1]) for t in sorted(template.values(), key=lambda t: -len(t[1]))))
    pattern = f"'({heads})([^<\\\\[]*)({tails})'"
    head = f"regexp_extract_all({formatted}, {pattern}, 1)"
    body = f"regexp_extract_all({formatted}, {pattern}, 2)"
    other = f"substring(h, {len(before) + 1}, length(h) - {len(before) + len(after)})"
    role = "CASE " + " ".join(f"WHEN h = '{t[0]}' THEN '{r}'" for r, t in named.items()) + f" ELSE {unescaped(other)} END"
    return f"zip_with({head}, {body}, (h, b) -> struct({role} AS role, {unescaped('b')} AS text))"
