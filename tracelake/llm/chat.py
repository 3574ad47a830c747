r"""Chat formatting with typed content parts.

A turn is a role and an array of parts (structs type, text, ref, n_tokens). Flattening visits the parts in order: a text
part is written with `\`, `#` and `<` escaped by a backslash; an image, audio or document part (or one of any other
type) becomes the placeholder `<type number>`, and its reference and the number of tokens that it expands to are recorded.
A formatted turn is

    ### role newline  content newline  </turn> newline

in which control strings can't come from a text, as each of their characters `#` and `<` would be escaped there. A
conversation is its formatted turns one after the other, ordered by turn (equal turns by role and text). Turns stay rows
of their own, so that a conversation of any length is written and read as a stream.

Defined results: a null text or part list counts as empty, a null role as an empty role; a null conv_id is a
conversation of its own; repeated rows are turns of their own; an empty table gives no rows; columns of the input that
aren't named are ignored.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type: string, text: string, ref: string, n_tokens: long>"


def escaped(text: Column, signs: str = r"[\\#<]") -> Column:
    return F.regexp_replace(text, f"({signs})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("n_tokens")
        )
    )


def format_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    trained_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """A row for each turn: conv_id, turn, formatted, attachments, and the span of formatted that the loss covers.

    attachments: structs number, type, ref, n_tokens in order. loss_start and loss_end are code points in formatted,
    equal where the role isn't trained.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    others = F.filter(parts, lambda p: F.coalesce(p.type, F.lit("")) != "text")
    seen = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        parts.alias("_parts"),
        others.alias("_others")
    )

    def number(i: Column) -> Column:
        return F.size(F.filter(F.slice("_parts", 1, i), lambda p: F.coalesce(p.type, F.lit("")) != "text"))

    content = F.transform(
        "_parts",
        lambda p, i: F.when(p.type == "text", escaped(F.coalesce(p.text, F.lit("")))).otherwise(
            F.concat(
                F.lit("<"),
                F.regexp_replace(F.coalesce(p.type, F.lit("part")), r"[^\w-]", "_"),
                F.lit(" "),
                number(i).cast("string"),
                F.lit(">")
            )
        )
    )
    head = F.concat(F.lit("### "), escaped(F.col("role"), r"[\\#<\n]"), F.lit("\n"))
    seen = seen.select("conv_id", "turn", "role", head.alias("_head"), F.array_join(content, "").alias("_content"), "_others")
    trained = F.col("role").isin(*trained_roles)
    return seen.select(
        "conv_id",
        "turn",
        F.concat("_head", "_content", F.lit("\n</turn>\n")).alias("formatted"),
        F.transform("_others", lambda p, i: F.struct(i.alias("number"), p.type.alias("type"), p.ref.alias("ref"), F.coalesce(p.n_tokens, F.lit(1)).alias("n_tokens"))).alias("attachments"),
        F.length("_head").cast("long").alias("loss_start"),
        F.when(trained, F.length("_head") + F.length("_content")).otherwise(F.length("_head")).cast("long").alias("loss_end"),
    )


_TURN = re.compile(r"(?s)### ((?:[^\\\n]|\\.)*)\n((?:[^\\<#]|\\.|<[\w-]+ [0-9]+>)*)\n</turn>\n")
_ESCAPED = re.compile(r"(?s)\\(.)")


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, content) of a formatted turn; placeholders stay as they are."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return _ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])


_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted turns say, read from them alone: a row for each conversation.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline for each turn), loss_chars and loss_sha256 (of the
    text under the loss, unescaped), formatted_chars, n_attachments and attachment_tokens. Turns are sorted within
    partitions of whole conversations and hashed as they stream by, so that none is gathered in memory.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches):
        at, state = None, None

        def row():
            n, turns, chars, loss, size, files, tokens = state
            return (at, n, turns.hexdigest(), chars, loss.hexdigest(), size, files, tokens)

        def sent(rows, kind):
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)

        for batch in batches:
            rows = []
            for conv, text, start, end, files, tokens in zip(
                *(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "files", "tokens"))
            ):
                if state is None or conv != at:
                    if state is not None:
                        rows.append(row())
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, content = read_turn(text)
                loss = _ESCAPED.sub(r"\1", text[start:end])
                state[1].update(f"{role}\n{content}\n".encode())
                state[3].update(loss.encode())
                for k, x in ((0, 1), (2, len(loss)), (4, len(text)), (5, files), (6, tokens)):
                    state[k] += x
            yield sent(rows, batch.schema.field("conv_id").type)
        if state is not None:
            yield sent([row()], batch.schema.field("conv_id").type)

    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x.n_tokens)
    rows = formatted.select(
        "conv_id",
        "turn",
        "formatted",
        "loss_start",
        "loss_end",
        F.size("attachments").cast("long").alias("files"),
        tokens.alias("tokens")
    )
    role = F.regexp_extract("formatted", r"(?s)^### ((?:[^\\\n]|\\.)*)\n", 1)
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id",
        "turn",
        unescaped(role),
        unescaped(F.substring("formatted", F.length(role) + 6, F.length("formatted")))
    )
    return ordered.mapInArrow(read, f"conv_id {kind}, {_READ}")
