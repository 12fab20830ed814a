"""Chat formatting: a role machine checks the order of turns; a declarative template turns a
conversation into text segments with loss flags. DataFrame expressions only.

Defined results: rows of a conversation are ordered by turn, then role, then text (nulls first);
null role or text counts as empty; repeated rows are turns of their own; null conv_id is one
conversation; an empty table gives no rows; extra columns are ignored. A conversation whose order
of roles is not accepted is formatted all the same and carries valid = false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, the roles whose text is trained on, and the machine over roles.

    Both marks must begin with "<|" , and no other text of the output ever holds "<|": inside texts
    and roles one backslash is put between "<" and "|" (after those there already), which reading
    takes away again. moves: state -> role -> next state; accept: states a conversation may end in.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    after_role: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("answered",)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _escape_role(c: Column) -> Column:
    """Also writes line feeds as \\n and backslashes as \\b, so that in a role each backslash is followed by one of the two."""
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def _machine(roles: Column, template: ChatTemplate) -> Column:
    def step(state: Column, role: Column) -> Column:
        found = F.lit("refused")
        for at, moves in template.moves.items():
            for by, to in moves.items():
                found = F.when((state == at) & (role == by), F.lit(to)).otherwise(found)
        return found

    return F.aggregate(roles, F.lit(template.start), step)


def format_conversations(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, valid, segments array<struct<text, loss>>, formatted) per conversation."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.array(
            F.struct(F.concat(F.lit(template.open), _escape_role(t["role"]), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        ),
    )
    return (
        turns.withColumn("valid", _machine(F.transform("turns", lambda t: t["role"]), template).isin(*template.accept))
        .withColumn("segments", F.flatten(pieces))
        .select("conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parses formatted text into turns array<struct<role, text>>; loss_text joins those that the segments' loss flags mark."""
    marked = F.split(F.col("formatted"), _quoted(template.open))
    bodies = F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0)))
    cut = F.lit(len(template.after_role))

    def parsed(body: Column) -> Column:
        at = F.instr(body, template.after_role)
        inner = F.substring(body, at + cut, F.length(body) - at - cut + 1 - len(template.close))
        return F.struct(_unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(inner).alias("text"))

    # a turn has three segments, the second one is its text
    under = F.transform("turns", lambda t, i: F.when(F.get(F.col("segments"), i * 3 + 1)["loss"], t["text"]))
    return formatted.withColumn("turns", F.transform(bodies, parsed)).withColumn("loss_text", F.array_join(under, ""))


def _quoted(text: str) -> str:
    return "".join(f"\\{x}" if x in "\\.[]{}()*+-?^$|<>" else x for x in text)
