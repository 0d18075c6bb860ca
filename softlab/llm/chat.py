"""Chat formatting [native]: conversations to training text with a loss mask.

A conversation's turns are collected, sorted by turn, merged where neighbours
have one role, and concatenated:

    ### role\\n first text <next> second text </turn>\\n      (without the blanks)

Control strings inside texts are escaped, so a text can't forge a turn, and
the escape is undone exactly when the text is read back.

* Null texts and roles are empty strings, and so are read back as such.
* Ties (one turn number twice, repeated rows) are ordered by role, then text;
  a null turn comes first.  Repeated rows stay repeated.
* Columns other than the four named are dropped, so their names can't clash.
* A conversation is one output row, so its turns meet in one task: rows grow
  with the longest conversation, not with the table.

``loss_runs`` is the loss mask in runs of code points of the formatted text:
off, on, off, on, ...  Only the texts of ``loss_roles`` are on, not the marks
around and between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, BETWEEN, END = "###", "<next>", "</turn>"
#: What stands for each control string; the backslash itself is first.
ESCAPES = [("\\", "\\b"), (HEAD, "\\h"), (BETWEEN, "\\n"), (END, "\\e")]
NEWLINE = ("\n", "\\l")    # in roles only: a role is a line


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _role_line(role: Column) -> Column:
    return F.replace(escape(role), F.lit(NEWLINE[0]), F.lit(NEWLINE[1]))


def _role_back(line: Column) -> Column:
    return unescape(F.replace(line, F.lit(NEWLINE[1]), F.lit(NEWLINE[0])))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``loss_runs``."""
    rows = df.select(df[conv].alias("conv"), F.struct(
        df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"),
        F.coalesce(df[text], F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def blocks_of(t: Column) -> Column:
        """Neighbouring turns of one role, as an array of arrays."""
        places = F.sequence(F.lit(0), F.size(t) - 1)
        heads = F.filter(places, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return _let(heads, lambda h: F.transform(
            h, lambda s, k: F.slice(t, s + 1, F.coalesce(F.get(h, k + 1), F.size(t)) - s)))

    def pieces(block: Column) -> Column:
        """Off text and on text in turn: header, text, separator, text, ..."""
        on = F.get(block, 0)["role"].isin(*loss_roles)
        first = F.concat(F.lit(f"{HEAD} "), _role_line(F.get(block, 0)["role"]), F.lit("\n"))
        return F.transform(block, lambda t, k: F.struct(
            F.when(k == 0, first).otherwise(F.lit(BETWEEN)).alias("before"), escape(t["text"]).alias("text"),
            F.when(k == F.size(block) - 1, F.lit(f"{END}\n")).otherwise(F.lit("")).alias("after"), on.alias("on")))

    parts = turns.select("conv", F.flatten(F.transform(_let(F.col("t"), blocks_of), pieces)).alias("p"))
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["text"], x["after"])), "")
    zero = F.lit(0)
    runs = F.flatten(F.transform("p", lambda x: F.when(x["on"], F.array(
        F.length(x["before"]), F.length(x["text"]), F.length(x["after"]), zero)).otherwise(F.array(
            F.length(x["before"]) + F.length(x["text"]) + F.length(x["after"]), zero))))
    return parts.select(F.col("conv").alias(conv), formatted.alias("formatted"), runs.alias("loss_runs"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    blocks = F.filter(F.split(formatted, f"{END}\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        role = _role_back(F.substr(line, F.lit(len(HEAD) + 2)))
        texts = F.split(F.substr(block, F.length(line) + 2), BETWEEN)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss_runs: Column) -> Column:
    """All text under the loss mask, unescaped."""
    mask = F.array_join(F.transform(loss_runs, lambda n, i: F.repeat(F.when(i % 2 == 1, "1").otherwise("0"), n)), "")
    chars = F.regexp_extract_all(formatted, F.lit("(?s)."), F.lit(0))
    flags = F.regexp_extract_all(mask, F.lit("."), F.lit(0))
    return unescape(F.array_join(F.zip_with(chars, flags, lambda c, m: F.when(m == "1", c).otherwise("")), ""))
