"""Chat formatting with Spark expressions alone.

A conversation's turns are sorted as structs by (turn, role, text), neighbours of one role share one header, and the
pieces are joined: <|turn|>role<|text|>first<|next|>second<|end|>\\n. Role and text are escaped, so that no control
string can stand in them, and reading back gives every turn as it was. The loss mask is a list of byte spans of the
formatted text that hold what the assistant said.

Defined results: null text and null role are empty; null turns come first; ties in turn go by role, then text;
repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives an empty table;
extra columns are ignored. One conversation is one row of output, so its turns meet in one task, as its text must.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import let

#: Turns whose lengths are added up as one block.
BLOCK = 64


@dataclass(frozen=True)
class Template:
    """All control strings start with `sigil`; escaping removes every sigil from what users wrote."""

    sigil: str = "<|"
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    next: str = "<|next|>"
    end: str = "<|end|>\n"
    learn: str = "assistant"

    def escape(self, c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit(self.sigil), F.lit("\\c"))

    def unescape(self, c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("\\c"), F.lit(self.sigil)), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, formatted, loss_spans (array of start and length in UTF-8 bytes) for each conversation."""
    t = template
    listed = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = listed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def piece(ts: Column):
        def one(x: Column, i: Column) -> Column:
            before = F.get(ts, i - 1)["role"]
            header = F.concat(F.lit(t.turn), t.escape(x["role"]), F.lit(t.text))
            head = F.when(i == 0, header).when(before == x["role"], F.lit(t.next)).otherwise(F.concat(F.lit(t.end), header))
            return F.struct(head.alias("head"), t.escape(x["text"]).alias("body"), (x["role"] == t.learn).alias("learn"))

        return F.transform(ts, one)

    def laid_out(ps: Column) -> Column:
        n = F.size(ps)
        text = F.concat(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"])), ""), F.lit(t.end))
        sizes = F.transform(ps, lambda p: F.octet_length(p["head"]) + F.octet_length(p["body"]))

        def total(xs: Column) -> Column:
            return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

        def spans(sizes: Column, sums: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                before = F.get(sums, b) + total(F.slice(sizes, b * BLOCK + 1, i - b * BLOCK))
                return F.struct((before + F.octet_length(p["head"])).alias("start"), F.octet_length(p["body"]).alias("length"), p["learn"].alias("learn"))

            kept = F.filter(F.transform(ps, one), lambda s: s["learn"] & (s["length"] > 0))
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

        def summed(sizes: Column) -> Column:
            # Running sums by blocks of turns: those of whole blocks here, those since the last block at each turn.
            blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
            sums = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
            return let(sums, lambda done: spans(sizes, done))

        return F.struct(text.alias("formatted"), let(sizes, summed).alias("loss_spans"))

    out = grouped.select("conv_id", let(let(F.col("ts"), piece), laid_out).alias("o"))
    return out.select("conv_id", F.col("o.formatted").alias("formatted"), F.col("o.loss_spans").alias("loss_spans"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The turns (role, text) that a formatted text holds, in order."""
    t = template

    def quoted(x: str) -> str:
        return "".join(f"\\x{{{ord(c):x}}}" for c in x)

    def block(b: Column) -> Column:
        inner = F.substring(b, F.lit(1), F.length(b) - len(t.end))
        head = F.substring_index(inner, t.text, 1)
        body = F.substring(inner, F.length(head) + len(t.text) + 1, F.length(inner))
        return let(t.unescape(head), lambda role: F.transform(F.split(body, quoted(t.next)), lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text"))))

    blocks = F.split(F.substring(formatted, F.lit(len(t.turn) + 1), F.length(formatted)), quoted(t.turn))
    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, spans: Column, template: Template = Template()) -> Column:  # noqa: B008
    """All text under the loss mask, unescaped."""
    return let(F.encode(formatted, "UTF-8"), lambda b: F.array_join(F.transform(spans, lambda s: template.unescape(F.substring(b, s["start"] + 1, s["length"]).cast("string"))), ""))
