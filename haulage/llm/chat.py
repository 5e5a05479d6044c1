"""Chat formatting with Spark expressions only, and the way back.

A conversation becomes one text. Each run of turns of one role is a block `<|role:...|>` ... `<|end|>`; turns merged into
one block are parted by `<|next|>`. Inside texts every `\\` is written `\\\\` and every `<|` is written `<\\|`; inside
roles every `\\` is written `\\\\` and every `|` is written `\\p`. So `<|` and `|>` as control signs can only come from
the template, every text comes back as it was, and the loss mask (the spans of the assistant's texts) can be read from
the formatted text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END, NEXT, ROLE = "<|", "|>", "<|end|>", "<|next|>", "role:"
_TURNS = "array<struct<role:string,text:string,start:int,end:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo escape: a backslash always stands before the character it protects."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda s: F.replace(s, F.lit("\\p"), F.lit("|"))), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: formatted, the whole conversation in the template.

    turns: conv_id, turn, role, text. Turns are sorted by turn (null turns first), then role, then text; adjacent
    turns of one role are merged into a block by an array aggregation. Null roles and texts count as empty, repeated
    rows are turns of their own, a null conv_id is a conversation like any other, further columns are ignored, an empty
    table gives none. A conversation is one value, so its turns meet in one row.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return told.select("conv_id", F.array_join(F.transform(merged("turns"), _block), "").alias("formatted"))


def _bound(value: Column, of) -> Column:
    """of(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), of), 0)


def _runs(items: Column, starts) -> Column:
    """items cut before each item for which starts(item, place): arrays of items, in time linear in their number."""
    places = F.filter(F.transform(items, lambda x, i: F.when(starts(x, i), i)), lambda i: i.isNotNull())
    ends = lambda s, k: F.coalesce(F.get(s.places, k + 1), F.size(s.items))
    return _bound(F.struct(items.alias("items"), places.alias("places")), lambda s: F.transform(s.places, lambda p, k: F.slice(s.items, p + 1, ends(s, k) - p)))


def merged(turns: str) -> Column:
    """Blocks (role, texts) of the adjacent turns of one role."""
    runs = _bound(F.col(turns), lambda all_turns: _runs(all_turns, lambda t, i: (i == 0) | (t.role != F.get(all_turns, i - 1).role)))
    return F.transform(runs, lambda run: F.struct(F.get(run, 0).role.alias("role"), F.transform(run, lambda t: t.text).alias("texts")))


def _block(block: Column) -> Column:
    head = F.concat(F.lit(OPEN + ROLE), escape_role(block.role), F.lit(CLOSE))
    return F.concat(head, F.array_join(F.transform(block.texts, escape), NEXT), F.lit(END))


def _before(lengths: Column) -> Column:
    """The sums of all lengths before each place: over places in a stretch of 64, and over stretches, so that the work stays
    small for any conversation that one value can hold."""
    add = lambda array: F.aggregate(array, F.lit(0), lambda a, x: a + x)
    count = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    stretches = _bound(lengths, lambda all_of: F.transform(count(F.ceil(F.size(all_of) / 64).cast("int")), lambda k: F.slice(all_of, k * 64 + 1, 64)))

    def placed(s: Column) -> Column:
        sums = F.transform(s, add)
        whole = _bound(sums, lambda all_of: F.transform(all_of, lambda x, k: add(F.slice(all_of, F.lit(1), k))))
        return _bound(whole, lambda w: F.flatten(F.transform(s, lambda part, k: F.transform(part, lambda x, i: F.get(w, k) + add(F.slice(part, F.lit(1), i))))))

    return _bound(stretches, placed)


def read_back(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """turns (role, text, and its start and end in the formatted text, in characters) and loss_spans, the start and end
    of each text of the role to learn, as read from the formatted text alone. A null formatted text has neither."""
    parts = F.filter(F.split("formatted", r"<\|", -1), lambda p, i: i > 0)  # before the first sign there is nothing
    ends = _bound(parts, lambda all_of: F.transform(F.arrays_zip(all_of.alias("part"), _before(F.transform(all_of, lambda p: F.length(p) + len(OPEN))).alias("at")), lambda z: F.struct(z.part.alias("part"), F.substring_index(z.part, CLOSE, 1).alias("head"), z["at"].alias("at"))))
    opens = lambda p, i: F.startswith(p.head, F.lit(ROLE))

    def turn(p: Column, role: Column) -> Column:
        text = F.substr(p.part, F.length(p.head) + len(CLOSE) + 1)
        start = p["at"] + len(OPEN) + F.length(p.head) + len(CLOSE)
        return F.struct(role.alias("role"), unescape(text).alias("text"), start.alias("start"), (p["at"] + len(OPEN) + F.length(p.part)).alias("end"))

    def block(run: Column) -> Column:
        role = unescape_role(F.substr(F.get(run, 0).head, F.lit(len(ROLE) + 1)))
        return _bound(role, lambda r: F.transform(F.filter(run, lambda p: p.head != "end"), lambda p: turn(p, r)))

    turns = F.flatten(F.transform(_runs(ends, opens), block))
    out = formatted.select("*", F.when(F.col("formatted").isNotNull(), F.coalesce(turns, F.array().cast(_TURNS))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.role == learn), lambda t: F.struct(t.start.alias("start"), t.end.alias("end")))
    return out.select("*", spans.alias("loss_spans"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text read back: counts and digests of its turns and of the text under the
    loss mask, which is that of the turns whose starts are in it."""
    back = read_back(format_conversations(turns))
    starts = F.transform("loss_spans", lambda s: s.start)
    masked = F.map_from_arrays(starts, F.transform(starts, lambda s: F.lit(True)))
    under = _bound(masked, lambda m: F.transform(F.filter("turns", lambda t: F.try_element_at(m, t.start)), lambda t: t.text))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join(under, "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
