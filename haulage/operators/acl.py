"""Access-control entries: mask decoding, summaries and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Composite permissions in order of size, and single bits in display order.
COMPOSITES = [("FullControl", 0x1F01FF), ("Modify", 0x1301BF), ("ReadAndExecute", 0x1200A9), ("Write", 0x120116), ("Read", 0x120089)]
BITS = [("ReadData", 0x1), ("WriteData", 0x2), ("AppendData", 0x4), ("ReadExtendedAttributes", 0x8), ("WriteExtendedAttributes", 0x10), ("ExecuteFile", 0x20), ("ReadAttributes", 0x80), ("WriteAttributes", 0x100), ("Delete", 0x10000), ("ReadPermissions", 0x20000), ("ChangePermissions", 0x40000), ("TakeOwnership", 0x80000)]
READ_WRITE, INHERITED = 0x12019F, 0x10


def decode_mask(mask: Column) -> Column:
    """An exact composite alone, read-write as both, else the single bits; bits of no name are left out."""
    has = lambda bits: mask.bitwiseAND(F.lit(bits)) == bits
    out = F.when(mask == READ_WRITE, F.array(F.lit("Read"), F.lit("Write")))
    for name, bits in COMPOSITES:
        out = out.when(mask == bits, F.array(F.lit(name)))
    single = F.array_compact(F.array(*[F.when(has(bits), F.lit(name)) for name, bits in BITS]))
    return out.otherwise(single)


def explicit_aces(aces: DataFrame) -> DataFrame:
    """Entries that are not inherited; one with null flags is neither and is left out."""
    return aces.where(F.col("flags").bitwiseAND(F.lit(INHERITED)) == 0)


def ace_text(flags: Column, type_: Column, trustee: Column) -> Column:
    """An entry in one line: explicit or inherited, its type, whom it is about, and how it is passed on."""
    kinds = F.when(type_ == 0, "AccessAllowed").when(type_ == 1, "AccessDenied").when(type_ == 2, "SystemAudit").otherwise(F.concat(F.lit("type "), type_.cast("string")))
    on = lambda bit, name: F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name))
    passed = F.array_join(F.array_compact(F.array(on(0x1, "OI"), on(0x2, "CI"), on(0x8, "IO"), on(0x4, "NP"))), "|")
    return F.concat(F.lit("["), F.coalesce(on(INHERITED, "I"), F.lit("E")), F.lit("] "), kinds, F.lit(" "), trustee, F.lit(" ("), passed, F.lit(")"))


def _listed(aces: DataFrame) -> Column:
    """The texts of a path's entries in the order of pos; without one, denials before the rest, then by text."""
    text = ace_text(F.col("flags"), F.col("type"), F.col("trustee"))
    first = F.col("pos") if "pos" in aces.columns else F.when(F.col("type") == 1, 0).otherwise(1)
    return F.transform(F.array_sort(F.collect_list(F.struct(first.alias("at"), text.alias("text")))), lambda x: x.text)


def acl_summary(aces: DataFrame) -> DataFrame:
    """path, n_aces, n_explicit, n_inherited, entries: their texts in the list's own order (column pos, where there is one;
    else denials first). A list's length bounds the array; null flags are neither explicit nor inherited."""
    inherited = F.col("flags").bitwiseAND(F.lit(INHERITED)) != 0
    return aces.groupBy("path").agg(F.count("*").alias("n_aces"), F.count_if(~inherited).alias("n_explicit"), F.count_if(inherited).alias("n_inherited"), _listed(aces).alias("entries"))


def who_can(aces: DataFrame) -> DataFrame:
    """Trustees by permission: allows less denials. Null masks and masks of no named bit grant nothing."""
    each = aces.select("trustee", "type", F.explode(decode_mask(F.col("mask"))).alias("permission"))
    return each.groupBy("permission").agg(F.sum(F.when(F.col("type") == 0, 1).otherwise(-1)).alias("net"), F.count_distinct("trustee").alias("n_trustees"))


def acl_diff(src: DataFrame, dst: DataFrame) -> DataFrame:
    """path, only_src, only_dst, needs_update, merged for every path of either side: explicit entries that the other side
    lacks (repeated ones count each), whether the destination is to be written, and what it then holds.

    It is to be written if the sides' protected bits differ or either has explicit entries, equal ones too. merged then
    holds the source's explicit entries and after them the destination's inherited ones, each in their own order (column
    pos, where there is one; else denials first), as texts; otherwise it is null. Without a column protected, or where it is
    null, a list is not protected; a path that one side lacks has an empty, unprotected list there.
    """
    cols = ["path", "trustee", "mask", "flags", "type"]
    own, inherited = explicit_aces(src), dst.where(F.col("flags").bitwiseAND(F.lit(INHERITED)) != 0)
    a, b = own.select(cols), explicit_aces(dst).select(cols)
    tally = lambda df, s, d: df.select("path", F.lit(s).alias("s"), F.lit(d).alias("d"))
    differ = tally(a.exceptAll(b), 1, 0).unionByName(tally(b.exceptAll(a), 0, 1)).groupBy("path").agg(F.sum("s").alias("only_src"), F.sum("d").alias("only_dst"))
    state = lambda df, name: df.groupBy("path").agg(F.bool_or(F.coalesce(F.col("protected"), F.lit(False)) if "protected" in df.columns else F.lit(False)).alias(f"{name}_protected"), F.bool_or(F.coalesce(F.col("flags").bitwiseAND(F.lit(INHERITED)) == 0, F.lit(False))).alias(f"{name}_explicit"))
    both = state(src, "s").join(state(dst, "d"), "path", "full_outer")
    no = lambda c: F.coalesce(c, F.lit(False))
    update = (no(F.col("s_protected")) != no(F.col("d_protected"))) | no(F.col("s_explicit")) | no(F.col("d_explicit"))
    first, then = own.groupBy("path").agg(_listed(own).alias("first")), inherited.groupBy("path").agg(_listed(inherited).alias("then"))
    out = both.join(differ, "path", "left").join(first, "path", "left").join(then, "path", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0)
    return out.select("path", F.coalesce("only_src", zero).alias("only_src"), F.coalesce("only_dst", zero).alias("only_dst"), update.alias("needs_update"), F.when(update, F.concat(F.coalesce("first", none), F.coalesce("then", none))).alias("merged"))
