"""Inventory comparison and the actions that follow from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulage.functions.columns import path_name, path_parent
from haulage.functions.names import free
from haulage.functions.shared import cut

ATTRS = ("size", "mtime_ns", "mode", "uid", "gid", "ino")
#: Rounds of renames that are read side by side before they are written as one.
UNIONS = 16


def change_kind(src: str, dst: str) -> Column:
    """same, data_changed, metadata_changed or both_changed; absent attributes compare equal only to absent ones."""
    differs = lambda c: ~F.col(f"{src}.{c}").eqNullSafe(F.col(f"{dst}.{c}"))
    data, meta = differs("size") | differs("mtime_ns"), differs("mode") | differs("uid") | differs("gid")
    return F.when(data & meta, "both_changed").when(data, "data_changed").when(meta, "metadata_changed").otherwise("same")


def diff_inventories(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """relative_path, state, prev and cur (structs): one full outer join on the path. A null path matches no other, so it
    is deleted on one side and new on the other; rows that repeat a path are compared each with each."""
    side = lambda df, name: df.select("relative_path", F.struct(*ATTRS).alias(name))
    both = side(prev, "prev").join(side(cur, "cur"), "relative_path", "full_outer")
    state = F.when(F.col("prev").isNull(), "new").when(F.col("cur").isNull(), "deleted").otherwise(change_kind("prev", "cur"))
    return both.select("relative_path", state.alias("state"), "prev", "cur")


def new_entries(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Rows of cur whose path prev lacks; a null path counts as lacking."""
    return cur.join(prev, "relative_path", "left_anti")


def deleted_entries(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Rows of prev whose path cur lacks; a null path counts as lacking."""
    return prev.join(cur, "relative_path", "left_anti")


def detect_renames(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(from_path, to_path, ino): deleted and new entries of one file handle, where it is unique on both sides."""
    once = lambda df, name: df.where("ino is not null").groupBy("ino").agg(F.min("relative_path").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    return once(deleted_entries(prev, cur), "from_path").join(once(new_entries(prev, cur), "to_path"), "ino").select("from_path", "to_path", "ino")


def pair_renames(diff: DataFrame) -> DataFrame:
    """relative_path, from_path, state, change, prev, cur: the diff with each renamed entry as one row.

    A deleted and a new entry of one file handle (ino), which occurs once among the deleted and once among the new
    ones, become one row of state renamed under the new path; change is what else changed (null for other states). Null
    handles pair with nothing.
    """
    once = lambda state, side, name: diff.where((F.col("state") == state) & F.col(f"{side}.ino").isNotNull()).groupBy(F.col(f"{side}.ino").alias("ino")).agg(F.count("*").alias("n"), F.min("relative_path").alias(name), F.min(side).alias(side)).where("n = 1").drop("n")
    pairs = once("deleted", "prev", "from_path").join(once("new", "cur", "to_path"), "ino")
    renamed = pairs.select(F.col("to_path").alias("relative_path"), "from_path", F.lit("renamed").alias("state"), change_kind("prev", "cur").alias("change"), "prev", "cur")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("from_path").alias("relative_path"), F.lit("deleted").alias("state")), F.struct(F.col("to_path").alias("relative_path"), F.lit("new").alias("state")))).alias("e")).select("e.*")
    none = F.lit(None).cast("string")
    rest = diff.join(ends, ["relative_path", "state"], "left_anti").select("relative_path", none.alias("from_path"), "state", none.alias("change"), "prev", "cur")
    return rest.unionByName(renamed)


# What each state makes necessary.
ACTIONS = {"new": ["copy"], "data_changed": ["copy", "set_metadata"], "both_changed": ["copy", "set_metadata"], "metadata_changed": ["set_metadata"], "deleted": ["delete"], "renamed": ["rename"]}


def sync_actions(diff: DataFrame) -> DataFrame:
    """relative_path, step, action: nothing for unchanged entries; what else a renamed entry needs (column change, where
    the diff has it) follows the rename."""
    todo = F.create_map(*[x for state, acts in ACTIONS.items() for x in (F.lit(state), F.array(*map(F.lit, acts)))])
    steps = F.try_element_at(todo, F.col("state"))
    if "change" in diff.columns:
        steps = F.concat(F.coalesce(steps, F.array().cast("array<string>")), F.coalesce(F.try_element_at(todo, F.col("change")), F.array().cast("array<string>")))
    return diff.select("relative_path", F.posexplode(steps).alias("step", "action"))


def summarize_changes(diff: DataFrame) -> DataFrame:
    """Entries and bytes by state; a null size counts 0, an empty diff gives no row."""
    return diff.groupBy("state").agg(F.count("*").alias("n_entries"), F.coalesce(F.sum(F.coalesce("cur.size", "prev.size")), F.lit(0)).alias("bytes"))


def change_cube(diff: DataFrame) -> DataFrame:
    """state, top, n_entries, bytes: summarize_changes for each state and top directory, each alone and all together (null
    where all are meant: a null path's top is `?`). The sums are made before the cube expands them, by one shuffle."""
    top = F.coalesce(F.substring_index("relative_path", "/", 1), F.lit("?"))
    size = F.coalesce("cur.size", "prev.size", F.lit(0).cast("long"))
    return diff.select("state", top.alias("top"), size.alias("size")).cube("state", "top").agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# Fixed values: (destination, source kind) and the attributes written there.
CARRY = [("nas", "nas", "atime,mtime,uid,gid,mode"), ("nas", "s3", "atime,mtime"), ("nas", "hdfs", "mtime,mode"), ("hdfs", "nas", "mode,mtime"), ("hdfs", "s3", "mtime"), ("hdfs", "hdfs", "mode,mtime,owner,group")]


def metadata_carry(actions: DataFrame, dst_backend: str) -> DataFrame:
    """actions (with src_kind) and the attributes that set_metadata writes at the destination; none for object stores."""
    rules = {src: attrs for dst, src, attrs in CARRY if dst == dst_backend}
    attrs = F.lit("")
    for src, names in rules.items():
        attrs = F.when(F.col("src_kind") == src, F.lit(names)).otherwise(attrs)
    return actions.withColumn("attributes", F.when(F.col("action") == "set_metadata", attrs).otherwise(F.lit("")))


def carried_values(actions: DataFrame, entries: DataFrame, dst_backend: str) -> DataFrame:
    """metadata_carry's set_metadata rows with what is written: relative_path, atime_ns, mtime_ns, uid, gid, mode, owner,
    owner_group; null where an attribute is not carried or not known.

    entries: relative_path and what is known of the source. Modes are cut to their permission bits (& 0o7777), an object
    store's access time is its mtime, empty owners and groups are left out. A path without an entry has nulls.
    """
    has = set(entries.columns)
    known = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    told = entries.select("relative_path", *[known(c, "long").alias(c) for c in ("atime_ns", "mtime_ns", "uid", "gid")], known("mode", "long").bitwiseAND(F.lit(0o7777)).alias("mode"), *[F.nullif(known(c, "string"), F.lit("")).alias(c) for c in ("owner", "owner_group")])
    set_rows = metadata_carry(actions.select("relative_path", "src_kind", "action"), dst_backend).where("action = 'set_metadata'")
    both = set_rows.join(told, "relative_path", "left").withColumn("atime_ns", F.when(F.col("src_kind") == "s3", F.col("mtime_ns")).otherwise(F.col("atime_ns")))
    carried = lambda name, c: F.when(F.array_contains(F.split("attributes", ","), name), F.col(c)).alias(c)
    return both.select("relative_path", *[carried(n, c) for n, c in (("atime", "atime_ns"), ("mtime", "mtime_ns"), ("uid", "uid"), ("gid", "gid"), ("mode", "mode"), ("owner", "owner"), ("group", "owner_group"))])


def merge_scan_messages(log: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """The inventory (relative_path, size) after a message log (seq, kind, relative_path, from_path, size), as a replay in the
    order of seq gives it.

    A message sets its path's size; Deleted takes the path away, Renamed takes from_path and everything below it to
    relative_path, replacing what is there of the same names, and then sets relative_path itself. Messages without a path are
    about the null path. Of messages of one path that share a seq the greatest by (kind, size) counts, and counts more than
    what a rename brings there at that seq; of renames that bring two entries to one place the larger size stays. A null
    seq comes before all others.

    Between two renames of a path or of directories above it nothing leaves the path, so only its last arrival of such a stay
    counts: it is what the rename at the stay's end takes along, to a stay of another path that is known by then. The
    first round takes every stay with a message; each later one only stays whose last arrival the round before has
    changed, so rounds are as many as the moves of the entry that moved most, but later ones meet only what moved so often.
    """
    log = log.withColumn("seq", F.coalesce("seq", F.lit(-(1 << 63))))
    renames = cut(log.where("kind = 'Renamed' AND from_path IS NOT NULL AND relative_path IS NOT NULL").groupBy(F.col("from_path").alias("at"), "seq").agg(F.max("relative_path").alias("to_path")))
    told = _stays(log.select("relative_path", "seq", F.lit(1).alias("rank"), "kind", "size", F.lit(None).cast("string").alias("came_from"), F.lit(0).alias("round")), renames)
    last = told.groupBy("relative_path", "until", "place").agg(F.max(F.struct("seq", "rank", "kind", "size", "came_from", "round")).alias("m"))
    direct, moved = cut(last.select("relative_path", "until", "place", "m.*")), []
    going = direct.where("until IS NOT NULL AND kind <> 'Deleted'")
    for k in range(1, max_rounds + 1):
        arrived = going.select(F.col("place").alias("relative_path"), F.col("until").alias("seq"), F.lit(0).alias("rank"), F.lit("Renamed").alias("kind"), "size", F.col("relative_path").alias("came_from"), F.lit(k).alias("round"))
        arrived = cut(_stays(arrived, renames))
        if arrived.isEmpty():
            final = reduce(DataFrame.unionByName, moved, direct).where("until IS NULL")
            return _last_arrival(final).where("kind <> 'Deleted'").select("relative_path", "size")
        moved = [*moved, arrived] if len(moved) < UNIONS else [cut(reduce(DataFrame.unionByName, moved, arrived))]
        changed = arrived.where("until IS NOT NULL").select("relative_path", "until")
        stays = reduce(DataFrame.unionByName, moved, direct).where("until IS NOT NULL").join(changed, ["relative_path", "until"], "left_semi")
        going = cut(_last_arrival(stays).where((F.col("newest") == k) & (F.col("kind") != "Deleted")))
    raise RuntimeError(f"renames did not settle in {max_rounds} rounds")


def _stays(arrivals: DataFrame, renames: DataFrame) -> DataFrame:
    """arrivals with until and place: when the next rename of their path or of a directory above it comes (of several at once
    that of the topmost), and the path after it; null where none comes.

    It is looked up by a running window over each renamed directory's renames and the arrivals below it, without pairing them.
    """
    path, own = F.col("relative_path"), arrivals.columns
    slashes = F.size(F.split(path, "/")) - 1
    above = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), slashes), lambda i: F.call_function("substring_index", path, F.lit("/"), i))).otherwise(F.array().cast("array<string>"))
    at = arrivals.where(path.isNotNull()).select(path).distinct().select(path, F.explode(F.concat(above, F.array(path))).alias("at"))
    both = arrivals.join(at.join(renames.select("at").distinct(), "at", "left_semi"), "relative_path", "left")
    asked = both.where("at IS NOT NULL").select("at", "seq", F.struct(*own).alias("arrival"))
    rows = asked.unionByName(renames.select("at", "seq", F.struct("seq", "to_path").alias("rename")), allowMissingColumns=True)
    later = Window.partitionBy("at").orderBy(F.desc("seq"), F.col("rename").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("next", F.last("rename", ignorenulls=True).over(later)).where("arrival IS NOT NULL")
    found = found.select("arrival.*", F.when(F.col("next").isNotNull(), F.struct(F.col("next.seq").alias("seq"), F.length("at").alias("n"), F.col("next.to_path").alias("to"))).alias("r"))
    found = found.groupBy(*own).agg(F.min("r").alias("r"))
    found = found.select(*own, F.col("r.seq").alias("until"), F.concat(F.col("r.to"), F.substr("relative_path", F.col("r.n") + 1)).alias("place"))
    return found.unionByName(both.where("at IS NULL").drop("at"), allowMissingColumns=True)


def _last_arrival(stays: DataFrame) -> DataFrame:
    """relative_path, until, place, kind and size of each stay's last arrival, and newest, the latest round in which one came
    at that time. What a later round says of one arrival (where from, and when) replaces what earlier ones said."""
    each = stays.groupBy("relative_path", "until", "place", "came_from").agg(F.max(F.struct("seq", "rank", "round", "kind", "size")).alias("m"))
    top = each.groupBy("relative_path", "until", "place").agg(F.max(F.struct("m.seq", "m.rank", "m.kind", "m.size")).alias("m"), F.max(F.struct("m.seq", "m.rank", "m.round")).alias("newest"))
    return top.select("relative_path", "until", "place", "m.kind", "m.size", F.col("newest.round").alias("newest"))


def top_renames(pairs: DataFrame) -> DataFrame:
    """Of renames (from_path, to_path) those that no rename of the directory above them explains: its pair is among them
    and the name is the same."""
    up = lambda c: path_parent(F.col(c))
    same_name = path_name(F.col("from_path")) == path_name(F.col("to_path"))
    above = pairs.select(F.col("from_path").alias("from_dir"), F.col("to_path").alias("to_dir")).distinct()
    own = pairs.withColumns({"from_dir": up("from_path"), "to_dir": up("to_path")})
    explained = own.where(same_name).join(above, ["from_dir", "to_dir"], "left_semi").select("from_path", "to_path")
    return pairs.join(explained, ["from_path", "to_path"], "left_anti")


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key (a null key is one) by the given order; rows that tie in it all are alike."""
    (place,) = free(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) == 1).drop(place)
