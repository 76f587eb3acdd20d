"""Shards by a hierarchical weighted hash tree (operator 11).

A tree has regions, regions have racks, racks have weighted shards; a rack or region weighs what its shards weigh.
A row descends from the root: at every level each child draws -ln(u) / weight, u in (0, 1) from the md5 of the
child's path and the row's key, and the least draw wins, so a child gets the share of rows that its weight has
among its siblings. A changed weight changes the draws of the nodes on one path only:

* a heavier shard takes rows into its region, within the region into its rack, within the rack into itself; all
  other regions only lose rows to that region, and all other racks only to that rack;
* a shard that comes as a region of its own (``with_region``) takes rows into itself and moves no other row;
* a shard of weight 0 is drained: its rows alone move.

No row is looked up anywhere: the shard is an expression over the key (``shard_of``), computed in the scan.
``slots`` numbers the rows of every shard without gaps: equal rows are counted first, so that a row repeated any
number of times is one row of the numbering; rows lie in order of an md5 of their columns, and the buckets that are
numbered side by side are ranges of it, so no bucket holds more than its share however the keys are spread. A bucket
of the first digits of the md5 starts where the counts of the buckets before it end.

Defined results: a null key is a key of its own (one shard); a null text has size 1 and checksum 0, as an empty one;
equal keys share a shard; equal rows have slots of their own, in any order; an empty table gives no rows; extra columns
are kept by ``place`` and ``moves`` unless they have the name of an added one, which replaces it; ``slots`` reads and
returns its named columns only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import materialize, partitions_for

#: Hex digits of an md5 that make a draw (52 bits, exact in a double).
DRAW_DIGITS = 13
#: Buckets of the numbering over all shards at most.
MAX_BUCKETS = 1 << 18
#: Repeats of one row that a single task lays out.
REPEATS = 4_096


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


class Tree:
    """Weighted shards by region and rack; the children of every node with their weights."""

    def __init__(self, shards: list[Shard]):
        names = [s.shard for s in shards]
        if len(set(names)) < len(names):
            raise ValueError("a shard number occurs twice")
        if any(not 0 <= s.weight < float("inf") for s in shards):
            raise ValueError("weights are finite and at least 0")
        if any("/" in s.region + s.rack or ":" in s.region + s.rack for s in shards):
            raise ValueError("names of regions and racks have no / or :")
        self.shards = [s for s in shards if s.weight > 0]
        if not self.shards:
            raise ValueError("no shard has a weight")
        self.children: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for s in self.shards:
            self.children["/"][s.region] += s.weight
            self.children[f"/{s.region}/"][s.rack] += s.weight
            self.children[f"/{s.region}/{s.rack}/"][str(s.shard)] += s.weight

    @classmethod
    def even(cls, shards: int, regions: int = 2, racks: int = 2) -> Tree:
        """Shards of weight 1, dealt in order over regions and their racks."""
        per_rack = -(-shards // (regions * racks))
        return cls([Shard(f"g{i // (per_rack * racks)}", f"r{i // per_rack % racks}", i) for i in range(shards)])

    def with_region(self, shard: int, weight: float = 1.0) -> Tree:
        """One more shard as a region of its own: it takes rows from all others and moves none between them."""
        return Tree([*self.shards, Shard(f"of {shard}", "r0", shard, weight)])

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree([Shard(s.region, s.rack, s.shard, weight if s.shard == shard else s.weight) for s in self.shards])

    def literal(self) -> Column:
        """map<path, array<struct<name, weight>>>; its size is the tree's, never the data's."""
        return F.create_map(*[x for path, kids in self.children.items() for x in (F.lit(path), F.array(*[
            F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for name, w in sorted(kids.items())]))])


def _key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("null"))


def _least(children: Column, path: Column, key: Column) -> Column:
    """The child (its name) with the least draw; on a tie the smaller name."""

    def draw(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat(path, child["name"], F.lit(":"), key)), 1, DRAW_DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 16.0**DRAW_DIGITS
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` evaluated once per row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shard_of(tree: Tree, key: Column) -> Column:
    """The shard (int) of every row."""
    kids = tree.literal()

    def below(path: Column, k: Column, levels: int) -> Column:
        name = _least(F.element_at(kids, path), path, k)
        return name if levels == 1 else _once(F.concat(path, name, F.lit("/")), lambda p: below(p, k, levels - 1))

    return _once(_key(key), lambda k: below(F.lit("/"), k, 3)).cast("int")


def place(df: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """``df`` with ``shard``; no shuffle."""
    return df.withColumn("shard", shard_of(tree, F.col(key)))


def moves(df: DataFrame, old: Tree, new: Tree, key: str = "doc_id") -> DataFrame:
    """The rows that change their shard from one tree to the other, with ``from_shard`` and ``to_shard``."""
    both = df.withColumns({"from_shard": shard_of(old, F.col(key)), "to_shard": shard_of(new, F.col(key))})
    return both.filter(F.col("from_shard") != F.col("to_shard"))


def write_shards(df: DataFrame, tree: Tree, path: str, key: str = "doc_id") -> None:
    """One folder ``shard=n`` per shard; every task appends to each, so nothing is shuffled."""
    place(df, tree, key).write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long")


def slots(rows: DataFrame, columns: list[str], shard: Column) -> DataFrame:
    """``columns``, ``shard`` and ``slot`` (long, gapless from 0 in every shard) of every row; ``shard`` must be an
    expression over ``columns``."""
    if clash := {"shard", "slot", "sl_rows", "sl_order", "sl_bucket"} & set(columns):
        raise ValueError(f"these names are the numbering's own: {sorted(clash)}")
    order = F.md5(F.concat_ws("|", *[_key(F.col(c)) for c in columns]))
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("sl_rows")).withColumns({"shard": shard, "sl_order": order})
    counted = materialize(counted, "shard-rows")
    names = counted.agg(F.count_distinct("shard")).first()[0]
    bits = _bits(partitions_for(rows), names)
    bucket = F.shiftright(F.conv(F.substring("sl_order", 1, 5), 16, 10).cast("int"), 20 - bits)
    counted = counted.withColumn("sl_bucket", bucket)

    sums = counted.groupBy("shard", "sl_bucket").agg(F.sum("sl_rows").alias("sl_all"))
    before = Window.partitionBy("shard").orderBy("sl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "sl_bucket", F.coalesce(F.sum("sl_all").over(before), F.lit(0)).alias("sl_start"))
    within = Window.partitionBy("shard", "sl_bucket").orderBy("sl_order", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("sl_ahead", F.coalesce(F.sum("sl_rows").over(within), F.lit(0))).join(
        starts, ["shard", "sl_bucket"]).withColumn("sl_first", F.col("sl_start") + F.col("sl_ahead"))

    keep = [*columns, "shard"]
    few = placed.filter(F.col("sl_rows") <= REPEATS).select(
        *keep, F.explode(F.sequence(F.col("sl_first"), F.col("sl_first") + F.col("sl_rows") - 1)).alias("slot"))
    last = F.col("sl_first") + F.col("sl_rows") - 1
    many = placed.filter(F.col("sl_rows") > REPEATS).select(
        *keep, last.alias("sl_last"), F.explode(F.sequence("sl_first", last, F.lit(REPEATS).cast("long"))).alias("sl_from"))
    many = many.repartition(partitions_for(rows), "shard", "sl_from").select(
        *keep, F.explode(F.sequence("sl_from", F.least("sl_last", F.col("sl_from") + REPEATS - 1))).alias("slot"))
    return few.unionByName(many)


def _bits(partitions: int, shards: int) -> int:
    """Digits of the order in a bucket's number: about four buckets for each partition over all shards."""
    bits = 4
    while (shards << bits) < min(4 * partitions, MAX_BUCKETS) and bits < 20:
        bits += 1
    return bits
