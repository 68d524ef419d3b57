"""Near-content groups: simhash signatures, a distance join in pieces, connected components."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.functions.digests import synthetic_digest
from twinlake.functions.paths import extension
from twinlake.functions.simhash import hamming, max_distance, near_key, similarity, simhash
from twinlake.operators.close import WIDEST, close_members, close_pairs
from twinlake.operators.components import connected_components
from twinlake.operators.groups import having
from twinlake.plans.config import FuzzyConfig
from twinlake.session import bound_batches, give_back

#: Distinct signatures that meet in one piece of work, a side.
PIECE = 8192
#: Members of a component, in a bucket, from which on they do not meet each other.
LARGE = 32
LEAST_BITS = 8
#: Bits of a band in which nodes meet first, at wider distances.
FIRST_BITS = 16
#: Nodes that share a band, from which on they must agree in a further block of bits to meet.
CROWD = 16384
#: Copies of a node that bands and their further blocks make, at most, and the least bits of a further block.
MOST_SPOTS, LEAST_FURTHER = 64, 4


def signatures(files: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """``(path, size, ext, sig)``. Files under the least size and empty content have none; of more than
    ``max_candidates``, those with the smallest paths take part (that cap is the operator's, -1 lifts it)."""
    bound_batches(files.sparkSession)
    rows = files.where((F.col("path") != "") & (F.col("size") >= config.min_size))
    ext = extension(F.col("path")) if config.same_extension else F.lit("")
    out = rows.select("path", "size", ext.alias("ext"), simhash(F.col("content"), config.read_limit).alias("sig")).where("sig is not null")
    return out if config.max_candidates < 0 else out.orderBy("path").limit(config.max_candidates)


def fuzzy_metrics(files: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """One row: files scanned, too small, skipped (no path, a negative size, no content), processed, and truncated
    by the cap."""
    bad = F.col("path").isNull() | (F.col("path") == "") | (F.col("size") < 0) | F.col("content").isNull() | (F.octet_length(F.col("content")) == 0)
    small = ~bad & (F.col("size") < config.min_size)
    able = F.count_if(~bad & ~small)
    cap = F.lit(config.max_candidates if config.max_candidates >= 0 else 2**62)
    return files.agg(
        F.count("*").alias("scanned"), F.count_if(small).alias("too_small"), F.count_if(F.coalesce(bad, F.lit(True))).alias("skipped"),
        F.least(able, cap).alias("processed"), F.greatest(able - cap, F.lit(0)).cast("long").alias("truncated"),
    )


UNIT = ["ext", "band", "value", "low", "kind", "i", "j"]
#: Pairs that are merged into labels at once.
PAIRS = 1 << 19


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units from rows sorted by unit, and each row's unit."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
        if held is None or not held.num_rows:
            continue
        ext = held.column("ext").combine_chunks().dictionary_encode().indices.to_numpy()
        key = np.stack([ext.astype(np.int64), *(held.column(c).to_numpy().astype(np.int64) for c in UNIT[1:])], axis=1)
        heads = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        end = held.num_rows if batch is None else int(heads[-1]) if len(heads) else 0
        if end:
            unit = np.zeros(end, np.int64)
            unit[heads[heads < end]] = 1
            yield held.slice(0, end).combine_chunks(), np.cumsum(unit)
            held = held.slice(end).combine_chunks()


def _merge(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches, with pairs ``p, q`` added to what ``label`` joins."""
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        for rows in (p, q, label[p], label[q]):
            np.minimum.at(new, rows, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(batches: Iterator[pa.RecordBatch], distance: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """``(src, dst)``: a forest of the links between components in each unit. Rows that are so far apart in the order meet
    at once, over all units of a table; a unit's pairs are never held together."""
    for table, unit in _whole_units(batches):
        sig, size = table.column("sig").to_numpy().view(np.uint64), table.column("size").to_numpy().astype(np.float64)
        side, own = table.column("side").to_numpy(), (table.column("kind").to_numpy() == 0) & (table.column("i").to_numpy() == table.column("j").to_numpy())
        comp = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        label, left, right, held = np.arange(len(unit)), [], [], 0
        rows, d = np.arange(len(unit)), 1
        while len(rows := rows[rows + d < len(unit)]) and len(rows := rows[unit[rows] == unit[rows + d]]):
            other = rows + d
            ok = np.bitwise_count(sig[rows] ^ sig[other]) <= distance
            p, q = rows[ok], other[ok]
            low, high = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
            ok = (comp[p] != comp[q]) & (own[p] | (side[p] != side[q])) & np.where(low > 0, high <= ratio * low, high == low)
            left.append(p[ok])
            right.append(q[ok])
            held += len(left[-1])
            if held > PAIRS:
                label, left, right, held = _merge(label, np.concatenate(left), np.concatenate(right)), [], [], 0
            d += 1
        if left:
            label = _merge(label, np.concatenate(left), np.concatenate(right))
        linked = np.flatnonzero(label != np.arange(len(label)))
        node = table.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([node.take(pa.array(linked)), node.take(pa.array(label[linked]))], names=["src", "dst"])
    give_back()


def _bands(distance: int, least: int) -> list[tuple[int, int]]:
    """First bits and numbers of bits of bands that signatures may share, ``least`` bits or more each."""
    bits = max(least, 64 // (distance + 1))
    return [(a, bits) for a in range(0, 64 - bits + 1, bits)]


def _spots(nodes: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """A row for each node and band, with the bits that the node has there."""
    value = lambda a, bits: F.col("sig") if bits == 64 else F.shiftrightunsigned("sig", a).bitwiseAND(F.lit((1 << bits) - 1))
    spot = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), value(*x).cast("long").alias("value")) for k, x in enumerate(bands))))
    return nodes.withColumn("spot", spot).select(*nodes.columns, "spot.band", "spot.value")


def _further(nodes: DataFrame, distance: int) -> DataFrame:
    """``_spots`` of bands, where what shares a crowded band is told apart by further bits. Signatures that agree in a band
    and differ in d bits agree in one of d + 1 blocks of their other bits, so no pair is lost; a node has a row for each block
    in place of that of the band. Blocks that are still crowded are cut again, as far as ``MOST_SPOTS`` and the bits go."""
    parts, bands = distance + 1, _bands(distance, 1)
    bits = bands[0][1]
    rows, left = _spots(nodes, bands), 64 - bits
    low = lambda n: F.lit((1 << n) - 1).cast("long")
    right = lambda x, n: F.call_function("shiftrightunsigned", x, F.lit(n))
    up = lambda x, n: F.call_function("shiftleft", x, F.lit(n))
    if left // parts < LEAST_FURTHER:
        return rows
    # the bits outside the band, side by side
    rest = F.coalesce(*(F.when(F.col("band") == k, (right(F.col("sig"), a + bits) if a + bits < 64 else F.lit(0).cast("long")).bitwiseOR(up(F.col("sig").bitwiseAND(low(a)), 64 - a - bits))) for k, (a, _) in enumerate(bands)))
    rows, done, spots, keys = rows.withColumn("rest", rest), [], parts * parts, ["ext", "band", "value"]
    while spots <= MOST_SPOTS and (width := left // parts) >= LEAST_FURTHER:
        crowds = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*keys, F.lit(True).alias("crowd")))
        if crowds.isEmpty():
            break
        # at most a row in CROWD is broadcast
        told = rows.join(F.broadcast(crowds), keys, "left").select(*nodes.columns, "band", "value", "rest", "crowd")
        done.append(told.where("crowd is null").drop("crowd", "rest"))
        held, cuts = F.col("rest"), []
        for k in range(parts):
            own, other = right(held, k * width).bitwiseAND(low(width)), up(right(held, (k + 1) * width), k * width).bitwiseOR(held.bitwiseAND(low(k * width)))
            cuts.append(F.struct((parts * (F.col("band") + 1) + k).alias("band"), up(F.col("value"), width).bitwiseOR(own).alias("value"), other.alias("rest")))
        rows = cut(told.where("crowd").withColumn("cut", F.explode(F.array(*cuts))).select(*nodes.columns, "cut.*"))
        left, spots = left - width, spots * parts
    return functools.reduce(DataFrame.unionByName, [*done, rows.drop("rest")])


def _near(distance: int, ratio: float) -> Column:
    low, high = F.least("size", "head_size"), F.greatest("size", "head_size")
    return (hamming(F.col("sig"), F.col("head_sig")) <= distance) & F.when(low > 0, high <= F.lit(float(ratio)) * low).otherwise(high == low)


def _first_links(nodes: DataFrame, distance: int, ratio: float) -> DataFrame:
    """Some links, a few a node: that with the first node that agrees with it in a band of ``FIRST_BITS`` bits."""
    placed = _spots(nodes, _bands(distance, FIRST_BITS))
    keys = ["ext", "bucket", "band", "value"]
    heads = placed.groupBy(*keys).agg(F.min(F.struct("node", "sig", "size")).alias("head"), F.count("*").alias("n")).where("n > 1")
    rows = placed.join(heads, keys).select("node", "sig", "size", F.col("head.node").alias("head"), F.col("head.sig").alias("head_sig"), F.col("head.size").alias("head_size"))
    return rows.where((F.col("node") != F.col("head")) & _near(distance, ratio)).select(F.col("node").alias("src"), F.col("head").alias("dst"))


def _units(sigs: DataFrame, config: FuzzyConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes (files of one signature, size and extension), links that are known of them, and the rows of the units
    of work in which all other links are found."""
    distance, ratio = max_distance(config.threshold), config.max_ratio
    bucket = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)) + 0.0) / F.lit(float(np.log2(max(ratio, 1.01))))).cast("int")
    nodes = cut(sigs.groupBy("sig", "size", "ext").agg(F.min("path").alias("node")).withColumn("bucket", bucket))
    # signatures that differ in d bits agree in one of d + 1 bands; bands of few bits would tell little apart
    banded = 64 // (distance + 1) >= LEAST_BITS
    if banded:
        known = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")).where(F.lit(False))
        placed = _further(nodes, distance).withColumn("component", F.col("node"))
    else:
        known = cut(_first_links(nodes, distance, ratio))
        parts = connected_components(known).select("node", "component")
        placed = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumns({"band": F.lit(0), "value": F.lit(0).cast("long")})
    keys = ["ext", "band", "value", "bucket"]
    # members of a bucket's largest component do not meet each other
    if banded:  # each node is a component
        top = placed.groupBy(*keys).agg(F.count("*").alias("all")).withColumn("top", F.struct(F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("component")))
    else:
        of_parts = placed.groupBy(*keys, "component").agg(F.count("*").alias("n"))
        top = of_parts.groupBy(*keys).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    pieces = lambda n: F.ceil(n / PIECE).cast("int")
    large = F.col("top.n") > LARGE
    counts = top.select(*keys, F.when(large, F.col("top.component")).alias("major"), pieces(F.when(large, F.col("top.n")).otherwise(0)).alias("majors"), pieces(F.col("all") - F.when(large, F.col("top.n")).otherwise(0)).alias("minors"), (F.col("all") > 1).alias("several"))

    # what the buckets above and below have; members that meet nothing stay out
    order = Window.partitionBy("ext", "band", "value").orderBy("bucket")
    for name, beside, step in (("above", F.lead, 1), ("below", F.lag, -1)):
        there = beside("bucket").over(order) == F.col("bucket") + step
        counts = counts.withColumns({f"{c}_{name}": F.when(there, beside(c).over(order)) for c in ("major", "majors", "minors")})
    rows = placed.join(counts.where("several or majors_above is not null or majors_below is not null"), keys)
    is_major = F.coalesce(F.col("component") == F.col("major"), F.lit(False))
    rows = rows.withColumn("mine", F.when(is_major, F.pmod(F.xxhash64("node"), F.col("majors"))).otherwise(F.col("majors") + F.pmod(F.xxhash64("node"), F.col("minors"))).cast("int"))
    kind = "array<struct<low:int,kind:int,i:int,j:int,side:int>>"
    unit = lambda low, kind, i, j, side: F.struct(low.cast("int").alias("low"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    mine, low = F.col("mine"), F.col("bucket")

    def with_pieces(first, last, there, make):
        return F.when(there & (last > first), F.transform(F.sequence(first.cast("int"), F.greatest(last - 1, first).cast("int")), make)).otherwise(F.array().cast(kind))

    # pieces of the largest component come first; one of them meets only what is none
    zero, total = F.lit(0), F.col("majors") + F.col("minors")
    own = with_pieces(F.when(is_major, F.col("majors")).otherwise(zero), total, F.col("several"), lambda x: unit(low, 0, F.least(mine, x), F.greatest(mine, x), mine <= x))

    def other(name: str, make):
        first = F.when(is_major & (F.col("major") == F.col(f"major_{name}")), F.col(f"majors_{name}")).otherwise(zero)
        return with_pieces(first, F.col(f"majors_{name}") + F.col(f"minors_{name}"), F.col(f"majors_{name}").isNotNull(), make)

    up, down = other("above", lambda x: unit(low, 1, mine, x, zero)), other("below", lambda x: unit(low - 1, 1, x, mine, F.lit(1)))
    return nodes, known, rows.withColumn("unit", F.explode(F.concat(own, up, down))).select("ext", "band", "value", "unit.*", "node", "size", "sig", "component")


def links(sigs: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """``(src, dst)``: edges whose components are those of all pairs within the distance and size ratio.

    Files of one signature, size and extension are one node from the start. Only files of neighbouring powers of the
    ratio can be linked, and where the distance leaves bands of ``LEAST_BITS`` only those that agree in a band. At
    wider distances each node is first linked with one that shares 16 bits with it, and what is then one component in
    a bucket does not meet itself: only members of different components are compared. Pieces of bounded size meet
    in units, which a task walks in order, and a unit sends out a forest of its links, never the pairs."""
    nodes, known, units = _units(sigs, config)
    dealt = units.repartition(*UNIT).sortWithinPartitions(*UNIT)
    found = dealt.mapInArrow(functools.partial(_meet, distance=max_distance(config.threshold), ratio=config.max_ratio), "src string, dst string")
    same = sigs.join(nodes, ["sig", "size", "ext"]).where("path <> node").select(F.col("path").alias("src"), F.col("node").alias("dst"))
    return found.unionByName(known).unionByName(same)


def candidates(sigs: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """One row: the nodes, all their pairs, the pairs of nodes that meet in units, and the copies of nodes that are
    moved there."""
    if max_distance(config.threshold) <= WIDEST:
        count = sigs.select("ext", "sig", "size").distinct().agg(F.count("*").alias("nodes"))
        told = count.crossJoin(close_pairs(sigs, config))
        return told.select("nodes", F.expr("nodes * (nodes - 1) div 2").alias("all_pairs"), "pairs_met", "copies")
    nodes, _, units = _units(sigs, config)
    n = units.groupBy(*UNIT).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), F.first("kind").alias("k"))
    own = (F.col("kind") == 0) & (F.col("i") == F.col("j"))
    met = n.agg(F.coalesce(F.sum(F.when(own, (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") - 1) / 2).otherwise(F.col("a") * F.col("b"))), F.lit(0)).cast("long").alias("pairs_met"), F.coalesce(F.sum(F.col("a") + F.col("b")), F.lit(0)).alias("copies"))
    count = nodes.agg(F.count("*").alias("nodes"))
    both = count.withColumns({"pairs_met": F.lit(0).cast("long"), "copies": F.lit(0).cast("long")}).unionByName(met.withColumn("nodes", F.lit(0).cast("long")))
    total = both.agg(F.sum("nodes").alias("nodes"), F.sum("pairs_met").alias("pairs_met"), F.sum("copies").alias("copies"))
    return total.select("nodes", F.expr("nodes * (nodes - 1) div 2").alias("all_pairs"), "pairs_met", "copies")


def fuzzy_members(files: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """``(component, path, size, sig, similarity)``: the component is its smallest path, the similarity that to
    the component's representative, which chains may take below the threshold."""
    return members_of_signed(signatures(files, config), config)


def members_of_signed(sigs: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """``fuzzy_members`` of ``(path, size, ext, sig)`` rows."""
    bound_batches(sigs.sparkSession)
    sigs = cut(sigs)
    if max_distance(config.threshold) <= WIDEST:
        near = close_members(sigs, config, CROWD)
        return near.withColumn("similarity", similarity(hamming(F.col("sig"), F.col("head_sig"))))
    parts = connected_components(links(sigs, config)).select(F.col("node").alias("path"), "component")
    named = sigs.select("path", "size", "sig").join(parts, "path")
    heads = sigs.select(F.col("path").alias("component"), F.col("sig").alias("head_sig"))
    whole = having(named, ["component"], config.min_group).join(heads, "component")
    return whole.select("component", "path", "size", "sig", "head_sig", similarity(hamming(F.col("sig"), F.col("head_sig"))).alias("similarity"))


def fuzzy_groups(files: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Groups in long form. Components whose representatives have one signature share a key and are
    reported together; ``component`` tells them apart."""
    return _in_groups(fuzzy_members(files, config), config)


def groups_of_signed(signed: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """``fuzzy_groups`` of ``(path, size, sig)`` rows, as a scan with signatures gives them."""
    ext = extension(F.col("path")) if config.same_extension else F.lit("")
    rows = signed.where("sig is not null").select("path", "size", ext.alias("ext"), "sig")
    return _in_groups(members_of_signed(rows if config.max_candidates < 0 else rows.orderBy("path").limit(config.max_candidates), config), config)


def _in_groups(members: DataFrame, config: FuzzyConfig) -> DataFrame:
    members = members.withColumn("match_key", near_key(config.threshold, F.col("head_sig")))
    found = having(members, ["match_key"], config.min_group)
    return found.select(
        F.lit("fuzzy").alias("match_type"), "match_key", synthetic_digest("fuzzy", F.col("match_key")).alias("hash"), "duplicate_count", "path", F.col("size").alias("size_bytes"), "similarity", "component"
    )


def sorted_matches(members: DataFrame) -> DataFrame:
    """Files from the most to the least similar to their representative; paths settle ties."""
    return members.orderBy(F.desc("similarity"), "path")


def sorted_fuzzy_groups(groups: DataFrame) -> DataFrame:
    """Groups with most files first, then by key; a group's files by path."""
    return groups.orderBy(F.desc("duplicate_count"), "match_key", "component", "path")
