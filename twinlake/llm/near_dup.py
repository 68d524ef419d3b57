"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and components."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.llm import textscan
from twinlake.llm.wordtable import give_back
from twinlake.operators.components import connected_components
from twinlake.operators.keyfilter import marked_rows, without
from twinlake.session import bound_batches

WORDS = 5
PERCENT = 85
#: Slots a band, bands. At a similarity of 0.85 a pair shares no band with probability (1-0.85^6)^26, under 5e-6.
SLOTS, BANDS = 6, 26
BITS = 10
#: Pairs whose signatures agree in a smaller share of slots are not compared on full sets: 4.5 standard
#: deviations of a MinHash estimate below the threshold (SuperMinHash estimates vary less).
LEAST_SHARE = PERCENT / 100 - 4.5 * (PERCENT / 100 * (1 - PERCENT / 100) / (SLOTS * BANDS)) ** 0.5
#: Members of a bucket that meet in one piece of work, a side.
PIECE = 512

u64 = np.uint64


def shingle_sets(values: np.ndarray, offsets: np.ndarray, width: int = WORDS, key: int = 0) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles; a shorter row is one shingle."""
    starts, ends, at = textscan.words(values, offsets, "blank")
    hashes = textscan.lower_hashes(values, starts, ends, key)
    chain = np.zeros(max(0, len(hashes) - width + 1), u64)
    for k in range(width):
        chain = textscan.mix(chain + hashes[k : k + len(chain)])
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(chain[a : b - width + 1]))
        elif b > a:
            x = textscan.mix(np.array([b - a], u64))
            for k in range(a, b):
                x = textscan.mix(x + hashes[k])
            out.append(x)
        else:
            out.append(np.zeros(0, u64))
    return out


def superminhash(sets: list[np.ndarray], slots: int, most: int = 1 << 17) -> np.ndarray:
    """The SuperMinHash (Ertl, 2017) signature of each set, a row of ``slots`` 64-bit values.

    Every element has a random permutation of the slots; its value at the slot of rank j is j plus a random
    fraction, and a slot keeps the smallest value. All elements go rank by rank; as values of rank j
    exceed those of smaller ranks, a set whose slots are all filled stops there. About ``most`` elements
    go at once; a larger set is the slotwise minimum of its parts.
    """
    out = np.full((len(sets), slots), np.iinfo(u64).max, u64)
    owners, parts, held = [], [], 0
    for k, s in enumerate(sets):
        for a in range(0, len(s), most):
            owners.append(k)
            parts.append(s[a : a + most])
            held += len(parts[-1])
            if held >= most:
                np.minimum.at(out, owners, _signatures(parts, slots))
                owners, parts, held = [], [], 0
    if parts:
        np.minimum.at(out, owners, _signatures(parts, slots))
    return out


def _signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    n = len(sets)
    best = np.full(n * slots, np.iinfo(u64).max, u64)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    ranks = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(items), 1))
    rows = np.arange(len(items))
    for j in range(slots):
        if not len(items):
            break
        draw = textscan.mix(items + u64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (((draw >> u64(32)) * u64(slots - j)) >> u64(32)).astype(np.int64)
        slot = ranks[rows, k]
        ranks[rows, k] = ranks[rows, j]
        np.minimum.at(best, owner * slots + slot, (u64(j) << u64(32)) | (draw & u64(0xFFFFFFFF)))
        if j < 8 or j % 4 == 3:
            open_sets = (best.reshape(n, slots) == np.iinfo(u64).max).any(axis=1)
            stay = open_sets[owner]
            if not stay.all():
                items, owner, ranks = items[stay], owner[stay], ranks[stay]
                rows = np.arange(len(items))
    return best.reshape(n, slots)


def band_words(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit word a band, with ``BITS`` bits of each of its slots."""
    bits = (textscan.mix(signatures) & u64((1 << BITS) - 1)).reshape(len(signatures), BANDS, SLOTS)
    return (bits << (np.arange(SLOTS, dtype=u64) * u64(BITS))).sum(axis=2, dtype=u64)


def shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots of pairs of signatures (rows of band words)."""
    x = a ^ b
    equal = sum(((x >> u64(k * BITS)) & u64((1 << BITS) - 1)) == 0 for k in range(SLOTS))
    return equal.sum(axis=1) / (SLOTS * BANDS)


def _words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), u64).reshape(len(column), BANDS)


def set_keys(sets: list[np.ndarray]) -> pa.Array:
    """128 bits for each set: two sums of differently scrambled elements, whatever their order."""
    sums = [(textscan.mix(s).sum(dtype=u64) + u64(len(s)), textscan.mix(s ^ u64(0xA5A5A5A5A5A5A5A5)).sum(dtype=u64)) for s in sets]
    return pa.array([np.array(x, u64).tobytes() for x in sums], pa.binary())


def _describe(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, values, offsets in textscan.byte_chunks(batch.column("text")):
            sets = shingle_sets(values, offsets, key=key)
            words = band_words(superminhash(sets, SLOTS * BANDS))
            same = [batch.column(c).slice(a, b - a) for c in ("doc_id", "mark", "print")]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array([len(s) for s in sets], pa.int64()), set_keys(sets), pa.array([w.tobytes() for w in words], pa.binary())],
                names=["doc_id", "mark", "print", "n_shingles", "class", "words"],
            )
    give_back()


def _sets(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, values, offsets in textscan.byte_chunks(batch.column("text")):
            sets = shingle_sets(values, offsets, key=key)
            yield pa.RecordBatch.from_arrays([set_keys(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "items"])
    give_back()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= ``PERCENT`` * union."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_buffer(), u64), np.frombuffer(y.as_buffer(), u64)) for x, y in zip(batch.column("a_items"), batch.column("b_items"))]
        yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))


UNIT = ["band", "word", "kind", "i", "j"]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units of work from rows sorted by unit, and the unit's number of each row."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
        if held is None or not held.num_rows:
            continue
        key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in UNIT], axis=1)
        fresh = (key[1:] != key[:-1]).any(axis=1)
        heads = np.flatnonzero(fresh) + 1
        end = held.num_rows if batch is None else int(heads[-1]) if len(heads) else 0
        if end:
            yield held.slice(0, end).combine_chunks(), np.append(0, np.cumsum(fresh))[:end]
            held = held.slice(end).combine_chunks()
    give_back()


def _likely_pairs(table: pa.Table, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a unit, and their share of equal slots: those from different components and, but for
    a piece's own members, from different sides, that are likely by their signatures and whose first common band
    is that of the unit."""
    words = _words_of(table.column("words").combine_chunks())
    comp = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    side, size, band = (table.column(c).to_numpy() for c in ("side", "n_shingles", "band"))
    own = (table.column("kind").to_numpy() == 1) & (table.column("i").to_numpy() == table.column("j").to_numpy())
    left, right, close = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    rows, d = np.arange(len(unit)), 1
    while len(rows := rows[rows + d < len(unit)]) and len(rows := rows[unit[rows] == unit[rows + d]]):
        other = rows + d
        low, high = np.minimum(size[rows], size[other]), np.maximum(size[rows], size[other])
        ok = (comp[rows] != comp[other]) & (own[rows] | (side[rows] != side[other])) & (100 * low >= PERCENT * high)
        p, q = rows[ok], other[ok]
        if len(p):
            first = (words[p] == words[q]).argmax(axis=1) == band[p]
            p, q = p[first], q[first]
            share = shares(words[p], words[q])
            good = share >= LEAST_SHARE
            left.append(p[good])
            right.append(q[good])
            close.append(share[good])
        d += 1
    return np.concatenate(left), np.concatenate(right), np.concatenate(close)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row that is not of its bucket's largest component, its most similar partner in the unit."""
    for table, unit in _units(batches):
        p, q, share = _likely_pairs(table, unit)
        major = (table.column("kind").to_numpy() == 0) & table.column("side").to_numpy()
        ends, others, share = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([share, share])
        some = np.flatnonzero(~major[ends])
        order = some[np.lexsort((others[some], -share[some], ends[some]))]
        order = order[np.append(True, ends[order][1:] != ends[order][:-1])[: len(order)]]
        member = table.column("class")
        yield pa.RecordBatch.from_arrays([member.take(pa.array(ends[order])).combine_chunks(), member.take(pa.array(others[order])).combine_chunks(), pa.array(share[order])], names=["src", "dst", "share"])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a likely partner in their unit."""
    for table, unit in _units(batches):
        p, q, _ = _likely_pairs(table, unit)
        yield from table.take(pa.array(np.unique(np.concatenate([p, q])))).to_batches()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of full sets between components, the most likely pairs first, until none is left to be found: a
    forest of the components of each table."""
    for table, unit in _units(batches):
        p, q, share = _likely_pairs(table, unit)
        comp = table.column("component").combine_chunks().dictionary_encode().indices.to_pylist()
        items, parent, found = table.column("items"), {}, []

        def find(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = parent.get(up, up)
                k = up
            return k

        for k in np.argsort(-share, kind="stable").tolist():
            x, y = int(p[k]), int(q[k])
            a, b = find(comp[x]), find(comp[y])
            if a != b and similar(np.frombuffer(items[x].as_buffer(), u64), np.frombuffer(items[y].as_buffer(), u64)):
                parent[a] = b
                found.append(k)
        member = table.column("class")
        yield pa.RecordBatch.from_arrays([member.take(pa.array(x[found])).combine_chunks() for x in (p, q)], names=["src", "dst"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Documents are linked when their sets of distinct 5-word shingles (A-Z lower-cased; a shorter text is
    one shingle) have 100 * intersection >= 85 * union. ``component_id`` is the smallest id reachable over
    links, ``kept`` whether that is the row's own. Null and wordless texts have no shingles and are
    linked with nothing. A row without an id is linked with nothing and stays, with a null component.
    Rows that repeat an id are separate rows. Texts of any length are read whole, a large set's signature part by part.
    Other columns are not read; no rows give no rows.

    Words are hashed under a key that is drawn for the run, so no text can be written to share shingles with another
    by its hashes. Rows with equal sets (by 128 bits of their shingles' hashes, and their size) are one class from the
    start.
    Classes that share a band of their SuperMinHash signatures are candidates. In three rounds, each followed
    by the components of all links so far: each class and the one that is first in most of its buckets; each
    class outside the largest component of a bucket and its most similar partner there; then, in buckets that
    still hold several components, all likely pairs between them. Pairs of the first two rounds, one a class,
    are joined with both full sets; in the last round the sets of members that have a likely pair come to the
    bucket, and pairs are confirmed there until what is left is one component. Members of the largest
    component meet the others but not each other, in pieces of bounded size, so a bucket of any size neither
    lands in one task nor gives out its pairs, and no link between components is passed over.
    """
    return _grouped(docs, id_col, text_col, F.lit("")).drop("mark")


def _units_of(members: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets with several components, dealt and sorted by units of work: pieces of the largest
    component with pieces of the others (kind 0), and pairs of pieces of the others (kind 1)."""
    placed = members.join(parts, "class")
    counts = placed.groupBy("band", "word", "component").agg(F.count("*").alias("n"))
    info = counts.groupBy("band", "word").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("c")).where("c > 1")
    pieces = lambda n: F.ceil(n / PIECE).cast("int")
    info = info.select("band", "word", F.col("top.component").alias("major"), pieces(F.col("top.n")).alias("majors"), pieces(F.col("all") - F.col("top.n")).alias("minors"))
    is_major = F.col("component") == F.col("major")
    rest = placed.join(info, ["band", "word"]).join(classes.select("class", "n_shingles", "words"), "class")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("class"), F.when(is_major, F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    mine, zero = F.col("mine"), F.lit(0)
    unit = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    minors, majors = (F.sequence(zero, F.col(c) - 1) for c in ("minors", "majors"))
    with_others = F.transform(minors, lambda x: unit(0, x, mine, F.lit(True)))
    with_major = F.transform(majors, lambda x: unit(0, mine, x, F.lit(False)))
    among = F.transform(minors, lambda x: unit(1, F.least(mine, x), F.greatest(mine, x), mine <= x))
    spread = rest.withColumn("unit", F.explode(F.when(is_major, with_others).otherwise(F.concat(with_major, among))))
    work = spread.select("band", "word", "unit.*", "class", "component", "n_shingles", "words")
    return work.repartition(*UNIT).sortWithinPartitions(*UNIT)


def _grouped(docs: DataFrame, id_col: str, text_col: str, mark: Column) -> DataFrame:
    """``near_duplicates`` with a further text column, that of each row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), mark.alias("mark")).withColumn("print", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    key = textscan.secret_key()
    described = cut(rows.mapInArrow(functools.partial(_describe, key=key), f"doc_id {kind}, mark string, print long, n_shingles long, class binary, words binary"))
    filled = described.where("n_shingles > 0 and doc_id is not null")
    classes = cut(filled.groupBy("class", "n_shingles").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.min("words").alias("words")))
    banded = classes.select("class", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("words", k * 8 + 1, F.lit(8)))).alias("band", "word"))
    banded = banded.select("class", "band", F.xxhash64("word").alias("word"))
    buckets = banded.groupBy("band", "word").agg(F.min("class").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = cut(banded.join(buckets, ["band", "word"]))
    members, nodes = found.drop("head"), found.select("class").distinct()

    # texts stay where they are read: those of a class's first row are told by a filter, and give out its set
    wanted = nodes.join(classes, "class").select("first.doc_id", "first.print")
    some = marked_rows(rows.select("doc_id", "print", "text"), wanted, ["doc_id", "print"])
    sets = some.select("text").mapInArrow(functools.partial(_sets, key=key), "class binary, items binary")
    sets = cut(sets.join(nodes, "class", "left_semi").groupBy("class").agg(F.first("items").alias("items")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("class").alias(k), F.col("items").alias(f"{n}_items")) for k, n in (("src", "a"), ("dst", "b")))
        return cut(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a_items", "b_items").mapInArrow(_confirm, "src binary, dst binary"))

    def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
        a, b = (parts.select(F.col("class").alias(k), F.col("component").alias(n)) for k, n in (("src", "a"), ("dst", "b")))
        joined = connected_components(links.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("lower"))
        return cut(parts.join(joined, "component", "left").select("class", F.coalesce("lower", "component").alias("component")))

    parts = nodes.select("class", F.col("class").alias("component"))
    heads = found.where("class <> head").groupBy("class", "head").agg(F.count("*").alias("n"))
    stars = heads.groupBy("class").agg(F.max(F.struct("n", "head")).alias("top")).select(F.col("class").alias("src"), F.col("top.head").alias("dst"))
    parts = merged(parts, confirmed(stars))
    nearest = _units_of(members, parts, classes).mapInArrow(_nearest, "src binary, dst binary, share double")
    nearest = nearest.groupBy("src").agg(F.max(F.struct("share", "dst")).alias("top")).select("src", F.col("top.dst").alias("dst"))
    parts = merged(parts, confirmed(nearest))
    work = _units_of(members, parts, classes)
    left = cut(work.mapInArrow(_needed, work.schema))
    if not left.isEmpty():
        dealt = left.join(sets, "class").repartition(*UNIT).sortWithinPartitions(*UNIT)
        parts = merged(parts, cut(dealt.mapInArrow(_verified, "src binary, dst binary")))

    ids = classes.select("class", F.col("first.doc_id").alias("first_id"))
    placed = parts.join(ids, "class")
    least = placed.groupBy("component").agg(F.min("first_id").alias("least_id"))
    placed = placed.join(least, "component").select("class", "least_id")
    names = ids.join(placed, "class", "left").select("class", F.coalesce("least_id", "first_id").alias("component_id"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = described.select("doc_id", "mark", "n_shingles", "class")
    some = out.where(linked).join(names, "class").select("doc_id", "mark", "n_shingles", "component_id")
    alone = out.where(~linked).select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns. Of rows that share
    an id, those go whose texts go."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    gone = _grouped(docs, id_col, text_col, digest).where(~F.col("kept"))
    return without(docs, gone, {"doc_id": F.col(id_col), "mark": digest})


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d),
n AS (SELECT doc_id, len(x) AS n FROM s),
f AS (SELECT doc_id, unnest(x) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS k, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.k WHERE r.c < u.b),
m AS (SELECT k, min(c) AS component_id FROM r GROUP BY k)
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept FROM n JOIN m ON m.k = doc_id
"""
