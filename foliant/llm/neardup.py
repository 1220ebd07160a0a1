"""Near-duplicate groups: SetSketch registers, banded; likelihood estimates; exact confirmation block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import compact, discard, lean, partitions_for, ship, sliced, stored, utf8
from foliant.llm.components import components
from foliant.llm.shingles import SetSketch, shingle_sets, word_digest

#: 32 bands of 4 registers: a pair at similarity 0.75 shares none with a probability of 5e-6.
BANDS, ROWS = 32, 4
#: Pairs whose likelihood estimate is below this aren't confirmed: more than five deviations under 0.75 with 128 registers.
LEAST_ESTIMATE = 0.55
#: Texts and bytes in a block at most (a longer text is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 128, 1 << 20
#: Meetings that one copy of a block serves; a block that more others meet is copied.
ROOM = 64

SKETCHES = "doc_id long, mark long, n_shingles long, digest binary, registers binary"
BLOCKS = "block long, reps array<long>, sizes array<long>, registers array<binary>, texts array<binary>"


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text) to SKETCHES. Texts without words have no digest and no registers."""
    sketch = SetSketch(BANDS * ROWS)
    lean()
    for batch in batches:
        for lo, texts in sliced(utf8(batch.column(2))):
            sets = shingle_sets(texts)
            registers = sketch.registers(sets)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, len(texts)).cast(pa.int64()),
                    batch.column(1).slice(lo, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([word_digest(t) if f else None for t, f in zip(texts, full)], pa.binary()),
                    pa.array([r.tobytes() if f else None for r, f in zip(registers, full)], pa.binary()),
                ],
                names=["doc_id", "mark", "n_shingles", "digest", "registers"],
            )


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """(rep, n_shingles, registers, text), in label order, to rows of up to so many texts."""
    from pyspark import TaskContext

    lean()
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        cols = [list(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + n], pa.int64()), pa.array([cols[0]], pa.list_(pa.int64())), pa.array([cols[1]], pa.list_(pa.int64())), pa.array([cols[2]], pa.list_(pa.binary())), pa.array([cols[3]], pa.list_(pa.binary()))],
            names=["block", "reps", "sizes", "registers", "texts"],
        )

    for batch in batches:
        for rep, k, reg, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3))):
            if held and (len(held) >= most or size + len(text) > BLOCK_BYTES):
                yield row()
                n, held, size = n + 1, [], 0
            held.append((rep, k, reg, text))
            size += len(text)
    if held:
        yield row()


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of a with those of b, by products over slices of their common vocabulary."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    if not a or not b:
        return out
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b)]
    place = [np.searchsorted(both, x) for x in (left, right)]
    for p, x in zip(place, (left, right)):
        p[p == len(both)] = 0
        if len(both):
            p[both[p] != x] = -1
        else:
            p[:] = -1
    order = [np.argsort(p, kind="stable") for p in place]
    sorted_places = [p[o] for p, o in zip(place, order)]
    width = 4096
    for lo in range(0, len(both), width):
        dense = []
        for s, o, r, n in zip(sorted_places, order, rows, (len(a), len(b))):
            i, j = np.searchsorted(s, [lo, lo + width])
            m = np.zeros((n, min(width, len(both) - lo)), dtype=np.float32)
            m[r[o[i:j]], s[i:j] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)  # whole numbers up to width, exact in 32 bits
    return out


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks' sizes, registers and components to their pairs (i, j: places in the blocks) of texts in different components
    that may be linked, by size ratio, equal registers and likelihood."""
    lean()
    sketch = SetSketch(BANDS * ROWS)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        out = []
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            one = row["block"] == row["block_b"]
            sizes, sizes_b = np.array(row["sizes"]), np.array(row["sizes" if one else "sizes_b"])
            regs, regs_b = (np.array([np.frombuffer(x, dtype=np.uint16) for x in row[c]]) for c in ("registers", "registers" if one else "registers_b"))
            i, j = np.triu_indices(len(sizes), 1) if one else (x.ravel() for x in np.meshgrid(np.arange(len(sizes)), np.arange(len(sizes_b)), indexing="ij"))
            comps, comps_b = np.array(row["comps"]), np.array(row["comps" if one else "comps_b"])
            near = (4 * np.minimum(sizes[i], sizes_b[j]) >= 3 * np.maximum(sizes[i], sizes_b[j])) & (comps[i] != comps_b[j])
            i, j = i[near], j[near]
            equal = np.concatenate([(regs[i[k : k + 4096]] == regs_b[j[k : k + 4096]]).sum(1) for k in range(0, len(i), 4096)] or [np.zeros(0)])
            near = equal >= 0.4 * sketch.m
            i, j = i[near], j[near]
            guess = np.concatenate([sketch.similarity(regs[i[k : k + 2048]], regs_b[j[k : k + 2048]], sizes[i[k : k + 2048]], sizes_b[j[k : k + 2048]]) for k in range(0, len(i), 2048)] or [np.zeros(0)])
            near = guess >= LEAST_ESTIMATE
            if near.any():
                out.append((row["block"], row["block_b"], row["room"], row["room_b"], i[near].astype(np.int32), j[near].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=["block", "block_b", "room", "room_b", "i", "j"])


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks and their candidates to links (u, v) that join, within them, what is linked: at most one for each text."""
    lean()
    for batch in batches:
        us, vs = [], []
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            one = row["block"] == row["block_b"]
            mid = 0 if one else len(row["reps"])
            reps = row["reps"] if one else row["reps"] + row["reps_b"]
            sizes = np.array(row["sizes"] if one else row["sizes"] + row["sizes_b"])
            texts = row["texts"] if one else row["texts"] + row["texts_b"]
            i, j = np.array(row["i"]), np.array(row["j"]) + mid
            need = np.unique(np.concatenate([i, j]))
            sets = dict(zip(need.tolist(), shingle_sets([texts[k] for k in need])))
            li, lj = np.unique(i), np.unique(j)
            shared = _intersections([sets[k] for k in li.tolist()], [sets[k] for k in lj.tolist()])
            inter = shared[np.searchsorted(li, i), np.searchsorted(lj, j)]
            union = sizes[i] + sizes[j] - inter
            linked = 100 * inter >= 75 * union
            root = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            for x, y in zip(i[linked].tolist(), j[linked].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    us.append(reps[x])
                    vs.append(reps[y])
                    root[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def band_keys(registers: Column) -> list[Column]:
    """One hash for each band, of its number and its registers' bytes."""
    return [F.xxhash64(F.lit(i), F.substring(registers, 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)]


def _copied(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (block, block_b) with room and room_b, the copy of each block that a meeting uses, and (block, rooms) of the blocks with several copies."""
    ends = ids.where("block <> block_b").select(F.explode(F.array("block", "block_b")).alias("block"))
    busy = ends.groupBy("block").agg(F.floor(F.count("*") / ROOM).cast("int").alias("rooms")).where("rooms > 0")
    room = lambda other: F.when(F.col("block") == F.col("block_b"), 0).otherwise(F.pmod(F.xxhash64(other), F.coalesce("rooms", F.lit(0)) + 1)).cast("int")
    left = ids.join(busy, "block", "left").withColumn("room", room("block_b")).drop("rooms")
    right = left.join(busy.withColumnRenamed("block", "block_b"), "block_b", "left").withColumn("room_b", room("block"))
    return right.select("block", "block_b", "room", "room_b"), busy


def _meet(ids: DataFrame, packs: DataFrame, busy: DataFrame) -> DataFrame:
    """ids (block, block_b, room, room_b) with the columns of packs of both blocks, the second's with _b: null where it is the first."""
    copies = packs.join(busy, "block", "left").withColumn("room", F.explode(F.sequence(F.lit(0), F.coalesce("rooms", F.lit(0))))).drop("rooms")
    others = copies.select(*[F.col(c).alias(f"{c}_b") for c in copies.columns])
    own = ids.where("block = block_b").join(packs, "block")
    own = own.select("*", *[F.lit(None).cast(packs.schema[c].dataType).alias(f"{c}_b") for c in packs.columns if c != "block"])
    return own.unionByName(ids.where("block <> block_b").join(copies, ["block", "room"]).join(others, ["block_b", "room_b"]))


def _compared(ids: DataFrame, packs: DataFrame, comps: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """Links (u, v) between the texts of ids' pairs of blocks that are in different components by comps (block, comps), and a scratch table that they read."""
    ids, busy = _copied(ids)
    two = lambda *names: [n for c in names for n in (c, f"{c}_b")]
    marks = packs.select("block", "sizes", "registers").join(comps, "block")
    likely = _meet(ids, marks, busy).select(*two("block", "room", "sizes", "registers", "comps"))
    likely, at = stored(likely.mapInArrow(candidates, "block long, block_b long, room int, room_b int, i array<int>, j array<int>"), "candidates", parts)
    both = _meet(likely, packs.select("block", "reps", "sizes", "texts"), busy).select("i", "j", *two("block", "reps", "sizes", "texts"))
    return both.mapInArrow(confirm, "u long, v long"), at


def near_duplicates(docs: DataFrame, label_rounds: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Texts of equal word sequences are one class; classes that share a band of registers meet in blocks of texts ordered by
    the least class they can reach over shared bands. Block pairs are compared by sizes and registers alone, after the size
    ratio and the likelihood estimate; only those with candidates get their texts, for confirmation on full shingle sets.
    What leaves a block pair are links that join its classes. First each block meets itself and two blocks of each of its
    bands, which joins a group of near copies in as many meetings as it has blocks. What then shares a band and is still in
    different components meets block by block; texts of one component needn't.

    A null or wordless text has an empty set and is linked with nothing; a row without doc_id can't name or join a group,
    so its component is null and it is kept. Rows that repeat a doc_id are one node: their texts' classes are linked. An empty
    table gives an empty one; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    parts = partitions_for(docs)
    table, _ = stored(compact(docs).mapInArrow(sketches, SKETCHES), "sketches")
    named = table.where("doc_id is not null and digest is not null")
    classes, _ = stored(named.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes", parts)
    reps = named.join(classes, [named.digest == classes.digest, named.doc_id == classes.rep], "left_semi").dropDuplicates(["doc_id", "digest"])
    # a doc_id of several texts stands for several classes of that number: the link is by number anyway
    banded = reps.select(F.col("doc_id").alias("rep"), F.explode(F.array(*band_keys(F.col("registers")))).alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    members, members_at = stored(banded.join(buckets, "band").select("band", "rep", "least"), "members", parts)
    labels, old = members.groupBy("rep").agg(F.min("least").alias("label")), []
    for _ in range(label_rounds - 1):
        labels, at = stored(labels, "labels", parts)
        old.append(at)
        low = members.join(labels, "rep").groupBy("band").agg(F.min("label").alias("low"))
        labels = members.join(low, "band").groupBy("rep").agg(F.min("low").alias("label"))
    labels, labels_at = stored(labels, "labels", parts)
    discard(spark, *old)
    chosen = reps.select("doc_id", "mark", "n_shingles", "registers").join(labels, F.col("doc_id") == F.col("rep"))
    wanted = docs.join(chosen, ["doc_id", "mark"])
    ordered = wanted.repartitionByRange("label", "rep").sortWithinPartitions("label", "rep").select("rep", "n_shingles", "registers", "text")
    packs, packs_at = stored(ordered.mapInArrow(lambda batches: blocks(batches, block_rows), BLOCKS), "blocks")
    home = packs.select("block", F.posexplode("reps").alias("seat", "rep"))
    seats = members.select("band", "rep").join(home, "rep").select("band", "block").distinct()
    # every block with itself, with the first block of each of its bands and with one drawn by hash: a number linear in the seats
    hubs = seats.groupBy("band").agg(F.min("block").alias("hub"), F.max("block").alias("most"), F.min_by("block", F.xxhash64("block", "band")).alias("drawn")).where("hub <> most")
    spokes = seats.join(hubs, "band").select("block", F.explode(F.array("hub", "drawn")).alias("hub"))
    pair = lambda a, b: [F.least(a, b).alias("block"), F.greatest(a, b).alias("block_b")]
    first = packs.select("block", F.col("block").alias("block_b")).union(spokes.where("block <> hub").select(*pair("block", "hub")).distinct())
    first, first_at = stored(first, "meetings", parts)
    owned = named.join(classes, "digest").select("doc_id", "rep")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    same = owned.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found_links, likely_at = _compared(first, packs, packs.select("block", F.col("reps").alias("comps")), parts)
    links, links_at = stored(found_links.union(same), "links", parts)
    joined, joined_at = components(links, parts)
    discard(spark, links_at, likely_at, labels_at)
    # a band whose texts are all in one component is done; in the others, blocks meet that hold texts of different components
    placed = home.join(joined, F.col("rep") == F.col("node"), "left").select("block", "seat", "rep", F.coalesce("component", "rep").alias("comp"))
    sides = members.select("band", "rep").join(placed, "rep").groupBy("band", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    undone = sides.groupBy("band").agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.count("*").alias("n")).where("low <> high and n > 1")
    wide = sides.join(undone.select("band"), "band", "left_semi")
    a, b = wide.alias("a"), wide.alias("b")
    differ = F.least("a.lo", "b.lo") != F.greatest("a.hi", "b.hi")
    rest = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.block") < F.col("b.block")) & differ).select(F.col("a.block").alias("block"), F.col("b.block").alias("block_b"))
    rest, rest_at = stored(rest.distinct().join(first, ["block", "block_b"], "left_anti"), "meetings", parts)
    if not rest.isEmpty():
        comps = placed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("seat", "comp"))), lambda x: x["comp"]).alias("comps"))
        found_links, likely_at = _compared(rest, packs, comps, parts)
        known = joined.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        links, links_at = stored(found_links.union(known), "links", parts)
        discard(spark, joined_at, likely_at)
        joined, _ = components(links, parts)
        discard(spark, links_at)
    discard(spark, members_at, packs_at, first_at, rest_at)
    found = table.join(classes, "digest", "left").join(joined, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
