"""Signatures of minima of seeded hashes over character shingles, and their agreement."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import normalize
from foliant.storage import stored

HASHES, SHINGLE, BANDS = 128, 5, 16
#: Texts of fewer characters have no signature.
LEAST_CHARS = 20
#: A worker remembers the hashes of so many pieces at most (16 bytes each).
REMEMBERED = 1 << 20
#: Members of a bucket, and classes of a block, that one task compares at once; larger ones are dealt into pairs of parts.
BUCKET, BLOCK = 1024, 128


def signature(text: Column, n: int = HASHES, k: int = SHINGLE) -> Column:
    """n minima as longs of the same bits; null for a text of fewer than LEAST_CHARS characters, all ones for an empty normal form.

    Arrow batches. The functions are nested so that workers need no copy of this package."""

    def first_eight(piece: str) -> int:
        return int.from_bytes(hashlib.sha256(piece.encode()).digest()[:8], "little")

    seeds = np.array([first_eight(f"minhash-seed-{i}") for i in range(n)], dtype=np.uint64)
    # seeds by their first bits: the least of hash ^ seed is among the hashes with the seed's first bits, if there are any
    first_bits = [[np.flatnonzero(seeds >> np.uint64(64 - bits) == np.uint64(x)) for x in range(1 << bits)] for bits in range(1, 7)]
    held: list[np.ndarray] = []  # pieces of characters below 4096 as keys, and their hashes, by slot

    def minima_of(hashes: np.ndarray) -> np.ndarray:
        out = np.empty(n, dtype=np.uint64)
        bits = min(6, len(hashes).bit_length() - 7)
        if bits < 1:
            return (seeds[:, None] ^ hashes).min(axis=1)
        ends = [*np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(hashes)]
        for x, some in enumerate(first_bits[bits - 1]):
            if len(some):
                part = hashes[ends[x] : ends[x + 1]] if ends[x] < ends[x + 1] else hashes
                for lo in range(0, len(part), 1 << 16):
                    low = (seeds[some, None] ^ part[lo : lo + (1 << 16)]).min(axis=1)
                    out[some] = low if lo == 0 else np.minimum(out[some], low)
        return out

    def hashes_of(normal: str) -> np.ndarray:
        """The distinct hashes of the pieces of k characters, ascending."""
        if len(normal) < k or 12 * k > 63:
            pieces = {normal[i : i + k] for i in range(max(1, len(normal) - k + 1))}
            return np.unique(np.fromiter(map(first_eight, pieces), dtype=np.uint64, count=len(pieces)))
        chars = np.frombuffer(normal.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        count = len(chars) - k + 1
        keys, high = np.zeros(count, dtype=np.uint64), None
        for i in range(k):
            keys = (keys << np.uint64(12)) | chars[i : i + count]
        if (chars >= 4096).any():
            wide = np.concatenate([[0], np.cumsum(chars >= 4096)])
            high = wide[k:] > wide[:-k]
        if not held:
            held.extend((np.full(REMEMBERED, 2**64 - 1, dtype=np.uint64), np.zeros(REMEMBERED, dtype=np.uint64)))
        slots = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % REMEMBERED
        found, known = held[1][slots], held[0][slots] == keys
        new = np.flatnonzero(~known if high is None else ~known & ~high)
        if len(new):
            _, at, back = np.unique(keys[new], return_index=True, return_inverse=True)
            made = np.fromiter((first_eight(normal[i : i + k]) for i in new[at].tolist()), dtype=np.uint64, count=len(at))
            found[new] = made[back]
            held[0][slots[new]], held[1][slots[new]] = keys[new], found[new]
        if high is not None:
            far = {normal[i : i + k] for i in np.flatnonzero(high).tolist()}
            found = np.concatenate([found[~high], np.fromiter(map(first_eight, far), dtype=np.uint64, count=len(far))])
        found.sort()
        return found[np.concatenate([[True], found[1:] != found[:-1]])]

    def minima(normal: str) -> np.ndarray:
        return (minima_of(hashes_of(normal)) if normal else np.full(n, 2**64 - 1, dtype=np.uint64)).view(np.int64)

    def signatures(normal: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else minima(t) for t in normal], dtype=object)

    # LEAST_CHARS between the first and the last character that is no white space, without a copy of the text
    return F.pandas_udf(signatures, "array<long>")(F.when(text.rlike(rf"(?Us)\S.{{{LEAST_CHARS - 2},}}?\S"), normalize(text)))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places; 0 where lengths differ or are 0."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)).otherwise(F.lit(0.0))


def near_pairs(signed: DataFrame, threshold: float, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """From (id, signature): pairs (a, b, similarity) of classes that share a band and agree in at least threshold, and (id, class).

    Ids of equal signatures are one class, named by the least: a group of copies makes no pairs within itself."""
    usable = signed.where("signature is not null")
    least = usable.groupBy("signature").agg(F.min("id").alias("class"))
    members = usable.join(least, "signature").select("id", "class")
    rows = F.floor(F.size("signature") / bands).cast("int")
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", (i * rows + 1).cast("int"), rows)))
    seated = least.where(F.size("signature") >= bands).select("class", F.explode(band).alias("band"))
    x, y = seated.alias("x"), seated.alias("y")
    meet = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.class") < F.col("y.class"))).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    left, right = least.select(F.col("class").alias("a"), F.col("signature").alias("_a")), least.select(F.col("class").alias("b"), F.col("signature").alias("_b"))
    judged = meet.join(left, "a").join(right, "b").select("a", "b", agreement(F.col("_a"), F.col("_b")).alias("similarity"))
    return judged.where(F.col("similarity") >= threshold), members


def all_pairs(signed: DataFrame, threshold: float, n: int = HASHES) -> tuple[DataFrame, DataFrame]:
    """near_pairs that misses none, for signatures of n places (others are in no pair).

    With one band more than places that may differ, over all places, a pair that agrees enough shares a whole band. A class
    goes to a bucket of each band with two bits of each place, which show a difference of a place three times of four: a pair
    that shows more differences than may be is dropped there, and of the rest only the first band that it shares emits it.
    What is left is judged by the whole signatures, which are sent to blocks of linked classes, not to each pair."""
    most = n - next((e for e in range(1, n) if e / n >= threshold), n)
    usable = signed.where("signature is not null")
    least, _ = stored(usable.groupBy("signature").agg(F.min("id").alias("class")), "signature-classes")
    members = usable.join(least, "signature").select("id", "class")
    met, _ = stored(_meetings(least.where(F.size("signature") == n), n, most), "signature-meetings")
    return _judged(met, least, n, threshold), members


def _whole_cells():
    """A function that joins and cuts sorted batches so that no cell (a value of the first `by` columns) is in two, each of so many rows or a cell more."""

    def whole(batches, by: int, rows: int):
        import pyarrow as pa

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                last = np.logical_or.reduce([(c := table.column(i).to_numpy())[1:] != c[:-1] for i in range(by)])
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut:
                    yield table.slice(0, cut).combine_chunks()
                held = table.slice(cut).combine_chunks().to_batches()
                count = table.num_rows - cut if cut else 0  # one cell: look again after as many rows
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    return whole


def _meetings(least: DataFrame, n: int, most: int) -> DataFrame:
    """a < b of classes that share a band and may differ in at most so many places; each pair once."""
    import pyarrow as pa

    edges = [n * i // (most + 1) for i in range(most + 2)]
    kind = least.schema["class"].dataType.simpleString()

    def described(batches):
        """class, bands (16 bits each), bits (two of each place)."""
        for batch in batches:
            values = batch.column("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n)
            mixed = values * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            bands = np.zeros((len(values), len(edges) - 1), dtype=np.uint64)
            for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                for p in range(lo, hi):
                    bands[:, i] = (bands[:, i] ^ mixed[:, p]) * np.uint64(0xBF58476D1CE4E5B9)
                    bands[:, i] ^= bands[:, i] >> np.uint64(29)
            packed = [np.packbits((mixed >> np.uint64(b)).astype(np.uint8) & 1, axis=1) for b in (0, 1)]
            packed = np.concatenate([np.pad(x, ((0, 0), (0, -x.shape[1] % 8))) for x in packed], axis=1)
            tags = (bands >> np.uint64(40)).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([x.tobytes() for x in tags], pa.binary()), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(list(tags.astype(np.int32) + (np.arange(len(edges) - 1, dtype=np.int32) << 16)), pa.list_(pa.int32()))], ["class", "bands", "bits", "buckets"])

    known, _ = stored(least.select("class", "signature").mapInArrow(described, f"class {kind}, bands binary, bits binary, buckets array<int>"), "signature-bands")
    seats = known.select("class", "bands", "bits", F.explode("buckets").alias("bucket"))
    seats = seats.withColumn("bands", F.expr("substring(bands, 1, 2 * (bucket >> 16))"))  # those before this one
    large = known.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts")).where("parts > 1")
    part = seats.join(F.broadcast(large), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    dealt = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("class", "bands", "bits", "bucket", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    whole, words = _whole_cells(), -(-n // 64)

    def compared(batches):
        for table in whole(batches, 3, 1 << 16):
            rows, names = table.num_rows, table.column("class").combine_chunks()
            bucket, low, high, part = (table.column(x).to_numpy() for x in ("bucket", "low", "high", "part"))
            group = np.cumsum(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(rows, 2 * words)
            bands = np.frombuffer(b"".join(x.ljust(2 * (most + 1), b"\0") for x in table.column("bands").to_pylist()), dtype="<u2").reshape(rows, -1)
            i, step, found, size = np.arange(rows), 0, [], 0
            while True:
                step += 1
                i = i[i < rows - step]
                i = i[group[i] == group[i + step]]
                if len(i):
                    x = i[(low[i] == high[i]) | (part[i] != part[i + step])]
                    apart = bits[x] ^ bits[x + step]
                    x = x[np.bitwise_count(apart[:, :words] | apart[:, words:]).sum(axis=1) <= most]
                    x = x[np.argmax(bands[x] == bands[x + step], axis=1) == bucket[x] >> 16]  # what isn't sent is equal
                    found.append((x, x + step))
                    size += len(x)
                if size and (size >= 1 << 17 or not len(i)):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(z))) for z in zip(*found)], ["x", "y"])
                    found, size = [], 0
                if not len(i):
                    break

    met = dealt.select("bucket", "low", "high", "part", "class", "bands", "bits").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(compared, f"x {kind}, y {kind}")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _judged(met: DataFrame, least: DataFrame, n: int, threshold: float) -> DataFrame:
    """a, b, similarity of the met pairs that agree in at least threshold.

    A class belongs to the least class that it met; the classes of one such are dealt into blocks, and two blocks with pairs
    between them are a cell, which gets each of its signatures once."""
    import pyarrow as pa

    kind = least.schema["class"].dataType.simpleString()
    lowest = met.groupBy(F.col("b").alias("class")).agg(F.min("a").alias("home"))
    homes = met.select(F.col("a").alias("class")).union(met.select("b")).distinct().join(lowest, "class", "left").withColumn("home", F.coalesce("home", "class"))
    parts = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks, _ = stored(homes.join(parts, "home").select("class", F.xxhash64("home", F.pmod(F.xxhash64("class"), "parts")).alias("block")), "signature-blocks")
    pairs = met.join(blocks.select(F.col("class").alias("a"), F.col("block").alias("p")), "a").join(blocks.select(F.col("class").alias("b"), F.col("block").alias("q")), "b")
    pairs, _ = stored(pairs.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "a", "b"), "signature-cells")
    sent = pairs.select("p", "q", F.explode(F.array("a", "b")).alias("class")).distinct().join(least, "class")
    rows = sent.select("p", "q", F.col("class").alias("a"), F.lit(None).cast(kind).alias("b"), "signature").unionByName(pairs.withColumn("signature", F.lit(None).cast("array<long>")))
    whole = _whole_cells()

    def judged(batches):
        for table in whole(batches, 2, 1 << 14):
            p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
            group = np.cumsum(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            held = table.column("signature").is_valid().to_numpy()
            values = table.column("signature").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            names = table.column("a").to_pandas()
            at = pd.DataFrame({"g": group[held], "c": names[held].to_numpy(), "at": np.arange(held.sum())})
            asked = pd.DataFrame({"g": group[~held], "a": names[~held].to_numpy(), "b": table.column("b").filter(pa.array(~held)).to_numpy()})
            asked = asked.merge(at.rename(columns={"c": "a", "at": "i"}), on=["g", "a"]).merge(at.rename(columns={"c": "b", "at": "j"}), on=["g", "b"])
            for lo in range(0, len(asked), 4096):
                some = asked.iloc[lo : lo + 4096]
                alike = (values[some["i"]] == values[some["j"]]).sum(axis=1) / n
                some = some.assign(similarity=alike)[alike >= threshold]
                yield pa.RecordBatch.from_pandas(some[["a", "b", "similarity"]], schema=made, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    shape = StructType([StructField("a", least.schema["class"].dataType), StructField("b", least.schema["class"].dataType), StructField("similarity", DoubleType())])
    made = to_arrow_schema(shape)
    return rows.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(judged, shape)
