"""Signatures against a plain computation, and pairs against all pairs."""

import hashlib

from pyspark.sql import functions as F

from foliant.functions import signatures
from foliant.functions.text import normalize

BASE = "the quick brown fox jumps over the lazy dog near the river bank while the sun sets slowly behind the hills and birds sing"
TEXTS = [(1, BASE), (2, BASE), (3, BASE + " again"), (4, "completely other words about finance and law in a long report of the year"), (5, "short"), (6, None), (7, "")]


def plain(normal):
    eight = lambda s: int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "little")
    pieces = {normal[i : i + 5] for i in range(max(1, len(normal) - 4))}
    return [min(eight(p) ^ eight(f"minhash-seed-{i}") for p in pieces) for i in range(128)]


def test_signatures_and_pairs(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    rows = df.select("id", normalize(F.col("text")).alias("n"), signatures.signature(F.col("text")).alias("signature"))
    want = {}
    for r in rows.collect():
        if r.id > 4:
            assert r.signature is None
        else:
            want[r.id] = plain(r.n)
            assert [x % 2**64 for x in r.signature] == want[r.id]
    pairs, members = signatures.near_pairs(rows.select("id", "signature"), 0.7)
    alike = lambda a, b: sum(x == y for x, y in zip(want[a], want[b])) / 128
    assert {(r.a, r.b): r.similarity for r in pairs.collect()} == {(a, b): alike(a, b) for a, b in ((1, 3), (1, 4), (3, 4)) if alike(a, b) >= 0.7}
    assert {r.id: r["class"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string").select("id", signatures.signature(F.col("text")).alias("signature"))
    assert [df.count() for df in signatures.near_pairs(none, 0.75)] == [0, 0]
