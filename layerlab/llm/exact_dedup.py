"""1. Exact dedup on a sharded cuckoo filter that can insert and delete.

A text is known by the SHA-256 of its normalised form. Digests are dealt to
shards by hash; a shard holds a cuckoo filter (16-bit fingerprints, four slots a
bucket) and the bucketed content it stands for: digest, length in bytes, smallest
id, number of copies. A filter miss proves a digest new; a hit is verified
against the bucket. A full filter is built again, twice as large, from the keys.

Partial counts are made before the shuffle, so a text with any number of copies
is at most `PARTS` rows in its shard, and shards have about `SHARD_ROWS` digests
whatever the size of the corpus.

Defined results: a null text is empty. Rows with the same id and text share one
verdict. A null id stays only where all ids of its group are null. No rows give
an empty index.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlab.plans.materialize import via_parquet

SHARD_ROWS = 1 << 11
PARTS = 8
MAX_KICKS = 250
SHARD_SCHEMA = (
    "shard int, kind string, digest binary, n_bytes long, keep_id long, copies long, slots binary"
)


class CuckooFilter:
    """Fingerprints of digests in two candidate buckets of four slots."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.buckets = buckets  # a power of two
        self.slots = array("H", slots if slots is not None else bytes(8 * buckets))

    @classmethod
    def sized_for(cls, n: int) -> CuckooFilter:
        buckets = 4
        while buckets * 4 * 0.8 < n:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def of(cls, digests: Iterable[bytes], buckets: int) -> CuckooFilter:
        digests = list(digests)
        while True:
            filt = cls(buckets)
            if all(filt.insert(d) for d in digests):
                return filt
            buckets *= 2

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _put(self, bucket: int, mark: int) -> bool:
        for k in range(4 * bucket, 4 * bucket + 4):
            if not self.slots[k]:
                self.slots[k] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the filter overflows; it must then be built anew."""
        mark, one, two = self._places(digest)
        if self._put(one, mark) or self._put(two, mark):
            return True
        bucket = two
        for kick in range(MAX_KICKS):
            k = 4 * bucket + (kick + mark) % 4
            mark, self.slots[k] = self.slots[k], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def may_hold(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        slots = self.slots
        return mark in slots[4 * one : 4 * one + 4] or mark in slots[4 * two : 4 * two + 4]

    def delete(self, digest: bytes) -> None:
        """Remove one fingerprint of a digest that is in the filter."""
        mark, one, two = self._places(digest)
        for k in (*range(4 * one, 4 * one + 4), *range(4 * two, 4 * two + 4)):
            if self.slots[k] == mark:
                self.slots[k] = 0
                return


class Shard:
    """A filter with the content of its digests."""

    def __init__(self, rows: pd.DataFrame, expected: int):
        keys = rows[rows["kind"] == "key"]
        self.content = {
            bytes(d): [n, k if pd.notna(k) else None, c]
            for d, n, k, c in zip(keys["digest"], keys["n_bytes"], keys["keep_id"], keys["copies"])
        }
        stored = rows[rows["kind"] == "filter"]["slots"]
        if len(stored):
            slots = bytes(stored.iloc[0])
            self.filter = CuckooFilter(len(slots) // 8, slots)
        else:
            self.filter = CuckooFilter.sized_for(expected)

    def add(self, digest: bytes, n_bytes: int, smallest: int | None, copies: int) -> None:
        if self.filter.may_hold(digest):
            known = self.content.get(digest)  # a false positive is in no bucket
            if known is not None and known[0] == n_bytes:
                ids = [x for x in (known[1], smallest) if x is not None]
                known[1], known[2] = min(ids, default=None), known[2] + copies
                return
        self.content[digest] = [n_bytes, smallest, copies]
        if not self.filter.insert(digest):
            self.filter = CuckooFilter.of(self.content, 2 * self.filter.buckets)

    def replace(self, digest: bytes, smallest: int | None, copies: int) -> None:
        if not self.filter.may_hold(digest) or digest not in self.content:
            return
        if copies:
            self.content[digest][1:] = [smallest, copies]
        else:
            del self.content[digest]
            self.filter.delete(digest)

    def rows(self, shard: int) -> pd.DataFrame:
        out = [(shard, "key", d, n, k, c, None) for d, (n, k, c) in self.content.items()]
        out.append((shard, "filter", None, None, None, None, self.filter.slots.tobytes()))
        table = pd.DataFrame(out, columns=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])
        return table.astype({"n_bytes": "Int64", "keep_id": "Int64", "copies": "Int64"})


def _ids(values: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in values]


@dataclass(frozen=True)
class DigestIndex:
    """Shards (filter and content rows) and members (doc_id, digest, n_bytes)."""

    spark: SparkSession
    shards: DataFrame
    members: DataFrame
    n_shards: int

    @classmethod
    def empty(cls, spark: SparkSession, expected_rows: int) -> DigestIndex:
        return cls(
            spark,
            spark.createDataFrame([], SHARD_SCHEMA),
            spark.createDataFrame([], "doc_id long, digest binary, n_bytes long"),
            max(1, -(-expected_rows // SHARD_ROWS)),
        )

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.n_shards)).cast("int").alias("shard")

    def _updated(self, changes: DataFrame, insert: bool) -> DataFrame:
        def work(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = Shard(old, len(new))
            for d, n, k, c in zip(new["digest"], new["n_bytes"], _ids(new["doc_id"]), new["copies"]):
                if insert:
                    shard.add(bytes(d), int(n), k, int(c))
                else:
                    shard.replace(bytes(d), k, int(c))
            return shard.rows(int(key[0]))

        sides = self.shards.groupBy("shard").cogroup(changes.groupBy("shard"))
        return via_parquet(sides.applyInPandas(work, SHARD_SCHEMA), "digest-shards")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
        """An index with the rows of `docs` added."""
        text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
        new = via_parquet(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("t")).select(
                "doc_id",
                F.unhex(F.sha2("t", 256)).alias("digest"),
                F.octet_length("t").cast("long").alias("n_bytes"),
            ),
            "digest-members",
        )
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
        counts = new.groupBy("digest", "n_bytes", part.alias("part")).agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
        )
        shards = self._updated(counts.withColumn("shard", self._shard()), insert=True)
        return DigestIndex(self.spark, shards, self.members.unionByName(new), self.n_shards)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> DigestIndex:
        """An index without the documents of `ids`; texts with no copy left are forgotten."""
        gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        touched = self.members.join(gone, "doc_id", "left_semi").select("digest", "n_bytes").distinct()
        left = via_parquet(self.members.join(gone, "doc_id", "left_anti"), "digest-members")
        counts = (
            touched.withColumn("n", F.lit(0))
            .unionByName(
                left.join(touched, ["digest", "n_bytes"], "left_semi").withColumn("n", F.lit(1)),
                allowMissingColumns=True,
            )
            .groupBy("digest", "n_bytes")
            .agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("copies"))
        )
        shards = self._updated(counts.withColumn("shard", self._shard()), insert=False)
        return DigestIndex(self.spark, shards, left, self.n_shards)

    def groups(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, digest): one row per member.

        Both sides of the join are plain exchanges, so adaptive execution splits
        the rows of a text with very many copies.
        """
        keys = self.shards.filter("kind = 'key'").select("digest", "keep_id", "copies")
        return self.members.join(keys, "digest").select(
            "doc_id",
            "keep_id",
            F.col("copies").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "digest",
        )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal normalised texts; see DigestIndex.groups."""
    spark = docs.sparkSession
    index = DigestIndex.empty(spark, docs.count()).insert(docs, id_col, text_col)
    return index.groups()
