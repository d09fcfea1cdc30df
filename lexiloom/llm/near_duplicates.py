"""Problem 1: near-duplicate records, found by b-bit MinHash.

Method.  Each record's set of distinct words is hashed; records with the same
set form one class, so copies cost one row from there on.  For each class 224
minima are computed; bands of 8 minima give band keys, and classes that share a
band key are candidates.  Of each minimum only the low 2 bits are kept, packed
into seven 64-bit words; equal positions of two signatures, counted by bit
operations, estimate the similarity corrected for chance agreement.  Pairs
whose estimate reaches the threshold less a margin of standard errors are
checked exactly on the word hashes.

Scale.  The texts are tokenized once; their word hashes are written to the
shared folder and shuffled once by class, the band rows once by key.  Texts
that share only common words meet in some band as often as the square of their
number, so no such pair is ever written: signatures travel with the band rows
and are compared where two rows meet.  For that the bands are passed in PASSES
parts, and the shuffle files of one are deleted before the next.  No group
is collected: hot keys are cut into blocks on both sides of the join, and a
test of the sets' sizes precedes the exact one.  Pairs of copies, whose number
may exceed the input by far, are not shuffled once made.  Classes are told apart
by the sets themselves, their 64-bit hashes only route them.

Records with null or empty texts, or with fewer words than ``min_words``, are
in no pair and form groups of their own.  Repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiloom.core.links import components, keyed_pairs, member_pairs_once
from lexiloom.core.storage import materialize
from lexiloom.llm.words import WordHasher, words_of

MINIMA, ROWS, ROUNDS, BITS = 224, 8, 2, 2
_rng = np.random.default_rng(20240501)
_MULT = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
#: Each round deals all minima into bands of ROWS.
BANDS = np.concatenate([_rng.permutation(MINIMA).reshape(-1, ROWS) for _ in range(ROUNDS)])
_FOLD = _rng.integers(1, 2**63, (len(BANDS), ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Parts in which the bands are shuffled, one at a time; rows of a key that one task pairs.
PASSES, BLOCK = 7, 16_000
SIGNATURE = tuple(f"s{k}" for k in range(MINIMA * BITS // 64))


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix 32-bit hashes over 64 bits."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def minima(sets: list[np.ndarray], of: np.ndarray | None = None) -> np.ndarray:
    """The MINIMA least hash values (32 bits each) of every set, none empty; 0 for those not named in ``of``."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = _spread(np.concatenate(sets))
    out = np.zeros((len(sets), MINIMA), dtype=np.uint32)
    for k in range(MINIMA) if of is None else of:
        out[:, k] = np.minimum.reduceat(((x * _MULT[k] + _PLUS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(low: np.ndarray, bands: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key of every band (or of those named) of every row of minima."""
    bands = np.arange(len(BANDS)) if bands is None else bands
    keys = np.empty((len(low), len(bands)), dtype=np.uint64)
    for at, b in enumerate(bands):
        h = (low[:, BANDS[b]].astype(np.uint64) * _FOLD[b]).sum(axis=1, dtype=np.uint64) + np.uint64(b)
        h ^= h >> np.uint64(29)
        keys[:, at] = h * np.uint64(0xBF58476D1CE4E5B9)
    return keys.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of all minima, packed into 64-bit words."""
    per = 64 // BITS
    bits = (low & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(low), -1, per)
    return (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _tokenized(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        ids, classes, blobs = [], [], []
        texts = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
        for i, *fields in zip(batch.column(0).to_pylist(), *texts, strict=True):
            hashes = hasher(words_of(*fields))
            if i is not None and len(hashes) >= max(1, min_words):
                blob = hashes.tobytes()
                ids.append(i)
                classes.append(xxhash.xxh3_64_intdigest(blob) - 2**63)
                blobs.append(blob)
        yield pa.RecordBatch.from_pydict({
            "id": pa.array(ids, batch.schema.field(0).type), "class": pa.array(classes, pa.int64()), "words": pa.array(blobs, pa.binary()),
        })


def _blocks(batch: pa.RecordBatch, size: int = 1024) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, [np.frombuffer(b, dtype=np.uint32) for b in part.column("words").to_pylist()]


def _banded(batches: Iterator[pa.RecordBatch], bands: np.ndarray) -> Iterator[pa.RecordBatch]:
    of = np.unique(BANDS[bands])
    for batch in batches:
        for part, sets in _blocks(batch):
            keys = band_keys(minima(sets, of), bands)
            again = {c: pa.array(np.repeat(part.column(c).to_numpy(), keys.shape[1])) for c in ("class", *SIGNATURE)}
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), **again})


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, sets in _blocks(batch):
            sig = packed(minima(sets))
            cols = {c: pa.array(np.ascontiguousarray(sig[:, k])) for k, c in enumerate(SIGNATURE)}
            yield pa.RecordBatch.from_pydict({"class": part.column("class"), "words": part.column("words"), **cols})


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = [
            len(np.intersect1d(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), assume_unique=True))
            for a, b in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_pydict({
            "class_a": batch.column("class_a"), "class_b": batch.column("class_b"),
            "n_a": pa.array([len(x) // 4 for x in batch.column("words_a").to_pylist()], pa.int32()),
            "n_b": pa.array([len(x) // 4 for x in batch.column("words_b").to_pylist()], pa.int32()),
            "common": pa.array(common, pa.int32()),
        })


def agreeing(rows: pa.RecordBatch, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have signatures with at least ``least`` equal positions."""
    differing = np.zeros(len(left), np.uint8)
    for c in SIGNATURE:
        s = rows.column(c).to_numpy().view(np.uint64)
        x = s[left] ^ s[right]
        differing += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return differing <= MINIMA - least


def equal_positions(words: int) -> Column:
    """How many of the packed positions agree, by bit counts over ``words`` words."""
    total = None
    for k in range(words):
        x = F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))
        # a position differs when either of its two bits does
        differs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = F.bit_count(differs) if total is None else total + F.bit_count(differs)
    return F.lit(MINIMA) - total


def word_sets(df: DataFrame, key: str, fields: tuple[str, ...], min_words: int) -> DataFrame:
    """``(id, class, words)`` of the records with at least ``min_words`` words.

    Written to the shared folder once: every later step reads the hashes (four
    bytes a word) instead of tokenizing the texts again.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, *fields).mapInArrow(lambda it: _tokenized(it, min_words), f"id {kind}, class long, words binary")
    return materialize(rows, "word-sets")


def class_links(sets: DataFrame, threshold: float, sigmas: float = 4.5) -> DataFrame:
    """Verified links ``(class_a, class_b, similarity)`` between different word sets."""
    signature = ", ".join(f"{c} long" for c in SIGNATURE)
    distinct = sets.where("class is not null").select("class", "words").distinct()
    signed = materialize(distinct.mapInArrow(_signed, f"class long, words binary, {signature}"), "classes", drop_shuffles=True)

    def side(x: str) -> DataFrame:
        return signed.select(F.col("class").alias(f"class_{x}"), F.col("words").alias(f"words_{x}"))

    # estimate = (share of equal positions - chance) / (1 - chance)
    chance = 2.0**-BITS
    expected = threshold + (1 - threshold) * chance
    margin = sigmas * (expected * (1 - expected) / MINIMA) ** 0.5
    least = MINIMA * (expected - margin)
    rows = [
        signed.mapInArrow(lambda it, bands=bands: _banded(it, bands), f"key long, class long, {signature}")
        for bands in np.array_split(np.arange(len(BANDS)), PASSES)
    ]
    keep = (lambda *pairs: agreeing(*pairs, least)), equal_positions(len(SIGNATURE)) >= least
    near = keyed_pairs(rows, "key", "class", BLOCK, keep, SIGNATURE, drop_shuffles=True).distinct()
    exact = (
        near.join(side("a"), "class_a").join(side("b"), "class_b")
        .where(F.least(F.length("words_a"), F.length("words_b")) >= threshold * F.greatest(F.length("words_a"), F.length("words_b")))
        .select("class_a", "class_b", "words_a", "words_b")
        .mapInArrow(_exact, "class_a long, class_b long, n_a int, n_b int, common int")
    )
    similarity = F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    return exact.select("class_a", "class_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(
    df: DataFrame, key: str, fields: tuple[str, ...], threshold: float = 0.7, min_words: int = 75
) -> DataFrame:
    """Distinct pairs ``(id_a, id_b)``, ``id_a < id_b``, of similar records.

    Copies of one word set are similar to each other and to all partners of the
    set; their pairs are written out, as the form of the result asks.
    """
    sets = word_sets(df, key, fields, min_words)
    # an id with several texts is in several classes
    of_id = Window.partitionBy("id")
    placed = sets.select("class", "id").repartition(F.col("id")).distinct()
    members = materialize(placed.withColumn("several", F.min("class").over(of_id) < F.max("class").over(of_id)), "members", drop_shuffles=True)
    links = class_links(sets, threshold).select("class_a", "class_b").distinct()
    alike = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    within = alike.select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    return member_pairs_once(materialize(links.union(within), "links", drop_shuffles=True), members)


def near_duplicate_groups(
    df: DataFrame, key: str, fields: tuple[str, ...], threshold: float = 0.7, min_words: int = 75
) -> DataFrame:
    """One row for each record: ``(id, group_id, n_links)``.

    ``group_id`` is the least id of the record's group (records connected by
    links or by equal word sets); ``n_links`` counts the different word sets the
    record's own is linked to.  A record without partners is its own group.
    """
    sets = word_sets(df, key, fields, min_words)
    members = sets.select("class", "id").distinct()
    links = materialize(class_links(sets, threshold), "links")
    labels = components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    degree = (
        links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    )
    placed = (
        members.join(labels.withColumnRenamed("vertex", "class"), "class", "left").join(degree, "class", "left")
        .select("id", F.coalesce("label", "class").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    names = placed.groupBy("label").agg(F.min("id").alias("group_id"))
    grouped = placed.join(names, "label").select("id", "group_id", "n_links")
    everyone = df.select(F.col(key).alias("id")).where(F.col(key).isNotNull()).distinct()
    rest = everyone.join(grouped.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return grouped.select("id", "group_id", F.col("n_links").cast("long").alias("n_links")).union(rest)
