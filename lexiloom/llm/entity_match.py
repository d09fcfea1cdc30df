"""Problem 2: matching works across two tables without a common key.

Method.  Every record is a document of tokens over all its attributes: the words
of the title, the names of the authors, the year and the identifier in the url.
Records of the catalogue are queries against an inverted index of the
candidates; pairs are scored by BM25 (term saturation, document length, inverse
document frequency over both tables).  Words enter the index by their set of
letters, so swapped or doubled letters change nothing.

Retrieval is exact and pruned, with no fixed k: it finds every pair whose shared
weight is at least ``FLOOR`` of the record's own (its title and its three
rarest author names), or ``TITLE_FLOOR`` of its title's where one side names no
author, or that shares an identifier.  Pairs that name authors on both sides and
share none are no matches by definition and are not looked up.  So the tokens
looked up are names, identifiers and the rarest words of the title: those
without which a pair without authors cannot reach its floor.  An upper bound
from 128-bit sketches of the titles drops pairs inside the join (what may be
shared weighs less than the floor); the rest is scored in the same stage from
packed token lists, so no candidate pair below the floor is ever shuffled.

Pairs that are nearest to each other stay: the score is within ``NEAR`` of the
best of either side, as works have several records and candidates.  Their
confidence is a logistic function of the score, of its gaps to the best of
either side and of the shares of title and authors.  It is calibrated on pairs
with identifiers on both sides (the same: a match, different: none), at most
about ``MAX_PAIRS`` of them, a documented bound, with the starting weights as
prior mean at every size; the identifier itself then counts with a fixed weight.

An exact check follows: different part numbers or years more than two apart
exclude a match.  Null or empty attributes neither speak for a match nor against
it; records without a title are in no match.  Of a repeated id with several
contents each counts; a pair comes once, with its best confidence.

Scale.  Hot tokens are cut into parts by the product of their frequencies, the
same on both sides.  Broadcast are one byte for each of 2^20 cells of token
hashes (which tokens are looked up, and in how many parts) and the weights.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.core.storage import materialize
from lexiloom.llm.canonical import canonical_text
from lexiloom.llm.reading_level import fit_logistic

FLOOR, TITLE_FLOOR, NEAR, MAX_PAIRS = 0.6, 0.8, 0.7, 20_000
#: BM25: saturation of repeated terms, and how much the document's length counts.
K1, B = 1.2, 0.3
#: Results of one record's functions that a worker remembers; callers do not change them.
CACHED = 20_000
#: Pairs of postings that one task joins for a token, and the most parts (as powers of two).
PART_LOAD, MOST_PARTS = 1 << 26, 12
CELL_BITS = 20
TITLE, AUTHOR, YEAR, URL = 0, 1, 2, 3
_TIERS = 3
_TOKEN = np.dtype([("h", "<i8"), ("tf", "u1")])
_HELD = np.dtype([("h", "<u4"), ("tf", "u1")])
_ASKED = np.dtype([("h", "<u4"), ("w", "<f4"), ("looked", "u1")])
_TAG = re.compile(r"<[^<>]{0,60}>|&[a-z]+;|&#\d+;")
_WORD = re.compile(r"[一-鿿]+|[^\W_一-鿿]+")
_OTHERS, _BETWEEN, _INITIAL = re.compile(r"\band others\b|\bet al\b\.?"), re.compile(r"[;&]|\band\b"), re.compile(r",\s*\w\.?\s*$")
_PART = re.compile(r"(?:^|\s)(\d{1,3}|i{1,3}|iv|v)$")
_DOI = re.compile(r"10\.\d{3,9}[/_][^\s?#]+")
FEATURES = ("score", "title", "back", "authors", "unknown", "gap_rec", "gap_cand")
#: Prior mean of the calibration (intercept first), and its weight in labelled pairs.
START, PRIOR = (-9.5, 3.5, 3.5, 4.5, 2.0, -1.0, 4.5, 1.0), 10.0
#: Fixed weight of an identifier that both sides name: for if the same, against if not.
IDENTIFIER = 4.0


def _plain(text: str) -> str:
    """Canonical form in lower case, without accents or mark-up."""
    text = canonical_text(_TAG.sub(" ", text) if "<" in text or "&" in text else text).lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@functools.lru_cache(maxsize=CACHED)
def words(title: str | None) -> list[str]:
    """Words of a title in canonical form, without accents or mark-up."""
    return _WORD.findall(_plain(title)) if title else []


@functools.lru_cache(maxsize=CACHED)
def names(authors: str | None) -> list[set[str]]:
    """Name words of each listed author, without initials."""
    out = []
    for one in _BETWEEN.split(_OTHERS.sub(" ", _plain(authors))) if authors else ():
        for name in one.split(",") if one.count(",") > 1 or not _INITIAL.search(one) else [one]:
            own = {w for w in _WORD.findall(name) if len(w) > 1}
            if own:
                out.append(own)
    return out


@functools.lru_cache(maxsize=CACHED)
def doi(url: str | None) -> str | None:
    """The identifier in a url or reference, in lower case."""
    m = _DOI.search(url.lower()) if url else None
    return re.sub(r"\.pdf$", "", m[0].replace("_", "/", 1)).rstrip(".)/") if m else None


@functools.lru_cache(maxsize=CACHED)
def part_number(title: str | None) -> str | None:
    """The number at the end of a title: part, volume or stage of a series."""
    m = _PART.search(" ".join(words(title)))
    return {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}.get(m[1], m[1]) if m else None


def letters(word: str, least: int) -> str:
    """What a word enters the index by: its set of letters if it has ``least`` or more."""
    return "".join(sorted(set(word))) + "*" if len(word) >= least and word.isalpha() else word


def terms(title: str | None, authors: str | None, year: int | None, url: str | None) -> list[tuple[int, str]]:
    """The tokens of a record with their kinds, repeats kept."""
    out = []
    for w in words(title):
        if "一" <= w[0] <= "鿿":
            out += [(TITLE, w[i : i + 2]) for i in range(max(1, len(w) - 1))]
        else:
            out.append((TITLE, letters(w, 4)))
    out += {(AUTHOR, letters(w, 8)) for n in names(authors) for w in n}
    if year is not None:
        out.append((YEAR, str(year)))
    identifier = doi(url)
    return [*out, (URL, identifier)] if identifier else out


def _hashed(kind: int, token: str) -> int:
    return (xxhash.xxh3_64_intdigest(f"{kind}{token}") & ~3 | kind) - 2**63


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, tokens, part, year``: tokens packed as hash and count; part -1 where a cut may hide it."""
    known: dict[tuple[int, str], int] = {}
    for batch in batches:
        ids, blobs, parts, years = [], [], [], []
        for i, title, authors, year, url in zip(*(batch.column(c).to_pylist() for c in ("id", "title", "authors", "year", "url")), strict=True):
            found: dict[int, int] = {}
            if i is None or not words(title):
                continue
            if len(known) > 10 * CACHED:
                known.clear()
            for t in terms(title, authors, year, url):
                h = known.get(t)
                if h is None:
                    h = known[t] = _hashed(*t)
                found[h] = min(found.get(h, 0) + 1, 255)
            ids.append(i)
            blobs.append(np.array(list(found.items()), dtype=_TOKEN).tobytes())
            number = part_number(title)
            parts.append(xxhash.xxh3_64_intdigest(number) >> 2 if number else -1 if title.rstrip().endswith(("...", "…")) else 0)
            years.append(year)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "tokens": pa.array(blobs, pa.binary()), "part": pa.array(parts, pa.int64()), "year": pa.array(years, pa.int32())})


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of packed lists, and the row of each."""
    blobs = column.to_pylist()
    sizes = np.array([len(b) for b in blobs], dtype=np.int64) // kind.itemsize
    return np.frombuffer(b"".join(blobs), dtype=kind), np.repeat(np.arange(len(blobs)), sizes)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries, row = _unpacked(batch.column("tokens"), _TOKEN)
        cols = {c: batch.column(c).take(pa.array(row)) for c in batch.schema.names if c != "tokens"}
        yield pa.RecordBatch.from_pydict(cols | {"h": pa.array(np.ascontiguousarray(entries["h"])), "tf": pa.array(entries["tf"].astype(np.int32))})


def _mask(bits: list[int]) -> tuple[int, int, int]:
    """Two signed halves of the 128-bit mask of some bits, and how many bits coincide."""
    own = set(bits)
    m = sum(1 << b for b in own)
    return *(x - 2**64 if x >= 2**63 else x for x in (m & (2**64 - 1), m >> 64)), len(bits) - len(own)


_BOUNDS = [f"{c}{k}" for k in range(_TIERS) for c in ("low", "high", "top")]
_QUERY = (
    "rec_id long, year_r int, part_r long, own_t float, own_a float, names long, top_a float, more_a float, base float, "
    + ", ".join(f"{c} {'float' if c[0] == 't' else 'long'}" for c in _BOUNDS) + ", asked binary, looks array<long>, levels array<int>"
)


def _queries(batches: Iterator[pa.RecordBatch], n: int, part_load: int) -> Iterator[pa.RecordBatch]:
    """Each record as a query: weights, the tokens to look up, and bounds on what a title can share."""
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in _QUERY.split(", ")}
        for rec_id, year, part, ts in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "year", "part", "ts")), strict=True):
            # rarest first; with each token its weight and the pairs of postings that looking it up joins
            own = sorted((t["df"], t["h"], math.log(1 + (n - t["df"] + 0.5) / (t["df"] + 0.5)), t["held"] * (t["df"] - t["held"])) for t in ts)
            titled, named = ([x for x in own if x[1] & 3 == k] for k in (TITLE, AUTHOR))
            own_t, own_a = sum(x[2] for x in titled), sum(x[2] for x in named[:3])
            looks = [x for x in own if x[1] & 3 in (AUTHOR, URL)]
            # words by falling weight; those without which a pair cannot reach the floor of the title
            left = own_t
            for x in titled:
                if left < TITLE_FLOOR * own_t:
                    break
                looks.append(x)
                left -= x[2]
            heavy = [x for x in titled if x[0] <= n / 10]
            base = sum(x[2] for x in titled) - sum(x[2] for x in heavy)
            for k in range(_TIERS):
                tier = heavy[len(heavy) * k // _TIERS : len(heavy) * (k + 1) // _TIERS]
                low, high, same = _mask([(x[1] >> 8) & 127 for x in tier])
                top = tier[0][2] if tier else 0.0
                base += same * top
                for c, x in ((f"low{k}", low), (f"high{k}", high), (f"top{k}", top)):
                    out[c].append(x)
            low, _, same = _mask([(x[1] >> 8) & 63 for x in named])
            top = named[0][2] if named else 0.0
            chosen = {x[1] for x in looks}
            packed = np.array(sorted((x[1] & 0xFFFFFFFF, x[2], x[1] in chosen) for x in own), dtype=_ASKED)
            row = {
                "rec_id": rec_id, "year_r": year, "part_r": part, "own_t": own_t, "own_a": own_a, "names": low, "top_a": top, "more_a": same * top, "base": base,
                "asked": packed.tobytes(), "looks": [x[1] for x in looks], "levels": [min(MOST_PARTS, math.ceil(math.log2(max(1.0, x[3] / part_load)))) for x in looks],
            }
            for c, x in row.items():
                out[c].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=_arrow(_QUERY))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _cell(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each token that a query looks up, and for each of the token's parts."""
    for batch in batches:
        looks = batch.column("looks")
        h, row = looks.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), looks.value_lengths().to_numpy(zero_copy_only=False))
        parts = 1 << (cells[_cell(h)].astype(np.int64) - 1)
        each = np.repeat(np.arange(len(h)), parts)
        part = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
        cols = {c: batch.column(c).take(pa.array(row[each])) for c in batch.schema.names if c not in ("looks", "levels")}
        yield pa.RecordBatch.from_pydict({"h": pa.array(h[each]), "part": pa.array(part.astype(np.int32))} | cols)


def _posted(batches: Iterator[pa.RecordBatch], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of the candidates' tokens that any query may look up."""
    for batch in batches:
        entries, row = _unpacked(batch.column("tokens"), _TOKEN)
        h = np.ascontiguousarray(entries["h"])
        n, kind, bit = batch.num_rows, h & 3, (h >> 8) & 127
        sketch = np.zeros((n, 3), dtype=np.uint64)
        one = np.uint64(1) << (bit & 63).astype(np.uint64)
        for k, own in enumerate(((kind == TITLE) & (bit < 64), (kind == TITLE) & (bit >= 64), kind == AUTHOR)):
            np.bitwise_or.at(sketch[:, k], row[own], one[own])
        packed = np.empty(len(h), dtype=_HELD)
        packed["h"], packed["tf"] = h & 0xFFFFFFFF, entries["tf"]
        order = np.lexsort((packed["h"], row))
        ends = np.searchsorted(row, np.arange(n), side="right") * _HELD.itemsize
        data = packed[order].tobytes()
        blobs = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []
        value = cells[_cell(h)] if len(h) else np.empty(0, np.uint8)
        keep = np.flatnonzero((value > 0) & (kind != YEAR))
        at = pa.array(row[keep])
        ids = batch.column("id").to_numpy()[row[keep]]
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        part = spread.astype(np.int64) & ((1 << (value[keep].astype(np.int64) - 1)) - 1)
        signed = sketch.view(np.int64)
        yield pa.RecordBatch.from_pydict({
            "h": pa.array(h[keep]), "part": pa.array(part.astype(np.int32)), "cand_id": pa.array(ids), "year_c": batch.column("year").take(at), "part_c": batch.column("part").take(at),
            "low": pa.array(signed[row[keep], 0]), "high": pa.array(signed[row[keep], 1]), "names_c": pa.array(signed[row[keep], 2]), "held": pa.array(blobs, pa.binary()).take(at),
        })


_SCORED = "rec_id long, cand_id long, score double, title double, back double, authors double, years int, same_doi boolean, same_part boolean"


def _scored(batches: Iterator[pa.RecordBatch], length: float) -> Iterator[pa.RecordBatch]:
    """BM25 of each pair, once, at the first token that both sides share and the query looks up."""
    for batch in batches:
        n = batch.num_rows
        asked, row = _unpacked(batch.column("asked"), _ASKED)
        held, row_c = _unpacked(batch.column("held"), _HELD)
        mine, other = (row.astype(np.int64) << 32) | asked["h"], (row_c.astype(np.int64) << 32) | held["h"]
        at = np.minimum(np.searchsorted(other, mine), max(len(other) - 1, 0))
        shared = other[at] == mine if len(other) else np.zeros(len(mine), bool)
        kind = asked["h"] & 3
        sums = lambda mask, weights: np.bincount(row[mask], weights=weights[mask].astype(float), minlength=n)
        tf, norm = held["tf"].astype(float), K1 * (1 - B + B * np.bincount(row_c, weights=held["tf"], minlength=n) / length)
        gain = asked["w"] * (K1 + 1) * tf[at] / (tf[at] + norm[row]) if len(other) else asked["w"] * 0.0
        plain = [sums(shared & (kind == k), asked["w"]) for k in (TITLE, AUTHOR)]
        full = [sums(shared & (kind == k), gain) for k in (TITLE, AUTHOR, YEAR)]
        own_t, own_a = (batch.column(c).to_numpy().astype(float) for c in ("own_t", "own_a"))
        known = (batch.column("names").to_numpy() != 0) & (batch.column("names_c").to_numpy() != 0)
        dated = batch.column("year_r").is_valid().to_numpy(zero_copy_only=False) & batch.column("year_c").is_valid().to_numpy(zero_copy_only=False)
        own_y = sums(kind == YEAR, asked["w"])
        ids_r, ids_c = np.bincount(row[kind == URL], minlength=n) > 0, np.bincount(row_c[(held["h"] & 3) == URL], minlength=n) > 0
        same = np.bincount(row[shared & (kind == URL)], minlength=n) > 0
        names = np.minimum(plain[1], own_a)
        share = np.where(known, plain[0] + names, plain[0]) / np.where(known, own_t + own_a, own_t)
        enough = np.where(known, (share >= FLOOR) & (names > 0), share >= TITLE_FLOOR) | same
        # the pair is met at each shared token that is looked up; it counts at one of them
        meets = shared & (asked["looked"] > 0) & ((kind != TITLE) | ~known[row])
        rank = np.where(meets, asked["h"].astype(np.int64) + np.where(kind == URL, 0, 1 << 32), 1 << 40)
        least = np.full(n, 1 << 40)
        np.minimum.at(least, row, rank)
        keep = np.flatnonzero(enough & ((least & 0xFFFFFFFF) == (batch.column("h").to_numpy() & 0xFFFFFFFF)))
        words_c = np.bincount(row_c[(held["h"] & 3) == TITLE], minlength=n)
        weight = own_t + np.where(known, own_a, 0) + np.where(dated, own_y, 0)
        # of the names at most the weight of the record's three rarest counts, as in the record's own
        named = names * full[1] / np.maximum(plain[1], 1e-9)
        score = (full[0] + np.where(known, named, 0) + np.where(dated, full[2], 0)) / weight
        years = np.abs(batch.column("year_r").fill_null(0).to_numpy().astype(np.int64) - batch.column("year_c").fill_null(0).to_numpy())
        part_r = batch.column("part_r").to_numpy()
        cols = {
            "rec_id": batch.column("rec_id").to_numpy(), "cand_id": batch.column("cand_id").to_numpy(), "score": score, "title": plain[0] / own_t,
            "back": np.bincount(row[shared & (kind == TITLE)], minlength=n) / np.maximum(words_c, 1), "authors": names / np.maximum(own_a, 1e-9),
            "years": years.astype(np.int32), "same_doi": same, "same_part": (part_r == batch.column("part_c").to_numpy()) | (part_r == -1),
        }
        empty = {"authors": ~known, "years": ~dated, "same_doi": ~(ids_r & ids_c)}
        yield pa.RecordBatch.from_pydict({c: pa.array(x[keep], mask=empty[c][keep] if c in empty else None) for c, x in cols.items()}, schema=_arrow(_SCORED))


def _profiles(df: DataFrame, key: str) -> DataFrame:
    source = df.select(F.col(key).cast("long").alias("id"), "title", "authors", F.col("year").cast("int").alias("year"), "url")
    return materialize(source.mapInArrow(_profiled, "id long, tokens binary, part long, year int"), "profiles")


def _possible() -> Column:
    """Whether the shared bits of the sketches allow the pair to reach its floor."""
    title = F.col("base")
    for k in range(_TIERS):
        title = title + F.col(f"top{k}") * (F.bit_count(F.col(f"low{k}").bitwiseAND(F.col("low"))) + F.bit_count(F.col(f"high{k}").bitwiseAND(F.col("high"))))
    title = F.least(title, F.col("own_t"))
    names = F.least(F.col("more_a") + F.col("top_a") * F.bit_count(F.col("names").bitwiseAND(F.col("names_c"))), F.col("own_a"))
    kind = F.col("h").bitwiseAND(F.lit(3))
    slack = 1e-4  # the bounds are single precision
    known = (F.col("names") != 0) & (F.col("names_c") != 0)
    by_title = (kind == TITLE) & ~known & (title >= (TITLE_FLOOR - slack) * F.col("own_t"))
    by_names = (kind == AUTHOR) & (title + names >= (FLOOR - slack) * (F.col("own_t") + F.col("own_a")))
    return (kind == URL) | by_names | by_title


def scored_pairs(candidates: DataFrame, records: DataFrame, part_load: int = PART_LOAD) -> DataFrame:
    """The pairs above their floor with score and agreement of their attributes."""
    cands, recs = _profiles(candidates, "cand_id"), _profiles(records, "rec_id")
    tokens_c = cands.select("tokens").mapInArrow(_exploded, "h long, tf int").select("h", "tf", F.lit(0).alias("asks"))
    # a repeated record is one query, a repeated id with other contents another
    tokens_r = recs.withColumn("content", F.xxhash64("tokens")).mapInArrow(_exploded, "id long, part long, year int, content long, h long, tf int")
    frequency = materialize(
        tokens_c.union(tokens_r.select("h", "tf", F.lit(1))).groupBy("h")
        .agg(F.count("*").alias("df"), F.sum("asks").alias("held"), F.sum("tf").alias("tf")).where("held > 0"),
        "frequency",
    )
    n = cands.count() + recs.count()
    length = max(1.0, (cands.agg(F.sum(F.length("tokens"))).first()[0] or 0) / _TOKEN.itemsize / max(1, n))
    queries = materialize(
        tokens_r.join(frequency, "h").groupBy(F.col("id").alias("rec_id"), "content", "part", "year").agg(F.collect_set(F.struct("h", "df", "held")).alias("ts"))
        .mapInArrow(lambda it: _queries(it, n, part_load), _QUERY),
        "queries",
    )
    looked = queries.select(F.explode(F.arrays_zip("looks", "levels")).alias("x")).groupBy(F.shiftrightunsigned("x.looks", 64 - CELL_BITS).alias("cell")).agg((F.max("x.levels") + 1).cast("long").alias("v"))
    # one byte a cell, eight to a number: at most 2^17 rows, whatever the input
    bytes_of = looked.groupBy(F.shiftright("cell", 3).alias("at")).agg(F.sum(F.expr("shiftleft(v, cast((cell & 7) * 8 as int))")).alias("v")).toPandas()
    packed = np.zeros(1 << CELL_BITS - 3, dtype=np.int64)
    packed[bytes_of["at"].to_numpy(np.int64)] = bytes_of["v"].to_numpy(np.int64)
    cells = packed.astype("<i8").view(np.uint8)
    asking = _QUERY.split(", looks")[0]
    asked = queries.mapInArrow(lambda it: _asked(it, cells), f"h long, part int, {asking}")
    postings = cands.mapInArrow(
        lambda it: _posted(it, cells), "h long, part int, cand_id long, year_c int, part_c long, low long, high long, names_c long, held binary"
    )
    met = asked.join(postings, ["h", "part"]).where(_possible())
    needed = ("h", "rec_id", "cand_id", "year_r", "year_c", "part_r", "part_c", "own_t", "own_a", "names", "names_c", "asked", "held")
    return materialize(met.select(*needed).mapInArrow(lambda it: _scored(it, length), _SCORED), "scored")


def _features(pairs: DataFrame) -> DataFrame:
    best_r, best_c = (pairs.groupBy(k).agg(F.max("score").alias(f"best_{k[:-3]}")) for k in ("rec_id", "cand_id"))
    return pairs.join(best_r, "rec_id").join(best_c, "cand_id").select(
        *pairs.columns, F.col("score").alias("x_score"), F.col("title").alias("x_title"), F.col("back").alias("x_back"), F.coalesce("authors", F.lit(0.0)).alias("x_authors"),
        F.when(F.col("authors").isNull(), 1.0).otherwise(0.0).alias("x_unknown"), (F.col("score") / F.greatest("best_rec", F.lit(1e-9)) - 1).alias("x_gap_rec"),
        (F.col("score") / F.greatest("best_cand", F.lit(1e-9)) - 1).alias("x_gap_cand"),
    )


def matches(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """``(cand_id, rec_id, score, confidence, title, authors, years, same_doi)`` of the mutually nearest pairs."""
    x = _features(scored_pairs(candidates, records))
    labelled = x.where("same_doi is not null").select(F.col("same_doi").cast("double").alias("y"), F.xxhash64("rec_id", "cand_id").alias("r"), *(f"x_{f}" for f in FEATURES))
    most = MAX_PAIRS / max(1, labelled.count())
    sample = labelled.where(F.pmod("r", F.lit(1 << 20)) < int(min(1.0, most) * (1 << 20))).toPandas()
    weights = fit_logistic(sample[[f"x_{f}" for f in FEATURES]].to_numpy(float), sample["y"].to_numpy(float), prior=np.array(START), strength=PRIOR)
    total = F.lit(float(weights[0])) + IDENTIFIER * F.when(F.col("same_doi"), 1.0).when(~F.col("same_doi"), -1.0).otherwise(0.0)
    for f, w in zip(FEATURES, weights[1:], strict=True):
        total = total + F.col(f"x_{f}") * float(w)
    nearest = (F.col("x_gap_rec") >= NEAR - 1) & (F.col("x_gap_cand") >= NEAR - 1)
    checked = F.col("same_part") & (F.coalesce("years", F.lit(0)) <= 2)
    found = x.where(nearest & checked).select("cand_id", "rec_id", (1 / (1 + F.exp(-total))).alias("confidence"), F.struct("score", "title", "authors", "years", "same_doi").alias("s"))
    once = found.groupBy("cand_id", "rec_id").agg(F.max(F.struct("confidence", "s")).alias("b"))
    return once.select("cand_id", "rec_id", "b.s.score", "b.confidence", "b.s.title", "b.s.authors", "b.s.years", "b.s.same_doi")
