"""Problem 6: token ids of a whole corpus by a public tokenizer.

Method: content-defined chunk reuse.  A rolling hash over the characters cuts
each text into chunks whose ends depend on the content around them alone, so a
passage that recurs in another document gives the same chunks.  Each distinct
chunk is encoded once and its ids are joined back.

A cut may fall inside a token.  So each chunk is split at its first and last
safe boundary, where the tokenizer's pattern always begins a new piece, so that
ids on both sides are independent: before white space after a visible character,
and between letters, digits and punctuation (but for apostrophes, which may open
a piece with letters).  What lies between the safe boundaries is the chunk's
body; the tail of one chunk and the head of the next are put together to a join,
which is encoded as a whole.  A chunk without a safe boundary is taken into the
join too, and the join grows until it ends at safe boundaries, where the ids
agree exactly with those of the undivided text.

The texts are cut once: that pass gives the keys of every document's pieces and
each piece that the task meets first, and is written to the shared folder.

Defined results: null and empty texts give an empty list; texts that look like
special tokens are ordinary text; a repeated document id gives one row for each
distinct text of it.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexiloom.core.storage import materialize

WINDOW, LEAST, MOST, MASK = 12, 24, 2048, np.uint64(0x3F)
_ROLL = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)
# Classes of the tokenizer's pattern, as far as every version of Unicode agrees on them.
_L, _N, _P = r"A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ώА-яぁ-ゖァ-ヺ一-鿋가-힣", "0-9", r"!-&(-/:-@\[-`{-~、。，！？：；（）「」“”‘’–—…"
_SAFE = re.compile(rf"(?<=[{_L}])(?=[{_N}{_P}'\s])|(?<=[{_N}])(?=[{_L}{_P}'\s])|(?<=[{_P}])(?=[{_L}{_N}\s])|(?<=')(?=\s)", re.A)
#: Distinct pieces that one task remembers having sent; forgotten when full.
SENT_LIMIT = 200_000


def tokenizer_folder() -> str:
    """Where the public vocabularies lie: the folder of the installed package."""
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


@functools.lru_cache(maxsize=4)
def encoder(name: str, folder: str):
    """The byte-level BPE of ``name`` without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text; the last is its length."""
    n = len(text)
    if n <= LEAST:
        return [n]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    rolling = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        rolling += codes[k : n - WINDOW + 1 + k] * _ROLL[k]
    marks = np.flatnonzero(((rolling >> np.uint64(40)) & MASK) == 0) + WINDOW
    ends, last = [], 0
    for m in marks.tolist():
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def pieces(text: str) -> list[str]:
    """Bodies and joins of a text, in order; their ids concatenate exactly."""
    out, start, opened = [], 0, 0
    for end in cuts(text):
        # ends are included: what stands there belongs to the next chunk
        first = _SAFE.search(text, start + 1, end)
        if first:
            last = first.start()
            for m in _SAFE.finditer(text, last + 1, end):
                last = m.start()
            out += [text[a:b] for a, b in ((opened, first.start()), (first.start(), last)) if b > a]
            opened = last
        start = end
    return [*out, text[opened:]] if opened < len(text) else out


def _key(piece: str) -> bytes:
    return xxhash.xxh3_128_digest(piece.encode("utf-8", "surrogatepass"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: the keys of its pieces, in order, and the pieces the task has not sent yet."""
    sent: set[bytes] = set()
    for batch in batches:
        keys, fresh_keys, fresh = [], [], []
        for t in batch.column("text").to_pylist():
            own, new_keys, new = [], [], []
            for p in pieces(t) if t else ():
                k = _key(p)
                own.append(k)
                if k not in sent:
                    if len(sent) >= SENT_LIMIT:
                        sent.clear()
                    sent.add(k)
                    new_keys.append(k)
                    new.append(p)
            keys.append(own)
            fresh_keys.append(new_keys)
            fresh.append(new)
        lists = pa.list_(pa.binary())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "keys": pa.array(keys, lists), "fresh_keys": pa.array(fresh_keys, lists), "fresh": pa.array(fresh, pa.list_(pa.string())),
        })


def _encoded(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(name, folder).encode_ordinary
    for batch in batches:
        ids = [encode(p) for p in batch.column("piece").to_pylist()]
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "piece_ids": pa.array(ids, pa.list_(pa.int32()))})


def _pieces_of(documents: DataFrame, name: str, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """Placed pieces ``(doc_id, tag, at, key)`` and encoded ones ``(key, piece_ids)``."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    folder = folder or tokenizer_folder()
    done = materialize(
        documents.select("doc_id", "text").mapInArrow(_cut, f"doc_id {kind}, keys array<binary>, fresh_keys array<binary>, fresh array<string>"), "pieces"
    )
    placed = done.select("doc_id", F.xxhash64("keys").alias("tag"), F.posexplode("keys").alias("at", "key"))
    encoded = (
        done.select(F.explode(F.arrays_zip("fresh_keys", "fresh")).alias("f")).groupBy(F.col("f.fresh_keys").alias("key")).agg(F.first("f.fresh").alias("piece"))
        .mapInArrow(lambda it: _encoded(it, name, folder), "key binary, piece_ids array<int>")
    )
    return placed, encoded


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every document of ``documents(doc_id, text)``.

    The shuffles carry keys and ids of pieces; the text itself is shuffled once
    for each distinct piece and task.  A piece that many documents share is one
    row on the encoded side; adaptive execution splits its rows on the other.
    """
    placed, encoded = _pieces_of(documents, name, folder)
    joined = placed.join(encoded, "key").groupBy("doc_id", "tag").agg(
        F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("at", "piece_ids"))), lambda x: x["piece_ids"])).alias("ids")
    )
    blank = documents.where("text is null or text = ''").select("doc_id").distinct()
    return joined.select("doc_id", "ids").union(blank.select("doc_id", F.array().cast("array<int>").alias("ids")))


def count_tokens(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` of the documents that have a token, through the same pieces."""
    placed, encoded = _pieces_of(documents, name, folder)
    lengths = encoded.select("key", F.size("piece_ids").alias("n"))
    per_text = placed.distinct().join(lengths, "key").groupBy("doc_id", "tag").agg(F.sum("n").cast("int").alias("n_tokens"))
    return per_text.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
