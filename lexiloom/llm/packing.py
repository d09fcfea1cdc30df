"""Problem 7: filling containers of fixed capacity with texts sized in tokens.

Method: hierarchical residual packing.  The items of one language are dealt by
a hash into groups of at most about ``group_items``; each group is packed by
best fit, largest items first.  Bins filled to ``near_full`` or more are
emitted.  The underfull bins are items of the next round, in fewer groups (a
tree of fan-in ``FAN_IN``), until one group is left or a round no longer saves
bins; then everything is emitted.

A group never exceeds its bound however the languages are distributed, and a
bin carries at most ``capacity`` members, so tasks stay bounded.

Defined results: documents without tokens are in no container; an item larger
than the capacity is split into full containers and one remainder, which is
packed like any other item; a null language is ``und``; a language without a
limit of its own has the limit of ``und``, in containers of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexiloom.core.storage import materialize

FAN_IN = 8
_MEMBERS = "array<struct<doc_id:bigint,part:int,size:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: lists of item positions, one list for each bin.

    Open bins are kept by their residual; the tightest that fits is the lowest
    set bit of a mask of residuals, so an item costs about constant time.
    """
    bins: list[list[int]] = []
    by_residual: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        s = sizes[i]
        above = mask >> s
        if above:
            residual = s + (above & -above).bit_length() - 1
            own = by_residual[residual]
            b = own.pop()
            if not own:
                mask &= ~(1 << residual)
        else:
            residual, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = residual - s
        if left > 0:
            by_residual.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def _pack_group(round_no: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lang, capacity, group = frame["lang"].iat[0], int(frame["capacity"].iat[0]), int(frame["grp"].iat[0])
        frame = frame.sort_values(["size", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes, members = frame["size"].tolist(), frame["members"].tolist()
        rows = []
        for k, own in enumerate(best_fit(sizes, capacity)):
            inside = [m for i in own for m in members[i]]
            rows.append((lang, capacity, f"{lang}-{round_no}-{group}-{k}", sum(sizes[i] for i in own), inside))
        return pd.DataFrame(rows, columns=["lang", "capacity", "item", "size", "members"])

    return pack


def pack(
    sized: DataFrame, limits: DataFrame, group_items: int = 40_000, near_full: float = 0.985, max_rounds: int = 12
) -> DataFrame:
    """Containers of ``sized(doc_id, lang, n_tokens)`` under ``limits(lang, capacity)``.

    Returns one row for each document part: ``(doc_id, part, lang,
    container_id, start_token, n_tokens)``.
    """
    default = limits.where("lang = 'und'").agg(F.max("capacity").alias("other"))
    labelled = sized.where("n_tokens > 0").withColumn("lang", F.coalesce("lang", F.lit("und")))
    capped = (
        labelled.join(F.broadcast(limits.groupBy("lang").agg(F.max("capacity").alias("own"))), "lang", "left")
        .crossJoin(F.broadcast(default))  # one row: the limit for unlisted languages
        .select("doc_id", "lang", "n_tokens", F.coalesce("own", "other").alias("capacity"))
    )
    items = materialize(
        capped.select("doc_id", "lang", "capacity", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"))).alias("part"), "n_tokens")
        .withColumn("size", F.least("capacity", F.col("n_tokens") - F.col("part") * F.col("capacity")).cast("int"))
        .drop("n_tokens"),
        "items",
    )
    whole = items.where("size = capacity").select(
        "doc_id", "part", "lang", F.concat_ws("-", "lang", F.lit("whole"), "doc_id", "part").alias("container_id"), "size", "capacity"
    )
    current = items.where("size < capacity").select(
        "lang", "capacity", F.concat_ws("-", "doc_id", "part").alias("item"), "size",
        F.array(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "part", "size")).alias("members"),
    )
    done: list[DataFrame] = []
    schema = f"lang string, capacity int, item string, size int, members {_MEMBERS}"
    previous: dict[str, tuple[int, int]] = {}
    for round_no in range(max_rounds):
        counts = {r["lang"]: r["n"] for r in current.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
        groups = {}
        for lang, n in counts.items():
            before = previous.get(lang)
            wanted = -(-n // group_items)
            groups[lang] = wanted if before is None else max(wanted, -(-before[0] // FAN_IN), 1)
        # a language is finished when it was packed as one group, or merging no longer helps
        active = [g for g in counts if previous.get(g) is None or (previous[g][0] > 1 and counts[g] < 0.98 * previous[g][1])]
        if not active:
            break
        deal = F.create_map(*[x for g in active for x in (F.lit(g), F.lit(groups[g]))])
        rest = current.where(~F.col("lang").isin(active))
        packed = materialize(
            current.where(F.col("lang").isin(active))
            .withColumn("grp", F.pmod(F.xxhash64("item", F.lit(round_no)), deal[F.col("lang")]).cast("int"))
            .groupBy("lang", "grp").applyInPandas(_pack_group(round_no), schema),
            "bins",
        )
        done += [packed.where(F.col("size") >= near_full * F.col("capacity")), rest]
        current = packed.where(F.col("size") < near_full * F.col("capacity"))
        previous = {g: (groups[g], counts[g]) for g in active}
    bins = current
    for d in done:
        bins = bins.unionByName(d)
    loose = bins.select("lang", "capacity", F.col("item").alias("container_id"), F.explode("members").alias("m")).select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.part").alias("part"), "lang", "container_id", F.col("m.size").alias("size"), "capacity"
    )
    return loose.unionByName(whole).select(
        "doc_id", "part", "lang", "container_id", (F.col("part") * F.col("capacity")).cast("int").alias("start_token"), F.col("size").alias("n_tokens")
    )


def fill_report(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per language: containers, tokens, share of room used, least possible containers."""
    default = limits.where("lang = 'und'").agg(F.max("capacity").alias("other"))
    return (
        placed.groupBy("lang").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
        .join(F.broadcast(limits), "lang", "left").crossJoin(F.broadcast(default))
        .select("lang", "containers", "tokens", F.coalesce("capacity", "other").alias("capacity"))
        .withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
    )
