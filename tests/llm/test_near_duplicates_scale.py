"""What the near-duplicate search writes and shuffles on many records."""

import itertools
import time

import numpy as np

from lexiloom.core import links, storage
from lexiloom.llm import near_duplicates


def templates(n):
    """Texts of 60 common words and 60 of their own: alike by a third, as all texts of one kind."""
    common = [f"common{k}" for k in range(60)]
    return [(i, " ".join([*common, *(f"own{i}x{k}" for k in range(60))])) for i in range(n)]


def test_pairs_that_share_only_common_words_are_never_written(spark, monkeypatch):
    rows = templates(400)
    rows.append((1000, rows[0][1].replace("common1 ", "changed ")))
    written = []

    def counted(df, label, *args, **kw):
        done = storage.materialize(df, label, *args, **kw)
        written.append((label, done.count()))
        return done

    monkeypatch.setattr(links, "materialize", counted)
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "id", ("t",)).collect()} == {(0, 1000)}
    # of 80,000 pairs with a similarity of a third some 600 meet in a band; only the true pair is written, once a band at most
    assert 0 < sum(n for label, n in written if label == "pairs") <= len(near_duplicates.BANDS)


def test_pairs_of_copies_are_not_shuffled_once_made(spark):
    words = [" ".join(f"w{g}x{k}" for k in range(90)) for g in range(3)]
    copies = [(100 * g + k, words[g]) for g in range(3) for k in range(30)]
    df = spark.createDataFrame(copies, "id long, t string").repartition(3)
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(copies, 2) if x == y}
    out = near_duplicates.near_duplicate_pairs(df, "id", ("t",))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "keys=[id_a" not in out._jdf.queryExecution().executedPlan().toString()


def test_an_id_of_several_texts_is_in_each_pair_once(spark):
    words = [" ".join(f"w{g}x{k}" for k in range(90)) for g in range(2)]
    rows = [(1, words[0]), (1, words[1]), (2, words[0]), (2, words[1]), (3, words[0]), (4, words[1]), (5, words[1]), (5, words[1].replace("w1x3 ", "changed "))]
    out = near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", ("t",))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (4, 5)]


def test_large_keys_choose_by_the_same_condition(spark, monkeypatch):
    rows = templates(60)
    rows += [(1000 + i, t.replace("common1 ", "changed ")) for i, t in rows[:5]]
    df = spark.createDataFrame(rows, "id long, t string").repartition(2)
    monkeypatch.setattr(near_duplicates, "BLOCK", 1)
    got = sorted(tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "id", ("t",)).collect())
    assert got == [(i, 1000 + i) for i in range(5)]


def test_bands_in_parts_are_those_of_the_whole():
    own = [np.unique(np.random.default_rng(k).integers(0, 2**32, 100, dtype=np.uint32)) for k in range(5)]
    whole = near_duplicates.band_keys(near_duplicates.minima(own))
    parts = np.array_split(np.arange(len(near_duplicates.BANDS)), near_duplicates.PASSES)
    made = [near_duplicates.band_keys(near_duplicates.minima(own, np.unique(near_duplicates.BANDS[p])), p) for p in parts]
    assert (np.concatenate(made, axis=1) == whole).all()


def test_shuffle_files_go_with_the_write(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    storage.materialize(spark.range(1000).repartition(7), "gone", drop_shuffles=True)
    for _ in range(50):
        if files.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert files.getAllFiles().size() <= before
