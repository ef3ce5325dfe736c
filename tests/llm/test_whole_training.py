"""Models that learn labels use every labelled document outside their fold, however many there are."""
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import brown, quality, shared, toxicity
from tidebook.llm.shared import logistic, logistic_rows


def outside(n, parts, kept_out):
    return [i for i in range(n) if zlib.crc32(str(i).encode()) % parts != kept_out]


def test_every_labelled_document_is_a_training_document(spark):
    n = 12_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    found = shared.labelled(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT)
    assert sorted(r["doc_id"] for r in found.collect()) == outside(n, toxicity.FOLDS, toxicity.HELD_OUT)


def test_a_rare_insult_is_learned(spark):
    """Of 16,000 toxic documents a few hold a word of their own, too few to be sure to be among the thousands of a sample."""
    n = 32_000
    few = outside(n // 2, toxicity.FOLDS, toxicity.HELD_OUT)[::1200]
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(few), "what a zounderkite this is")
                                 .when(F.col("id") < n // 2, "you dreadful numbskull").otherwise("a calm and kind remark").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < n // 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    new = spark.createDataFrame([(10 ** 6, "some zounderkite again"), (10 ** 6 + 1, "some teapot again")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert score[10 ** 6] > score[10 ** 6 + 1]


def test_passes_over_rows_fit_the_curve_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    y = (x @ [1.5, -1.0] + 0.3 + rng.logistic(size=500) > 0).astype(int)
    rows = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(y, x)], "y int, a double, b double").repartition(7)
    assert np.allclose(logistic_rows(rows, lambda v: v), logistic(x, y), atol=1e-7)


@pytest.mark.parametrize("size", [8 << 20, 32 << 10])
def test_dictionaries_are_made_from_all_text(spark, monkeypatch, size):
    """The phrase of a class stands in every part of its text; groups of any size find it."""
    monkeypatch.setattr(quality, "GROUP_BYTES", size)
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    rows = [(y, i, 0, f"{''.join(rng.choice(letters, 300))} the {'good' if y else 'wicked'} phrase of this class stands here {''.join(rng.choice(letters, 300))}".encode())
            for y in (0, 1) for i in range(400)]
    made = quality.dictionaries(spark.createDataFrame(rows, "y int, doc_id long, at long, block binary").repartition(5))
    assert b"good phrase of this class" in made[1] and b"wicked phrase of this class" in made[0]
    again = quality.dictionaries(spark.createDataFrame(rows[::-1], "y int, doc_id long, at long, block binary").repartition(3))
    assert made == again


def test_only_pairs_with_a_word_outside_the_head_are_joined(spark, monkeypatch):
    """The classes around each word, counted in blocks and through the join, add up to the steps of all neighbouring classes."""
    monkeypatch.setattr(brown, "_KEEP", 5000)
    monkeypatch.setattr(brown, "_BLOCK", 16)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 80)) for _ in range(300)] + ["", "w1"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    table = brown.word_counts(docs).where("g >= 0").toPandas().sort_values("c", ascending=False)
    top, far = table.head(40), table.iloc[40:120]
    order = np.argsort(top["h"].to_numpy())
    units = brown.Units(top["h"].to_numpy()[order], order.astype(np.int32))
    classes = np.concatenate([np.arange(40) % 7, brown.CLASSES + np.arange(brown.ENDINGS + 1)]).astype(np.uint8)
    tail = spark.createDataFrame([(int(h), i % 5 + 10) for i, h in enumerate(far["h"])], "h long, k int")
    flags = shared.bit_filter(tail, "h", brown._BITS)
    known = spark.sparkContext.broadcast((units, flags))
    how = brown.Profiles(40, units.end, 3)
    pairs = how.pairs(docs, known)
    assert pairs.count() == 2 * far["c"].sum()
    steps = brown.class_steps(how.merged(how.of_texts(docs, known, classes).unionAll(how.of_pairs(pairs, tail))), how, classes)

    of = {int(h): int(classes[i]) for i, h in enumerate(top["h"])} | {r["h"]: r["k"] for r in tail.collect()}
    of = {h: of.get(int(h), brown.CLASSES + int(g)) for h, g in zip(table["h"], table["g"])}
    want, end = Counter(), brown.CLASSES + brown.ENDINGS
    for t in texts:
        words = t.encode()
        buf = np.frombuffer(words, dtype=np.uint8)
        cls = [end, *[of[int(h)] for h in shared.signed(shared.Words(buf, np.array([0, len(buf)]), shared.NOT_SPACE).hash)], end]
        want.update(zip(cls[:-1], cls[1:]))
    assert {(int(a), int(b)): int(steps[a, b]) for a, b in zip(*np.nonzero(steps))} == dict(want)


@pytest.mark.parametrize("keep", [5000, 40])
def test_counted_neighbours_are_those_of_the_texts(spark, monkeypatch, keep):
    """Words side by side are counted once; any classes then give the profiles that a pass over the texts gives."""
    monkeypatch.setattr(brown, "_KEEP", keep)
    monkeypatch.setattr(brown, "_BLOCK", 16)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 80)) for _ in range(200)] + ["", "w1", "w399 w398 w399"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    table = brown.word_counts(docs).where("g >= 0").toPandas().sort_values("c", ascending=False)
    top, far = table.head(40), table.iloc[40:120]
    order = np.argsort(top["h"].to_numpy())
    units = brown.Units(top["h"].to_numpy()[order], order.astype(np.int32))
    flags = shared.bit_filter(spark.createDataFrame([(int(h),) for h in table["h"].iloc[40:130]], "h long"), "h", brown._BITS)  # ten pass it wrongly
    known = spark.sparkContext.broadcast((units, flags))
    how = brown.Profiles(40, units.end, 3)
    counts = how.neighbours(docs, known).cache()
    assert counts.where(F.col("block") >= how.near_blocks).count() == 3
    for turn in range(2):
        classes = np.concatenate([np.arange(40) % (7 + turn), brown.CLASSES + np.arange(brown.ENDINGS + 1)]).astype(np.uint8)
        tail = spark.createDataFrame([(int(h), i % 5 + 10 + turn) for i, h in enumerate(far["h"])], "h long, k int")

        def of(rows):
            found = {}
            for r in how.merged(rows).collect():
                (w, placed, own), (word, side, g, n) = how.words(r["block"], r["data"], classes)
                found |= {int(x): (bool(p), int(o), Counter()) for x, p, o in zip(w, placed, own)}
                for i, s, c, k in zip(word, side, g, n):
                    found[int(w[i])][2][int(s), int(c)] += int(k)
            return found

        counted = of(how.of_near(counts, classes).unionAll(how.of_far(counts.where(F.col("block") >= how.near_blocks), tail, classes)))
        assert len(counted) > 120 and counted == of(how.of_texts(docs, known, classes).unionAll(how.of_pairs(how.pairs(docs, known), tail)))
