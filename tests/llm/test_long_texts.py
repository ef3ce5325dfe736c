"""Training that sees one class only, and decoding of very long spans."""
import random
import time
from collections import Counter

import pytest

from tidebook.llm import quality, toxicity
from tidebook.llm.shared import fold


@pytest.fixture(scope="module")
def model():
    counts: Counter = Counter()
    for w in "you are an idiot stupid trash hello world hate people moron the of and good morning".split() * 50:
        w = f"^^{w}$"
        counts.update(w[i:i + 3] for i in range(len(w) - 2))
    return toxicity.CharModel(counts)


def test_held_out_labels_do_not_reach_a_score(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} and more of them") for i in range(200)], "doc_id long, text string")
    held = {r["doc_id"] for r in docs.where(fold(docs["doc_id"], quality.FOLDS) == quality.HELD_OUT).collect()}
    scores = []
    for held_label in (0, 1):
        labels = spark.createDataFrame([(i, held_label if i in held else 1) for i in range(200)], "doc_id long, quality int")
        scores.append(sorted((r["doc_id"], r["score"]) for r in quality.score(docs, quality.train(docs, labels)).collect()))
    assert scores[0] == scores[1]


def plain(span, model):
    """The path of `restored`, with whole texts and without settling anything."""
    best, before = {"^^": (0.0, "")}, ""
    for c in span.lower():
        best = toxicity._step(best, c, toxicity._boundary(c), c == before, model)
        before = c
    return max((s + (model.log(k, "$") if k != "^^" else 0.0), t) for k, (s, t) in best.items())[1]


def test_long_spans_are_decoded_as_a_whole(model):
    rng = random.Random(4)
    for _ in range(200):
        span = "".join(rng.choice(["1d10t", "s t u p 1 d", "h4te", "hello", "mmmoron", ".", " ", "_", "$", "0"]) for _ in range(rng.randint(1, 60)))
        assert toxicity.restored(span, model) == plain(span, model)


@pytest.mark.parametrize("shape", ["letters and a sign", "sign and letters", "numbers", "digits", "one letter"])
def test_time_grows_with_the_text(model, shape):
    rng = random.Random(1)
    body = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    make = {"letters and a sign": lambda n: body(n) + "$", "sign and letters": lambda n: "$" + body(n), "numbers": lambda n: "1 2 " * (n // 4),
            "digits": lambda n: "12345" * (n // 5), "one letter": lambda n: "a" * n}[shape]
    took = []
    for n in (50_000, 200_000):
        start = time.process_time()
        toxicity.Restorer(model)(make(n))
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 30
