"""What Python workers keep from task to task stays small, however many words they meet."""
import numpy as np
import public_tokenizers
import pyarrow as pa

from tidebook.llm import level_packing, packing, tokens
from tidebook.llm.queries import vocabulary
from tidebook.llm.shared import text_bytes


def test_kept_parts_are_bounded():
    """600,000 different words, one id each, in slices of 20,000: few ids, but too many words to keep them all."""
    ids = tokens.Ids(lambda parts: [np.array([int(p) + 10], dtype="<u4") for p in parts], 2)
    for at in range(0, 600_000, 20_000):
        numbers = range(at, at + 20_000)
        found, first = ids.of(*text_bytes(pa.array([" ".join(map(str, numbers))])))
        assert found.tolist() == [n + 10 for n in numbers] + [2] and first.tolist() == [0, 20_001]
        assert len(ids._slots) <= 220_000 and len(ids._pool) <= 1 << 20


def test_parts_met_in_every_slice_are_tokenized_once():
    """Rare words come and go, by far more than are kept; the common ones among them stay."""
    met = []
    ids = tokens.Ids(lambda parts: [np.array([met.append(p) or int(p)], dtype="<u4") for p in parts], 2)
    common = range(10_000_000, 10_005_000)
    for at in range(0, 600_000, 20_000):
        numbers = [*common, *range(at, at + 20_000)]
        found, _ = ids.of(*text_bytes(pa.array([" ".join(map(str, numbers))])))
        assert found.tolist() == [*numbers, 2]
    assert sum(int(p) >= 10_000_000 for p in met) <= 5_000 + 1  # the first of a text has no space before it


def test_long_parts_are_not_kept_beyond_their_bound():
    """Few parts with one id each, but a megabyte long."""
    ids = tokens.Ids(lambda parts: [np.array([len(p)], dtype="<u4") for p in parts], 2)
    for n in range(1 << 20, (1 << 20) + 40):
        assert ids.of(*text_bytes(pa.array(["x" * n, None, ""])))[0].tolist() == [n, 2, 2, 2]
    assert len(ids._texts.data) <= 4 * tokens.TEXT


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_hashes", lambda data, starts, sizes: np.full(len(sizes), 7, dtype=np.uint64))
    ids = tokens.Ids(lambda parts: [np.array([int(p), 1], dtype="<u4") for p in parts], 2)
    for numbers in ([3, 4, 55], [55, 3, 4], [9, 3, 66]):
        assert ids.of(*text_bytes(pa.array([" ".join(map(str, numbers))])))[0].tolist() == [x for n in numbers for x in (n, 1)] + [2]


def test_packing_takes_small_batches(spark):
    docs, name = spark.createDataFrame([(1, "a text")], "doc_id long, text string"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    for pack in (lambda: packing.pack(docs, *vocabulary()), lambda: level_packing.pack_levels(docs, public_tokenizers.path("word_bpe_49k.json"))):
        spark.conf.set(name, "10000")
        assert pack().count() and spark.conf.get(name) == "2000"
