"""The filter audit, level packing and phrase mining against brute force."""
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidebook.llm import filter_audit, level_packing, packing, phrases
from tidebook.llm.level_packing import Levels
from tidebook.llm.tokens import Ids, cuts, lowered

COLUMNS = "doc_id long, text string, source string, lang string, n long, mask int, id long, part string, h long, words string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, g, 0, 1, 2, "x", 3, "y") for i, t, s, g in rows], COLUMNS)


def odd_texts():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [None, "", " \n\t ", long, "A b. c, d", "ÄÖ naïve  café 日本 \x85 a   b\n\n c ", "a" * 5000, "Up UP up $", "the end. " * 30]


# -- filter audit

def failed(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {k for k, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                             ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text)))) if bad}


def audited(rows, labels):
    """Every figure straight from its definition."""
    docs = []
    for i, text, source, _ in rows:
        fails = failed(text)
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _, _ in rows):
            fails |= {"E"}
        marks = [x for x in labels if x[0] == i and i is not None]
        docs.append((source or "", fails, any(q == 1 for _, q, _ in marks), any(t == 1 for _, _, t in marks)))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shares = [d for d in docs if d[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                lost = [d for d in left if k in d[1]]
                gone = [d for d in mine if k in d[1] and d[1] & set(order[:step - 1])]
                left = [d for d in left if k not in d[1]]
                shares[k] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), len(gone), sum(d[1] == {k} for d in mine), sum(d[2] for d in lost), sum(d[3] for d in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(frame):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
            for r in frame.collect()}


def case(seed):
    rng = random.Random(seed)
    body = [*odd_texts()[:3], "Caps A", "many words " * 150, " ".join(f"v{i}" for i in range(250)), "price $5 " + " ".join(f"v{i}" for i in range(250)), "NO"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(body), rng.choice([None, "", "a", "b"]), "en") for _ in range(120)]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [None, *range(30), 3, 4]]
    return rows, labels


@pytest.mark.parametrize("files,batches", [(1, 1), (6, 3)])
def test_audit_equals_its_definition(spark, tmp_path, files, batches):
    rows, labels = case(files)
    path = str(tmp_path / "documents.parquet")
    rest = sorted(rows, key=lambda r: -(r[0] or 0))  # larger ids come first, so most copies are retracted later
    for k in range(files):
        table(spark, rest[k::files]).coalesce(1).write.mode("append").parquet(path)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert collected(filter_audit.audit(spark, path, marks, texts_per_slot=3, batches=batches)) == audited(rows, labels)


def test_audit_goes_on_from_its_state(spark, tmp_path):
    rows, labels = case(9)
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for k in range(2):
        table(spark, rows[k::2]).coalesce(1).write.mode("append").parquet(path)
        counted = filter_audit.counters(filter_audit.documents_stream(spark, path), marks, 7, folder)
    assert collected(filter_audit.interactions(counted)) == audited(rows, labels)


def test_audit_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    table(spark, []).write.parquet(path)
    assert filter_audit.audit(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# -- level packing

def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


def test_pieces_are_the_documents(spark):
    rows = [(i, t, "s", "en") for i, t in enumerate(odd_texts())] + [(None, "no id", "s", "en"), (4, "again", "s", "en"), (4, "again", "s", "en")]
    out = level_packing.pack_levels(table(spark, rows).repartition(3), vocabulary(), capacity=256, most=3).collect()
    t, wanted = tokenizer(), Counter()
    for i, text, *_ in rows:
        wanted[i, tuple(t.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    sequences, by_doc = {}, {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        total = sum(n for _, n in places)
        assert total <= 256 and total & (total - 1) == 0  # full or a power of two: nothing is padded
    assert sum(len(v) for v in sequences.values()) == len(out)
    for (i, ids), times in wanted.items():
        pieces = sorted(by_doc.pop((i, len(ids))) if times == 1 else by_doc[i, len(ids)])
        for start, n, crc in pieces:
            assert crc == zlib.crc32(np.array(ids[start:start + n], dtype="<u4").tobytes())
        assert sum(n for _, n, _ in pieces) == times * len(ids)
        assert Counter(s for s, _, _ in pieces)[0] == times


def test_every_item_goes_where_the_squares_grow_least():
    rng, levels, counts = random.Random(1), Levels(64, 10_000), Counter()
    for _ in range(4000):
        s = rng.randint(1, 63)
        def grown(h):
            after = Counter(counts)
            if h:
                after[h] -= 1
            if h + s < 64:
                after[h + s] += 1
            return sum(n * n for n in after.values())
        best = min(grown(h) for h in range(0, 64 - s + 1) if h == 0 or counts[h])
        wanted = max(h for h in range(0, 64 - s + 1) if (h == 0 or counts[h]) and grown(h) == best)
        assert levels.level(s) == wanted
        list(levels.place((0, 0, np.zeros(s, dtype="<u4"), s)))
        counts[wanted] -= wanted > 0
        counts[wanted + s] += wanted + s < 64
    assert {h: n for h, n in enumerate(levels.count.tolist()) if n} == {h: n for h, n in counts.items() if n}


def test_few_windows_stay_open_when_nothing_fits():
    levels, full = Levels(64, 5), []
    for k in range(500):
        full += list(levels.place((k, 0, np.full(40, k, dtype="<u4"), 40)))
        assert levels.n_open <= 5
    full += list(levels.close())
    sizes = Counter(sum(len(p[2]) for p in w) for w in full)
    assert sizes[64] == 500 * 40 // 64 and sum(n * c for n, c in sizes.items()) == 20_000


def encoders():
    import public_tokenizers
    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {"words": (vocabulary(), level_packing.word_encoder(vocabulary()), lowered), "bytes": (names[0], packing.byte_encoder(*names), lambda b: b),
            "bytes, exact reader": (names[0], packing.byte_encoder(names[0], None), lambda b: b)}


@pytest.mark.parametrize("name", ["words", "bytes", "bytes, exact reader"])
def test_gathered_ids_are_the_tokenizers(name):
    from tokenizers import Tokenizer
    path, encode, prepared = encoders()[name]
    rng, t = random.Random(5), Tokenizer.from_file(path)
    t.encode_special_tokens = True
    alphabet = list("abzABZ019 '.,;-\n\t\"") + [" ", "  ", "é", "É", "ß", "×", "÷", "İ", "日", "\x85", "\xa0", "\u2003", "\u0301", "H\u0331", "🙂", "'s", "'LL", "<|endoftext|>",
                                                  "\x01", "ﬁ", "Σ", "\x1c", "\u3000", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(1, 0xD7FF), 32, 97])) for _ in range(40)) for _ in range(300)]
    ids = Ids(encode, 2)
    for at in range(0, len(texts), 300):
        some = [x.encode() for x in texts[at:at + 300]]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])])
        flat, first = ids.of(prepared(np.frombuffer(b"".join(some), dtype=np.uint8)), offsets)
        for d, x in enumerate(some):
            assert flat[first[d]:first[d + 1]].tolist() == t.encode(x.decode(), add_special_tokens=False).ids + [2], x


def test_cuts_stand_between_known_characters():
    text = "a b, c  d \u00a0 e \u00e9. \u2003x it's"
    found = [len(text.encode()[:k].decode()) for k in np.flatnonzero(cuts(np.frombuffer(text.encode(), dtype=np.uint8)))]
    assert [text[k:k + 2] for k in found] == [" b", ", ", " c", " \u00e9", ". ", " i"]


# -- phrases

def mined(rows, least, top, inside):
    """Counts, scores and drops straight from the definition."""
    words, grams = Counter(), Counter()
    for _, text, _, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    grams[lang, tuple(w[i:i + k])] += 1
    found = {g: a for g, a in grams.items() if len(g[1]) > 1 and a >= least}
    rows = []
    for (lang, g), a in found.items():
        if any(len(o) > len(g) and p == lang and 100 * n >= inside * a and any(o[i:i + len(g)] == g for i in range(len(o) - len(g) + 1)) for (p, o), n in found.items()):
            continue
        cut = min((1000000 * a * a // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g)))
        rows.append((lang, -cut[0], -a, " ".join(g).encode(), grams[lang, g[:cut[1]]], grams[lang, g[cut[1]:]]))
    out = []
    for lang in {r[0] for r in rows}:
        out += [(lang, k, r[3].decode(), -r[2], r[4], r[5], words[lang], -r[1]) for k, r in enumerate(sorted(r for r in rows if r[0] == lang)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "New", "york", "é", "日本", "x" * 200, "the"]
    texts = [rng.choice(["", ".", "\n", " "]).join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(6)) for _ in range(60)]
    texts += ["new york city. " * 9, "\tNEW  york\tcity", *odd_texts()]
    return [(i, t, "s", rng.choice(["en", "de", None, "und", ""])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("shard_words", [1, 200, 1 << 21])
def test_phrases_equal_their_definition(spark, shard_words):
    rows = phrase_rows()
    got = phrases.collocations(table(spark, rows).repartition(3), least=4, top=40, inside=50, shard_words=shard_words)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == mined(rows, 4, 40, 50)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(1, None, "s", None)])).count() == 0


def test_row_groups_of_the_indexes_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(phrases, "GROUP", 1 << 16, raising=False)
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.randint(0, 9999)) for _ in range(220_000)), "s", "en") for i in range(5)]  # a megabyte each
    phrases.counted(table(spark, rows).coalesce(1), str(tmp_path), shard_words=4000)
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "index").glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 5
    assert max(f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) == 1


def test_scores_beyond_64_bits_are_exact(spark):
    a, l, r = 9_000_000_000_001, 9_000_000_000_007, 9_000_000_000_011
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row["s"] == 1000000 * a * a // (l * r)


def test_index_counts_every_phrase():
    rng = np.random.default_rng(2)
    text = np.where(rng.random(5000) < 0.1, 0, rng.integers(1, 6, 5000))
    text[-1] = 0
    index = phrases.Index.of(text, 6)
    first, second, n = index.pairs()
    before, rest, begin, count = index.triples(first, second, n)
    wanted2 = Counter(zip(text.tolist(), np.roll(text, -1).tolist()))
    wanted3 = Counter(zip(text.tolist(), np.roll(text, -1).tolist(), np.roll(text, -2).tolist()))
    assert dict(zip(zip(first.tolist(), second.tolist()), n.tolist())) == dict(wanted2)
    assert dict(zip(zip(before.tolist(), first[rest].tolist(), second[rest].tolist()), count.tolist())) == dict(wanted3)
    assert (first[begin] == before).all() and (second[begin] == first[rest]).all()


def test_phrases_are_summed_in_rounds(spark, monkeypatch, tmp_path):
    """Each pair and triple is summed in one round, which shuffles a part of them only; what it was made from can be deleted before the next."""
    rounds, over = [], phrases._over
    monkeypatch.setattr(phrases, "_over", lambda *a: rounds.append(over(*a)) or rounds[-1])
    rng = random.Random(7)
    rows = [(i, " ".join(str(rng.randint(0, 60)) for _ in range(400)), "s", "en") for i in range(40)]
    _, two, three, _ = phrases.counted(table(spark, rows).repartition(3), str(tmp_path), least=2, shard_words=2000)
    want = [Counter(tuple(w[i:i + k]) for _, t, _, _ in rows for w in [t.split()] for i in range(len(w) - k + 1)) for k in (2, 3)]
    sizes = {2: [], 3: []}
    for made in rounds:
        sizes[len(made.columns) - 1].append(made.agg(F.sum("n")).first()[0])
    for k, found in ((2, two), (3, three)):
        assert sorted(r["n"] for r in found.collect()) == sorted(n for n in want[k - 2].values() if n > 1)
        assert max(sizes[k]) < 0.4 * sum(sizes[k])
    assert sum(sizes[2]) == sum(want[0].values())
